"""Fetching a data set's archive over HTTP, on the driver: archives of interaction data are small."""

from __future__ import annotations

import os
import shutil
import tempfile
import urllib.request
import zipfile
from pathlib import Path


def fetch(url: str, folder: str, seconds: float = 60.0) -> list[str]:
    """The files of the zip archive at ``url``, unpacked into ``folder``; nothing is fetched if they are there.

    The archive is unpacked beside the folder and moved into place as a whole, so a broken download leaves nothing.
    Members that would lie outside the folder are an error.
    """
    place = Path(folder)
    if not place.is_dir():
        place.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=place.parent) as work:
            archive, out = os.path.join(work, "archive.zip"), Path(work, "out").resolve()
            with urllib.request.urlopen(url, timeout=seconds) as answer, open(archive, "wb") as f:
                shutil.copyfileobj(answer, f)
            with zipfile.ZipFile(archive) as z:
                for name in z.namelist():
                    if not (out / name).resolve().is_relative_to(out):
                        raise ValueError(f"{name!r} lies outside the archive's folder")
                z.extractall(out)
            os.replace(out, place)
    return sorted(str(p) for p in place.rglob("*") if p.is_file())
