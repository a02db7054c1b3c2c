import random
import re

import numpy as np

from tessera.llm import _text, license_scan as ls

rng = random.Random(2)
VOCAB = ["the", "of", "and", "license", "version", "thou", "erre", "ing", "le", "é"]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def plain(name):
    return ls.TEMPLATES[name].replace("{", "").replace("}", "")


def brute(text, least=ls.LEAST_COVERAGE):
    """(license, matched, first and last word) without fingerprints: every template against the whole text."""
    powers = _text.Powers()
    index = ls.Templates(ls.TEMPLATES)
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashes = _text.words(raw, np.array([0, len(raw)]), powers, ls.BETWEEN)[0]
    found = [(t, *m) for t, w in enumerate(index.words) for m in ls.accepted(w, index.runs[t], hashes, -len(w), len(hashes), least)]
    return [(index.names[t], matched) for t, matched, _, _ in ls.settled(found, [len(w) for w in index.words])]


def test_finds_every_template_whole_and_damaged(spark):
    rows, want = [], set()
    for i, name in enumerate(ls.TEMPLATES):
        words = plain(name).split()
        key = set(re.findall(r"\S+", " ".join(re.findall(r"\{([^}]*)\}", ls.TEMPLATES[name]))))
        hurt = [w for w in words if rng.random() > 0.08 or w.strip(".,;:") in key] if len(words) > 30 else words
        for k, body in enumerate((plain(name), plain(name).upper().replace(" ", "\n* "), " ".join(hurt))):
            rows.append((10 * i + k, f"{prose(rng.randint(0, 50))} ; {body} ; {prose(rng.randint(0, 50))}", 1.0, "x"))
            want.add((10 * i + k, name))
    clean = [(900, None, 1.0, ""), (901, "", 1.0, ""), (902, " ", 1.0, ""), (903, prose(4000), 1.0, ""), (904, "License", 1.0, "")]
    long = "x" + prose(400_000) + ". " + plain("mit-notice") + " " + prose(100_000)
    docs = spark.createDataFrame([*rows, *clean, (990, long, 1.0, ""), (None, "Released under the MIT License. " * 3, 0.0, "")], "doc_id long, text string, coverage double, license string")
    got = ls.scan_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in got if r.doc_id is not None and r.doc_id < 900} == want
    texts = {r[0]: r[1] for r in rows}
    for i, text in texts.items():
        assert [(r.license, r.matched) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)] == brute(text)
    for r in got:
        if r.doc_id in texts:
            inside = re.findall(r"[a-z0-9]+", texts[r.doc_id][r.start : r.end].lower())
            template = re.findall(r"[a-z0-9]+", plain(r.license).lower())
            assert inside[0] in template and inside[-1] in template and r.matched <= len(template) and 0.8 <= r.coverage <= 1
            if r.doc_id % 10 < 2:
                assert r.coverage == 1 and inside == template
    assert [(r.license, long[r.start : r.end]) for r in got if r.doc_id == 990] == [("mit-notice", "Released under the MIT License")]
    assert sorted(r.start for r in got if r.doc_id is None) == [0, 32, 64]
    assert not [r for r in got if r.doc_id is not None and 900 <= r.doc_id < 990]


def test_versions_and_variants_are_told_apart(spark):
    gpl = plain("gpl-3.0-header")
    cases = {
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0-notice"], "Licensed under CC BY 4.0.": ["cc-by-4.0-notice"], "Licensed under CC BY-SA 4.0.": ["cc-by-sa-4.0-notice"],
        "Licensed under CC BY-NC-SA 4.0": ["cc-by-nc-sa-4.0-notice"], "Licensed under CC BY 3.0.": [], "Licensed under CC BY-XX 4.0.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-notice"], "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0-notice"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [], "This work is licensed under the GNU General Public License, version 1.": [],
        gpl: ["gpl-3.0-header"], gpl.replace("version 3", "version 2"): ["gpl-2.0-header"], gpl.replace("General", "Affero General"): ["agpl-3.0-header"], gpl.replace("version 3", "version 4"): [],
        plain("bsd-2-clause"): ["bsd-2-clause"], plain("bsd-3-clause"): ["bsd-3-clause"], plain("bsd-3-clause") + " " + plain("bsd-2-clause"): ["bsd-3-clause", "bsd-2-clause"],
        plain("apache-2.0-header") + " and " + plain("mit"): ["apache-2.0-header", "mit"], (plain("mit") + " ") * 3: ["mit"] * 3, plain("mit")[:500]: [],
        "in no event shall the " * 3000 + plain("isc"): ["isc"],
    }
    texts = list(cases)
    got = ls.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        own = [r.license for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)]
        assert own == cases[text], text[:80]
        assert len(text) > 20_000 or [n for n, _ in brute(text)] == own


def test_alignment_against_plain_scores():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)).astype(np.uint64), r.integers(0, 4, r.integers(1, 20)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (ls.MATCH if a[i - 1] == b[j - 1] else ls.MISMATCH), best[i - 1, j] + ls.GAP, best[i, j - 1] + ls.GAP)
        matched, start, end, where = ls.align(a, b, -len(a), len(b))
        assert all(b[j] == a[i] for i, j in enumerate(where) if j >= 0)
        assert matched * ls.MATCH >= best.max() and (0 <= start <= end <= len(b)) and (matched > 0) == (best.max() > 0)


def test_winnowing_keeps_every_shared_run():
    powers = _text.Powers()
    r = np.random.default_rng(4)
    for _ in range(200):
        run = r.integers(0, 2**60, ls.GRAM + ls.WINDOW - 1).astype(np.uint64)
        sides = [np.concatenate((r.integers(0, 2**60, r.integers(0, 5)).astype(np.uint64), run, r.integers(0, 2**60, r.integers(0, 5)).astype(np.uint64))) for _ in range(2)]
        one, two = (set(ls.fingerprints(s, np.array([len(s)]), powers)[1].tolist()) for s in sides)
        assert one & two


def test_empty(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ls.scan_licenses(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), {}).count() == 0
