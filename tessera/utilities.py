"""Seeds and logging of command-line runs.  No operator draws random numbers: their constants are fixed or hashed."""

from __future__ import annotations

import logging
import random

import numpy as np

SEED = 42


def seed_all(seed: int = SEED) -> None:
    random.seed(seed)
    np.random.seed(seed)


def logger(name: str) -> logging.Logger:
    """A logger that writes time, level, name and message; handlers set up before stay."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)s | %(name)s | %(message)s")
    return logging.getLogger(name)
