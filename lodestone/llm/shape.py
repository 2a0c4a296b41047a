"""Character and word statistics of texts, computed with numpy over a whole batch."""

from __future__ import annotations

import numpy as np

from . import textcore

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_upper = np.zeros(256, np.int64)
_upper[65:91] = 1
_letter = np.zeros(256, np.int64)
_letter[[*range(65, 91), *range(97, 123)]] = 1
_digit = np.zeros(256, np.int64)
_digit[48:58] = 1
_symbol = np.zeros(256, np.int64)
_symbol[np.frombuffer(b"|%$&*#!<>{}[]\\^~=+_@/`", np.uint8)] = 1
_stop = np.zeros(256, np.int64)
_stop[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 1
_space = np.zeros(256, np.int64)
_space[[9, 10, 11, 12, 13, 32]] = 1

CLASSES = {"upper": _upper, "letter": _letter, "digit": _digit, "symbol": _symbol, "stop": _stop, "space": _space}


def ascii_words(column) -> tuple[textcore.Words, np.ndarray]:
    """Words and their hashes; only ASCII letters are lower-cased, so positions are those of the text itself."""
    w = textcore.split_words(column, lower=False)
    own = w.buf
    w.buf = LOWER[own]
    h = w.hashes()
    w.buf = own
    return w, h


def class_counts(buf: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Bytes of each class between consecutive edges."""
    out = {}
    total = np.zeros(len(buf) + 1, np.int64)
    for name, weight in CLASSES.items():
        np.cumsum(weight[buf], out=total[1:])
        out[name] = np.diff(total[edges])
    return out


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive edges."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def repeats(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """1 for each word that is the same as the word before it in its text."""
    r = np.zeros(len(hashes), np.int64)
    r[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    return r
