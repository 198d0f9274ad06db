"""Statistics of whole documents, slice by slice in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import coded, mixed, texts, words

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_TAIL = bytes(range(0x80, 0xC0))
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"
#: The statistics in the order of the matrix's columns.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_punct", "n_distinct", "n_chars", "n_marked", "n_wide")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated(codes: np.ndarray, starts: np.ndarray, width: int = 5) -> np.ndarray:
    """How many words of each document lie in windows of so many words that it holds twice or more."""
    n = np.diff(starts)
    count = np.maximum(n - width + 1, 0)
    total = int(count.sum())
    out = np.zeros(len(n), np.int64)
    if not total:
        return out
    owner = np.repeat(np.arange(len(n)), count)
    begin = np.arange(total) - (np.cumsum(count) - count)[owner] + starts[owner]
    h = mixed(owner.astype(np.uint64) + np.uint64(0x51))
    for j in range(width):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + codes[begin + j].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = begin[order[:-1][same]], begin[order[1:][same]]
    if any((codes[a + j] != codes[b + j]).any() for j in range(width)) or (owner[order[:-1][same]] != owner[order[1:][same]]).any():  # a collision of hashes
        _, h = np.unique(np.stack([owner, *(codes[begin + j] for j in range(width))]), axis=1, return_inverse=True)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(total, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int32)
    at = begin[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    inside = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    return inside[starts[1:]] - inside[starts[:-1]]


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def matrix(batch: pa.RecordBatch, text: str = "text") -> np.ndarray:
    """A row of NAMES for each text; null has none of anything."""
    docs = texts(batch, text)
    split = [words(t) for t in docs]
    _, codes, starts = coded(split)
    out = np.zeros((len(docs), len(NAMES)), np.int64)
    out[:, 0] = np.diff(starts)
    out[:, 4] = repeated(codes.astype(np.int64), starts)
    for i, t in enumerate(docs):
        chars = len(t) - _count(t, _TAIL)
        space = _count(t, _SPACE)
        out[i, 1] = chars - space
        out[i, 2] = _count(t, SYMBOLS)
        out[i, 3] = dup_lines(t) if b"\n" in t else 0
        out[i, 5:10] = (t.count(b"\n") + 1, _count(t, _UPPER), _count(t, _LOWER), _count(t, _DIGIT), _count(t, _PUNCT))
        out[i, 10] = len(set(split[i]))
        out[i, 11] = chars
        out[i, 12] = sum(w[-1] in SYMBOLS or w[-1] == 33 for w in split[i])
        out[i, 13] = sum(len(w) > 25 for w in split[i])
    return out


#: The features of the models, in order.
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "digit_share", "punct_share", "distinct_share", "marked_share", "wide_share")


def features(m: np.ndarray) -> np.ndarray:
    """FEATURES of rows of NAMES."""
    x = m.astype(np.float64)
    n, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
    return np.stack([np.log1p(x[:, 0]), x[:, 1] / n, x[:, 2] / chars, x[:, 3] / np.maximum(x[:, 5], 1), x[:, 4] / n, x[:, 0] / np.maximum(x[:, 5], 1), x[:, 6] / chars, x[:, 8] / chars, x[:, 9] / n, x[:, 10] / n, x[:, 12] / n, x[:, 13] / n], axis=1)
