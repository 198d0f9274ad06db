"""Pre-tokens of texts, found once for each distinct stretch between single spaces, and packed byte strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# --- fixed values: white space, as any dialect has it; the pattern of pre-tokens that the shortcuts hold for ---
_WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values ---
_BREAK = f"{_WS} | {_WS}"
_MARKS = ".,;:!?"
#: The least lead byte of characters from U+0240 on; those before it are of the same kind in all versions of Unicode.
_FOREIGN = 0xC9


def bounds(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings begin and end in their bytes, and the bytes."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    data = strings.buffers()[2] if len(strings) else None
    return offsets.astype(np.int64) - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def _stretches(docs: pa.Array, find) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts one after another, and how many each text has. A line feed marks one that follows no space."""
    whole = pa.compute.match_substring_regex(docs, _BREAK).to_numpy(zero_copy_only=False)
    marked = pa.compute.binary_join_element_wise("\n", docs, "")
    parts = pa.compute.split_pattern(marked.filter(pa.array(~whole)), " ")
    count = np.zeros(len(docs), np.int64)
    count[~whole] = pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False)
    flat = parts.flatten()
    if not whole.any():
        return flat, count
    odd = [["\n" + p for p in find(t)] for t in docs.filter(pa.array(whole)).to_pylist()]
    count[whole] = [len(x) for x in odd]
    flat = pa.concat_arrays([flat, pa.array([x for y in odd for x in y], pa.string())])
    # back into the order of the texts
    order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
    first = np.zeros(len(docs), np.int64)
    first[order] = np.cumsum(count[order]) - count[order]
    ends = np.cumsum(count)
    return flat.take(pa.array(np.repeat(first - (ends - count), count) + np.arange(ends[-1]))), count


def piece_codes(docs: list[str] | pa.Array, pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the number of its pre-token for each place, and where each document begins."""
    distinct, codes, starts = coded_pieces(docs, pattern)
    return distinct.cast(pa.binary()).to_pylist(), codes, starts


def coded_pieces(docs: list[str] | pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As piece_codes, with the distinct pre-tokens in an Arrow array of strings.

    Under SPACED a single space between characters that are not white space always begins a pre-token, so the stretches
    between such spaces can be split on their own, each distinct one once. A text with other white space next to a space is
    split as a whole, as every text is under any other pattern."""
    import regex

    find = regex.compile(pattern).findall
    docs = docs if isinstance(docs, pa.Array) else pa.array(docs, pa.string())
    docs = pa.compute.fill_null(docs if pa.types.is_string(docs.type) else docs.cast(pa.string()), "")
    if pattern != SPACED:
        if regex.compile(pattern).groups:
            find = lambda t: [m.group() for m in regex.finditer(pattern, t)]
        found = [[p for p in find(t) if p] for t in docs.to_pylist()]
        own = pa.array([p for x in found for p in x], pa.string()).dictionary_encode()
        return own.dictionary, own.indices.to_numpy(zero_copy_only=False), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
    flat, sizes = _stretches(docs, find)
    code = flat.dictionary_encode()
    del flat
    distinct, codes, first = _split(code.dictionary, find)
    at = code.indices.to_numpy(zero_copy_only=False)
    del code
    got, count = gathered(np.diff(first).astype(np.int32), codes, at)
    return distinct, got, np.append(0, np.cumsum(count, dtype=np.int64))[np.append(0, np.cumsum(sizes))]


def _split(stretches: pa.Array, find) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens; those of all stretches one after another, as numbers of them; and where each stretch's begin.

    Letters, alone or with one mark, need no pattern: they and the space before them are a pre-token, the mark is another."""
    n = len(stretches)
    offsets, data = bounds(stretches)
    word = pa.compute.ascii_rtrim(stretches, characters=_MARKS)
    marks = np.diff(offsets) - pa.compute.binary_length(word).to_numpy(zero_copy_only=False)
    highest = np.maximum.reduceat(np.append(data, np.uint8(0)), offsets[:-1]) if n else np.zeros(0, np.uint8)
    plain = pa.compute.utf8_is_alpha(word).to_numpy(zero_copy_only=False) & (marks <= 1) & (highest < _FOREIGN)
    found = [find(u[1:] if u[:1] == "\n" else " " + u) for u in stretches.filter(pa.array(~plain)).to_pylist()]
    count = np.where(plain, 1 + marks, 0)
    count[~plain] = [len(x) for x in found]
    first = np.append(0, np.cumsum(count))
    marked = np.flatnonzero(plain & (marks == 1))
    kinds, kind = np.unique(data[offsets[marked + 1] - 1], return_inverse=True)
    words = pa.compute.binary_join_element_wise("", word.filter(pa.array(plain)), " ")
    pool = pa.concat_arrays([words, pa.array([chr(k) for k in kinds], pa.string()), pa.array([p for x in found for p in x], pa.string())])
    place = np.empty(first[-1], np.int64)
    place[first[:-1][plain]] = np.arange(len(words))
    place[first[marked] + 1] = len(words) + kind
    rest = np.ones(len(place), bool)
    rest[first[:-1][plain]] = rest[first[marked] + 1] = False
    place[rest] = len(words) + len(kinds) + np.arange(int(rest.sum()))
    own = pool.dictionary_encode()
    return own.dictionary, own.indices.to_numpy(zero_copy_only=False)[place].astype(np.int32), first


def zipped(a: np.ndarray) -> bytes:
    """An integer array, its bytes by significance, compressed."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unzipped(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(data[8:], n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def packed(strings: list[bytes]) -> bytes:
    raw = b"".join(strings)
    lengths = zipped(np.fromiter(map(len, strings), np.uint32, len(strings)))
    return len(lengths).to_bytes(8, "little") + lengths + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> pa.Array:
    n = int.from_bytes(data[:8], "little")
    lengths = unzipped(data[8 : 8 + n], np.uint32)
    size = int.from_bytes(data[8 + n : 16 + n], "little")
    raw = pa.decompress(data[16 + n :], size, "zstd") if size else pa.py_buffer(b"")
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), raw])


def gathered(lengths: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values is cut into runs of lengths; the runs that codes names, one after another, and each one's length."""
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    count = lengths[codes]
    ends = np.cumsum(count, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    narrow = np.int32 if max(n, len(values)) < 1 << 31 else np.int64
    place = np.repeat((first[codes] - (ends - count)).astype(narrow), count)
    place += np.arange(n, dtype=narrow)
    return values[place], count
