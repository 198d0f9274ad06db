"""Benchmark decontamination as a prefix-filtered set join.

The shingles of an item window are its word pairs (its word, if it has only one). They are ordered by how rare they are
in all documents; a document that holds the whole window holds its rarest shingle, so one prefix token is enough. A
document position with that token fixes where the window would begin: the length and position bounds drop what would
leave the document, and the window's words are then compared one after another. The benchmark is taken in blocks of
bounded size, each held against all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, coded_array, fresh, mapped, mixed, released, shared, texts, written
from .pieces import gathered

#: Bytes of benchmark text in one block, and candidates that are verified at once.
BLOCK_BYTES, CANDIDATES = 16 << 20, 1 << 20


def _distinct(flat: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """For each run of n numbers of flat, the place of the first run that equals it."""
    h = np.zeros(len(begin), np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + flat[begin + j].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if any((flat[begin[order[1:][same]] + j] != flat[begin[order[:-1][same]] + j]).any() for j in range(n)):  # a collision of hashes
        order = np.lexsort([flat[begin + j] for j in range(n)])
        same = np.ones(len(begin) - 1, bool)
        for j in range(n):
            same &= flat[begin[order[1:]] + j] == flat[begin[order[:-1]] + j]
    head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(begin)), 0))
    out = np.empty(len(begin), np.int64)
    out[order] = order[head]
    return out


class Index:
    """The windows of a block of items in flat arrays: the items' words as numbers one after another, each distinct window by
    where it first begins there, its items, and prefix tokens to windows. About 60 bytes for each word of the block."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        items = sorted(items)
        self.words, flat, starts = coded_array([alnum_words(text) for _, text in items])
        self.flat = flat.astype(np.int32)
        names = [name for (name, _), n in zip(items, np.diff(starts)) if n]
        self.names = sorted(set(names))
        number = {name: i for i, name in enumerate(self.names)}
        filled = np.flatnonzero(np.diff(starts))
        item = np.array([number[name] for name in names], np.int64)
        sizes = np.minimum(np.diff(starts)[filled], window)
        self.size = max(1, len(self.words))
        pair = self.flat[:-1].astype(np.int64) * self.size + self.flat[1:]
        inside = np.ones(len(pair), bool)
        inside[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(flat))] - 1] = False
        self.pairs = np.unique(pair[inside])
        self.windows: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            count = np.diff(starts)[filled[rows]] - n + 1
            of = np.repeat(np.arange(len(rows)), count)
            begin = starts[filled[rows]][of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
            first, which = np.unique(_distinct(self.flat, begin, n), return_inverse=True)
            owner = np.unique(which.astype(np.int64) * len(self.names) + item[rows[of]])
            self.windows[n] = begin[first]
            self.owners[n] = np.searchsorted(owner // len(self.names), np.arange(len(first) + 1)), (owner % len(self.names)).astype(np.int32)
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def order(self, count: np.ndarray) -> None:
        """Chooses each window's prefix token, given how often each pair of self.pairs occurs in the documents."""
        token = self.flat[:-1].astype(np.int64) * self.size + self.flat[1:]
        often = count[np.minimum(np.searchsorted(self.pairs, token), len(count) - 1)] if len(count) else count
        for n, begin in self.windows.items():
            off = np.zeros(len(begin), np.int32)
            key = self.flat[begin].astype(np.int64)
            if n > 1:
                least = np.full(len(begin), np.iinfo(np.int64).max)
                for j in range(n - 1):
                    rarer = often[begin + j] < least
                    least[rarer], off[rarer], key[rarer] = often[begin[rarer] + j], j, token[begin[rarer] + j]
            by = np.argsort(key, kind="stable").astype(np.int32)
            keys, first = np.unique(key[by], return_index=True)
            self.prefix[n] = (keys, np.append(first, len(by)), by, off)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        return pa.compute.fill_null(pa.compute.index_in(distinct, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _tokens(index: Index, batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number in the index (-1: none), where documents begin, and each position's pair (-1: none)."""
    distinct, codes, starts = coded_array([alnum_words(t) for t in texts(batch, text)])
    g = index.numbers(distinct)[codes] if len(codes) else np.zeros(0, np.int64)
    pair = np.full(len(g), -1, np.int64)
    if len(g) > 1:
        both = (g[:-1] >= 0) & (g[1:] >= 0)
        both[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(g))] - 1] = False
        pair[:-1][both] = g[:-1][both] * index.size + g[1:][both]
    return g, starts, pair


def _occurrences(index: Index, g: np.ndarray, starts: np.ndarray, pair: np.ndarray):
    """(length, first positions, windows) of all occurrences."""
    for n, w in index.windows.items():
        keys, first, by, off = index.prefix[n]
        if not len(keys):
            continue
        at = np.flatnonzero((pair if n > 1 else g) >= 0)
        token = (pair if n > 1 else g)[at]
        k = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
        hit = keys[k] == token
        at, k = at[hit], k[hit]
        each = first[k + 1] - first[k]
        ends = np.cumsum(each)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES)))
            m = each[lo:hi]
            pos = np.repeat(at[lo:hi], m)
            win = by[np.repeat(first[k[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            begin = pos - off[win]
            doc = np.searchsorted(starts, pos, side="right") - 1
            ok = (begin >= starts[doc]) & (begin + n <= starts[doc + 1])
            begin, win = begin[ok], win[ok]
            for j in range(n):
                same = g[begin + j] == index.flat[w[win] + j]
                begin, win = begin[same], win[same]
            if len(begin):
                yield n, begin, win
            lo = hi


def _counted(docs: DataFrame, index: Index, text: str) -> np.ndarray:
    """How often each pair of the index occurs in all documents."""
    known = shared(docs.sparkSession, index)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = known()
        pair = _tokens(index, batch, text)[2]
        pair = pair[pair >= 0]
        k = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
        n = np.bincount(k[index.pairs[k] == pair], minlength=1)
        at = np.flatnonzero(n)
        return pa.record_batch({"at": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})

    count = np.zeros(len(index.pairs), np.int64)
    if len(count):
        got = mapped(docs.select(text), one, "at long, n long", text).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        count[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return count


def _marked(docs: DataFrame, index: Index, text: str, others: list[str], out: list[str], add: bool) -> DataFrame:
    """The columns of others, and those named by out: the numbers of words and of hit words, hits (a bit for each word) and
    items. add: to the hits and items that docs has."""
    known = shared(docs.sparkSession, index)
    words, hit_words, hits_name, items_name = out
    hits, held = (hits_name, items_name) if add else (None, None)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = known()
        g, starts, pair = _tokens(index, batch, text)
        edge = np.zeros(len(g) + 1, np.int32)
        seen = [np.zeros(0, np.int64)]
        total = max(1, len(index.names))
        for n, begin, win in _occurrences(index, g, starts, pair):
            edge += np.bincount(begin, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(begin + n, minlength=len(edge)).astype(np.int32)
            doc = np.searchsorted(starts, begin, side="right") - 1
            both = np.unique(doc * len(index.windows[n]) + win)
            first, owner = index.owners[n]
            owners, count = gathered(np.diff(first), owner, both % len(index.windows[n]))
            seen.append(np.unique(np.repeat(both // len(index.windows[n]), count) * total + owners))
        hit = np.cumsum(edge[:-1]) > 0
        bits, items = [], [[] for _ in range(batch.num_rows)]
        for x in np.unique(np.concatenate(seen)).tolist():
            items[x // total].append(index.names[x % total])
        had = batch.column(hits).to_pylist() if hits else None
        old = batch.column(held).to_pylist() if hits else None
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            mine = np.packbits(hit[a:b])
            if hits:
                mine |= np.frombuffer(had[i], np.uint8)
                items[i] += old[i]
            bits.append(mine.tobytes())
        cols = {c: batch.column(c) for c in others}
        return pa.record_batch(cols | {words: pa.array(np.diff(starts), pa.int64()), hit_words: pa.array([int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in bits], pa.int64()), hits_name: pa.array(bits, pa.binary()), items_name: pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))})

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return mapped(docs, one, ", ".join([*fields, f"`{words}` long", f"`{hit_words}` long", f"`{hits_name}` binary", f"`{items_name}` array<string>"]), text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col or the columns of keep, n_words, n_hit, items): one row for each row of docs.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z in lower case. An item's windows are its runs of so many words,
    or all its words if it has fewer. n_hit counts the words inside any occurrence of a window, items holds the ids (as
    strings, sorted as such) of items with an occurring window. Columns of keep stay as they are, whatever their names; rows
    that repeat stay rows of their own. Null or wordless texts have no words. Benchmark rows with
    a null id, null text or no word match nothing; rows that repeat an item add to it."""
    others = keep or [id_col]
    out = [fresh(docs, n) for n in ("_n_words", "_n_hit", "_hits", "_items")]
    items = benchmark.select(F.col(item_col).cast("string").alias("_id"), F.col(item_text).alias("_text")).where("_id is not null and _text is not null")
    size = items.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    carried = list(dict.fromkeys([*others, text_col]))
    state = docs.select(*carried)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == b).toArrow()  # BLOCK_BYTES or so
        index = Index(list(zip(rows.column("_id").to_pylist(), rows.column("_text").cast(pa.binary()).to_pylist())), window)
        del rows
        released()
        index.order(_counted(docs, index, text_col))
        state, before = _marked(state, index, text_col, others if b == blocks - 1 else carried, out, b > 0), state
        if b < blocks - 1:
            state = written(state, "hits", before if b else None)
    return state.select(*others, F.col(out[0]).alias("n_words"), F.col(out[1]).alias("n_hit"), F.col(out[3]).alias("items"))
