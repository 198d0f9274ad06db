"""Byte-level BPE: a global shuffle of distinct pre-tokens, each encoded once, and decoding by the token-byte table."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, shared
from .lexicon import distinct_in, pack, put_together, words_of
from .pieces import bounds, gathered, piece_codes, unzipped, zipped

#: Bytes that a rank file may have, since it is broadcast; ids that are decoded at once.
RANKS_BYTES, IDS_AT_ONCE = 64 << 20, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        data = f.read(RANKS_BYTES + 1)
    if len(data) > RANKS_BYTES:
        raise ValueError(f"{path}: over {RANKS_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every row's whole text, without special tokens; null and empty texts have none.

    Pre-tokens are the matches of pattern. Rows that repeat an id stay rows of their own."""
    known = shared(docs.sparkSession, ranks)

    def split(part: pa.RecordBatch):
        return piece_codes(part.column(text_col), pattern)

    def one(table: pa.Table) -> pa.Table:
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known(), special_tokens={})
        distinct, rows = distinct_in(table)
        ids = [bpe._encode_single_piece(w) for w in distinct.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        back = [gathered(lengths, flat, codes) for codes in rows]
        released()
        return pa.table({"block": table.column("block"), "digest": table.column("digest"), "codes": table.column("codes"), "ids": pa.array([zipped(a) for a, _ in back], pa.binary()), "lengths": pa.array([zipped(b.astype(np.uint32)) for _, b in back], pa.binary())})

    def build(ids: list, sizes: np.ndarray, pos: np.ndarray, rows: pa.Table) -> pa.Table:
        codes = [unzipped(x, np.uint32) for x in rows.column("codes").to_pylist()]
        lengths = [unzipped(x, np.uint32) for x in rows.column("lengths").to_pylist()]
        values = [unzipped(x, np.uint32) for x in rows.column("ids").to_pylist()]
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        lengths = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
        values = np.concatenate(values) if values else np.zeros(0, np.uint32)
        where = np.zeros(len(codes), np.int64)
        where[codes] = np.arange(len(codes))
        flat, count = gathered(lengths, values, where[pos])
        at = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))]
        return pa.table({"id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))})

    blocks = pack(docs, split, id_col, text_col, buckets, keep=False)
    values = words_of(blocks).select("block", "digest", "bucket", "codes", "words").groupBy("bucket").applyInArrow(one, "block long, digest binary, codes binary, ids binary, lengths binary")
    return put_together(blocks, values, build, "id long, ids array<int>").withColumnRenamed("id", id_col)


def joined(strings: pa.Array, batch: pa.RecordBatch, ids_col: str) -> list[bytes]:
    """For each row, the strings of its ids one after another; ids out of range (or null) stand for nothing."""
    ids = batch.column(ids_col)
    counts = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = pa.compute.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(strings) - 1), flat, len(strings) - 1)  # the last string is empty
    got = strings.take(pa.array(flat))
    if isinstance(got, pa.ChunkedArray):
        got = got.combine_chunks()
    offsets, data = bounds(got)
    data, ends = data.tobytes(), offsets[np.append(0, np.cumsum(counts))].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col: the bytes that the ids stand for, joined from the token-byte table.

    Null ids, null lists and ids out of range stand for nothing; a column that is already named out_col is replaced."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 2)
    for token, i in ranks.items():
        tokens[i] = token
    known = shared(encoded.sparkSession, tokens)
    others = [f.name for f in encoded.schema.fields if f.name != out_col]

    def run(batches):
        table = pa.array(known(), pa.binary())
        for batch in batches:
            lo = 0
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            while lo < batch.num_rows:  # so many ids at once, or one row
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), IDS_AT_ONCE, side="right")))
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*(part.column(c) for c in others), pa.array(joined(table, part, ids_col), pa.binary())], names=[*others, out_col])
                lo = hi
            del batch, part
            released()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != out_col)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` binary")


def digests(decoded: DataFrame, id_col: str, keep_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of rows with ids and decoded, and ids if they are kept.

    Built-in functions: another Python worker for each task would take more memory than the digests are worth."""
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    out = [F.col(id_col), F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return decoded.select(*out, *(["ids"] if keep_ids else []))
