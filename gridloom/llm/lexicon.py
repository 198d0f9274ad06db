"""A global shuffle of distinct words: documents are packed into blocks that name each distinct word once, the words are
dealt out by hash and get a value each, and the values come back to their blocks, where documents are put together by
position.

A block holds a bounded stretch of texts; what leaves it is one row for each bucket of its words, so a word that is in
every text costs one entry a block, however often it occurs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, shuffle_width, slices, written
from .pieces import packed, unpacked, unzipped, zipped

BLOCK_BYTES = 8 << 20
_LEX = "array<struct<bucket:int,codes:binary,words:binary,more:binary>>"


def _digest(ids: list, distinct: list[bytes], sizes: bytes, pos: bytes) -> bytes:
    """What tells a block from one of the same number that was cut from other texts."""
    h = hashlib.blake2b(repr(ids).encode(), digest_size=16)
    h.update(b"\0".join(distinct))
    h.update(sizes)
    h.update(pos)
    return h.digest()


def pack(docs: DataFrame, split: Callable, id_col: str, text_col: str, buckets: int | None = None, more: Callable | None = None, keep: bool = True) -> DataFrame:
    """Blocks: (block, ids, sizes, pos, digest, lex), written to the shared folder if they are kept.

    split: a slice to (distinct words, codes, where documents begin); more: the slice and these three to an integer for
    each distinct word, which travels with it. Blocks that aren't kept are made again for each use, which takes less disk;
    their numbers then rely on docs giving the same slices again, as tables in files do, and put_together checks it."""
    n = buckets or 4 * shuffle_width(docs.sparkSession)

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for part in slices(batches, text_col, BLOCK_BYTES):
            distinct, codes, starts = split(part)
            bucket = np.fromiter((zlib.crc32(w) % n for w in distinct), np.int64, len(distinct))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            extra = None if more is None else more(part, distinct, codes, starts)
            ids, sizes, pos = part.column(id_col).cast(pa.int64()).to_pylist(), zipped(np.diff(starts).astype(np.uint32)), zipped(codes.astype(np.uint32))
            del codes, part
            digest = _digest(ids, distinct, sizes, pos)
            lex = []
            for rows in np.split(order, cuts) if len(order) else []:
                lex.append({"bucket": int(bucket[rows[0]]), "codes": zipped(rows.astype(np.uint32)), "words": packed([distinct[i] for i in rows.tolist()]), "more": None if extra is None else zipped(extra[rows])})
            kind = pa.list_(pa.struct([("bucket", pa.int32()), ("codes", pa.binary()), ("words", pa.binary()), ("more", pa.binary())]))
            del distinct, bucket, order, extra
            yield pa.record_batch({"block": pa.array([serial], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.binary()), "pos": pa.array([pos], pa.binary()), "digest": pa.array([digest], pa.binary()), "lex": pa.array([lex], kind)})
            serial += 1
            del lex, ids, sizes, pos
            released()

    blocks = docs.select(id_col, text_col).mapInArrow(run, f"block long, ids array<long>, sizes binary, pos binary, digest binary, lex {_LEX}")
    return written(blocks, "blocks") if keep else blocks


def words_of(blocks: DataFrame) -> DataFrame:
    """(block, digest, bucket, codes, words, more): a row for each block and bucket."""
    return blocks.select("block", "digest", F.explode("lex").alias("x")).select("block", "digest", "x.*")


def distinct_in(table: pa.Table, column: str = "words") -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of a bucket's rows, and each row's words as numbers of them."""
    rows = [unpacked(x) for x in table.column(column).to_pylist()]
    code = pa.concat_arrays(rows).dictionary_encode()
    ends = np.cumsum([len(r) for r in rows])[:-1]
    return code.dictionary, np.split(code.indices.to_numpy(zero_copy_only=False), ends)


def put_together(blocks: DataFrame, values: DataFrame, build: Callable, schema: str) -> DataFrame:
    """build(ids, sizes, pos, rows) for each block: rows are the values' rows that came back to it, with the block's digest.

    A block that was made again from other texts than the ones that its words came from raises an error."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        came = set(right.column("digest").to_pylist())
        for i in range(left.num_rows):
            pos = unzipped(left.column("pos")[i].as_py(), np.uint32)
            if came != ({left.column("digest")[i].as_py()} if len(pos) else set()):
                raise RuntimeError("the texts were sliced in another way; write them to a table first")
            out.append(build(left.column("ids")[i].as_py(), unzipped(left.column("sizes")[i].as_py(), np.uint32).astype(np.int64), pos, right))
        released()
        return pa.concat_tables(out)

    return blocks.select("block", "ids", "sizes", "pos", "digest").groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)
