"""What the operators share: reading, the shared folder, splitting of texts and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow slice holds at most, unless a single text is longer.
SLICE_BYTES = 8 << 20
#: [^\x20\x09-\x0D]+ is what bytes.split() yields; this table also drops ASCII but letters and digits.
ALNUM_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets one of
    its own, and any other an error, since executors of a cluster don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back: later stages don't compute it again, and survive lost executors.

    instead_of: a written table that nothing needs any more; it goes at once, the others when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if instead_of is not None:
        deleted(spark, instead_of._written)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def released() -> None:
    """Gives memory that this process has freed back to the system; a worker would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast value; its class needn't be known where it is read. Call the result to get it."""
    sent, got = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not got:
            got.append(pickle.loads(sent.value))
        return got[0]

    return get


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def residue(col: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod (null: that of the empty text)."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(0)) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts hold about limit bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    col = batch.column(column)
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, case kept."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.translate(ALNUM_TABLE).split()


def coded_array(docs: list[list[bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of its distinct word for each word, and where each document begins (one more at the end)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    code = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
    return code.dictionary, code.indices.to_numpy(zero_copy_only=False), starts


def coded(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """As coded_array, with the distinct words in a list."""
    distinct, codes, starts = coded_array(docs)
    return distinct.to_pylist(), codes, starts


def mapped(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; one turns a slice into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            out = one(part)
            del part
            if out is not None:
                yield from (out.to_batches() if isinstance(out, pa.Table) else [out])
            del out
            released()

    return df.mapInArrow(run, schema)


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (in place on a copy)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h
