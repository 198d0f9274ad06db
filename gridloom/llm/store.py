"""A content-addressed store of token ids.

A rolling hash over the last ids cuts every document's id stream into chunks; a chunk is addressed by a hash of its bytes
and stored once. A recipe lists a document's chunks, and carries the root of a Merkle tree over them; the manifest has a
root for each run of recipes. Reading checks every chunk against its address, every recipe against its root, and every
run against the manifest.

Folders: staged/kind=chunks (a, n, data: ids as little-endian unsigned integers of 2 or 4 bytes), recipes (part, row, id, start,
n_tokens, root, refs) in ascending order of ids, manifest (part, rows, tokens, root)."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import deleted, released, shared, shared_dir, shuffle_width, slices
from .pieces import bounds, coded_pieces, gathered

#: Ids that the rolling hash sees, bits of it that are zero at a cut (so chunks have 2 ** BITS ids or so), and the most ids in a chunk.
ROLL, BITS, MOST = 16, 10, 8192
#: Pre-tokens that go to the tokenizer in one string.
AT_ONCE = 256
SLICE_BYTES = 28 << 20
#: Pre-tokens whose documents are put together at once, unless a single one has more.
PIECES_AT_ONCE = 600_000
#: Bytes that a tokenizer file may have, since it is broadcast.
TOKENIZER_BYTES = 64 << 20


#: Rows as they are staged: recipes and chunks in a folder each.
STAGED = "a binary, n int, data binary, recipe struct<id:bigint,tokens:bigint,refs:array<struct<a:binary,n:int>>,tie:binary>, kind string"


def _staged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(f"{path}/staged").where(F.col("kind") == kind)


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def root(leaves: list[bytes]) -> bytes:
    """The root of the Merkle tree over leaves; an odd node goes up alone."""
    if not leaves:
        return address(b"")
    while len(leaves) > 1:
        leaves = [address(b"\x01" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def cuts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end: at documents' starts, where the rolling hash says so, and after MOST ids.

    The hash of a window is the sum of its ids' random numbers: it rolls by adding one and taking one away."""
    n = len(ids)
    if not n:
        return np.zeros(1, np.int64)
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.cumsum(h, out=h)
    rolled = h[ROLL - 1 :].copy()
    rolled[1:] -= h[:-ROLL]
    rolled *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(rolled < np.uint64(1 << (64 - BITS))) + ROLL
    doc = np.searchsorted(starts, at, side="right") - 1
    at = at[(at - starts[doc] >= ROLL) & (at < n)]  # its window lies in one document
    edges = np.unique(np.concatenate([starts[(starts < n)], at, [n]]))
    long = np.flatnonzero(np.diff(edges) > MOST)
    more = [np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in long]
    return np.unique(np.concatenate([edges, *more]))


class Encoder:
    """The tokenizers library over distinct pre-tokens, many in one string."""

    def __init__(self, json_text: str, pattern: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = json.loads(json_text)
        self.json_text, self.whole = json_text, None
        self.added = [t["content"] for t in known.get("added_tokens") or []]
        # pre-tokens come from texts without an added token, and must not make one where they stand side by side
        self.tokenizer = Tokenizer.from_str(json.dumps(known | {"added_tokens": [], "post_processor": None}))
        self.pattern = pattern
        vocab = known["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in known.get("added_tokens") or [])], default=0)
        self.length = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        # a character of a byte-level token is a byte
        self.length[np.fromiter(vocab.values(), np.int64, len(vocab))] = np.fromiter(map(len, vocab), np.int64, len(vocab))

    def _entire(self, text: str) -> list[int]:
        """The ids of a text that holds an added token."""
        from tokenizers import Tokenizer

        self.whole = self.whole or Tokenizer.from_str(self.json_text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _many(self, pieces: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens one after another, and the number of each id's pre-token. mark: stands behind each (and is no one's)."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets, data = bounds(pa.compute.binary_join_element_wise(pieces, "", mark) if mark else pieces)
        edges = np.append(offsets[:-1:AT_ONCE], offsets[-1]).tolist()
        raw = data.tobytes()
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges, edges[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int64) for e in found])
        ends = np.cumsum(self.length[ids])
        limits = np.sort(np.concatenate([offsets[1:], offsets[1:] - len(mark)])) if mark else offsets[1:]
        last = np.searchsorted(ends, limits)
        if not len(ids) or ends[-1] != limits[-1] or (ends[last] != limits).any():
            raise ValueError("the tokenizer's ids don't end where the pre-tokens do")
        owner = np.searchsorted(limits, ends)
        if not mark:
            return ids, owner
        return ids[owner % 2 == 0], owner[owner % 2 == 0] // 2

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each pre-token, and all ids one after another.

        Pre-tokens that begin with a space and go on with something else need nothing between them; those without white
        space at their beginning are told apart by line feeds; white space is encoded on its own."""
        offsets, data = bounds(pieces)
        head = data[offsets[:-1]] if len(pieces) else data
        second = np.append(data, np.uint8(32))[offsets[:-1] + 1]
        long = np.diff(offsets) > 1
        solid = lambda b: (b > 32) & (b < 127) | (b > 0xC2) & (b < 0xC9)  # noqa: E731 - ASCII and Latin letters, no white space
        kinds = np.where((head == 32) & long & solid(second), 1, np.where(solid(head), 2, 0))
        other = np.flatnonzero(kinds == 0)
        for r, t in zip(other.tolist(), pieces.take(pa.array(other)).to_pylist()):
            kinds[r] = 2 if not t[0].isspace() else 1 if t[0] == " " and t[1:2] and not t[1].isspace() else 3
        found = []
        for kind, mark in ((1, ""), (2, "\n")):
            rows = np.flatnonzero(kinds == kind)
            ids, owner = self._many(pieces.take(pa.array(rows)), mark)
            found.append((ids, rows[owner]))
        for r in np.flatnonzero(kinds == 3).tolist():
            ids = np.array(self.tokenizer.encode(pieces[r].as_py(), add_special_tokens=False).ids, np.int64)
            found.append((ids, np.full(len(ids), r)))
        ids, owner = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(pieces)), ids[order]

    def texts(self, docs: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of documents: the first one's number, all ids one after another, each document with end_id, and where
        documents begin (one more at the end). A text that holds an added token goes through the library whole."""
        special = np.zeros(len(docs), bool)
        for t in self.added:
            special |= pa.compute.fill_null(pa.compute.match_substring(docs, t), False).to_numpy(zero_copy_only=False)
        own = {int(i): np.append(self._entire(docs[int(i)].as_py()), end_id) for i in np.flatnonzero(special)}
        if own:
            docs = pa.compute.if_else(pa.array(special), pa.scalar("", docs.type), docs)
        pieces, codes, starts = coded_pieces(docs, self.pattern)
        lengths, flat = self.distinct(pieces)
        del pieces
        lengths, flat = lengths.astype(np.int32), flat.astype(np.uint32)
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECES_AT_ONCE, side="right")) - 1)
            ids, count = gathered(lengths, flat, codes[starts[lo] : starts[hi]])
            at = np.append(0, np.cumsum(count))[starts[lo : hi + 1] - starts[lo]]
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            if special[lo:hi].any():
                parts = [own.get(lo + i, ids[at[i] : at[i + 1]]) for i in range(hi - lo)]
                ids, at = np.concatenate(parts).astype(ids.dtype), np.append(0, np.cumsum([len(x) for x in parts]))
            yield lo, ids, at
            lo = hi


def write_store(docs: DataFrame, json_text: str, pattern: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store of all rows, and returns its folder (one in the shared folder that goes with the session, if none is given).

    Null and empty texts are a document of the end id alone. Recipes go by ascending id (null first), rows that repeat an id
    by a hash of their ids; rows whose ids and texts are equal are told apart by their numbers only."""
    spark = docs.sparkSession
    if len(json_text) > TOKENIZER_BYTES:
        raise ValueError(f"tokenizer file over {TOKENIZER_BYTES} bytes")
    own = path is None
    path = path or f"{shared_dir(spark)}/gridloom-store-{uuid.uuid4().hex}"
    known = shared(spark, json_text)

    def run(batches):
        encoder = None
        for part in slices(batches, text_col, SLICE_BYTES):
            encoder = encoder or Encoder(known(), pattern)
            wide = np.dtype(np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32)
            doc_ids = part.column(id_col).to_pylist()
            seen: set[bytes] = set()
            for lo, ids, starts in encoder.texts(part.column(text_col), end_id):
                edge = cuts(ids, starts)
                raw = ids.astype(wide).tobytes()
                bounds = (edge * wide.itemsize).tolist()
                data = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
                names = list(map(address, data))
                count = np.diff(edge).astype(np.int32)
                of = np.searchsorted(edge, starts).tolist()
                docs_here = len(starts) - 1
                tie = [root(names[a:b]) for a, b in zip(of, of[1:])]
                new = [j for j, a in enumerate(names) if a not in seen and not seen.add(a)]
                m = len(new)
                refs = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(count)], ["a", "n"]))
                recipe = pa.StructArray.from_arrays([pa.array(doc_ids[lo : lo + docs_here], pa.int64()), pa.array(np.diff(starts), pa.int64()), refs, pa.array(tie, pa.binary())], ["id", "tokens", "refs", "tie"])
                # recipes are dealt out by a running number, chunks by their address
                key = [b"%d" % (zlib.crc32(r) ^ k) for k, r in enumerate(tie)] + [names[j] for j in new]
                none = pa.nulls(m, recipe.type)
                yield pa.record_batch({"kind": pa.array(["recipes"] * docs_here + ["chunks"] * m, pa.string()), "a": pa.array(key, pa.binary()), "n": pa.array([None] * docs_here + count[new].tolist(), pa.int32()), "data": pa.array([None] * docs_here + [data[j] for j in new], pa.binary()), "recipe": pa.concat_arrays([recipe, none])})
                del ids, raw, data, names, tie, refs, recipe, key
            released()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "kind string, " + STAGED.removesuffix(", kind string"))
    # one exchange: equal addresses meet and the first stays
    first = F.row_number().over(Window.partitionBy("kind", "a").orderBy("n"))
    once = rows.withColumn("_first", first).where("_first = 1 or kind = 'recipes'").drop("_first")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/staged")
    recipes = _staged(spark, path, "recipes").select("recipe.*")
    ordered = recipes.repartitionByRange(shuffle_width(spark), "id", "tie").sortWithinPartitions("id", "tie").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    ordered.write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.parquet(f"{path}/ordered")
    by_part = Window.partitionBy("part").orderBy("row")
    inner = ordered.withColumn("_before", F.coalesce(F.sum("tokens").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = ordered.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    offsets = sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row for each part
    final = inner.join(offsets, "part").select("part", "row", "id", (F.col("_before") + F.col("_offset")).alias("start"), F.col("tokens").alias("n_tokens"), F.col("tie").alias("root"), "refs")
    final.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    deleted(spark, f"{path}/ordered")
    if own:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def _roots(recipes: DataFrame) -> DataFrame:
    """(part, rows, tokens, root) of recipes; the root is over a running hash of the part's recipes in order."""
    leaves = recipes.select("part", "row", "n_tokens", F.sha2(F.concat_ws(":", F.hex("root"), F.col("id").cast("string"), F.col("start").cast("string"), F.col("n_tokens").cast("string")), 256).alias("leaf"))
    level = leaves.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1)
    # two levels of the tree: of 1024 recipes each, and of a part
    low = level.groupBy("part", F.floor(F.col("pos") / 1024).alias("at")).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf"))), lambda x: x["leaf"]), ","), 256).alias("leaf"))
    return low.groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda x: x["leaf"]), ","), 256).alias("root"))


def _shift(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc32 values moved past so many zero bytes: by[i] is a row of 32 words, the images of single bits."""
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= np.where((crc >> np.uint32(b)) & np.uint32(1), by[:, b], np.uint32(0))
    return out


def _zero_ids(most: int) -> np.ndarray:
    """The images of single bits under so many zero ids of 4 bytes, for 0 to most ids."""
    bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    power = np.array([zlib.crc32(b"\0\0\0\0", int(b)) ^ zlib.crc32(b"\0\0\0\0", 0) for b in bits], np.uint32)
    out = bits[None]
    while len(out) <= most:  # from up to n zero ids to up to 2 n + 1
        out = np.concatenate([out, _shift(out.ravel(), np.broadcast_to(power, (out.size, 32))).reshape(-1, 32)])
        power = _shift(power, np.broadcast_to(power, (32, 32)))
    return out[: most + 1]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, verified) of each document, from the store's files.

    ids_crc32: crc32 of the document's ids as little-endian unsigned 32-bit integers, put together from its chunks' own.
    verified: every chunk is there, has its address and its length, and the recipe has its root. A part of recipes that
    doesn't match the manifest raises an error."""
    chunks = _staged(spark, path, "chunks").select("a", "n", "data")
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    if _roots(recipes).select("part", "rows", "tokens", "root").exceptAll(manifest.select("part", "rows", "tokens", "root")).limit(1).count():
        raise ValueError(f"{path}: recipes don't match the manifest")

    def crcs(batches):
        for batch in batches:
            data, n = batch.column("data").to_pylist(), batch.column("n").to_pylist()
            found = [zlib.crc32(np.frombuffer(x, np.uint32 if len(x) == 4 * k else np.uint16).astype("<u4").tobytes()) for x, k in zip(data, n)]
            good = [address(x) == a and len(x) in (2 * k, 4 * k) for x, a, k in zip(data, batch.column("a").to_pylist(), n)]
            yield pa.record_batch({"a": batch.column("a"), "crc": pa.array(found, pa.int64()), "good": pa.array(good)})

    checked = chunks.mapInArrow(crcs, "a binary, crc long, good boolean")
    refs = recipes.select("row", "id", "start", "n_tokens", "root", F.posexplode("refs").alias("seq", "ref")).select("row", "id", "start", "n_tokens", "root", "seq", "ref.a", "ref.n")
    parts = refs.join(checked, "a", "left").groupBy("row", "id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "good", "a"))).alias("parts"))

    def combined(batches):
        shifts = _zero_ids(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("parts")
            counts = pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, first = parts.flatten(), np.cumsum(counts) - counts
            n, each = flat.field("n").to_numpy(zero_copy_only=False), pa.compute.fill_null(flat.field("crc"), 0).to_numpy(zero_copy_only=False).astype(np.uint32)
            if len(shifts) <= n.max():  # as the store was written, whatever MOST is now
                shifts = _zero_ids(int(n.max()))
            crc = np.zeros(len(parts), np.uint32)
            for k in range(int(counts.max())):
                rows = np.flatnonzero(counts > k)
                at = first[rows] + k
                crc[rows] = _shift(crc[rows], shifts[n[at]]) ^ each[at]
            sound = pa.compute.fill_null(flat.field("good"), False).to_numpy(zero_copy_only=False)
            names = flat.field("a").to_pylist()
            sums, fine = np.add.reduceat(n, first), np.logical_and.reduceat(sound, first)
            tokens, roots = batch.column("n_tokens").to_numpy(zero_copy_only=False), batch.column("root").to_pylist()
            good = [bool(fine[i]) and sums[i] == tokens[i] and root(names[first[i] : first[i] + counts[i]]) == roots[i] for i in range(len(parts))]
            yield pa.record_batch({"id": batch.column("id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc.astype(np.int64)), "verified": pa.array([bool(x) for x in good])})

    return parts.mapInArrow(combined, "id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of each document: the ids themselves, put together from the chunks."""
    chunks = _staged(spark, path, "chunks").select("a", "data")
    refs = spark.read.parquet(f"{path}/recipes").select("row", "id", "start", F.posexplode("refs").alias("seq", "ref")).select("row", "id", "start", "seq", "ref.a", "ref.n")
    parts = refs.join(chunks, "a").groupBy("row", "id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "data"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [[i for x in p for i in np.frombuffer(x["data"], np.uint32 if len(x["data"]) == 4 * x["n"] else np.uint16).tolist()] for p in batch.column("parts").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "start": batch.column("start"), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return parts.mapInArrow(run, "id long, start long, ids array<long>")
