"""MinHash near-duplicates with tensored banding: table keys are pairs of half-keys from two small collections.

m half-keys of h minhashes on either side give m * m tables of 2 * h minhashes each, out of 2 * m * h minhashes in all.
Texts with equal shingle sets form one class first, so copies never meet in a table. In every table each class is held
against one centre of its bucket; the pairs whose signatures are not far apart form clusters. Among all classes that met
another, clusters are then joined by an exact way: linked sets have one of their rarest shingles in common (prefix filter).
Inside a cluster all links are confirmed on the full shingle sets, block against block, where a rigorous bound from parity bitmaps
spares most set intersections. Only a spanning forest of links leaves a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded, mapped, mixed, texts, word_hashes, words, written
from .components import components

#: Half-keys on either side, and minhashes in a half-key: at similarity 0.8 a pair meets in no table with probability
#: 2 * (1 - 0.8 ** 3) ** 12 = 4e-4, at 0.85 with 2e-5. Two minhashes would let half-keys of unlike texts meet ever more often.
HALF_KEYS, HASHES = 12, 3
#: Share of equal minhashes from which two classes belong to one cluster: signatures at similarity 0.8 agree less with probability 1e-10.
NEAR = 0.45
#: Documents and shingles of one block.
BLOCK_DOCS, BLOCK_SHINGLES = 768, 400_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _hashes(docs: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each document's distinct shingles in ascending order, and where each document begins."""
    distinct, codes, starts = coded(docs)
    n = np.diff(starts)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    if not len(codes):
        return np.zeros(0, np.uint64), out
    h = word_hashes(distinct)[codes]
    owner = np.repeat(np.arange(len(docs)), count)
    first = np.arange(out[-1]) - out[owner] + starts[owner]
    last = starts[owner + 1]
    got = np.zeros(out[-1], np.uint64)
    for j in range(k):
        at = first + j
        inside = at < last
        got = np.where(inside, (got + h[np.minimum(at, len(h) - 1)]) * _ODD ^ (got >> np.uint64(32)), got)
    got = mixed(got)
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    got, owner = got[keep], owner[keep]
    np.cumsum(np.bincount(owner, minlength=len(docs)), out=out[1:])
    return got, out


def _of(batch: pa.RecordBatch, k: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    return _hashes([words(t.lower()) for t in texts(batch, text)], k)


def _classes(got: np.ndarray, starts: np.ndarray) -> list[str | None]:
    """A name for each distinct shingle set: its size and 128 bits of sums over its hashes. An empty set has none."""
    n = np.diff(starts)
    some = n > 0
    out: list[str | None] = [None] * len(n)
    if some.any():
        at = starts[:-1][some]
        a = np.add.reduceat(mixed(got), at)
        b = np.add.reduceat(mixed(got ^ _ODD), at)
        for i, size, x, y in zip(np.flatnonzero(some), n[some], a, b):
            out[i] = f"{size:x}-{x:016x}{y:016x}"
    return out


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(id, row, n_shingles, class, sig): row is that of row_col, or else the id; sig holds 2 * m * h minhashes as unsigned 32-bit integers; none for an empty set."""
    rows = 2 * HALF_KEYS * HASHES
    rng = np.random.default_rng(11)
    mult = (rng.integers(0, 1 << 63, rows, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    add = rng.integers(0, 1 << 63, rows, np.int64).astype(np.uint64)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, starts = _of(batch, shingle, text_col)
        n = np.diff(starts)
        some = n > 0
        sig = np.zeros((rows, int(some.sum())), np.uint32)
        if some.any():
            at = starts[:-1][some]
            for r in range(rows):
                sig[r] = np.minimum.reduceat(((got * mult[r] + add[r]) >> np.uint64(32)).astype(np.uint32), at)
        packed = iter(np.ascontiguousarray(sig.T))
        return pa.record_batch({"id": batch.column(id_col).cast(pa.int64()), "row": batch.column(row_col or id_col).cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()), "class": pa.array(_classes(got, starts), pa.string()), "sig": pa.array([next(packed).tobytes() if s else None for s in some], pa.binary())})

    return mapped(docs.select(*dict.fromkeys([id_col, row_col or id_col, text_col])), one, "id long, row long, n_shingles long, class string, sig binary", text_col)


def _half_keys(classes: DataFrame) -> DataFrame:
    """(node, at, half): the half-keys of each class."""

    def one(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, 2 * HALF_KEYS, HASHES).astype(np.uint64)
            half = np.zeros(sig.shape[:2], np.uint64)
            for j in range(HASHES):
                half = mixed((half + sig[:, :, j]) * _ODD + np.uint64(j + 1))
            half = mixed(half + np.arange(2 * HALF_KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            n = 2 * HALF_KEYS
            at = np.tile(np.arange(n, dtype=np.int32), batch.num_rows)
            yield pa.record_batch({"node": batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), n))), "at": pa.array(at), "half": pa.array(half.reshape(-1).view(np.int64))})

    return classes.select("node", "sig").mapInArrow(one, "node long, at int, half long")


def _shares(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs, whose first columns are a and b, with share: of the places, how many agree in the signatures of a and b."""
    names = pairs.columns
    sig = classes.select("node", "sig")
    pairs = pairs.join(sig.toDF("a", "sig_a").hint("merge"), "a").join(sig.toDF("b", "sig_b").hint("merge"), "b").select(*names, "sig_a", "sig_b")

    def one(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield pa.record_batch({n: batch.column(n) for n in names} | {"share": pa.array((x == y).mean(1))})

    return pairs.mapInArrow(one, ", ".join([*(f"{n} long" for n in names), "share double"]))


def _confirm(threshold: int):
    """The links of one pair of blocks (or within one block): a spanning forest of them, confirmed on whole sets."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        name = table.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        n = np.array([len(s) for s in sets], np.int64)
        width = 1 << int(min(max(9, np.ceil(np.log2(4 * max(1, n.max())))), 16))
        maps = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(sets):
            maps[i] = np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)
        parent = list(range(len(sets)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        pairs: list[tuple[int, int]] = []
        for k, i in enumerate(left):
            others = right[k + 1 :] if same else right
            if not len(others):
                continue
            total = n[i] + n[others]
            # intersection / union >= t / 100 means: symmetric difference <= total * (100 - t) / (100 + t); sizes bound it too
            most = total * (100 - threshold) // (100 + threshold)
            others = others[(np.abs(n[i] - n[others]) <= most)]
            if not len(others):
                continue
            apart = np.bitwise_count(maps[others] ^ maps[i]).sum(1, dtype=np.int64)
            for j in others[apart <= (n[i] + n[others]) * (100 - threshold) // (100 + threshold)].tolist():
                a, b = find(int(i)), find(j)
                if a == b:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= threshold * (int(n[i] + n[j]) - common):
                    parent[a] = b
                    pairs.append((name[i], name[j]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _prefixes(full: DataFrame, threshold: int) -> DataFrame:
    """(shingle, node, n, at): the shingles of which two linked sets have one in common, from 0 on the place of each in its set.

    full: (node, shingles). Sets are in one order, rare shingles first. Linked sets share threshold in 100 of either at
    least, so their first common shingle is among the first n - ceil(threshold * n / 100) + 1. Lone shingles only count."""

    def one(batches):
        for batch in batches:
            sets = batch.column("shingles").to_pylist()
            n = np.array([len(x) // 8 for x in sets], np.int64)
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.record_batch({"node": batch.column("node").take(owner), "n": pa.array(n).take(owner), "shingle": pa.array(np.frombuffer(b"".join(sets), np.int64))})

    rows = full.select("node", "shingles").mapInArrow(one, "node long, n long, shingle long")
    seen = rows.withColumn("seen", F.count("*").over(Window.partitionBy("shingle"))).where("seen > 1")
    by_node = seen.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("some")).withColumn("lone", F.col("n") - F.size("some"))
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - F.col("lone")).cast("int")
    return by_node.select("node", "n", "lone", F.posexplode(F.slice("some", F.lit(1), length)).alias("at", "x")).select("x.shingle", "node", "n", (F.col("at") + F.col("lone")).alias("at"))


def _bridged(full: DataFrame, clusters: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """clusters (node, label), joined where two sets may be linked though no centre brought them together.

    full: (node, shingles), the sets of all classes that met another in a table. Whether the two met each other doesn't
    matter here: pairs of different clusters come from common shingles of their prefixes, and what follows the first
    common one must be long enough on either side."""
    prefixes = _prefixes(full, threshold).join(clusters.hint("merge"), "node", "left")
    prefixes = written(prefixes.select("shingle", "node", F.coalesce("label", "node").alias("label"), "n", "at"), "prefixes")
    mixed_up = prefixes.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("shingle")
    left = written(prefixes.join(mixed_up.hint("merge"), "shingle"), "mixed", prefixes)
    one, two = left.toDF("shingle", "a", "x", "na", "pa"), left.toDF("shingle", "b", "y", "nb", "pb")
    enough = f"{100 + threshold} * least(na - pa, nb - pb) >= {threshold} * (na + nb)"
    pairs = one.join(two.hint("merge"), "shingle").where(f"a < b and x != y and {enough}").select("a", "b", "x", "y").distinct()
    bridges = written(_shares(pairs, classes).where(F.col("share") >= NEAR).select("x", "y").distinct(), "bridges")
    moved = components(bridges, "x", "y")
    every = clusters.union(moved.select("node", F.col("node").alias("label"))).distinct()
    return every.join(moved.toDF("label", "top").hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def links(docs: DataFrame, classes: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between the nodes of classes that join all that are linked.

    classes: (node, class, sig, id, n), a row for each distinct shingle set, with the smallest id that has it."""
    halves = written(_half_keys(classes), "halves")
    # a class meets another in a table only if it shares a half-key on either side: only those half-keys form keys
    shared = halves.groupBy("half").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("half")
    # the joins are of one kind at every size: no side of them has a bound that would allow a broadcast
    kept = halves.join(shared.hint("merge"), "half")
    sides = kept.groupBy("node").agg(F.collect_list(F.when(F.col("at") < HALF_KEYS, F.col("half"))).alias("left"), F.collect_list(F.when(F.col("at") >= HALF_KEYS, F.col("half"))).alias("right"))
    keys = written(sides.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r")).select("node", F.xxhash64("l", "r").alias("key")), "keys")
    # one order of the classes chooses the centres, so that the tables of a family mostly agree on them
    centre = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"))).alias("c"), F.max("node").alias("hi"), F.min("node").alias("lo")).where("lo != hi").select("key", F.col("c.b").alias("b"))
    met = written(keys.join(centre.hint("merge"), "key").where("node != b").select("key", F.col("node").alias("a"), "b"), "met")
    shares = written(_shares(met.select("a", "b").distinct(), classes), "shares")
    # a class has a centre in each of its tables at most; all of them join the one that comes first, so that edges stay few
    near = shares.where(F.col("share") >= NEAR).groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("top"), F.collect_set("b").alias("others"))
    edges = near.select("top", F.explode(F.array_append("others", F.col("a"))).alias("b")).distinct().where("top != b")
    clusters = components(edges, "top", "b")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, starts = _of(batch, shingle, "_text")
        name = _classes(got, starts)
        keep = pa.array([a == b for a, b in zip(name, batch.column("class").to_pylist())])  # another row may carry the same id
        packed = pa.array([got[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())
        return pa.record_batch({"node": batch.column("node"), "shingles": packed}).filter(keep)

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    grouped = written(met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "class", "id").hint("merge"), "node"), "grouped")
    # a class whose rows all lack an id is found among the rows without one
    with_text = found.join(grouped.hint("merge"), found["id"].eqNullSafe(grouped["id"])).select("node", "class", "_text")
    # rows that repeat an id and a text give the same set once more
    full = written(mapped(with_text, sets, "node long, shingles binary", "_text").dropDuplicates(["node"]), "sets")
    clusters = written(_bridged(full, clusters, classes, threshold), "clusters")
    members = clusters.join(classes.select("node", "n"), "node")
    blocks = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = written(members.join(blocks, "label").select("node", "label", "blocks"), "members")
    full = full.join(members.hint("merge"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = full.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "label", "shingles", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    return dealt.groupBy("label", "bi", "bj").applyInArrow(_confirm(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row for each row of docs; with row_col, that column, too.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; the set of a document is its distinct shingles of so many words,
    with fewer words the whole sequence. Documents with 100 * intersection >= threshold * union are linked, component_id is
    the smallest id reachable. A null, empty or wordless text has an empty set, is linked with nothing and is kept. Rows
    that repeat an id stay rows of their own; a null id takes part, and gives way to ids that are not null. Other columns
    of docs are not read. row_col: whole numbers, another one in each row; then a component keeps one row, that with the
    smallest id and, among rows that tie on it, the lowest number. Without it all rows with the smallest id are kept."""
    sketched = written(sketches(docs, shingle, id_col, text_col, row_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    of_class = sketched.where("class is not null").groupBy("class").agg(F.min_by("sig", "sig").alias("sig"), F.min("row").alias("id"), F.max("n_shingles").alias("n"), first)
    classes = written(of_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    joined = components(links(docs, classes, shingle, threshold, row_col or id_col, text_col))
    # classes that are linked take their component's label; every other class is its own
    named = written(classes.select("node", "class", "first").join(joined, "node", "left").select("class", "first", F.coalesce("label", "node").alias("label")), "named")
    top = named.groupBy("label").agg(F.min("first").alias("first"))
    by_class = named.select("class", "label").join(top, "label").select("class", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row"))
    out = sketched.join(by_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    if row_col:
        kept = F.col("class").isNull() | (F.col("row") == F.col("first_row"))
    return out.select(F.col("id").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), "n_shingles", component.alias("component_id"), kept.alias("kept"))
