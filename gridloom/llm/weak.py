"""Quality classifier from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, and a hashed
linear scorer learns from the posterior labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded, mapped, shared, texts, words, written
from .stats import FEATURES, features, matrix

#: Documents that the scorer is fitted on at most, and bytes of their features: those whose ids hash lowest, as long as they
#: fit; the driver holds no more.
TRAINING_ROWS, TRAINING_BYTES = 20_000, 256 << 20
BITS = 16
#: The labellers: feature, bad if above (or below), good if below (or above); between them a labeller abstains.
LABELLERS: tuple[tuple[str, str, float, float], ...] = (
    ("symbol_share", "above", 0.08, 0.02),
    ("repeat_share", "above", 0.25, 0.10),
    ("dup_line_share", "above", 0.30, 0.10),
    ("upper_share", "above", 0.40, 0.15),
    ("marked_share", "above", 0.30, 0.05),
    ("distinct_share", "below", 0.20, 0.45),
    ("digit_share", "above", 0.25, 0.05),
    ("mean_word", "above", 12.0, 8.0),
    ("log_words", "below", 1.7, 2.7),
)


def votes(x: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 abstains: a column for each labeller."""
    out = np.full((len(x), len(LABELLERS)), -1, np.int8)
    for j, (name, side, bad, good) in enumerate(LABELLERS):
        v = x[:, FEATURES.index(name)] * (1 if side == "above" else -1)
        bad, good = (bad, good) if side == "above" else (-bad, -good)
        out[v >= bad, j] = 0
        out[v <= good, j] = 1
    return out


@dataclass
class LabelModel:
    """prior: of good; accuracy[l, c, v]: that labeller l votes v (bad, good, abstains) on a document of class c."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.prior, self.prior])) + np.zeros((len(v), 1))
        for j in range(v.shape[1]):
            log += np.log(self.accuracy[j][:, v[:, j]].T)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)


def fit_labels(v: np.ndarray, count: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents have each. A labeller's bad vote starts as the stronger sign."""
    k = v.shape[1]
    bad, good = (v == 0).sum(1), (v == 1).sum(1)
    q = np.clip((good + 1) / (good + 1 + 3 * bad + 0.5), 0.02, 0.98)
    prior, acc = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds if len(v) else 0):
        w = np.stack([(1 - q) * count, q * count])
        prior = float(np.clip(w[1].sum() / w.sum(), 0.05, 0.95))
        for j in range(k):
            for c in (0, 1):
                n = np.bincount(v[:, j] % 3, w[c], 3) + 0.5
                acc[j, c] = n / n.sum()
        q = LabelModel(prior, acc).posterior(v % 3)
    return LabelModel(prior, acc)


def _shape(word: bytes) -> bytes:
    return re.sub(rb"([aA0])\1+", rb"\1", word.translate(_SHAPES))


_SHAPES = bytes(65 if 65 <= b < 91 else 97 if b >= 97 and b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))


def _hashed(batch: pa.RecordBatch, text: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features in rows: (document, slot, value): word shapes, their pairs, and each statistic by its step."""
    import xxhash

    docs = [words(t) for t in texts(batch, text)]
    distinct, codes, starts = coded(docs)
    mask = np.uint64((1 << BITS) - 1)
    shape = np.fromiter((xxhash.xxh3_64_intdigest(_shape(w)) for w in distinct), np.uint64, len(distinct))
    h = shape[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(docs)), np.diff(starts))
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pair = (h[inner] * np.uint64(31) + h[inner + 1]) * np.uint64(0x9E3779B97F4A7C15)
    slot = np.concatenate([(h & mask), ((pair >> np.uint64(20)) & mask)]).astype(np.int64)
    doc = np.concatenate([owner, owner[inner]])
    key, n = np.unique(doc * (1 << BITS) + slot, return_counts=True)
    doc, slot = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(n)
    norm = np.sqrt(np.bincount(doc, value**2, len(docs)))
    value = value / np.maximum(norm[doc], 1e-9)
    step = np.clip(np.round(x * np.where(x > 1.5, 2, 20)), 0, 60).astype(np.int64)
    at = ((np.arange(x.shape[1]) * 64 + step) * 40503) & ((1 << BITS) - 1)
    return np.concatenate([doc, np.repeat(np.arange(len(docs)), x.shape[1])]), np.concatenate([slot, at.ravel()]), np.concatenate([value, np.full(at.size, 0.5)])


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(doc, self.weight[slot] * value, n), -40, 40)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 12, rate: float = 0.5, l2: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by stochastic gradients with step sizes of their own for each slot."""
    w, seen, b, seen_b = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), 0.0, 1e-3
    rng = np.random.default_rng(5)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            slot, value, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(b + w[slot] @ value, -40, 40)))
            g = (p - y) * value + l2 * w[slot]
            seen[slot] += g * g
            w[slot] -= rate * g / np.sqrt(seen[slot])
            seen_b += (p - y) ** 2
            b -= rate * (p - y) / np.sqrt(seen_b)
    return Scorer(w, float(b))


def classify(docs: DataFrame, threshold: float = 0.5, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_votes, label_prob, score, kept) for each row: votes cast, posterior of good, the scorer's probability of good.

    The label model sees the vote patterns of all documents, counted; the scorer is fitted on at most so many documents
    with their posterior labels. Null and empty texts are wordless documents and are scored as such. Rows that repeat an id
    are scored each by its own text; in the fit they share the least vote pattern among them."""
    spark = docs.sparkSession
    digits = "string"

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = votes(features(matrix(batch, text_col)))
        return pa.record_batch({"id": batch.column(id_col).cast(pa.int64()), "votes": pa.array(["".join("01-"[a % 3] for a in r) for r in v.tolist()], pa.string())})

    cast = written(mapped(docs.select(id_col, text_col), vote, f"id long, votes {digits}", text_col), "votes")
    patterns = cast.groupBy("votes").count().orderBy("votes").collect()  # 3 ** labellers at most
    v = np.array([[{"0": 0, "1": 1, "-": 2}[a] for a in r["votes"]] for r in patterns], np.int8).reshape(len(patterns), len(LABELLERS))
    model = fit_labels(v, np.array([r["count"] for r in patterns], float))
    posterior = dict(zip([r["votes"] for r in patterns], model.posterior(v).tolist())) if len(v) else {}
    labels = shared(spark, posterior)
    few = cast.orderBy(F.xxhash64("id"), "id").limit(rows).groupBy("id").agg(F.min("votes").alias("votes"))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, slot, value = _hashed(batch, "text", features(matrix(batch)))
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
        s, x = slot[order].astype(np.int32), value[order].astype(np.float32)
        y = [labels()[r] for r in batch.column("votes").to_pylist()]
        return pa.record_batch({"id": batch.column("id"), "y": pa.array(y, pa.float64()), "slot": pa.array([s[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), "value": pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    before = F.sum(F.octet_length("slot") + F.octet_length("value")).over(Window.orderBy(F.xxhash64("id"), "id", "slot"))  # so many rows at most, unless ids repeat
    fitted = mapped(sample, hashed, "id long, y double, slot binary, value binary").withColumn("_bytes", before).where(F.col("_bytes") <= TRAINING_BYTES).drop("_bytes")
    got = sorted(fitted.collect(), key=lambda r: (r["id"], r["slot"]))
    scorer = fit_scorer([(np.frombuffer(r["slot"], np.int32), np.frombuffer(r["value"], np.float32).astype(float), r["y"]) for r in got])
    known = shared(spark, scorer)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(matrix(batch, text_col))
        v = votes(x)
        p = known().score(*_hashed(batch, text_col, x), batch.num_rows)
        prob = [labels()["".join("01-"[a % 3] for a in r)] for r in v.tolist()]
        return pa.record_batch([batch.column(id_col).cast(pa.int64()), pa.array((v >= 0).sum(1), pa.int64()), pa.array(prob, pa.float64()), pa.array(p), pa.array(p >= threshold)], names=["id", "n_votes", "label_prob", "score", "kept"])

    return mapped(docs.select(id_col, text_col), score, "id long, n_votes long, label_prob double, score double, kept boolean", text_col).withColumnRenamed("id", id_col)
