"""Quality rules: fixed rules and boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import mapped, shared
from .stats import FEATURES, NAMES, features, matrix

#: Rows with a label that a model is fitted on at most: those whose ids hash lowest.
TRAINING_ROWS = 20_000
#: More symbols, repeats or duplicate lines never make a document better.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share", "marked_share")}
BASE = NAMES[:5]


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y) of at most so many documents with a label of 0 or 1; ids that are null are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    few = one.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(few), id_col).select(F.col(id_col).alias("id"), "text", F.col("_y").alias("y"))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> boosting.Trees:
    """Trees that tell good documents from others, fitted on a bounded sample of the labelled ones."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = matrix(batch)
        return pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("y"), *(pa.array(c) for c in m.T)], names=["id", "y", *NAMES])

    schema = "id long, y int, " + ", ".join(f"{n} long" for n in NAMES)
    got = mapped(labelled(docs, labels, "quality", rows, id_col, text_col), one, schema).toPandas().sort_values(["id", *NAMES])
    return boosting.fit(features(got[list(NAMES)].to_numpy().reshape(-1, len(NAMES))), got["y"].to_numpy(np.float64), MONOTONE)


def quality(docs: DataFrame, model: boosting.Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) for each row.

    Words are [^\\x20\\x09-\\x0D]+. base_failed: under 10 words, or over 20 % of the words in repeated windows of five. kept:
    not base_failed, and good by the trees with at least the threshold's probability. Null and empty texts have no words
    and fail."""
    known = shared(docs.sparkSession, model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = matrix(batch, text_col)
        p = known().probability(features(m))
        failed = (m[:, 0] < 10) | (100 * m[:, 4] > 20 * m[:, 0])
        cols = [batch.column(id_col).cast(pa.int64()), *(pa.array(m[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
        return pa.record_batch(cols, names=["id", *BASE, "base_failed", "probability", "kept"])

    schema = "id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, probability double, kept boolean"
    return mapped(docs.select(id_col, text_col), one, schema, text_col).withColumnRenamed("id", id_col)
