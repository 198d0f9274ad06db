"""Documents in, token ids out: toxicity, near-duplicates, decontamination, secrets, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; run()
writes each stage's rows to the shared folder and reads them again for the next. All stages but the last return the
columns of documents. Rows with a null or empty text pass the filters: they are neither toxic nor copies of anything."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import decode, digests, encode, load_ranks
from gridloom.llm.common import table, written
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.neardup import near_duplicates
from gridloom.llm.secrets import redact
from gridloom.llm.toxicity import toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: words of a shingle and similarity in percent; decontamination: words of a window.
SHINGLE, SIMILARITY, WINDOW = 5, 80, 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go, row by row; the network learns from the labels of the whole
    documents table. Without labels, or with one class of them, it rejects all or nothing alike."""
    network = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity(docs, network, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id stays of each group of near-duplicates; of rows that tie on it, the first as they are numbered."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), "rows")
    gone = near_duplicates(rows, SHINGLE, SIMILARITY, row_col="_row").where("not kept").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, row by row. Null texts stay, and all do if there is no benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), WINDOW, keep=COLUMNS).where("n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows the text. Null texts stay null with their n_chars, empty ones
    empty; rows that repeat stay rows of their own."""
    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the texts as token ids. Null and empty texts have none; rows that
    repeat an id, or have none, stay rows of their own."""
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks), "doc_id", keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_level_bpe", tokenize),
]
#: SQL can express neither the network nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return stage_out(spark, docs, sf_dir)


def stage_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), f"stage-{name}").drop("ids")
