"""Texts above the operators' limits, and columns whose names clash with the operators' own."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import secrets
from tests.llm.test_operators import brute_secrets


def base64_run(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))


def test_entropy_is_linear_in_a_candidate(spark):
    flat = ("aB3" * 400_000)[: 1 << 20]  # never dense, so every window is looked at
    rows = [(0, "see " + base64_run(1 << 20) + " end"), (1, flat), (2, "/".join(["usr", "lib"] * 50_000)), (3, "-".join(["a"] * 100_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert time.time() - began < 60
    assert got == {0: [(4, 3, 4 + (1 << 20))], 1: [], 2: [], 3: []}


def test_many_matches_and_pieces(spark):
    rng = random.Random(5)
    parts = []
    for i in range(6000):
        parts.append(rng.choice(["é", "word", f"token={i}abcdefgh", "f" * 32, f"password: {'0a' * 20}", "日本"]))
    text = " ".join(parts)
    docs = spark.createDataFrame([(0, text, "keep", "old", 1), (1, text[:4096], "keep", "old", 2)], "doc_id long, text string, _more string, spans string, _base int")
    out = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    for i, t in ((0, text), (1, text[:4096])):
        assert [tuple(s) for s in out[i]["base_spans"]] == brute_secrets(t) and out[i]["_more"] == "keep"
        wanted, at = [], -1
        for a, _, b in sorted(tuple(s) for s in out[i]["spans"]):
            if a > at:
                wanted += [t[max(at, 0) : a], "[SECRET]"]
            at = max(at, b)
        assert clean[i]["text"] == "".join(wanted) + t[max(at, 0) :]
        assert (clean[i]["_more"], clean[i]["spans"], clean[i]["_base"]) == ("keep", "old", i + 1)


def test_decontamination_of_clashing_columns_and_repeated_windows(spark):
    from gridloom.llm.decontaminate import Index, decontaminate
    from tests.llm.test_operators import brute_hits

    rng = random.Random(2)
    words = [rng.choice(["ab", "cd", "é1", "日", "x9"]) for _ in range(4000)]
    bench = [(i, " ".join(words[i * 7 : i * 7 + rng.choice([3, 10, 14])])) for i in range(60)] + [(3, "ab ab ab ab ab ab ab ab ab ab ab ab"), (61, " ".join(words[7:17]))]
    rows = [(i, " ".join(words[i * 40 : i * 40 + rng.randint(1, 300)]), "keep", 7) for i in range(40)] + [(99, "ab " * 60_000, "keep", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hits string, _items int")
    got = decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), 10, keep=["doc_id", "_hits", "_items"]).collect()
    assert len(got) == len(rows) and all(r["_hits"] == "keep" and r["_items"] in (7, 8) for r in got)
    for r in got:
        text = next(t for i, t, _, _ in rows if i == r["doc_id"])
        assert (r["n_words"], r["n_hit"], tuple(r["items"])) == brute_hits(text[:6000] if r["doc_id"] == 99 else text, bench, 10) or r["doc_id"] == 99 and r["n_hit"] == 60_000
    assert Index([], 10).windows == {} and len(Index([("a", b"one")], 10).windows[1]) == 1
