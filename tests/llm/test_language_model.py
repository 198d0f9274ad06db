"""The language model against a naive scorer, at any partition count, and without one of its parts."""

import collections
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import mixing
from gridloom.llm.common import coded, mixed, word_hashes
from tests.llm.test_operators import make


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def naive(rows, spelled, rates, without=()):
    """log10 of each row's probability, a token and a bit at a time, from plain dictionaries."""
    grams = [collections.Counter() for _ in rows]
    padded = [[None, None, *tokens_of(t)] for _, t in rows]
    for words, count in zip(padded, grams):
        for j in range(2, len(words)):
            for k in range(3):
                count[tuple(words[j - k : j + 1])] += 1
            for k in range(1, 3):
                count[("behind", *words[j - k : j])] += 1
        count[()] = len(words) - 2
    corpus = collections.Counter()
    for (i, _), count in zip(rows, grams):
        if not mixing.is_held(i):
            corpus.update(count)
    out = []
    for (i, _), words, own in zip(rows, padded, grams):
        known = collections.Counter(corpus)
        if not mixing.is_held(i):
            known.subtract(own)
        counters, weights, steps, past, total = {}, {}, collections.Counter(), (0, 0), 0.0
        for j in range(2, len(words)):
            if (j - 2) % mixing.STRIDE == 0:
                for (gate, n), x in steps.items():
                    weights[gate][n] += x if "refining" not in without else 0
                steps.clear()
            level = 0
            for k in (2, 1, 0):
                n = known[("behind", *words[j - k : j])] if k else known[()]
                c = known[tuple(words[j - k : j + 1])]
                if n <= 0:
                    continue
                size = min(int(math.log2(n)), mixing.SIZES - 1)
                w = weights.setdefault((k, past[0]), list(mixing.START))
                x = [math.log(rates[k] / (1 - rates[k]))]
                for context in (("size", k, size), ("past", k, *past)):
                    seen, hits = counters.get(context, (0, 0))
                    p = (hits + mixing.PRIOR * rates[k]) / (seen + mixing.PRIOR)
                    x.append(math.log(p / (1 - p)))
                x.append(size - 2.0)
                x = [0.0 if name in without else v for name, v in zip(("known", "frequency", "past", "size"), x)]
                p = 1 / (1 + math.exp(-max(-14, min(14, sum(a * b for a, b in zip(w, x))))))
                p = min(max(p, 1e-6), 1 - 1e-6)
                y = c > 0
                total += math.log10(p if y else 1 - p)
                for m in range(4):
                    steps[((k, past[0]), m)] += mixing.RATE * (y - p) * x[m]
                for context in (("size", k, size), ("past", k, *past)):
                    seen, hits = counters.get(context, (0, 0))
                    counters[context] = (seen + 1, hits + y)
                if y:
                    level = k + 1
                    total += math.log10(c / n)
                    break
            if not level:
                total += spelled[words[j]]
            past = (level, past[0])
            for k in range(3):
                known[tuple(words[j - k : j + 1])] += 1
            for k in range(1, 3):
                known[("behind", *words[j - k : j])] += 1
            known[()] += 1
        out.append(total)
    return out


def fitted(rows):
    """The letters' model and the corpus's rates, from plain counts."""
    train = [tokens_of(t) for i, t in rows if not mixing.is_held(i)]
    count = collections.Counter(w for words in train for w in words)
    n = sum(count.values())
    once = []
    for k in range(3):
        grams = collections.Counter(tuple([None, None, *words][j + 2 - k : j + 3]) for words in train for j in range(len(words)))
        once.append(sum(c == 1 for c in grams.values()))
    rates = np.clip(1 - np.array(once) / max(n, 1), 0.02, 0.98)
    tables = np.zeros((2, mixing.BASES[-1]))
    for w, c in count.items():
        nodes, bit, _ = mixing.events([w])
        for k in range(5):
            np.add.at(tables, (bit, nodes[k]), c)
    zeros, ones = tables.astype(np.float32)
    order = sorted(count, key=lambda w: (int(mixed(word_hashes([w]) + np.uint64(5))[0]), w))
    model = mixing.fit_letters(order, np.array([count[w] for w in order]), zeros, ones)
    every = sorted({w for _, t in rows for w in tokens_of(t)})
    return dict(zip(every, mixing.spell(model, every).astype(np.float32).tolist())), rates


@pytest.fixture(scope="module")
def rows():
    return [r for r in make(seed=4, n=80) if r[0] is not None]


def test_scores_equal_the_naive_ones_at_any_partition_count(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "TOKENS_AT_ONCE", 300)
    monkeypatch.setattr(mixing, "ROOM", 30)  # no two contexts share a slot
    spelled, rates = fitted(rows)
    wanted = sorted(round(x, 5) for x in naive(rows, spelled, rates))
    for parts in (1, 7):
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, block int").repartition(parts)
        got = sorted(round(r["score"], 5) for r in mixing.score(docs, buckets=3 + parts).collect())
        assert np.allclose(got, wanted, atol=2e-4)


def test_each_part_helps(monkeypatch):
    """On held-out texts: without a predictor, the refining of weights or the contexts of words, they cost more."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    held = np.array([mixing.is_held(i) for i in table.column("doc_id").to_pylist()])
    words, codes, starts = coded([tokens_of(t) for t in table.column("text").to_pylist()])
    code, owner, h, bits = codes.astype(np.int64), np.repeat(np.arange(len(held)), np.diff(starts)), word_hashes(words), 40
    mine = ~held[owner]
    slots, inverse = np.unique(mixing.context_keys(h[code], starts, bits).ravel(), return_inverse=True)
    totals, count = np.bincount(inverse, np.tile(mine, 2)).astype(np.int64), np.bincount(code, mine, len(words)).astype(np.int64)
    seen, context = mixing.own_counts(count[code], totals, h[code], code, starts, owner, mine, bits, int(mine.sum()), int((~held).sum()))
    once = [(count == 1).sum(), *((totals[(slots & np.uint64(1)) == k] == 1).sum() for k in (0, 1))]
    rates = np.clip(1 - np.array(once) / mine.sum(), 0.02, 0.98)

    def cost(start=mixing.START, rate=0.0, contexts=3):
        monkeypatch.setattr(mixing, "START", start)
        known = context * (np.arange(3) < contexts)[:, None]
        return -mixing.mixed_words(seen, known, starts, np.full(len(code), -5.5), rates, rate)[held[owner]].sum()

    full, (_, frequency, past, _) = cost(), mixing.START
    assert cost(rate=mixing.RATE) < full
    assert cost((0, frequency, 0, 0)) > 1.001 * full and cost((0, 0, past, 0)) > 1.001 * full
    assert cost(contexts=2) > 1.005 * full and cost(contexts=1) > 1.1 * cost(contexts=2)
