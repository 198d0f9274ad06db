"""Models against naive versions, and near-duplicates in large families."""

import collections
import math
import random
import re

import numpy as np
import pytest

from gridloom.llm import neardup, toxicity, weak
from gridloom.llm.stats import SYMBOLS
from tests.llm.test_operators import brute_components, counted, make


def test_no_planted_pair_of_a_family_is_lost(spark, monkeypatch):
    """Families of texts that share a passage (similarity about 0.3 and 0.5), pairs planted at 0.80, 0.86 and 0.90, many blocks."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 60)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts, pairs = [], collections.defaultdict(list)
    for common in (60, 84):
        passage = [word() for _ in range(common)]
        for i in range(260):
            words = passage + [word() for _ in range(123 - common)]
            texts.append(" ".join(words))
            for changed, of in ((13, range(40)), (9, range(40, 60)), (6, range(60, 80))):
                if i in of:
                    pairs[changed].append((len(texts) - 1, len(texts)))
                    texts.append(" ".join(words[:-changed] + [word() for _ in range(changed)]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()}
    assert {c: sum(got[a] == got[b] for a, b in p) / len(p) for c, p in pairs.items()} == {13: 1.0, 9: 1.0, 6: 1.0}
    assert len(set(got.values())) == len(rows) - sum(map(len, pairs.values()))


def test_blocks_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words))
    rows = [*enumerate(texts), (70, " ".join(base) * 400), (71, " ".join(base) * 400)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == counted(brute_components(rows, 4))


def naive_toxicity(net, text):
    """The score of a text: a window, a word and a step at a time."""
    p, sig = net.p, lambda x: 1 / (1 + np.exp(-x))
    words = [w for i, w in enumerate(found) if not i or w != found[i - 1]] if (found := re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())) else []
    best = -np.inf
    for begin in range(0, max(1, -(-max(0, len(words) - toxicity.WINDOW) // toxicity.STRIDE) + 1)):
        part = words[begin * toxicity.STRIDE :][: toxicity.WINDOW]
        x = toxicity.embedded(net, part)[:-1].astype(float)
        states = []
        for d, seq in (("f", x), ("b", x[::-1])):
            h, out = np.zeros(toxicity.H), []
            for row in seq:
                xw, hu = row @ p["w" + d] + p["b" + d], h @ p["u" + d]
                z, r = sig(xw[: toxicity.H] + hu[: toxicity.H]), sig(xw[toxicity.H : 2 * toxicity.H] + hu[toxicity.H : 2 * toxicity.H])
                h = (1 - z) * h + z * np.tanh(xw[2 * toxicity.H :] + r * hu[2 * toxicity.H :])
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        if not part:
            best = max(best, p["bo"][0])
            continue
        hid = np.concatenate(states, 1)
        e = np.exp(np.tanh(hid @ p["wa"]) @ p["va"])
        best = max(best, (e / e.sum()) @ hid @ p["vo"] + p["bo"][0])
    return 1 / (1 + math.exp(-(net.scale * best + net.shift)))


def ordered(rng, n):
    """Texts whose label is the order of two words: each class holds both as often as the other does."""
    rows = []
    for i in range(n):
        y = i % 2
        w = [rng.choice(["red", "blue", "stone", "river", "cloud", "seven", "paper", "light"]) for _ in range(rng.randint(3, 24))]
        at = rng.randint(0, len(w))
        rows.append((" ".join(w[:at] + (["vile", "you"] if y else ["you", "vile"]) + w[at:]).encode(), y))
    return rows


def test_the_network_learns_more_than_words(spark, monkeypatch):
    rng = random.Random(1)
    rows = ordered(rng, 1200)
    net = toxicity.fit_network([t for t, _ in rows[:900]], np.array([y for _, y in rows[:900]]), epochs=40, rate=0.03)
    got = np.array([naive_toxicity(net, t) > 0.5 for t, _ in rows[900:]])
    assert (got == np.array([y for _, y in rows[900:]])).mean() > 0.9  # the words alone would give a half
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    texts = [t.decode() for t, _ in rows[:20]] + [None, "", "É é vile you", "you " * 50 + "vile you " * 3000, " ".join(t.decode() for t, _ in rows[:200])]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id long, text string")
    for r in toxicity.toxicity(docs.coalesce(1), net, keep=["doc_id", "text"]).collect():
        assert abs(r["score"] - naive_toxicity(net, (r["text"] or "").encode())) < 1e-3
    assert toxicity.toxicity(docs, net).count() == 27


def naive_votes(text):
    t = text or ""
    b, w = t.encode(), t.encode().split()
    n, chars = max(1, len(w)), max(1, sum(len(x.decode(errors="replace")) for x in w))
    lines = [x for x in b.split(b"\n") if x.split()]
    n_lines = b.count(b"\n") + 1
    seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    repeat = {k for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    count = lambda of: sum(c in of for c in b)
    f = {
        "symbol_share": count(SYMBOLS) / chars, "repeat_share": len(repeat) / n, "dup_line_share": (len(lines) - len(set(lines))) / max(1, n_lines), "upper_share": count(bytes(range(65, 91))) / chars,
        "marked_share": sum(x[-1] in SYMBOLS + b"!" for x in w) / n, "distinct_share": len(set(w)) / n, "digit_share": count(bytes(range(48, 58))) / chars, "mean_word": sum(len(x.decode(errors="replace")) for x in w) / n, "log_words": math.log1p(len(w)),
    }
    out = []
    for name, side, bad, good in weak.LABELLERS:
        v = f[name]
        is_bad, is_good = (v >= bad, v <= good) if side == "above" else (v <= bad, v >= good)
        out.append(1 if is_good else 0 if is_bad else 2)
    return tuple(out)


def naive_posterior(votes, rounds=50):
    """Expectation-maximisation over documents one by one."""
    q = [min(0.98, max(0.02, (v.count(1) + 1) / (v.count(1) + 1 + 3 * v.count(0) + 0.5))) for v in votes]
    for _ in range(rounds):
        prior = min(0.95, max(0.05, sum(q) / len(q)))
        acc = {}
        for j in range(len(votes[0])):
            for c in (0, 1):
                n = [0.5] * 3
                for v, p in zip(votes, q):
                    n[v[j]] += p if c else 1 - p
                acc[j, c] = [x / sum(n) for x in n]
        q = []
        for v in votes:
            a, b = (math.log(pr) + sum(math.log(acc[j, c][x]) for j, x in enumerate(v)) for c, pr in ((0, 1 - prior), (1, prior)))
            q.append(1 / (1 + math.exp(a - b)))
    return q


def test_weak_labels_row_by_row(spark):
    rows = make(seed=11, n=40) + [(200 + i, t) for i, t in enumerate(["BUY NOW!!! $$$ " * 20, "#### $$ %% ||" * 9, "123 456 789 " * 30, "THE SAME LINE\n" * 12])]
    votes = [naive_votes(t) for _, t in rows]
    wanted = [(i, sum(x < 2 for x in v), round(p, 6)) for (i, _), v, p in zip(rows, votes, naive_posterior(votes))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, votes string, id int").repartition(3)
    got = weak.classify(docs).collect()
    assert counted((r["doc_id"], r["n_votes"], round(r["label_prob"], 6)) for r in got) == counted(wanted)
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)
