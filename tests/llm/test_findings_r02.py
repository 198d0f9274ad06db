"""What the second review found in the training-data operators."""

import numpy as np

from gridloom.llm import mixing, neardup
from gridloom.llm.pieces import packed, zipped


def crafted(rng, like, table, agree=0):
    """A signature with like's minhashes in both half-keys of the table and in so many other places, but in no other whole half-key."""
    sig = rng.integers(1 << 31, 1 << 32, 72, np.uint64).astype(np.uint32)
    keep = [i for h in table for i in range(3 * h, 3 * h + 3)]
    for i in keep + [i for i in range(72) if i % 3 < 2 and i not in keep][:agree]:
        sig[i] = like[i]
    return sig


def links_of(spark, texts, sigs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketched = {r["id"]: r for r in neardup.sketches(docs, 4, "doc_id", "text").collect()}
    rows = [(i, sketched[i]["class"], bytearray(s.tobytes()), i, sketched[i]["n_shingles"]) for i, s in enumerate(sigs)]
    classes = spark.createDataFrame(rows, "node long, class string, sig binary, id long, n long")
    return {frozenset(r) for r in neardup.links(docs, classes, 4, 80, "doc_id", "text").collect()}


def unlike(k):
    return " ".join(f"t{k}x{i}" for i in range(60))


def test_linked_texts_that_meet_others_only(spark):
    """Two linked texts each meet a text in some table, but share no table."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 31, 72, np.uint64).astype(np.uint32)
    y = crafted(rng, x, (), 44)
    sigs = [x, y, crafted(rng, x, (0, 12)), crafted(rng, y, (3, 15))]
    same = [f"w{i}" for i in range(120)]
    texts = [" ".join(same), " ".join([*same[:-5], *(f"v{i}" for i in range(5))]), unlike(0), unlike(1)]
    assert links_of(spark, texts, sigs) == {frozenset((0, 1))}


def test_unlike_texts_of_one_bucket_are_not_paired(spark, monkeypatch):
    """Texts that share a passage and a table, but are not linked: what is compared doesn't grow with their pairs."""
    compared = []
    shares = neardup._shares

    def counted(pairs, classes):
        compared.append(pairs.count())
        return shares(pairs, classes)

    monkeypatch.setattr(neardup, "_shares", counted)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 31, 72, np.uint64).astype(np.uint32)
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"{unlike(k)} {passage}" for k in range(60)]
    assert links_of(spark, texts, [x] + [crafted(rng, x, (0, 12)) for _ in texts[1:]]) == set()
    assert sum(compared) <= 2 * len(texts)


def test_sets_are_taken_once_from_repeated_ids(spark):
    """Rows that repeat an id and a text, and rows without ids, beside linked ones."""
    same = [f"w{i}" for i in range(60)]
    near = " ".join([*same[:-2], "v0", "v1"])
    rows = [(1, " ".join(same)), (1, " ".join(same)), (1, near), (None, near), (None, unlike(0)), (2, unlike(0) + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, 4).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted([(None, 1), (1, 1), (1, 1), (1, 1), (None, 2), (2, 2)], key=repr)


def test_letters_are_fitted_on_all_words(spark):
    """More distinct words than the 40,000 that the weights once came from; one row of the lexicon or several give the same."""
    spelled = [f"{'ab' if i % 3 else 'xyz'}{i:x}".encode() for i in range(45_000)]
    count = np.arange(45_000, dtype=np.int64) % 5 + 1
    rng = np.random.default_rng(7)
    zeros, ones = rng.integers(0, 50, (2, mixing.BASES[-1])).astype(np.float32)
    rows = [(bytearray(packed(spelled[a:b])), bytearray(zipped(count[a:b]))) for a, b in ((0, 20_000), (20_000, 45_000))]
    got = mixing._fitted(spark.createDataFrame(rows, "words binary, counts binary").repartition(2), zeros, ones)
    whole = mixing.fit_letters(spelled[::-1], count[::-1], zeros, ones)
    assert np.allclose(got.weights, whole.weights, atol=1e-6) and np.allclose(got.refined, whole.refined, atol=1e-6)
    part = mixing.fit_letters(spelled[:40_000], count[:40_000], zeros, ones)
    assert not np.allclose(part.weights, whole.weights, atol=1e-6)


def test_equal_letters_are_predicted_once(monkeypatch):
    """Words that share endings: their bits' sums come from distinct letters, and are those of all words' bits."""
    spelled = [f"{i:03}withacommonending{i % 3}".encode() for i in range(1000)] + [b"", b"x" * 3000]
    count = np.arange(1002, dtype=np.int64) % 7 + 1
    tables = np.zeros((2, mixing.BASES[-1]), np.float32)
    nodes, bit, owner = mixing.events(spelled)
    for k in range(5):
        np.add.at(tables, (bit, nodes[k]), count[owner])
    predicted, plain = [], mixing.inputs

    def counted(zeros, ones):
        predicted.append(zeros.shape[1])
        return plain(zeros, ones)

    monkeypatch.setattr(mixing, "inputs", counted)
    model = mixing.fit_letters(spelled, count, *tables)
    assert sum(predicted) < len(bit) / 2  # four passes
    predicted.clear()
    got = mixing.spell(model, spelled)
    assert sum(predicted) < len(bit) / 5
    one = bit.astype(np.float32)
    x, gate = plain(np.maximum(tables[0][nodes] - (1 - one), 0), np.maximum(tables[1][nodes] - one, 0))
    weight, w = np.sqrt(count)[owner], np.linspace(0.1, 0.4, mixing.GATES * 6).reshape(-1, 6)
    error = (bit - mixing.squash(np.einsum("ke,ek->e", x, w[gate]))) * weight
    keys, counts, weights = mixing.letters_of(spelled, count)
    whole = mixing.letter_sums(keys, weights, *tables, w, False)
    assert np.allclose(whole[:6] / mixing.FIXED, [np.bincount(gate, error * x[k], mixing.GATES) for k in range(6)], atol=0.01, rtol=1e-4)
    assert counts.sum() == (np.array([len(s) + 1 for s in spelled]) * count).sum()
    part = (keys >> np.uint64(8)) % np.uint64(3)
    assert (sum(mixing.letter_sums(keys[part == k], weights[part == k], *tables, w, False) for k in range(3)) == whole).all()
    monkeypatch.setattr(mixing, "LETTERS", 40)
    assert (mixing.letter_sums(keys, weights, *tables, w, False) == whole).all()
    x, gate = plain(tables[0][nodes], tables[1][nodes])
    dot = np.einsum("ke,ek->e", x, model.weights[gate].astype(np.float32))
    p = mixing.squash((dot + model.refined[gate, mixing.step_of(dot)]) / 2)
    assert np.isclose(got, np.bincount(owner, np.log10(np.where(bit, p, 1 - p)), len(spelled)), atol=1e-3).mean() > 0.99  # steps may round apart


def test_letters_are_summed_over_tasks(spark, monkeypatch):
    """Tasks that send their letters many times, and words of several stretches: tables and weights are those of all words."""
    monkeypatch.setattr(mixing, "LETTERS", 500)
    spelled = [f"{i * 7919 % 4001:x}é{i}".encode() for i in range(4000)]
    count = np.arange(4000, dtype=np.int64) % 4  # 0: not in training
    rows = [(bytearray(packed(spelled[a : a + 400])), bytearray(zipped(count[a : a + 400]))) for a in range(0, 4000, 400)]
    got = mixing._fitted(spark.createDataFrame(rows, "words binary, counts binary").repartition(3))
    kept = [s for s, c in zip(spelled, count) if c]
    tables = np.zeros((2, mixing.BASES[-1]), np.float32)
    nodes, bit, owner = mixing.events(kept)
    for k in range(5):
        np.add.at(tables, (bit, nodes[k]), count[count > 0][owner])
    assert (got.zeros == tables[0]).all() and (got.ones == tables[1]).all()
    whole = mixing.fit_letters(kept, count[count > 0], *tables)
    assert np.allclose(got.weights, whole.weights, atol=1e-9) and np.allclose(got.refined, whole.refined, atol=1e-9)
