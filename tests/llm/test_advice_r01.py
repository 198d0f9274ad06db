"""What the first review found missing in the training-data operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import neardup


def crafted(rng, base, agree, table=(0, 12)):
    """A signature that has base's minhashes in both half-keys of the table and in so many places in all, but in no other whole half-key."""
    sig = rng.integers(1 << 31, 1 << 32, 72, np.uint64).astype(np.uint32)
    keep = [i for h in table for i in range(3 * h, 3 * h + 3)]
    rest = [i for i in range(72) if i % 3 < 2 and i not in keep]
    for i in keep + rest[: agree - len(keep)]:
        sig[i] = base[i]
    return sig


@pytest.mark.parametrize("with_centre", [6, 36])
def test_linked_texts_meet_beside_a_third_centre(spark, with_centre):
    """Many unlike texts share a table with two linked ones, and the bucket's centre is none of the two. 36: one is near the centre, the other isn't."""
    rng = np.random.default_rng(3)
    same = [f"w{i}" for i in range(120)]
    other = [*same[:-5], *(f"v{i}" for i in range(5))]
    texts = [" ".join(same), " ".join(other)] + [" ".join(f"t{k}x{i}" for i in range(60)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_hash = [r["id"] for r in spark.range(200).orderBy(F.xxhash64("id").desc()).collect()]  # the last one becomes the centre
    x = rng.integers(0, 1 << 31, 72, np.uint64).astype(np.uint32)
    y = crafted(rng, x, 50)
    centre = crafted(rng, x, with_centre)
    centre[[i for i in range(72) if i >= 6 and centre[i] == x[i] == y[i] and i % 2 and i not in (36, 37, 38)]] = 7
    if with_centre == 36:  # near x only
        centre[np.flatnonzero((centre != x) & (y != x))[:12]] = x[np.flatnonzero((centre != x) & (y != x))[:12]]
        assert (centre == x).mean() >= neardup.NEAR > (centre == y).mean()
    sigs = [x, y] + [crafted(rng, x, 6) for _ in range(39)] + [centre]
    nodes = by_hash[:41] + by_hash[-1:]
    sketched = {r["id"]: r for r in neardup.sketches(docs, 4, "doc_id", "text").collect()}
    rows = [(nodes[i], sketched[i]["class"], bytearray(sigs[i].tobytes()), i, sketched[i]["n_shingles"]) for i in range(42)]
    classes = spark.createDataFrame(rows, "node long, class string, sig binary, id long, n long")
    found = neardup.links(docs, classes, 4, 80, "doc_id", "text").collect()
    assert {frozenset(r) for r in found} == {frozenset(nodes[:2])}


def test_texts_with_an_added_token(spark):
    import zlib

    import public_tokenizers as P
    from tokenizers import Tokenizer

    from gridloom.llm import store

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json_text = f.read()
    texts = ["a b c", "a <|endoftext|> b", None, "", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endof", "text|> z"]
    whole = Tokenizer.from_str(json_text)
    wanted = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert 50256 in wanted[1]
    path = store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), json_text, P.PATTERN, 2)
    assert {r["id"]: list(r["ids"]) for r in store.read_ids(spark, path).collect()} == wanted
    got = {r["id"]: r for r in store.read_store(spark, path).collect()}
    assert all(r["verified"] and r["ids_crc32"] == zlib.crc32(np.array(wanted[i], "<u4").tobytes()) and r["start"] == sum(len(wanted[j]) for j in range(i)) for i, r in got.items())


KEY = "kJ8sd7GhPq2LmN4xVz9RtYb3Wc6Fh5Ds0QaUeXo1"
FOUND = [  # text, and what of it is found
    (f"at /{KEY[1:]} end", f"/{KEY[1:]}"),
    (f"at /home/u/{KEY} end", KEY),
    (f"see http://localhost/u/{KEY} end", KEY),
    (f"split {KEY[:20]}/{KEY[20:]} end", f"{KEY[:20]}/{KEY[20:]}"),
    (f"in {KEY}xxxx end", f"{KEY}xxxx"),
    (f"in {KEY}example0123456789 end", f"{KEY}example0123456789"),
    ("seed JBSWY3DPEHPK3PXPKRUGS4ZANFZSA5DF end", "JBSWY3DPEHPK3PXPKRUGS4ZANFZSA5DF"),
    ("id 9x2kq7vw4m1zt8bj3rc6yh5nd0pf end", "9x2kq7vw4m1zt8bj3rc6yh5nd0pf"),
    ("the /usr/local/share/readers/annual-report2024/notes end", None),
    ("an example-placeholder-xxxx-xxxx-xxxx end", None),
    ("id 550e8400-e29b-41d4-a716-446655440000 end", None),
]


def test_entropy_of_paths_placeholders_and_one_case(spark):
    from gridloom.llm import secrets

    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert [[t[s["start"] : s["end"]] for s in out[i]] for i, (t, _) in enumerate(FOUND)] == [[x] if x else [] for _, x in FOUND]
