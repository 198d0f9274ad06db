"""Language-model scoring by logistic context mixing.

A text is its words in lower case and one end. Three layers of bits spell it out, each bit predicted by several contexts
whose predictions are mixed in the logistic domain.

- Words: whether the corpus, or the text so far, has the token behind the two words before it; if not, behind the one word
  before it; if not, anywhere. Counts of all hashed word pairs and triples of the training part are gathered, so they grow
  with the corpus. Each of these bits is predicted by the corpus's own rate, by how often the text's bits came true under
  as frequent a context, by the same after the last two tokens' outcomes, and by the context's frequency; weights that a
  gate picks are refined as the text goes on. A token that is known takes its share of the context's counts.
- Letters: a token that nothing knows is spelled as bytes and a terminator, a byte as eight bits; hashed contexts (place,
  and the last one to four bytes) predict each bit from counts over the training part's words, mixed by gated weights and
  refined by a probability map.

Of a training document its own counts are taken away first, so every text is predicted from the others and its own
beginning only; a text that occurs twice costs next to nothing."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, deleted, mixed, released, shared, shuffle_width, texts, word_hashes, words, written
from .lexicon import distinct_in, pack, put_together, words_of
from .pieces import packed, unpacked, unzipped, zipped

#: Nodes of each letter context's table: place, then the last one, two, three and four bytes.
TABLES = (1 << 12, 1 << 16, 1 << 18, 1 << 19, 1 << 20)
BASES = tuple(int(x) for x in np.cumsum((0, *TABLES)))
GATES, STEPS = 32, 33
END, TERMINATOR = b"", 32
#: Segments of the node tables, Newton steps for the letters' weights, and parts of 1 in their sums.
SEGMENTS, ROUNDS, FIXED = 32, 3, 1 << 16
#: Bits of a letter's number; letters that are sorted at once, or kept by a task; and events that are predicted at once.
KEY_BITS, LETTERS, EVENTS = 44, 1 << 19, 1 << 16
HELD_MODULUS, HELD = 7, 2
#: Slots of hashed word pairs and triples for each byte of text, as a power of two; the most bits of a slot's number.
ROOM, MOST_BITS = 6, 56
#: Of the words' bits: inputs, outcomes (known behind two words, behind one, at all, or not), steps of frequency, tokens between two refinements, and the rate.
INPUTS, LEVELS, SIZES, STRIDE, RATE = 4, 4, 8, 32, 0.005
#: Tokens whose bits are mixed at once, unless a single text has more.
TOKENS_AT_ONCE = 200_000
#: Weights that every text begins with, and how many bits the corpus's rate counts for in a text's own counters.
START, PRIOR = (0.0, 0.5, 0.6, 0.0), 2.0
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Spelling:
    """Counts of zero and one bits by node, the gates' weights (the last is a bias) and the probability map."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refined: np.ndarray


def letters(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all bytes of the words and their terminators: place (15 at most), the four bytes before and the byte itself in one
    number, all that a spelling's contexts know; and the word's number."""
    lengths = np.fromiter((len(w) + 1 for w in spelled), np.int64, len(spelled))
    flat = np.frombuffer(b"".join([w + b" " for w in spelled]), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(spelled)), lengths)
    place = np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[owner]
    key = flat.copy()
    for k in range(1, 5):
        key[k:] |= flat[:-k] << np.uint64(8 * k)
    key &= np.array([(1 << 8 * (k + 1)) - 1 for k in range(5)], np.uint64)[np.minimum(place, 4)]
    return key | np.minimum(place, 15).astype(np.uint64) << np.uint64(40), owner


def nodes_of(keys: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bit of each letter (0: the highest): the nodes of all contexts, and its value."""
    at = bit.astype(np.uint64)
    byte = keys & np.uint64(255)
    node = (np.uint64(1) << at) | (byte >> (np.uint64(8) - at))
    before = [(keys >> np.uint64(8 * k)) & np.uint64(255) for k in range(1, 5)]
    context = [keys >> np.uint64(40), before[0]]
    for b in before[1:]:
        context.append(context[-1] * np.uint64(257) + b + np.uint64(1))
    nodes = np.empty((5, len(keys)), np.int64)
    for k in range(5):
        h = context[k] * np.uint64(256) + node
        if k > 1:
            h *= np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) >> np.uint64(8) & np.uint64(TABLES[k] - 1)
        nodes[k] = h
        nodes[k] += BASES[k]
    return nodes, ((byte >> (np.uint64(7) - at)) & np.uint64(1)).astype(np.uint8)


def events(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bits of the words and their terminators: the nodes of all contexts, the bit, and the word's number."""
    keys, owner = letters(spelled)
    return *nodes_of(np.repeat(keys, 8), np.tile(np.arange(8), len(keys))), np.repeat(owner, 8)


def stretches(spelled: list[bytes]) -> list[tuple[int, int]]:
    """The words cut so that each part has about LETTERS bytes, unless a single word has more."""
    part = np.cumsum(np.fromiter((len(w) + 1 for w in spelled), np.int64, len(spelled))) // LETTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(spelled)] if spelled else []
    return list(zip(cuts, cuts[1:]))


def gathered(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct letters in ascending order, and the sums of their values."""
    ordered, order = sorted_places(keys, KEY_BITS)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return ordered[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def letters_of(spelled: list[bytes], count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct letters of the words in ascending order, their tokens, and the sums of their words' weights (1 / FIXED).

    A word weighs the root of its count."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in stretches(spelled):
        keys, owner = letters(spelled[a:b])
        weight = np.rint(np.sqrt(count[a:b].astype(float)) * FIXED).astype(np.int64)
        parts.append(gathered(keys, count[a:b][owner], weight[owner]))
    return gathered(*(np.concatenate(x) for x in zip(*parts)))


def beginnings(keys: np.ndarray) -> list[np.ndarray]:
    """Of distinct letters in ascending order, for each bit of a byte: those that differ from the one before in it or a
    higher bit. The others share this event, its nodes and its value, with the last of them."""
    out = []
    for bit in range(8):
        begun = keys >> np.uint64(7 - bit)
        new = np.ones(len(keys), bool)
        new[1:] = begun[1:] != begun[:-1]
        out.append(np.flatnonzero(new))
    return out


def events_of(keys: np.ndarray, first: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The letter and the bit of each event, by bits; first: beginnings."""
    return np.concatenate([keys[f] for f in first]), np.repeat(np.arange(8), [len(f) for f in first])


def summed_events(keys: np.ndarray, values: np.ndarray):
    """The letters, bits and sums of the values of at most EVENTS events after another, from about LETTERS letters at once.

    Letters are distinct and in ascending order. Those of one context are never parted, so every event comes once."""
    begun = np.flatnonzero(np.diff(keys >> np.uint64(8))) + 1
    cuts = begun[np.unique(np.searchsorted(begun, np.arange(LETTERS, len(keys), LETTERS)).clip(max=len(begun) - 1))] if len(begun) else begun
    cuts = [0, *cuts.tolist(), len(keys)] if len(keys) else []
    for a, b in zip(cuts, cuts[1:]):
        first = beginnings(keys[a:b])
        key, bit = events_of(keys[a:b], first)
        total = np.concatenate([np.add.reduceat(values[a:b], f) for f in first])
        for at in range(0, len(key), EVENTS):
            yield key[at : at + EVENTS], bit[at : at + EVENTS], total[at : at + EVENTS]


def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts' predictions, stretched, with a constant; and each event's gate."""
    x = np.empty((6, zeros.shape[1]), np.float32)
    np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2)), out=x[:5])
    x[5] = 0.3
    seen = np.log2(zeros[3:] + ones[3:] + 1)
    return x, np.minimum(seen[1], 7).astype(np.int64) * 4 + np.minimum(seen[0] / 3, 3).astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def step_of(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x * 2), -16, 16).astype(np.int64) + 16


def voted(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The inputs' sum by their gate's weights, in an order that doesn't depend on how many events there are."""
    w = weights.astype(np.float32)
    out = x[0] * w[gate, 0]
    for k in range(1, len(x)):
        out += x[k] * w[gate, k]
    return out


def spell(model: Spelling, spelled: list[bytes]) -> np.ndarray:
    """log10 of each word's probability, its terminator included. Each distinct letter is predicted once."""
    out = np.zeros(len(spelled))
    for a, b in stretches(spelled):
        keys, owner = letters(spelled[a:b])
        ordered, order = sorted_places(keys, KEY_BITS)
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        distinct = ordered[new]
        first = beginnings(distinct)
        key, bit = events_of(distinct, first)
        cost = np.empty(len(key))
        for at in range(0, len(key), EVENTS):
            nodes, value = nodes_of(key[at : at + EVENTS], bit[at : at + EVENTS])
            x, gate = inputs(model.zeros[nodes], model.ones[nodes])
            dot = voted(x, gate, model.weights)
            p = squash((dot + model.refined[gate, step_of(dot)]) / 2)
            cost[at : at + EVENTS] = np.log10(np.where(value, p, 1 - p))
        each, at = np.zeros(len(distinct)), 0
        for f in first:
            each += np.repeat(cost[at : at + len(f)], np.diff(np.append(f, len(distinct))))
            at += len(f)
        letter = np.empty(len(keys))
        letter[order] = each[np.cumsum(new) - 1]
        out[a:b] = np.bincount(owner, letter, b - a)
    return out


def _letters(lexicon: DataFrame, buckets: int | None = None) -> DataFrame:
    """(part, keys, counts, weights): letters_of all training words; letters of one context are on one row.

    Tasks sum equal letters before they send them, so what is sent and kept grows with the distinct ones."""
    parts = buckets or 4 * shuffle_width(lexicon.sparkSession)

    def dealt(keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        part, order = sorted_places(mixed(keys >> np.uint64(8)) % np.uint64(parts), parts.bit_length())
        groups = np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []
        return pa.record_batch({"part": pa.array(np.unique(part).astype(np.int32)), "keys": pa.array([zipped(np.diff(keys[g], prepend=np.uint64(0))) for g in groups], pa.binary()), "counts": pa.array([zipped(counts[g]) for g in groups], pa.binary()), "weights": pa.array([zipped(weights[g]) for g in groups], pa.binary())})

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            for x, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                spelled, count = unpacked(x).to_pylist(), unzipped(c, np.int64)
                kept.append(letters_of([spelled[i] for i in np.flatnonzero(count)], count[count > 0]))
                size += len(kept[-1][0])
                if size > 2 * LETTERS:
                    kept = [gathered(*(np.concatenate(v) for v in zip(*kept)))]
                    size = len(kept[0][0])
                    if size > LETTERS:
                        yield dealt(*kept[0])
                        kept, size = [], 0
        if kept:
            yield dealt(*gathered(*(np.concatenate(v) for v in zip(*kept))))
        released()

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unzipped(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()])
        keys, *sums = gathered(keys, *(np.concatenate([unzipped(x, np.int64) for x in table.column(k).to_pylist()]) for k in ("counts", "weights")))
        return pa.table({"part": table.column("part")[:1], "keys": pa.array([zipped(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([zipped(sums[0])], pa.binary()), "weights": pa.array([zipped(sums[1])], pa.binary())})

    schema = "part int, keys binary, counts binary, weights binary"
    few = lexicon.select("words", "counts").coalesce(max(2, shuffle_width(lexicon.sparkSession) // 2))
    return written(few.mapInArrow(run, schema).groupBy("part").applyInArrow(total, schema), "letters")


def _counted(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zero and one bits by node, over all training tokens: partial tables in segments, summed by segment. found: _letters."""
    size = BASES[-1]
    edge = np.linspace(0, size, SEGMENTS + 1).astype(int)

    def partial(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for x, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                for key, bit, count in summed_events(np.cumsum(unzipped(x, np.uint64), dtype=np.uint64), unzipped(c, np.int64)):
                    nodes, value = nodes_of(key, bit)
                    for k in range(5):
                        np.add.at(total.reshape(-1), value * np.int64(size) + nodes[k], count)
        yield pa.record_batch({"segment": pa.array(range(SEGMENTS), pa.int32()), "counts": pa.array([zipped(total[:, a:b].ravel()) for a, b in zip(edge, edge[1:])], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        total = sum(unzipped(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"segment": table.column("segment")[:1], "counts": pa.array([zipped(total)], pa.binary())})

    few = found.select("keys", "counts").coalesce(max(2, shuffle_width(found.sparkSession) // 2))
    rows = few.mapInArrow(partial, "segment int, counts binary").groupBy("segment").applyInArrow(summed, "segment int, counts binary").collect()  # SEGMENTS rows of fixed size
    out = np.zeros((2, size), np.float32)
    for r in rows:
        out[:, edge[r["segment"]] : edge[r["segment"] + 1]] = unzipped(r["counts"], np.int64).reshape(2, -1)
    return out[0], out[1]


def letter_sums(keys: np.ndarray, weights: np.ndarray, zeros: np.ndarray, ones: np.ndarray, w: np.ndarray, last: bool) -> np.ndarray:
    """Sums over the letters' bits under the weights w: by gate, slopes and curvatures of the loss; last: the map's weights.

    Letters are distinct and in ascending order, with the sums of their words' weights; those of one context come together.
    Every word is predicted as if one of its tokens hadn't been counted. Sums are whole numbers (1 / FIXED), so that they
    don't depend on how the letters are dealt out."""
    total = np.zeros((2, GATES * STEPS) if last else (6 + 36, GATES), np.int64)
    for key, place, heavy in summed_events(keys, weights):
        nodes, bit = nodes_of(key, place)
        one = bit.astype(np.float32)
        x, gate = inputs(np.maximum(zeros[nodes] - (1 - one), 0), np.maximum(ones[nodes] - one, 0))
        dot = voted(x, gate, w)
        if last:
            np.add.at(total.reshape(-1), (bit * np.int64(GATES) + gate) * STEPS + step_of(dot), heavy)
            continue
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        gate, x, heavy = gate[order], x[:, order], heavy[order]
        edge = np.flatnonzero(np.diff(gate, prepend=-1))
        guess = squash(dot[order].astype(float))
        error, bend = (bit[order] - guess) * heavy, guess * (1 - guess) * heavy
        for k in range(6):
            total[k, gate[edge]] += np.add.reduceat(np.rint(error * x[k]).astype(np.int64), edge)
            bent = bend * x[k]
            for m in range(k + 1):
                total[6 + 6 * k + m, gate[edge]] += np.add.reduceat(np.rint(bent * x[m]).astype(np.int64), edge)
    return total


def fitted_letters(sums, zeros: np.ndarray, ones: np.ndarray) -> Spelling:
    """Gates' weights by Newton's method, then the probability map; sums(w, last): letter_sums over all training letters."""
    start = np.full((GATES, 6), 0.25)
    start[:, 5] = 0
    w = start
    for _ in range(ROUNDS):
        total = sums(w, False) / FIXED
        bend = total[6:].reshape(6, 6, GATES)
        bend = bend + np.tril(np.ones((6, 6)), -1).T[:, :, None] * bend.transpose(1, 0, 2)
        bend = bend.transpose(2, 0, 1) + 50 * np.eye(6)  # a gate with few bits stays near the start
        w = w + np.linalg.solve(bend, (total[:6].T - 50 * (w - start))[:, :, None])[:, :, 0]
    table = (sums(w, True) / FIXED).reshape(2, GATES, STEPS)
    own = 20 * squash((np.arange(STEPS) - 16) / 2)
    return Spelling(zeros, ones, w, np.log((table[1] + own) / (table[0] + 20 - own)))


def fit_letters(spelled: list[bytes], count: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Spelling:
    """Gates' weights and the probability map, learned from these words, in any order."""
    keys, _, weights = letters_of(spelled, count)
    return fitted_letters(lambda w, last: letter_sums(keys, weights, zeros, ones, w, last), zeros, ones)


def _fitted(lexicon: DataFrame, zeros: np.ndarray | None = None, ones: np.ndarray | None = None, buckets: int | None = None) -> Spelling:
    """fit_letters over all training words of the lexicon, with its own counts unless others are given: each task sends its
    sums, of fixed size."""
    spark = lexicon.sparkSession
    found = _letters(lexicon, buckets)
    if zeros is None:
        zeros, ones = _counted(found)
    tables = shared(spark, (zeros, ones))
    few = found.select("keys", "weights").coalesce(max(2, shuffle_width(spark) // 2))

    def sums(w: np.ndarray, last: bool) -> np.ndarray:
        empty = letter_sums(np.zeros(0, np.uint64), np.zeros(0, np.int64), zeros, ones, w, last)
        shape = empty.shape

        def partial(batches):
            total = np.zeros(shape, np.int64)
            for batch in batches:
                for x, y in zip(batch.column("keys").to_pylist(), batch.column("weights").to_pylist()):
                    total += letter_sums(np.cumsum(unzipped(x, np.uint64), dtype=np.uint64), unzipped(y, np.int64), *tables(), w, last)
            yield pa.record_batch({"sums": pa.array([zipped(total.ravel())], pa.binary())})

        return sum((unzipped(r["sums"], np.int64).reshape(shape) for r in few.mapInArrow(partial, "sums binary").collect()), empty)

    model = fitted_letters(sums, zeros, ones)
    deleted(spark, found._written)
    return model


def context_keys(h: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """(2, tokens): the slot of each token with the word before it, and with the two before it; the last bit tells which.

    h: hashes of the tokens. Where a document has no word before, a constant stands for it."""
    before = np.empty((2, len(h)), np.uint64)
    for k, last in enumerate((h, before[0])):
        before[k, 1:] = last[:-1]
        before[k, starts[:-1]] = 0
    one = mixed(mixed(before[0] * _ODD + np.uint64(1)) + h)
    two = mixed(mixed(mixed(before[1] * _ODD + np.uint64(2)) + before[0]) + h)
    keys = np.stack([one, two]) >> np.uint64(65 - bits)
    return (keys << np.uint64(1)) | np.arange(2, dtype=np.uint64)[:, None]


def sorted_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys in ascending order, and the place of each; equal keys keep their order."""
    room = max(1, int(len(keys) - 1).bit_length())
    if bits + room <= 64:  # much faster than a stable sort
        both = np.sort((keys << np.uint64(room)) | np.arange(len(keys), dtype=np.uint64))
        return both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def runs(sorted_keys: np.ndarray, order: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in order: each place's number of its key, how many places of its owner have the key, and how many of them come before."""
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    fresh = new.copy()
    fresh[1:] |= owner[order[1:]] != owner[order[:-1]]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    number, own, rank = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    own[order] = np.repeat(size, size)
    rank[order] = np.arange(n) - np.repeat(first, size)
    return number, own, rank


def _counters(context: np.ndarray, contexts: int, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit, how many bits of its document came before under its context, and how many of them were ones."""
    key = (doc * contexts + context).astype(np.uint64)
    ordered, order = sorted_places(key, int(key.max(initial=0)).bit_length())
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    ones = np.append(0, np.cumsum(y[order]))
    seen, hits = np.empty(len(key)), np.empty(len(key))
    seen[order] = np.arange(len(key)) - first
    hits[order] = ones[:-1] - ones[first]
    return seen, hits


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def refined(x: np.ndarray, gate: np.ndarray, y: np.ndarray, doc: np.ndarray, token: np.ndarray, rate: float = RATE) -> np.ndarray:
    """The mixed probability of each bit. x: (bits, INPUTS); bits go by document and token (its place in the document).

    Weights belong to a document and a gate; every STRIDE tokens they take a step against the errors since the last one."""
    docs = int(doc.max(initial=-1)) + 1
    weight = np.tile(np.array(START), (docs * 3 * LEVELS, 1))
    at = doc * (3 * LEVELS) + gate
    out = np.empty(len(y))
    part = token // STRIDE
    # bits of equal part one after another; in each, documents in order
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(int(part.max(initial=-1)) + 2))
    for a, b in zip(edges, edges[1:]):
        rows = order[a:b]
        mine, xs = at[rows], x[rows]
        p = squash(np.einsum("ek,ek->e", xs, weight[mine]))
        out[rows] = p
        if b < len(order):
            used, inner = np.unique(mine, return_inverse=True)
            error = rate * (y[rows] - p)
            for k in range(INPUTS):
                weight[used, k] += np.bincount(inner, error * xs[:, k], len(used))
    return np.clip(out, 1e-6, 1 - 1e-6)


def mixed_words(counts: np.ndarray, totals: np.ndarray, starts: np.ndarray, spelled: np.ndarray, rates: np.ndarray, rate: float = RATE) -> np.ndarray:
    """log10 of each token's probability.

    counts, totals: (3, tokens), how often the token came at all, behind the word before it, and behind the two before it;
    and how often anything did. spelled: log10 of the token's spelling. rates: the corpus's share of known tokens, likewise."""
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    token = np.arange(len(doc)) - starts[:-1][doc]
    known = (counts > 0) & (totals > 0)
    level = np.where(known[2], 3, np.where(known[1], 2, np.where(known[0], 1, 0)))
    past = np.zeros((2, len(doc)), np.int64)
    for k, last in enumerate((level, past[0])):
        past[k, 1:] = last[:-1]
        past[k, starts[:-1]] = 0
    share = np.zeros(len(doc))
    rows, order = [], []
    for k in (2, 1, 0):
        asked = np.flatnonzero((level <= k + 1) & (totals[k] > 0))
        rows.append(asked)
        order.append(np.full(len(asked), k))
        here = np.flatnonzero(level == k + 1)
        share[here] = np.log10(np.minimum(counts[k, here] / totals[k, here], 1))
    share[level == 0] = spelled[level == 0]
    rows, order = np.concatenate(rows), np.concatenate(order)
    by = np.argsort(rows, kind="stable")
    rows, order = rows[by], order[by]
    y = (level[rows] == order + 1).astype(np.float64)
    size = np.minimum(np.log2(totals[order, rows]), SIZES - 1).astype(np.int64)
    known_rate = rates[order]
    x = np.empty((len(rows), INPUTS))
    x[:, 0] = stretch(known_rate)
    for j, (context, contexts) in enumerate(((order * SIZES + size, 3 * SIZES), ((order * LEVELS + past[0, rows]) * LEVELS + past[1, rows], 3 * LEVELS * LEVELS))):
        seen, hits = _counters(context, contexts, doc[rows], y)
        x[:, j + 1] = stretch((hits + PRIOR * known_rate) / (seen + PRIOR))
    x[:, 3] = size - 2.0
    p = refined(x, order * LEVELS + past[0, rows], y, doc[rows], token[rows], rate)
    return share + np.bincount(rows, np.log10(np.where(y > 0, p, 1 - p)), len(doc))


def is_held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_MODULUS == HELD


def _contexts(blocks: DataFrame, bits: int, buckets: int) -> DataFrame:
    """(block, digest, bucket, keys, counts): the slots of each block's word pairs and triples in ascending order, dealt out
    by ranges, and how many of its training tokens have each."""
    edges = np.array([(b << bits) // buckets // 2 * 2 for b in range(buckets + 1)], np.uint64)  # even, so that the last bit stays when they are taken away

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                sizes, pos = unzipped(row["sizes"], np.uint32).astype(np.int64), unzipped(row["pos"], np.uint32)
                hashes = np.zeros(int(pos.max()) + 1, np.uint64)  # every row has an end
                for x in row["lex"]:
                    hashes[unzipped(x["codes"], np.uint32)] = word_hashes(unpacked(x["words"]).to_pylist())
                starts = np.append(0, np.cumsum(sizes))
                keys = context_keys(hashes[pos], starts, bits).ravel()
                train = np.tile(np.repeat([not is_held(i) for i in row["ids"]], sizes), 2)
                distinct, inverse = np.unique(keys, return_inverse=True)
                count = np.bincount(inverse, train, len(distinct)).astype(np.uint32)
                cut = np.searchsorted(distinct, edges)
                some = np.flatnonzero(np.diff(cut))
                yield pa.record_batch({"block": pa.array([row["block"]] * len(some), pa.int64()), "digest": pa.array([row["digest"]] * len(some), pa.binary()), "bucket": pa.array(some, pa.int32()), "keys": pa.array([zipped(np.diff(distinct[cut[i] : cut[i + 1]], prepend=edges[i])) for i in some], pa.binary()), "counts": pa.array([zipped(count[cut[i] : cut[i + 1]]) for i in some], pa.binary())})
                del row, keys, train, distinct, inverse, count
                released()

    return blocks.select("block", "digest", "ids", "sizes", "pos", "lex").mapInArrow(run, "block long, digest binary, bucket int, keys binary, counts binary")


def _context_totals(contexts: DataFrame) -> DataFrame:
    """(block, digest, bucket, totals, pairs, triples): for each of the block's slots, how many training tokens have it in
    all; on one row of a bucket, how many of its pairs and triples only one training token has."""

    def total(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unzipped(x, np.uint64)) for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([unzipped(x, np.uint32) for x in table.column("counts").to_pylist()]), len(distinct)).astype(np.int64)
        once = np.bincount((distinct[count == 1] & np.uint64(1)).astype(np.int64), minlength=2)
        none = np.zeros(table.num_rows, np.int64)
        pairs, triples = none.copy(), none
        pairs[0], triples[0] = once
        out = pa.table({"block": table.column("block"), "digest": table.column("digest"), "bucket": table.column("bucket"), "totals": pa.array([zipped(count[x].astype(np.uint32)) for x in np.split(inverse, ends)], pa.binary()), "pairs": pa.array(pairs), "triples": pa.array(triples)})
        released()
        return out

    return contexts.groupBy("bucket").applyInArrow(total, "block long, digest binary, bucket int, totals binary, pairs long, triples long")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row for each row.

    Learns from the rows whose crc32(id as text) modulo 7 is not 2 (a null id: of the empty text). Words are
    [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end; a null or empty text is the end alone. base_score sums
    log10((c + 1) / (N + V + 1)), score is log10 of the text's probability under the model, bits_per_byte spreads it over
    the bytes of the words and ends. Rows that repeat an id or a text are rows of their own, and know each other's counts.
    Without training rows, words are spelled by untrained contexts. The score of a row depends on the table's rows only,
    not on how they are dealt out over tasks."""
    n_buckets = buckets or 4 * shuffle_width(docs.sparkSession)

    def split(part: pa.RecordBatch):
        return coded([[*words(t.lower()), END] for t in texts(part, text_col)])

    def trained(part: pa.RecordBatch, distinct: list[bytes], codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        held = np.array([is_held(i) for i in part.column(id_col).to_pylist()], bool)
        return np.bincount(codes[~np.repeat(held, np.diff(starts))], minlength=len(distinct)).astype(np.int64)

    def total(table: pa.Table) -> pa.Table:
        distinct, rows = distinct_in(table)
        count, blocks_with = np.zeros((2, len(distinct)), np.int64)
        for codes, more in zip(rows, table.column("more").to_pylist()):
            own = unzipped(more, np.int64)
            count[codes] += own
            blocks_with[codes] += own > 0
        spelled = distinct.to_pylist()
        ends = int(count[spelled.index(END)]) if END in spelled else 0
        out = pa.table({"bucket": table.column("bucket")[:1], "words": pa.array([packed(spelled)], pa.binary()), "counts": pa.array([zipped(count)], pa.binary()), "lone": pa.array([zipped((blocks_with <= 1).astype(np.uint8))], pa.binary()), "tokens": pa.array([int(count.sum())]), "types": pa.array([int((count > 0).sum())]), "once": pa.array([int((count == 1).sum())]), "ends": pa.array([ends])})
        released()
        return out

    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(20, int(size).bit_length() + ROOM))
    blocks = pack(docs, split, id_col, text_col, n_buckets, trained)
    by_bucket = words_of(blocks)
    lexicon = written(by_bucket.groupBy("bucket").applyInArrow(total, "bucket int, words binary, counts binary, lone binary, tokens long, types long, once long, ends long"), "lexicon")
    sums = lexicon.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("once").alias("o"), F.sum("ends").alias("d")).first()
    n, v, once, n_docs = (sums[k] or 0 for k in "nvod")
    contexts = written(_context_totals(_contexts(blocks, bits, n_buckets)), "contexts")
    rare = contexts.agg(F.sum("pairs").alias("pairs"), F.sum("triples").alias("triples")).first()
    rates = np.clip(1 - np.array([once, rare["pairs"] or 0, rare["triples"] or 0]) / max(n, 1), 0.02, 0.98)
    model = shared(docs.sparkSession, _fitted(lexicon, buckets=n_buckets))

    def valued(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sends each block what the lexicon has of its words."""
        known = unpacked(right.column("words")[0].as_py())
        count = unzipped(right.column("counts")[0].as_py(), np.int64)
        strings = known.to_pylist()
        # a word that several blocks train on is known to every text; the others may have to be spelled
        lone = np.flatnonzero(unzipped(right.column("lone")[0].as_py(), np.uint8))
        spelled, hashes = np.zeros(len(strings), np.float32), word_hashes(strings)
        spelled[lone] = spell(model(), [strings[i] for i in lone.tolist()])
        length = np.fromiter(map(len, strings), np.uint32, len(strings)) + np.uint32(1)
        rows = [pa.compute.index_in(unpacked(x), known).to_numpy(zero_copy_only=False) for x in left.column("words").to_pylist()]
        sent = {k: pa.array([zipped(a[r]) for r in rows], pa.binary()) for k, a in (("counts", count), ("spelled", spelled), ("sizes", length), ("hashes", hashes))}
        out = pa.table({"block": left.column("block"), "digest": left.column("digest"), "codes": left.column("codes")} | sent)
        del known, strings, rows, sent
        released()
        return out

    def build(ids: list, sizes: np.ndarray, pos: np.ndarray, rows: pa.Table) -> pa.Table:
        m = int(pos.max()) + 1  # every row has an end
        count, spelled, length, hashes = np.zeros(m, np.int64), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.uint64)
        own = rows.filter(pa.compute.is_null(rows.column("totals")))
        for codes, c, s, z, h in zip(*(own.column(k).to_pylist() for k in ("codes", "counts", "spelled", "sizes", "hashes"))):
            at = unzipped(codes, np.uint32)
            count[at], spelled[at], length[at], hashes[at] = unzipped(c, np.int64), unzipped(s, np.float32), unzipped(z, np.uint32), unzipped(h, np.uint64)
        of = rows.filter(pa.compute.is_valid(rows.column("totals"))).sort_by("bucket")
        totals = np.concatenate([unzipped(x, np.uint32) for x in of.column("totals").to_pylist()]).astype(np.int64)
        starts = np.append(0, np.cumsum(sizes))
        pos = pos.astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        held = np.array([is_held(i) for i in ids])
        mine = ~held[owner]  # tokens that the corpus's counts include
        seen, context = own_counts(count[pos], totals, hashes[pos], pos, starts, owner, mine, bits, n, n_docs)
        del totals
        got, lo = [], 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + TOKENS_AT_ONCE, side="right")) - 1)
            a, b = starts[lo], starts[hi]
            got.append(mixed_words(seen[:, a:b], context[:, a:b], starts[lo : hi + 1] - a, spelled[pos[a:b]], rates))
            lo = hi
        got = np.concatenate(got)
        del seen, context
        c = count[pos]
        base = np.bincount(owner, np.log10((c + 1) / (n + v + 1)), len(ids))
        full = np.bincount(owner, got, len(ids))
        size = np.bincount(owner, length[pos], len(ids))
        return pa.table({"id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(sizes), "n_known": pa.array(np.bincount(owner, c > 0, len(ids)).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(base), "score": pa.array(full), "bits_per_byte": pa.array(-full * np.log2(10) / np.maximum(size, 1))})

    values = by_bucket.select("block", "digest", "bucket", "codes", "words").groupBy("bucket").cogroup(lexicon.select("bucket", "words", "counts", "lone").groupBy("bucket")).applyInArrow(valued, "block long, digest binary, codes binary, counts binary, spelled binary, sizes binary, hashes binary")
    values = values.unionByName(contexts.select("block", "digest", "bucket", "totals"), allowMissingColumns=True)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return put_together(blocks, values, build, schema).withColumnRenamed("id", id_col)


def own_counts(count: np.ndarray, totals: np.ndarray, h: np.ndarray, code: np.ndarray, starts: np.ndarray, owner: np.ndarray, mine: np.ndarray, bits: int, n: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, tokens) twice: how often each token came at all, behind one word and behind two; and how often anything did.

    count: of the tokens in training, totals: of the sorted distinct slots of the block; h, code: hashes and numbers of the
    tokens. Every count is without the token's own document (mine: the corpus's counts include it), but with its beginning."""
    seen, context = np.empty((2, 3, len(code)), np.int64)

    def put(k: int, total: np.ndarray, own: np.ndarray, rank: np.ndarray) -> None:
        seen[k] = np.maximum(total - np.where(mine, own, 0), 0) + rank

    ordered, order = sorted_places(code.astype(np.uint64), max(1, int(code.max(initial=0)).bit_length()))
    _, own, rank = runs(ordered, order, owner)
    put(0, count, own, rank)
    keys = context_keys(h, starts, bits)
    ordered, order = sorted_places(keys.ravel(), bits)
    number, own, rank = runs(ordered, order, np.tile(owner, 2))
    total = totals[number].reshape(2, -1)
    own, rank = own.reshape(2, -1), rank.reshape(2, -1)
    for k in (1, 2):
        put(k, total[k - 1], own[k - 1], rank[k - 1])
    size = np.diff(starts)
    place = np.arange(len(code)) - starts[:-1][owner]
    context[0] = n - np.where(mine, size[owner], 0) + place
    first = starts[:-1]
    for k in (1, 2):  # what came before the token is the context of one word more
        context[k, 1:] = seen[k - 1, :-1]
        context[k, first] = n_docs - mine[first]
    return seen, context
