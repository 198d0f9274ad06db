"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all overlapping windows.

A word's input is an embedding of the word, of its first four and its first six bytes, and the mean embedding of its
character trigrams, all hashed; a word that is repeated at once counts once. What fewer training documents than RARE hold has no embedding of its own. A document's
score is that of its worst window, calibrated on the training documents."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded, mapped, released, residue, shared, texts
from .pieces import gathered

#: Slots of words and of their beginnings; of trigrams; dimensions of an embedding and of a hidden state; documents that make a slot.
SLOTS = {"word": 1 << 17, "six": 1 << 16, "four": 1 << 15}
CHAR_SLOTS, D, H, RARE = 1 << 11, 8, 8, 6
INPUTS = (len(SLOTS) + 1) * D
#: Words of a window, and between the beginnings of two.
WINDOW, STRIDE = 32, 16
#: Windows that go through the network at once.
AT_ONCE = 2048
#: Labelled rows that the network is trained on at most, and bytes of their texts: those whose ids hash lowest, as long as
#: they fit; the driver holds no more.
TRAINING_ROWS, TRAINING_BYTES = 4000, 64 << 20
MODULUS, HELD = 3, 1
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass
class Network:
    """word, char: embeddings; for each direction w (input), u (hidden), b; attention and output; the calibration."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def slots(distinct: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Each word's slots by table; the slots of its trigrams one after another, and how many it has."""
    cut = {"word": None, "six": 6, "four": 4}
    own = {k: np.fromiter((zlib.crc32(w[:n]) % SLOTS[k] for w in distinct), np.int64, len(distinct)) for k, n in cut.items()}
    padded = [b"<" + w + b">" for w in distinct]
    count = np.fromiter((len(w) - 2 for w in padded), np.int64, len(padded))
    flat = np.frombuffer(b"".join(padded), np.uint8).astype(np.int64)
    first = np.cumsum(count + 2) - (count + 2)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    tri = ((flat[at] * 263 + flat[at + 1]) * 263 + flat[at + 2]) * 2654435761 % (1 << 32) % CHAR_SLOTS if len(at) else np.zeros(0, np.int64)
    return own, tri, count


def embedded(net: Network, distinct: list[bytes]) -> np.ndarray:
    """The input of each distinct word; the last row, zeros, is for places without a word."""
    out = np.zeros((len(distinct) + 1, INPUTS), np.float32)
    if distinct:
        own, tri, count = slots(distinct)
        for i, (k, at) in enumerate(own.items()):
            out[:-1, i * D : (i + 1) * D] = net.p[k][at]
        out[:-1, -D:] = np.add.reduceat(net.p["char"][tri], np.cumsum(count) - count) / count[:, None]
    return out


def collapsed(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the repeats of a word that directly follow it in its document."""
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[starts[:-1][starts[:-1] < len(codes)]] = True
    return codes[new], np.append(0, np.cumsum(new))[starts]


def windows(codes: np.ndarray, starts: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows' words (none: no word there) and each window's document; a document without words has one empty window."""
    n = np.diff(starts)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * STRIDE
    at = begin.astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    inside = at < n[doc][:, None]
    place = np.where(inside, at + starts[:-1].astype(np.int32)[doc][:, None], 0)
    return (np.where(inside, codes[place], none) if len(codes) else np.full(at.shape, none)).astype(np.int32), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _run(net: Network, d: str, xw: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states (time, window, H) of one direction. xw: (time, window, 3H) inputs times weights, in its order."""
    u = net.p["u" + d]
    t, n, _ = xw.shape
    h = np.zeros((n, H), np.float32)
    out = np.empty((t, n, H), np.float32)
    saved = []
    for i in range(t):
        hu = h @ u
        zr = _sigmoid(xw[i, :, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(xw[i, :, 2 * H :] + r * hu[:, 2 * H :])
        new = h + mask[i] * z * (c - h)
        if keep:
            saved.append((h, z, r, c, hu[:, 2 * H :]))
        h = new
        out[i] = h
    return out, saved


def forward(net: Network, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: inputs of distinct words, ids: (window, time) rows of it, mask: where there is a word."""
    p = net.p
    at, m = ids.T, mask.T[:, :, None].astype(np.float32)
    a, sa = _run(net, "f", (x @ p["wf"] + p["bf"])[at], m, keep)
    b, sb = _run(net, "b", (x @ p["wb"] + p["bb"])[at[::-1]], m[::-1], keep)
    hid = np.concatenate([a, b[::-1]], 2)
    att = np.tanh(hid @ p["wa"])
    s = att @ p["va"] + np.where(m[:, :, 0] > 0, 0, -30).astype(np.float32)
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, hid)
    logit = pooled @ p["vo"] + p["bo"][0]
    return (logit, (x[at], m, sa, sb, hid, att, alpha, pooled)) if keep else logit


def _back_gru(net: Network, d: str, dh_all: np.ndarray, saved, xt: np.ndarray, m: np.ndarray, grad: dict) -> np.ndarray:
    u, w = net.p["u" + d], net.p["w" + d]
    t, n, _ = dh_all.shape
    dh = np.zeros((n, H), np.float32)
    dx = np.empty_like(xt)
    for i in range(t - 1, -1, -1):
        h, z, r, c, hc = saved[i]
        dh = dh + dh_all[i]
        g = dh * m[i]
        dz, dc = g * (c - h) * z * (1 - z), g * z * (1 - c * c)
        dr = dc * hc * r * (1 - r)
        da = np.concatenate([dz, dr, dc], 1)
        du = np.concatenate([dz, dr, dc * r], 1)
        grad["u" + d] += h.T @ du
        grad["w" + d] += xt[i].T @ da
        grad["b" + d] += da.sum(0)
        dx[i] = da @ w.T
        dh = dh - g * z + du @ u.T
    return dx


def backward(net: Network, dlogit: np.ndarray, kept) -> tuple[dict, np.ndarray]:
    """Gradients of the weights and of the inputs (window, time, INPUTS)."""
    p = net.p
    xt, m, sa, sb, hid, att, alpha, pooled = kept
    grad = {k: np.zeros_like(v) for k, v in p.items() if k not in (*SLOTS, "char")}
    grad["vo"], grad["bo"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = dlogit[:, None] * p["vo"]
    dalpha = np.einsum("nh,tnh->tn", dpool, hid)
    ds = alpha * (dalpha - (alpha * dalpha).sum(0))
    grad["va"] = np.einsum("tn,tna->a", ds, att)
    datt = ds[:, :, None] * p["va"] * (1 - att * att)
    grad["wa"] = np.einsum("tnh,tna->ha", hid, datt)
    dhid = alpha[:, :, None] * dpool + datt @ p["wa"].T
    dx = _back_gru(net, "f", dhid[:, :, :H], sa, xt, m, grad)
    dx = dx + _back_gru(net, "b", dhid[::-1, :, H:], sb, xt[::-1], m[::-1], grad)[::-1]
    return grad, dx.transpose(1, 0, 2)


def _logits(net: Network, x: np.ndarray, ids: np.ndarray, none: int) -> np.ndarray:
    out = np.empty(len(ids), np.float32)
    for at in range(0, len(ids), AT_ONCE):
        part = ids[at : at + AT_ONCE]
        used, inner = np.unique(part, return_inverse=True)
        out[at : at + AT_ONCE] = forward(net, x[used], inner.reshape(part.shape), part != none)
    return out


def _worst(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Each document's window with the highest logit."""
    order = np.lexsort((logit, doc))
    return order[np.searchsorted(doc[order], np.arange(n), side="right") - 1]


def fit_network(docs: list[bytes], y: np.ndarray, epochs: int = 7, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Trains on the worst window of each document and one other of each clean one. One class alone gives a constant.

    docs is emptied once its words are known."""
    rng = np.random.default_rng(3)
    n = lambda *shape, s: rng.standard_normal(shape, np.float32) * np.float32(s)
    net = Network({"char": n(CHAR_SLOTS, D, s=0.05), "va": n(8, s=0.3), "wa": n(2 * H, 8, s=0.3), "vo": n(2 * H, s=0.3), "bo": np.zeros(1, np.float32)})
    for d in "fb":
        net.p |= {"w" + d: n(INPUTS, 3 * H, s=0.25), "u" + d: n(H, 3 * H, s=0.25), "b" + d: np.zeros(3 * H, np.float32)}
    net.p |= {k: np.zeros((size, D), np.float32) for k, size in SLOTS.items()}
    if not len(y) or y.min() == y.max():
        net.scale, net.shift = 0.0, (3.0 if len(y) and y.min() else -3.0)
        return net
    n_docs, number, found = len(docs), {}, []
    for t in docs:
        found.append(np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32))
    distinct, starts = list(number), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
    codes, starts = collapsed(np.concatenate(found), starts)
    docs.clear()
    del number, found
    released()
    own, tri, count = slots(distinct)
    # the first dimension of an embedding starts as how much more toxic documents have the slot
    owner = np.repeat(np.arange(n_docs), np.diff(starts))
    known = {}
    for k, size in SLOTS.items():
        pair = np.unique(owner * size + own[k][codes])  # a document counts once
        have = [np.bincount(pair[y[pair // size] == c] % size, minlength=size) for c in (0, 1)]
        odds = np.log((have[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((have[0] + 0.5) / ((y == 0).sum() + 1))
        known[k] = sum(have) >= RARE
        net.p[k] = np.where(known[k][:, None], n(size, D, s=0.05), np.float32(0))
        net.p[k][:, 0] = np.where(known[k], np.clip(odds * sum(have) / (sum(have) + 5), -3, 3), 0)
    ids, doc = windows(codes, starts, len(distinct))
    dense = {k: v for k, v in net.p.items() if k not in SLOTS}
    first, second = ({k: np.zeros_like(v) for k, v in dense.items()} for _ in range(2))
    squares = {k: np.full_like(net.p[k], 1e-4) for k in SLOTS}
    step = 0
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    for epoch in range(epochs):
        x = embedded(net, distinct)
        chosen = _worst(_logits(net, x, ids, len(distinct)), doc, n_docs)
        other = rng.permutation(np.flatnonzero(y[doc] == 0))[: n_docs]
        batch_order = rng.permutation(np.concatenate([chosen, other]))
        for at in range(0, len(batch_order), 128):
            rows = batch_order[at : at + 128]
            part = ids[rows]
            used, inner = np.unique(part, return_inverse=True)
            inner = inner.reshape(part.shape)
            real = used[used < len(distinct)]
            runs, size = gathered(count, tri, real)
            inputs = np.zeros((len(real) + 1, INPUTS), np.float32)
            for i, k in enumerate(SLOTS):
                inputs[:-1, i * D : (i + 1) * D] = net.p[k][own[k][real]]
            if len(real):
                inputs[:-1, -D:] = np.add.reduceat(net.p["char"][runs], np.cumsum(size) - size) / size[:, None]
            logit, kept = forward(net, inputs, np.minimum(inner, len(real)), part != len(distinct), True)
            dlogit = ((_sigmoid(logit) - y[doc[rows]]) * weight[doc[rows]] / len(rows)).astype(np.float32)
            grad, dx = backward(net, dlogit, kept)
            dword = np.zeros((len(used), INPUTS), np.float32)
            np.add.at(dword, inner.ravel(), dx.reshape(-1, INPUTS))
            dword = dword[: len(real)]
            sparse = {}
            for i, k in enumerate(SLOTS):
                at_slot, place = np.unique(own[k][real], return_inverse=True)
                g = np.zeros((len(at_slot), D), np.float32)
                np.add.at(g, place, dword[:, i * D : (i + 1) * D])
                sparse[k] = (at_slot[known[k][at_slot]], g[known[k][at_slot]])
            grad["char"] = np.zeros_like(net.p["char"])
            np.add.at(grad["char"], runs, np.repeat(dword[:, -D:] / size[:, None], size, axis=0))
            step += 1
            now = rate * 0.5 ** (epoch / 3)
            for k, g in grad.items():
                g = g + (20 * decay if k == "char" else decay) * net.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for k, (at_slot, g) in sparse.items():
                g = g + decay * net.p[k][at_slot]
                squares[k][at_slot] += g * g
                net.p[k][at_slot] -= now * g / (np.sqrt(squares[k][at_slot]) + 1e-6)
    x = embedded(net, distinct)
    logit = _logits(net, x, ids, len(distinct))
    top = logit[_worst(logit, doc, n_docs)].astype(float)
    a, b = 1.0, 0.0
    for _ in range(500):  # the calibration: logistic regression on the worst window's logit
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        a, b = a - 0.5 * ((q - y) * top).mean() / max(1.0, (top**2).mean()), b - 0.5 * (q - y).mean()
    net.scale, net.shift = a, b
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network from labels.toxic (0 or 1) of at most so many rows whose crc32(id as text) modulo 3 is not 1.

    Documents that repeat an id all count as labelled; a null id or another label is none. Rows go by a hash of their ids
    up to TRAINING_ROWS ids and TRAINING_BYTES of text."""
    one = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & (residue(id_col, MODULUS) != HELD)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("_y"))
    few = one.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    got = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), id_col).select(F.col(id_col).cast("long").alias("id"), "text", "_y")
    before = F.sum(F.octet_length("text") + 1).over(Window.orderBy(F.xxhash64("id"), "id", "text"))  # so many rows at most, unless ids repeat
    got = got.withColumn("_bytes", before).where(F.col("_bytes") <= TRAINING_BYTES).drop("_bytes").toArrow()
    got = got.sort_by([("id", "ascending"), ("text", "ascending")])
    y = got.column("_y").to_numpy().astype(np.int64)
    text = got.column("text").cast(pa.binary()).to_pylist()
    del got
    released()
    return fit_network(text, y)


def toxicity(docs: DataFrame, network: Network, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted), or the columns of keep, score, predicted: one row for each row; only the text is scored.

    score: probability of label 1 (0 to 1); a null, empty or wordless text is one empty window. Rows that repeat an id are
    scored each by its own text; columns of keep stay as they are. held_out: crc32(id as text)
    modulo 3 is 1, so the row's label wasn't learned from. predicted: 1 from the threshold on."""
    known = shared(docs.sparkSession, network)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = known()
        distinct, codes, starts = coded([tokens(t) for t in texts(batch, text_col)])
        codes, starts = collapsed(codes, starts)
        ids, doc = windows(codes, starts, len(distinct))
        logit = _logits(net, embedded(net, distinct), ids, len(distinct))
        top = logit[_worst(logit, doc, batch.num_rows)].astype(np.float64)
        score = 1 / (1 + np.exp(-np.clip(net.scale * top + net.shift, -30, 30)))
        found = {"_score": pa.array(score), "_predicted": pa.array((score >= threshold).astype(np.int32))}
        return pa.record_batch(({c: batch.column(c) for c in keep} if keep else {"id": batch.column(id_col).cast(pa.int64())}) | found)

    if keep:
        fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
        out = mapped(docs.select(*dict.fromkeys([*keep, text_col])), one, ", ".join([*fields, "_score double, _predicted int"]), text_col, 4 << 20)
        return out.select(*keep, F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
    out = mapped(docs.select(id_col, text_col), one, "id long, _score double, _predicted int", text_col, 4 << 20)
    return out.select(F.col("id").alias(id_col), (residue("id", MODULUS) == HELD).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
