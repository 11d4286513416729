"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read every text byte by byte, one from each end; at each
position both states give the probabilities of the languages, and a document's are
the mean over its positions. The network is trained here, in numpy, by
backpropagation through time over windows of a bounded sample of labelled rows, which
has every language of the table.

Texts are read as segments side by side. Where the state in which a reader entered
its segment isn't that in which it left the one before, the segment is read again
from there, until the states meet, so that every position has the labels of a single
pass over the whole text. Squashing is by x / (1 + abs(x)), which needs no
exponentials.

Defined results: a null or empty text has no language and probability 0; texts of
any length are read whole; ties go to the language that comes first in the
alphabet; repeated rows are labelled each; without labelled rows nothing has a
language; rows without a label are not learnt from; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, spread_sample, text_bytes

#: labelled texts that the network is trained on, at most; every language has one at least
TRAINING_ROWS = 1500
HIDDEN, WINDOW, BATCH, STEPS, RATE = 8, 64, 256, 240, 0.02
SEGMENT, LANES = 512, 4096
#: places whose probabilities are computed at once
TOGETHER = 8
#: states closer than this are the same
TOLERANCE = 1e-6


@dataclass
class Network:
    """Weights: for each direction the bytes' inputs (256 x 3H), the recurrence (H x 3H) and the output (H x C); and the output's bias."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrence: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    d = 1 + np.abs(x)
    return 1 / (d * d)


def _cell(g: np.ndarray, h: np.ndarray, u: np.ndarray):
    """One step: the new state and what going back over it needs."""
    k = h.shape[1]
    s = h @ u
    gates = g[:, : 2 * k] + s[:, : 2 * k]
    rz = 0.5 + 0.5 * _squash(gates)
    r, z = rz[:, :k], rz[:, k:]
    a = g[:, 2 * k :] + r * s[:, 2 * k :]
    n = _squash(a)
    return n + z * (h - n), (gates, r, z, a, n, s[:, 2 * k :])


def _states(x: np.ndarray, e: np.ndarray, u: np.ndarray):
    h = np.zeros((len(x), u.shape[0]), np.float32)
    states, kept = [h], []
    for t in range(x.shape[1]):
        h, k = _cell(e[x[:, t]], h, u)
        states.append(h)
        kept.append(k)
    return states, kept


def _back(x: np.ndarray, states: list, kept: list, grad: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrence; ``grad`` is that of each state ``[step, lane, unit]``."""
    k = u.shape[0]
    du = np.zeros_like(u)
    per_byte = np.empty((x.shape[1], len(x), 3 * k), np.float32)
    dh = np.zeros((len(x), k), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        gates, r, z, a, n, s = kept[t]
        dh = dh + grad[t]
        h = states[t]
        da = dh * (1 - z) * _slope(a)
        slope = 0.5 * _slope(gates)
        d_rz = np.hstack([da * s, dh * (h - n)]) * slope
        per_byte[t] = np.hstack([d_rz, da])
        ds = np.hstack([d_rz, da * r])
        du += h.T @ ds
        dh = dh * z + ds @ u.T
    hot = np.zeros((x.size, 256), np.float32)
    hot[np.arange(x.size), x.T.reshape(-1)] = 1
    return hot.T @ per_byte.reshape(x.size, -1), du


def _loss(net: Network, x: np.ndarray, y: np.ndarray):
    """Mean cross entropy over all positions, and the gradients of all weights in order."""
    b, t = x.shape
    both = [_states(x, net.inputs[0], net.recurrence[0]), _states(x[:, ::-1], net.inputs[1], net.recurrence[1])]
    ahead = np.stack(both[0][0][1:])
    behind = np.stack(both[1][0][1:])[::-1]
    logits = ahead @ net.output[0] + behind @ net.output[1] + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    loss = -np.log(p[:, np.arange(b), y] + 1e-9).mean()
    p[:, np.arange(b), y] -= 1
    p /= b * t
    flat = p.reshape(-1, p.shape[2])
    grads = []
    for i, (seen, xs, order) in enumerate(((ahead, x, 1), (behind, x[:, ::-1], -1))):
        de, du = _back(xs, both[i][0], both[i][1], (p @ net.output[i].T)[::order], net.recurrence[i])
        grads += [de, du, seen.reshape(len(flat), -1).T @ flat]
    return loss, [*grads, flat.sum(axis=0)]


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 5) -> Network:
    """A network for the languages in ``labels``; every language is drawn equally often."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    c = len(languages)
    net = Network(languages, [init(256, 3 * hidden) for _ in range(2)], [init(hidden, 3 * hidden) for _ in range(2)], [init(hidden, c) for _ in range(2)], np.zeros(c, np.float32))
    of = [[np.frombuffer(t, np.uint8) for t, lang in zip(texts, labels) if lang == name and t] for name in languages]
    usable = [i for i in range(c) if of[i]]
    if len(usable) < 2:
        return net
    weights = [w for i in range(2) for w in (net.inputs[i], net.recurrence[i], net.output[i])] + [net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        x, y = np.full((BATCH, WINDOW), 32, np.uint8), np.empty(BATCH, np.int64)
        for i in range(BATCH):
            y[i] = usable[i % len(usable)]
            t = of[y[i]][rng.integers(len(of[y[i]]))]
            at = rng.integers(max(len(t) - WINDOW, 0) + 1)
            part = t[at : at + WINDOW]
            x[i, : len(part)] = part
        _, grads = _loss(net, x, y)
        rate = RATE * (1 - step / (steps + 1))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _tables(net: Network, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs ``[gate, byte, unit]`` and recurrence ``[gate, unit, unit]`` of one direction: each gate of many lanes is contiguous."""
    e, u = net.inputs[side], net.recurrence[side]
    k = u.shape[0]
    return np.ascontiguousarray(e.reshape(256, 3, k).transpose(1, 0, 2)), np.ascontiguousarray(u.reshape(k, 3, k).transpose(1, 0, 2))


def _step(e: np.ndarray, u: np.ndarray, byte: np.ndarray, h: np.ndarray, g: np.ndarray, s: np.ndarray, out: np.ndarray) -> None:
    """:func:`_cell` without what training needs; ``g`` and ``s`` ``[gate, lane, unit]`` are room to work in."""
    np.take(e, byte, axis=1, out=g, mode="clip")
    np.matmul(h, u, out=s)
    rz, n, room = s[:2], s[2], g[2]
    rz += g[:2]
    np.abs(rz, out=g[:2])
    g[:2] += 1
    rz /= g[:2]
    rz *= 0.5
    rz += 0.5
    n *= rz[0]
    n += room
    np.abs(n, out=room)
    room += 1
    n /= room
    np.subtract(h, n, out=room)
    room *= rz[1]
    np.add(room, n, out=out)


def _read(net: Network, side: int, buf: np.ndarray, own: np.ndarray, size: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States ``[place in the lane, lane, unit]`` of one direction, and those in which lanes end; lanes are sorted by falling size.

    A lane is entered in the state in which lane ``before`` of it ends, or in its own
    of ``first`` where that is negative. Places behind the end of a lane have no meaning.
    """
    e, u = _tables(net, side)
    steps, k = int(size[0]), u.shape[1]
    states = np.zeros((steps, len(own), k), np.float32)
    alive = np.searchsorted(-size, -np.arange(steps), side="left").tolist()
    entry = np.where(before[:, None] < 0, first, np.float32(0))
    room = np.empty((2, 3 * len(own) * k), np.float32)
    h, n = entry, -1
    for t in range(steps - 1, -1, -1) if side else range(steps):
        if alive[t] != n:
            if side and n >= 0:
                h[n : alive[t]] = entry[n : alive[t]]
            n = alive[t]
            g, s = room[:, : 3 * n * k].reshape(2, 3, n, k)
        _step(e, u, buf[own[:n] + t], h[:n], g, s, states[t, :n])
        h = states[t]
    last = states[0].copy() if side else states[size - 1, np.arange(len(own))]
    while True:
        true = np.where(before[:, None] < 0, first, last[before])
        lane = np.flatnonzero(np.abs(true - entry).max(axis=1) > TOLERANCE)
        if not len(lane):
            return states, last
        entry[lane] = h = true[lane]
        at, left = (size[lane] - 1 if side else np.zeros_like(lane)), size[lane]
        t = 0
        while len(lane):
            g, s = room[:, : 3 * len(lane) * k].reshape(2, 3, len(lane), k)
            now = np.empty_like(h)
            _step(e, u, buf[own[lane] + at], h, g, s, now)
            h = now
            t += 1
            over = left == t
            if t % 8 == 0 or over.any():
                last[lane[over]] = h[over]
                over |= np.abs(h - states[at, lane]).max(axis=1) <= TOLERANCE
                states[at, lane] = h
                if over.any():
                    lane, at, left, h = lane[~over], at[~over], left[~over], h[~over]
            else:
                states[at, lane] = h
            at += 1 - 2 * side


def _lanes(net: Network, side: int, buf: np.ndarray, own: np.ndarray, size: np.ndarray, doc: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive segments of texts by falling size, one direction's states in that order, and those in which it leaves each segment.

    ``enter`` has the state in which the first (or the last) segment of a text is entered.
    """
    order = np.argsort(-size, kind="stable")
    place = np.argsort(order)
    inside = doc[1:] == doc[:-1]
    before = np.full(len(doc), -1)
    if side:
        before[:-1][inside] = place[1:][inside]
    else:
        before[1:][inside] = place[:-1][inside]
    states, last = _read(net, side, buf, own[order], size[order], before[order], enter[order])
    return order, states, last[place]


def _segments(net: Network, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, start and size of segments, many at a time and by falling size, with the states of both directions.

    A text of more than ``LANES`` segments is read in blocks: first backwards alone,
    which gives the state in which each block is entered from its end.
    """
    hidden = net.recurrence[0].shape[0]
    pieces = -(-(ends - starts) // SEGMENT)
    total = np.cumsum(pieces)
    i = 0
    while i < len(pieces):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LANES, side="right")))
        group = np.arange(i, j)
        doc = np.repeat(group, pieces[group])
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces[group]) - pieces[group], pieces[group])
        own = starts[doc] + nth * SEGMENT
        size = np.minimum(own + SEGMENT, ends[doc]) - own
        blocks = [slice(k, k + LANES) for k in range(0, len(doc), LANES)]
        zero = np.zeros((len(doc), hidden), np.float32)
        entered = [zero[:1]] * len(blocks)
        for k in range(len(blocks) - 1, 0, -1):
            s = blocks[k]
            final = np.zeros_like(zero[s])
            final[-1] = entered[k]
            entered[k - 1] = _lanes(net, 1, buf, own[s], size[s], doc[s], final)[2][:1]
        carried = zero[:1]
        for k, s in enumerate(blocks):
            first, final = np.zeros_like(zero[s]), np.zeros_like(zero[s])
            first[0], final[-1] = carried, entered[k]
            order, ahead, left = _lanes(net, 0, buf, own[s], size[s], doc[s], first)
            _, behind, _ = _lanes(net, 1, buf, own[s], size[s], doc[s], final)
            carried = left[-1:]
            yield doc[s][order], own[s][order], size[s][order], ahead, behind
        i = j


def _probabilities(net: Network, size: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A first place, the languages' probabilities ``[place, language, lane]`` of some places from there, 0 behind the end of a lane, and which places lanes have."""
    out = [np.ascontiguousarray(o.T) for o in net.output]
    for t in range(0, len(ahead), TOGETHER):
        place = np.arange(t, min(t + TOGETHER, len(ahead)))
        n = int(np.searchsorted(-size, -t, side="left"))
        p = np.matmul(out[0], ahead[place[0] : place[-1] + 1, :n].transpose(0, 2, 1))
        p += np.matmul(out[1], behind[place[0] : place[-1] + 1, :n].transpose(0, 2, 1))
        p += net.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        there = place[:, None] < size[:n]
        if size[n - 1] <= place[-1]:
            p *= there[:, None]
        yield t, p, there


def positions(net: Network, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in the buffer and language probabilities of every byte, many at a time."""
    for doc, own, size, ahead, behind in _segments(net, buf, starts, ends):
        for t, p, there in _probabilities(net, size, ahead, behind):
            place, lane = np.nonzero(there)
            yield doc[lane], own[lane] + t + place, p[place, :, lane]


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Mean probabilities of each text; zeros for a text without bytes."""
    buf, starts, ends = text_bytes(column)
    total = np.zeros((len(column), len(net.languages)))
    for doc, _, size, ahead, behind in _segments(net, buf, starts, ends):
        of_lane = np.zeros((len(net.languages), len(doc)))
        for _, p, _ in _probabilities(net, size, ahead, behind):
            of_lane[:, : p.shape[2]] += p.sum(axis=0)
        for c in range(len(of_lane)):
            total[:, c] += np.bincount(doc, weights=of_lane[c], minlength=len(total))
    return total / np.maximum(ends - starts, 1)[:, None]


def spans(net: Network, raw: bytes) -> list[tuple[int, int, str]]:
    """Runs of bytes with the same likeliest language: start, end, language."""
    buf = np.frombuffer(raw, np.uint8)
    best = np.zeros(len(buf), np.int64)
    for _, place, p in positions(net, buf, np.array([0]), np.array([len(buf)])):
        best[place] = p.argmax(axis=1)
    edge = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1], [True]])) if len(buf) else np.zeros(1, int)
    return [(int(a), int(b), net.languages[best[a]]) for a, b in zip(edge[:-1], edge[1:])]


def labelled_network(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> Network:
    """Train on about ``rows`` texts at most whose language is known, of every language in the table as many, those with the least hash.

    With more languages than ``rows`` each still has one text.
    """
    known = spread_sample(docs, text_col, F.col(lang_col), lambda counts: dict.fromkeys(counts, max(rows // max(len(counts), 1), 1)))
    return train([t.encode() for t, _ in known], [lang for _, lang in known])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None, lang_col: str = "lang") -> DataFrame:
    """Every document's id, its ``predicted`` language, that language's ``probability`` and the number of bytes labelled."""
    model = ship(docs.sparkSession, net or labelled_network(docs, text_col, lang_col))

    def run(column: pa.Array) -> pa.Array:
        network = model()
        p = pooled(network, column)
        known = p.sum(axis=1) > 0 if len(network.languages) else np.zeros(len(column), bool)
        best = p.argmax(axis=1) if len(network.languages) else np.zeros(len(column), int)
        names = pa.array([network.languages[b] if k else None for b, k in zip(best.tolist(), known.tolist())], pa.string())
        top = np.where(known, p[np.arange(len(p)), best], 0.0) if len(network.languages) else np.zeros(len(column))
        return pa.StructArray.from_arrays([names, pa.array(top)], names=["predicted", "probability"])

    kind = T.StructType([T.StructField("predicted", T.StringType()), T.StructField("probability", T.DoubleType())])
    labelled = docs.select(F.col(id_col), F.arrow_udf(run, kind)(F.col(text_col)).alias("_l"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_positions"))
    return labelled.select(id_col, "_l.predicted", "_l.probability", "n_positions")
