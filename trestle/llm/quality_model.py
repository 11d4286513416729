"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The
votes of the whole corpus are counted by pattern, and expectation-maximisation over
those counts estimates how often each labeller's votes are right and wrong. The posterior labels of a bounded
sample, which has every pattern by its share and once at least, then train a linear scorer over hashed byte
trigrams, which scores every document. Votes are cast on whole Arrow columns, from counts of bytes and
the hashes of words.

Defined results: a null or empty text has score 0 and isn't kept; texts of any
length are read whole; repeated rows are scored each; without any text to learn
from the score is 0.5; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, spread_sample, text_bytes
from .linear import fit_logistic, sigmoid
from .textfeat import pieces, words

#: texts that the scorer is fitted on, at most
TRAINING_ROWS = 3000
THRESHOLD, BITS = 0.5, 12
FALSE_ALARMS = 0.01
#: how much more than a trigram the share of repeated words counts before it is fitted
REPEATS_WEIGH = 5.0
#: characters whose share a measure is
CHARACTERS = {"junk": "#$%&*<>=~^@", "bars": "|", "exclamations": "!", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊÎÔÛÑÁÍÓÚ"}
#: name, measures of a text that are added up, and from what sum a vote is bad and up to what sum it is good
LABELLERS: list[tuple[str, tuple[str, ...], float, float]] = [
    ("symbols", ("junk",), 0.03, 0.0),
    ("bars", ("bars",), 0.02, 0.0),
    ("exclamations", ("exclamations",), 0.03, 0.0),
    ("capitals", ("capitals",), 0.25, 0.0),
    ("plain", ("junk", "bars", "exclamations"), 0.02, 0.005),
    ("stutter", ("again",), 0.15, 0.0),
    ("runs", ("thrice",), 0.1, 0.0),
]


def _counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, characters: str) -> np.ndarray:
    """How many of ``characters`` (one or two bytes each) every text has."""
    one = np.zeros(256, bool)
    two: dict[int, np.ndarray] = {}
    for c in characters:
        raw = c.encode()
        if len(raw) == 1:
            one[raw[0]] = True
        else:
            two.setdefault(raw[0], np.zeros(256, bool))[raw[1]] = True
    hit = one[buf]
    for lead, follow in two.items():
        at = np.flatnonzero(buf[:-1] == lead)
        hit[at] |= follow[buf[at + 1]]
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[ends] - total[starts]


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """For each text the shares of :data:`CHARACTERS`, and of words that repeat the one (``again``) or the two (``thrice``) before them."""
    buf, starts, ends = text_bytes(column)
    out = {name: np.zeros(len(column)) for name in CHARACTERS}
    for i, j in pieces(starts, ends):
        s, e = starts[i:j], ends[i:j]
        if not (e > s).any():
            continue
        lo, hi = int(s[e > s].min()), int(e.max())
        b, s, e = buf[lo:hi], np.maximum(s - lo, 0), np.maximum(e - lo, 0)
        size = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        length = np.maximum(size[e] - size[s], 1)
        for name, characters in CHARACTERS.items():
            out[name][i:j] = _counts(b, s, e, characters) / length
    out["again"], out["thrice"] = _repeats(column)
    return out


def votes(column: pa.Array) -> list[str | None]:
    """Votes of all labellers on each text as a string of ``+``, ``-`` and ``0``; null for a text without characters."""
    m = measures(column)
    _, starts, ends = text_bytes(column)
    each = []
    for _, names, bad, good in LABELLERS:
        total = sum(m[n] for n in names)
        each.append(np.where(total > bad, "-", np.where(total < good, "+", "0")))
    cast = ["".join(v) for v in zip(*(e.tolist() for e in each))]
    return [v if e > s else None for v, s, e in zip(cast, starts.tolist(), ends.tolist())]


def pattern(text_col: str) -> Column:
    """:func:`votes` of a column."""
    return F.arrow_udf(lambda column: pa.array(votes(column), pa.string()), T.StringType())(F.col(text_col))


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[np.ndarray, dict[str, float]]:
    """Rates ``[labeller, vote, class]`` at which bad votes, good votes and none are cast on bad and good texts, and each pattern's posterior of good.

    A bad vote on a good text is held to ``FALSE_ALARMS`` at
    most, without which labellers of rare, separate faults outvote each other. The
    rounds start from the belief that any bad vote is right and stop when no
    posterior moves.
    """
    patterns = sorted(counts)
    if not patterns:
        return np.zeros((0, 3, 2)), {}
    v = np.array([list(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], np.float64)
    cast = [(v == c).astype(float) for c in "-+0"]
    good = np.where(cast[0].any(1), 0.03, 0.97)
    rates = np.zeros((v.shape[1], 3, 2))
    for _ in range(rounds):
        mass = np.array([((1 - good) * n).sum(), (good * n).sum()])
        for vote in (0, 1, 2):
            for c, weight in ((0, (1 - good) * n), (1, good * n)):
                rates[:, vote, c] = (cast[vote].T @ weight + 1) / (mass[c] + 3)
        rates[:, 0, 1] = np.minimum(rates[:, 0, 1], FALSE_ALARMS)
        odds = np.log((mass[1] + 1) / (mass[0] + 1)) + sum(cast[vote] @ np.log(rates[:, vote, 1] / rates[:, vote, 0]) for vote in (0, 1, 2))
        new = sigmoid(odds)
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-6:
            break
    return rates, dict(zip(patterns, good.tolist()))


def _buckets(b: np.ndarray) -> np.ndarray:
    x = b.astype(np.uint32)
    return (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


def _repeats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Share of words that repeat the word before them, and of those that repeat the two words before them, for each text."""
    again, thrice, total = np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column))
    for i, j, row, h in words(column):
        total[i:j] = np.bincount(row, minlength=j - i)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again[i:j] = np.bincount(row[1:][same], minlength=j - i)
        thrice[i:j] = np.bincount(row[2:][same[1:] & same[:-1]], minlength=j - i)
    total = np.maximum(total, 1)
    return again / total, thrice / total


def _frequencies(column: pa.Array) -> np.ndarray:
    """Share of each hashed trigram in each text, and of repeated words in the last column."""
    buf, starts, ends = text_bytes(column)
    out = np.zeros((len(column), (1 << BITS) + 1), np.float32)
    for r, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if e - s > 2:
            out[r, :-1] = np.bincount(_buckets(buf[s:e]), minlength=1 << BITS) / (e - s - 2)
    out[:, -1] = _repeats(column)[0]
    return out


def _trust(size: np.ndarray) -> np.ndarray:
    """How far the shares in a text of so many bytes are taken at their word."""
    return size / (size + 100.0)


def fit_scorer(texts: list[str], good: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the trigrams' shares (and of repeated words), their mean score and the intercept, for posterior labels."""
    if not texts:
        return np.zeros((1 << BITS) + 1, np.float32), 0.0, 0.0
    x = _frequencies(pa.array(texts, pa.large_string()))
    scale = 1 / (x.std(axis=0) + 1e-4)
    scale[-1] *= REPEATS_WEIGH
    mean = x.mean(axis=0)
    x -= mean
    x *= scale
    x *= _trust(np.array([len(t.encode()) for t in texts])).astype(np.float32)[:, None]
    w, b = fit_logistic(x, good, penalty=0.02 * len(texts), steps=120, rate=0.02)
    w = (w * scale).astype(np.float32)
    return w, float(w @ mean), b


def scores(column: pa.Array, w: np.ndarray, mean: float, b: float) -> np.ndarray:
    """Probability that each text is good."""
    buf, starts, ends = text_bytes(column)
    total = np.zeros(len(column))
    for i, j in pieces(starts, ends):
        at = np.flatnonzero(ends[i:j] - starts[i:j] > 2) + i
        if not len(at):
            continue
        lo, hi = int(starts[at[0]]), int(ends[at[-1]])
        mass = np.concatenate([[0.0], np.cumsum(w[_buckets(buf[lo:hi])], dtype=np.float64)])
        total[at] = (mass[ends[at] - lo - 2] - mass[starts[at] - lo]) / (ends[at] - starts[at] - 2)
    out = sigmoid((total + w[-1] * _repeats(column)[0] - mean) * _trust(ends - starts) + b)
    out[ends == starts] = 0.0
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = TRAINING_ROWS) -> DataFrame:
    """Every document's id, its quality score and whether it is kept."""
    posterior: dict[str, float] = {}

    def quotas(counts: dict[str, int]) -> dict[str, int]:
        posterior.update(estimate(counts)[1])
        spare = max(rows - len(counts), 0) / max(sum(counts.values()), 1)
        return {p: 1 + int(spare * n) for p, n in counts.items()}

    sample = spread_sample(docs, text_col, pattern(text_col), quotas)  # three to the power of the labellers patterns at most
    model = ship(docs.sparkSession, fit_scorer([t for t, _ in sample], np.array([posterior[p] for _, p in sample])))

    def run(column: pa.Array) -> pa.Array:
        return pa.array(scores(column, *model()))

    rated = docs.select(F.col(id_col), F.arrow_udf(run, T.DoubleType())(F.col(text_col)).alias("score"))
    return rated.withColumn("keep", F.col("score") >= threshold)
