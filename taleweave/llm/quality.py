"""Quality: a linear-chain conditional random field labels lines good or bad.

A line's features are the shares of its characters that are symbols, capitals, digits or bars, how many of
its words repeat, how long it is, whether the line itself repeats, and the same of the lines before and
after it.  The field is trained by gradient on a bounded sample: a good document's lines are good, a bad
one's bad at first; after that, lines of bad documents that the field thinks good are taken as good, all but
the worst one.  Forward-backward gives each line's probability; their mean, weighted by length, is
calibrated into the document's score.

Defined results: null and empty texts are one empty line; without both classes to learn from, every score
is 0; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frugal, pieces, small
from .learning import labelled_sample, logistic, sigmoid

PER_CLASS, THRESHOLD = 1500, 0.5
_OWN = 9
#: Classes of the code points below 0x250; all above count as small letters.
_UPPER, _SYMBOL, _DIGIT, _SPACE, _BAR, _LOWER = range(6)
_CLASS = np.array([_SPACE if chr(i).isspace() else _BAR if chr(i) == "|" else _UPPER if chr(i).isupper() else _DIGIT if chr(i).isdigit() else _LOWER if chr(i).isalpha() or chr(i) in ".,;:'-" else _SYMBOL for i in range(0x250)], dtype=np.int8)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, in order; the lines of each text; the lengths."""
    lines, counts = [], []
    for t in texts:
        own = (t or "").split("\n")
        lines += own
        counts.append(len(own))
    joined = "\n".join(lines) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], _LOWER)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    share = np.stack([np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(6)], axis=1).astype(float)
    share[:, _SPACE] -= 1  # the line's end
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words], dtype=float)
    distinct = np.array([len(set(w)) for w in words]) / np.maximum(n, 1)
    again = np.zeros(len(lines))
    at = 0
    for c in counts:
        seen: dict[str, int] = {}
        for i in range(at, at + c):
            seen[lines[i]] = seen.get(lines[i], 0) + 1
        for i in range(at, at + c):
            again[i] = seen[lines[i]] > 1 and sizes[i] > 0
        at += c
    letters = np.maximum(share[:, _UPPER] + share[:, _LOWER], 1)
    solid = np.maximum(sizes - share[:, _SPACE], 1)
    own = np.stack(
        [share[:, _SYMBOL] / solid, share[:, _UPPER] / letters, share[:, _DIGIT] / solid, share[:, _BAR] / np.maximum(n, 1), (1 - distinct) * np.minimum(n / 20, 1), np.log1p(sizes) / 8, np.minimum(solid / np.maximum(n, 1), 30) / 10, again, sizes < 20],
        axis=1,
    )
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[np.cumsum(counts) - 1] = 0
    return np.hstack([own, before[:, :5], after[:, :5], np.ones((len(own), 1))]), np.array(counts), sizes


def _by_length(counts: np.ndarray):
    """Groups of documents whose numbers of lines are alike, to run them side by side with little padding."""
    order = np.argsort(counts, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and counts[order[b]] <= 1.2 * counts[order[a]] + 2:
            b += 1
        yield order[a:b]
        a = b


def marginals(emit: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is bad) for every line, and the expected counts of the four transitions, by forward-backward.

    emit: log potentials (lines, 2); move: log potentials (2, 2).
    """
    out, pairs = np.zeros(len(emit)), np.zeros((2, 2))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    t_move = np.exp(move)
    for group in _by_length(counts):
        longest = int(counts[group].max())
        at = starts[group][:, None] + np.minimum(np.arange(longest)[None], counts[group][:, None] - 1)
        real = np.arange(longest)[None] < counts[group][:, None]
        e = np.exp(emit[at] - emit[at].max(axis=2, keepdims=True))
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        fwd[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, longest):
            x = (fwd[:, i - 1] @ t_move) * e[:, i]
            fwd[:, i] = np.where(real[:, i, None], x / x.sum(axis=1, keepdims=True), fwd[:, i - 1])
        for i in range(longest - 2, -1, -1):
            x = (bwd[:, i + 1] * e[:, i + 1]) @ t_move.T
            bwd[:, i] = np.where(real[:, i + 1, None], x / x.sum(axis=1, keepdims=True), 1.0)
        p = fwd * bwd
        p /= p.sum(axis=2, keepdims=True)
        out[at[real]] = p[..., 1][real]
        if longest > 1:
            x = fwd[:, :-1, :, None] * t_move[None, None] * (e[:, 1:] * bwd[:, 1:])[:, :, None, :]
            x /= x.sum(axis=(2, 3), keepdims=True)
            pairs += x[real[:, 1:]].sum(axis=0)
    return out, pairs


def train_field(x: np.ndarray, counts: np.ndarray, bad: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the emission of `bad` (against `good`) and the transitions, by gradient ascent with momentum-free Adam steps."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    first, second = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    k = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[k].astype(int), bad[k + 1].astype(int)), 1)
    for i in range(1, rounds + 1):
        p, pairs = marginals(np.stack([np.zeros(len(x)), x @ w], axis=1), counts, move)
        g = np.concatenate([x.T @ (bad - p) - 0.01 * w, (seen - pairs).ravel() - 0.01 * move.ravel()]) / len(x)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.15 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-9)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    return w, move


def badness(x: np.ndarray, counts: np.ndarray, sizes: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's mean over its lines, weighted by length, and each line's probability."""
    p, _ = marginals(np.stack([np.zeros(len(x)), x @ w], axis=1), counts, move)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = sizes + 1.0
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), p


def _calibration(share: np.ndarray) -> np.ndarray:
    return np.stack([share, np.log((share + 1e-3) / (1 - share + 1e-3))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> dict | None:
    samples = labelled_sample(docs, labels, "quality", learn, per_class)
    y = np.array([v for _, v in samples], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x, counts, sizes = line_features([t for t, _ in samples])
    bad = np.repeat(1 - y, counts)
    w, move = train_field(x, counts, bad)
    _, p = badness(x, counts, sizes, w, move)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    worst = np.repeat(np.maximum.reduceat(p, starts), counts)
    bad = bad * ((p >= 0.5) | (p >= worst))
    w, move = train_field(x, counts, bad)
    share, _ = badness(x, counts, sizes, w, move)
    return {"w": w, "move": move, "last": logistic(_calibration(share), y)}


def score_texts(model: dict | None, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    if model:
        for a, b in pieces(texts):
            share, _ = badness(*line_features(texts[a:b]), model["w"], model["move"])
            out[a:b] = sigmoid(_calibration(share) @ model["last"][:-1] + model["last"][-1])
    return out


def score(docs: DataFrame, model: dict | None, flag, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in small(batches, "text"):
            s = score_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold("doc_id", 3) == 1
    return score(docs, fit(docs, labels, ~held_out), held_out)
