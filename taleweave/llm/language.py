"""Language identification with a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes, all of them, the last one padded.  In each
window, filters of several widths run over byte embeddings; the maximum of each filter over the window
goes through a softmax.  A text's probabilities are the mean of its windows', weighted by their length.

Training takes about `PER_LANGUAGE` documents of each language, chosen by a hash, and evenly spread windows
of them.  At prediction a filter's response is a sum of table rows, one for each pair of bytes, so a task
needs a few MB of tables and one block of windows at a time.

Defined results: lang_pred is `und` with score 0 if the text is null or has no letter, or if there was
nothing to learn from; a text of any length is read whole, in blocks of windows; repeated rows, of one id or
not, are judged alike; of languages with equal probabilities the first by name is taken; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frugal, pieces, small
from .learning import thinned

WINDOW, WIDTHS, FILTERS, DIM, PAD = 128, (2, 3, 4), 16, 8, 256
PER_LANGUAGE, WINDOWS_EACH, EPOCHS = 400, 10, 6
_WORDLIKE = re.compile(r"[^\W\d_]")


def _letter(text: str) -> bool:
    """Whether the text has a letter: general category L.  What is wordlike may also be a number such as ½ or Ⅷ."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text each belongs to, and its length in bytes."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([-(-len(b) // WINDOW) for b in raw], dtype=np.int64)
    out = np.full((int(counts.sum()), WINDOW), PAD, dtype=np.int32)
    flat, at = out.reshape(-1), 0
    sizes = np.empty(len(out), dtype=np.float32)
    row = 0
    for b, n in zip(raw, counts, strict=True):
        flat[at : at + len(b)] = np.frombuffer(b, np.uint8)
        sizes[row : row + n] = WINDOW
        if n:
            sizes[row + n - 1] = len(b) - (n - 1) * WINDOW
        at, row = at + n * WINDOW, row + n
    return out, np.repeat(np.arange(len(texts)), counts), sizes


def train(samples: list[tuple[str, str]], seed: int = 7) -> dict | None:
    names = sorted({lang for _, lang in samples})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    x, of, sizes = windows([t for t, _ in samples])
    spread = np.concatenate([np.unique(np.linspace(a, b - 1, WINDOWS_EACH).astype(int)) for a, b in _spans(of)]) if len(of) else np.arange(0)
    x, y = x[spread], np.array([names.index(samples[i][1]) for i in of[spread]], dtype=np.int64)
    if not len(x):
        return None
    short = rng.random(len(x)) < 0.3
    cut = rng.integers(6, WINDOW, len(x))
    x = np.where(short[:, None] & (np.arange(WINDOW) >= cut[:, None]), PAD, x)
    p = {"emb": rng.normal(0, 0.5, (257, DIM)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))), "bias": np.zeros(len(names))}
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(y, minlength=len(names))
    weight = (len(y) / (len(names) * np.maximum(share, 1))).astype(np.float32)
    for _ in range(EPOCHS if len(x) > 4000 else 3 * EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            rows = order[a : a + 64]
            grads = _gradients(p, x[rows], y[rows], weight)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {"names": names, **p}


def _spans(of: np.ndarray):
    edges = np.flatnonzero(np.diff(of)) + 1
    return zip([0, *edges], [*edges, len(of)], strict=True)


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    e = p["emb"][x]
    pooled, seen = [], {}
    for w in WIDTHS:
        n = WINDOW - w + 1
        cols = np.concatenate([e[:, o : o + n] for o in range(w)], axis=2)
        z = cols @ p[f"w{w}"] + p[f"b{w}"]
        at = z.argmax(axis=1)
        best = np.take_along_axis(z, at[:, None], axis=1)[:, 0]
        seen[w] = cols, at, best
        pooled.append(np.maximum(best, 0))
    h = np.concatenate(pooled, axis=1)
    q = _softmax(h @ p["out"] + p["bias"])
    d = q.copy()
    d[np.arange(len(y)), y] -= 1
    d *= (weight[y] / len(y))[:, None]
    grads = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
    back = d @ p["out"].T
    rows = np.arange(len(y))[:, None]
    for i, w in enumerate(WIDTHS):
        cols, at, best = seen[w]
        g = back[:, i * FILTERS : (i + 1) * FILTERS] * (best > 0)
        picked = cols[rows, at]  # batch, filter, w * DIM: only the maximum of each filter has a gradient
        grads[f"w{w}"] = np.einsum("bfk,bf->kf", picked, g)
        grads[f"b{w}"] = g.sum(0)
        to = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(len(y), FILTERS, w, DIM)
        for o in range(w):
            np.add.at(grads["emb"], x[rows, at + o], to[:, :, o])
    return grads


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _tables(m: dict) -> dict:
    """For each width, a table for each pair of neighbouring bytes (and one for an odd last byte)."""
    out = {}
    for w in WIDTHS:
        one = [(m["emb"] @ m[f"w{w}"][o * DIM : (o + 1) * DIM]).astype(np.float32) for o in range(w)]
        one[0] = one[0] + m[f"b{w}"]
        two = [(o, (one[o][:, None] + one[o + 1][None]).reshape(-1, FILTERS)) for o in range(0, w - 1, 2)]
        out[w] = two, (w - 1, one[w - 1]) if w % 2 else None
    return out


def predict(m: dict, tables: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    x, of, sizes = windows(texts)
    total = np.zeros((len(texts), len(m["names"])))
    for a in range(0, len(x), 512):
        b = x[a : a + 512]
        pairs = b[:, :-1] * 257 + b[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            two, odd = tables[w]
            z = two[0][1][pairs[:, :n]]
            for o, t in two[1:]:
                z += t[pairs[:, o : o + n]]
            if odd:
                z += odd[1][b[:, odd[0] : odd[0] + n]]
            pooled.append(np.maximum(z.max(axis=1), 0))
        q = _softmax(np.concatenate(pooled, axis=1) @ m["out"] + m["bias"])
        np.add.at(total, of[a : a + 512], q * sizes[a : a + 512, None])
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    best = total.argmax(axis=1)
    return [m["names"][i] for i in best], total[np.arange(len(texts)), best]


def fit(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> dict | None:
    known = docs.select("doc_id", "text", "lang").where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = thinned(known, "lang", per_language).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([(r["text"], r["lang"]) for r in rows if _letter(r["text"])])


def classify(docs: DataFrame, model: dict | None, flag) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches):
        tables = _tables(model) if model else None
        for batch in small(batches, "text"):
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in pieces(texts):
                some = [i for i in range(a, b) if model and texts[i] and _letter(texts[i])]
                if some:
                    found, score = predict(model, tables, [texts[i] for i in some])
                    scores[some] = score
                    for i, lang in zip(some, found, strict=True):
                        langs[i] = lang
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 3) == 1
    return classify(docs, fit(docs, ~held_out), held_out)
