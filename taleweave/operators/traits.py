"""Traits: the gate before embeddings, nearest neighbours, and the fold that merges wordings into one row."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from .nearest import nearest_rows

MERGE_FROM, VERIFY_FROM, OFFLINE_MERGE_FROM, LEXICAL_MERGE_FROM = 0.82, 0.72, 0.88, 0.55


def attributed(traits: DataFrame, guarded: Column, evidence: str) -> DataFrame:
    """Without guarded traits whose evidence names a sibling and not the character.  Columns: siblings, own."""
    names = lambda c: F.exists(F.col(c), lambda n: X.mentions(F.col(evidence), n))
    return traits.where(~(guarded & names("siblings") & ~names("own")))


def gated(traits: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds `verdict` by joins with a lexicon of any size: word, accepted, emotion, arousal."""
    words = traits.withColumn("_w", F.get(X.meaningful_words("content"), F.lit(0)))
    words = words.withColumn("_s", X.approx_stem("_w"))
    by = lambda c, p: lexicon.select(F.col("word").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in ("accepted", "emotion", "arousal")])
    j = words.join(by("_w", "a"), "_w", "left").join(by("_s", "b"), "_s", "left")
    yes = lambda x: F.coalesce(f"a_{x}", F.lit(False)) | F.coalesce(f"b_{x}", F.lit(False))
    level = F.coalesce("a_arousal", "b_arousal")
    emotional = F.when(level.isNull() | (level >= 0.55), "reject").otherwise("verify")
    verdict = F.when(F.coalesce("category", F.lit("personality")) != "personality", "verify").when(F.col("_w").isNull(), "verify").when(yes("accepted"), "accept").when(yes("emotion"), emotional).otherwise("verify")
    return j.withColumn("verdict", verdict).select(*traits.columns, "verdict")


def nearest(probes: DataFrame, traits: DataFrame, k: int = 3) -> DataFrame:
    """a_id, b_id, similarity, rank: the k nearest of the same character and category."""
    own = probes.select("character_id", "category", F.col("id").alias("query"), "embedding")
    found = nearest_rows(own, traits.select("character_id", "category", "id", "embedding"), ["character_id", "category"], k, True)
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id"))
    return found.select(F.col("query").alias("a_id"), F.col("id").alias("b_id"), "similarity").withColumn("rank", rank)


#: Containment of normalised texts: characters of a run, and runs of a window of which the least is kept.
RUN, WINDOW = 16, 32


def _least_runs(text: str) -> np.ndarray:
    """The least hash of each window of runs: a text that stands inside another brings all of its own along."""
    b = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint64)
    h = np.zeros(len(b) - RUN + 1, np.uint64)
    for i in range(RUN):
        h = h * np.uint64(1099511628211) + b[i : len(b) - RUN + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def contained(texts: list[str]) -> list[list[int]]:
    """For each of distinct texts of ASCII letters and digits, not empty: the others that it stands inside, or that stand inside it.

    Long texts meet by their rarest least run and are compared then; short ones are looked for in all texts.
    """
    near: list[list[int]] = [[] for _ in texts]
    long = [i for i, x in enumerate(texts) if len(x) >= RUN + WINDOW - 1]
    if long:
        each = [_least_runs(texts[i]) for i in long]
        owner = np.repeat(np.array(long), [len(x) for x in each])
        runs = np.concatenate(each)
        by = np.argsort(runs, kind="stable")
        owner, runs = owner[by], runs[by]
        for i, own in zip(long, each, strict=True):
            lo, hi = np.searchsorted(runs, own, "left"), np.searchsorted(runs, own, "right")
            key = (hi - lo).argmin()
            for j in owner[lo[key] : hi[key]].tolist():
                if j != i and texts[i] in texts[j]:
                    near[i].append(j)
                    near[j].append(i)
    short = set(range(len(texts))) - set(long)
    if short:
        whole = "\n".join(texts)
        starts = np.cumsum([0, *[len(x) + 1 for x in texts]])
        for i in short:
            at = whole.find(texts[i])
            while at >= 0:
                j = int(np.searchsorted(starts, at, "right")) - 1
                if j != i:
                    near[i].append(j)
                    near[j].append(i)
                at = whole.find(texts[i], int(starts[j + 1]))
    return near


_KEPT = re.compile("[^a-z0-9]+")
#: Rows whose vectors meet the canonical rows' at once.
AHEAD = 256


def _alike(rows: pd.Series, canonical: np.ndarray) -> np.ndarray | None:
    """Cosines of the rows' vectors (0 without one) and the canonical rows' units, in single precision."""
    if not len(canonical):
        return None
    m = np.zeros((len(rows), canonical.shape[1]), np.float32)
    for i, v in enumerate(rows):
        size = np.linalg.norm(np.asarray(v, float)) if v is not None else 0.0
        if size:
            m[i] = np.asarray(v, float) / size
    return m @ canonical.astype(np.float32).T


def fold(traits: DataFrame, merge: float = MERGE_FROM, verify: float = VERIFY_FROM, longest_first: bool = False, verdict=None) -> DataFrame:
    """id, canonical_id, merged_count, similarity: each wording against the canonical rows before it.

    Substring containment merges first, then equal wording, then cosine: from `merge` on at once, from
    `verify` on if verdict(candidate, canonical) says MERGE (its default), REJECT drops the row, KEEP
    makes it canonical.  Each insert changes what comes after, so a (character, category, chat) is one
    sequential fold; different ones run in parallel.  Wordings without a chat are a chat of their own.
    """
    decide = verdict or (lambda a, b: "MERGE")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True]) if longest_first else pdf.sort_values("id")
        norms = [_KEPT.sub("", x.lower()) for x in pdf["content"]]
        number = {x: i for i, x in enumerate(dict.fromkeys(x for x in norms if x))}
        near = contained(list(number))
        place = lambda k: (len(k[1]), -k[0])
        by_norm: dict[int, tuple] = {}
        empty = None  # stands inside every text
        vectors = np.zeros((16, 0))
        sized: list[tuple] = []
        merged: dict = {}
        out = []
        ahead, stop, known = None, 0, 0
        for at, (row, norm) in enumerate(zip(pdf.itertuples(index=False), norms, strict=True)):
            if at >= stop:  # the next rows against the canonical rows so far, as one product
                known = len(sized)
                stop = at + max(16, min(AHEAD, 4_000_000 // max(1, known)))
                ahead = _alike(pdf["embedding"].iloc[at:stop], vectors[:known])
                start, tops = at, None if ahead is None else ahead.max(axis=1)
            v = np.asarray(row.embedding, float) if row.embedding is not None else None
            size = np.linalg.norm(v) if v is not None else 0.0
            hit, how = None, 0.0
            n = number[norm] if norm else -1
            inside = [by_norm[i] for i in (n, *near[n]) if i in by_norm] if norm else []
            if norm and empty:
                inside.append(empty)
            if inside:
                hit, how = max(inside, key=place), 1.0
            elif size and sized:
                some = np.arange(known, len(sized))
                if ahead is not None and tops[at - start] >= verify - 1e-5:  # single precision picks, double precision ranks
                    some = np.concatenate([np.flatnonzero(ahead[at - start] >= tops[at - start] - 1e-5), some])
                best = None
                if len(some):
                    like = vectors[some] @ v / size
                    # a product may be off by rounding: those near its top are weighed again
                    best = max((float(v @ k[2]) / (size * k[3]), -k[0], k) for k in (sized[i] for i in some[np.flatnonzero(like >= like.max() - 1e-9)]))
                if best and best[0] >= verify:
                    said = "MERGE" if best[0] >= merge else decide(row.content, best[2][1])
                    if said == "REJECT":
                        continue
                    if said == "MERGE":
                        hit, how = best[2], best[0]
            if hit is None:
                kept = (row.id, row.content, v, size)
                if norm:
                    by_norm[n] = kept
                else:
                    empty = max(empty or kept, kept, key=place)
                if size:
                    if not sized:
                        vectors = np.zeros((16, len(v)))
                    elif len(sized) == len(vectors):
                        vectors = np.concatenate([vectors, np.zeros_like(vectors)])
                    vectors[len(sized)] = v / size
                    sized.append(kept)
                out.append([row.id, None, how])
            else:
                merged[hit[0]] = merged.get(hit[0], 0) + 1
                out.append([row.id, hit[0], how])
        found = pd.DataFrame(out, columns=["id", "canonical_id", "similarity"])
        found["canonical_id"] = found["canonical_id"].astype("Int64")
        found["merged_count"] = [merged.get(i, 0) for i in found["id"]]
        return found[["id", "canonical_id", "merged_count", "similarity"]]

    chat = F.coalesce(F.col("source_chat"), F.lit("")) if "source_chat" in traits.columns else F.lit("")
    rows = traits.select("character_id", "category", chat.alias("chat"), "id", "content", F.length("content").alias("size"), V.doubles("embedding").alias("embedding"))
    return rows.groupBy("character_id", "category", "chat").applyInPandas(run, "id long, canonical_id long, merged_count long, similarity double")
