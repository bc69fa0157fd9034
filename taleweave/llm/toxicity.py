"""Toxicity: a Levenshtein automaton run along a lexicon trie, and scores from each hit's context.

The lexicon is learned from a bounded sample of labelled documents: words, and stems with several endings,
that are many times commoner in toxic documents than in others.  Near copies of a document count once, so
the words of one copied text don't enter it.  The trie is walked with the automaton's rows: a word of five
letters or more may differ from a term by one insertion, deletion, substitution or swap.  A stem's node
accepts any ending, so a word may differ by one edit within the stem, if that has five letters or more.
The parts of a term or stem that one edit leaves whole select the few words for which the walk is worth it.

Each hit is scored in a window of words: hits beside it raise the score, and one inside quotation marks
counts for a third, as someone else's words; a quotation may have any length within its paragraph.  A logistic regression over a document's hit scores gives
its score.

Defined results: null and empty texts have no hits and get the score of such; without both classes to learn
from, every score is 0; a text of any length is scored whole; repeated rows, of one id or not, are scored alike;
an empty table gives an empty result; `score` ignores other columns, whatever their names, `keep_clean` keeps them.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frugal, pieces, small
from .learning import labelled_sample, logistic, sigmoid

#: Labelled documents of either class that are learned from, about.
PER_CLASS = 3000
THRESHOLD, SPAN = 0.3, 6
LEAST_RATIO, FUZZY_FROM, STEM_FROM, STEM_TO = 20.0, 5, 4, 8
QUOTED, NEIGHBOUR, FUZZY = 0.33, 0.25, 0.5
LEAST_SHARE, CHANCE = 0.01, 0.05
_WORD = re.compile(r"[^\W_]+")
#: Quotation marks, and the ends of paragraphs.
_MARKS = re.compile(r"[\"“”„«»‘’]|\n[^\S\n]*\n")
#: The marks that close each opening one.
_CLOSED_BY = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}


class Lexicon:
    """A trie of terms; a stem takes any ending."""

    def __init__(self, terms: list[str], stems: list[str], known: list[str] = ()):
        """known: words that resemble a term but are used in clean documents."""
        self.terms, self.stems, self.known = sorted(terms), sorted(stems), set(known)
        self.root: dict = {}
        for term in self.terms:
            self._add(term)["word"] = term
        for stem in self.stems:
            self._add(stem)["stem"] = stem
        self.exact, self.stem_set = set(self.terms), set(self.stems)
        self.lengths = sorted({len(s) for s in self.stems})
        self.heads, self.tails, self.swaps = defaultdict(set), defaultdict(set), set()
        for t in self.terms:
            if len(t) >= FUZZY_FROM:
                h = len(t) // 2
                self.heads[h].add(t[:h])
                self.tails[len(t) - h].add(t[h:])
                self.swaps.add(t[: h - 1] + t[h] + t[h - 1] + t[h + 1 :])
        self.heads, self.tails = dict(self.heads), dict(self.tails)
        # of stems: first halves, last halves by where they may start, and stems with the middle letters swapped
        self.stem_heads, self.stem_tails, self.stem_swaps = defaultdict(set), defaultdict(set), defaultdict(set)
        for s in self.stems:
            if len(s) >= FUZZY_FROM:
                h = len(s) // 2
                self.stem_heads[h].add(s[:h])
                for start in (h - 1, h, h + 1):
                    self.stem_tails[start, start + len(s) - h].add(s[h:])
                self.stem_swaps[len(s)].add(s[: h - 1] + s[h] + s[h - 1] + s[h + 1 :])
        self.stem_heads, self.stem_tails, self.stem_swaps = dict(self.stem_heads), dict(self.stem_tails), dict(self.stem_swaps)

    def _add(self, term: str) -> dict:
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        return node

    def walk(self, word: str) -> str | None:
        """The first term within one edit of the word, or else stem of its beginning: rows of the automaton go down the trie's branches."""
        n = len(word)
        stack = [(self.root, None, None, "", list(range(n + 1)))]
        found = began = None
        while stack:
            node, above, last, char, row = stack.pop()
            for c, child in node.items():
                if len(c) != 1:
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    cost = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != c))
                    if above is not None and i > 1 and word[i - 1] == char and word[i - 2] == c:
                        cost = min(cost, above[i - 2] + 1)
                    new.append(cost)
                term = child.get("word")
                if term and len(term) >= FUZZY_FROM and new[n] <= 1 and (found is None or term < found):
                    found = term
                stem = child.get("stem")
                if stem and len(stem) >= FUZZY_FROM and min(new) <= 1 and (began is None or stem < began):
                    began = stem
                if min(new) <= 1 or min(row) <= 1:
                    stack.append((child, row, last, c, new))
        return found or began

    def _near_stem(self, word: str) -> bool:
        return any(word[:k] in s for k, s in self.stem_heads.items()) or any(word[a:b] in s for (a, b), s in self.stem_tails.items()) or any(word[:k] in s for k, s in self.stem_swaps.items())

    def match(self, word: str) -> tuple[str, float] | None:
        """The term that a lower-cased word stands for, and how surely."""
        if word in self.exact:
            return word, 1.0
        for k in self.lengths:
            if word[:k] in self.stem_set:
                return word[:k], 1.0
        if len(word) < FUZZY_FROM - 1 or word in self.known:
            return None
        if word in self.swaps or any(word[:k] in s for k, s in self.heads.items()) or any(word[-k:] in s for k, s in self.tails.items()) or self._near_stem(word):
            term = self.walk(word)
            return (term, FUZZY) if term else None
        return None


def quotations(text: str) -> list[tuple[int, int]]:
    """Where text is quoted, in order and apart, by one scan.  Each kind of mark pairs by itself; one that its paragraph doesn't close is none."""
    found, opened = [], {}
    for m in _MARKS.finditer(text):
        mark, at = m.group(), m.start()
        if mark[0] == "\n":
            opened.clear()
            continue
        closes = next((o for o in opened if mark in _CLOSED_BY[o]), None)
        if closes and at > opened[closes] + 1:
            found.append((opened.pop(closes), at + 1))
        elif mark in _CLOSED_BY:
            opened[mark] = at
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def document_features(text: str, hits: dict[str, tuple[str, float]]) -> list[float]:
    """hits: the words of this text (or of others too) that stand for terms."""
    spans = [(m.start(), m.end(), hits.get(m.group())) for m in _WORD.finditer(text.lower())]
    quotes = quotations(text)
    starts = [a for a, _ in quotes]
    at = [i for i, (_, _, hit) in enumerate(spans) if hit]
    weights = []
    for i in at:
        q = bisect.bisect_right(starts, spans[i][0]) - 1
        quoted = q >= 0 and spans[i][1] <= quotes[q][1]
        near = bisect.bisect_right(at, i + SPAN) - bisect.bisect_left(at, i - SPAN) - 1
        weights.append(spans[i][2][1] * (QUOTED if quoted else 1.0) * (1 + NEIGHBOUR * min(near, 3)))
    if not weights:
        return [0.0, 0.0, 0.0]
    return [float(np.log1p(sum(weights))), max(weights), float(np.log1p(len({spans[i][2][0] for i in at})))]


def _families(texts: list[str]) -> list[int]:
    """A number for each document, the same for near copies: they share half of the least word hashes."""
    numbers, seen = [], {}
    for i, text in enumerate(texts):
        low = sorted(xxhash.xxh64_intdigest(w) for w in _words(text))[:8]
        votes = Counter(seen[h] for h in low if h in seen)
        best, n = votes.most_common(1)[0] if votes else (i, 0)
        of = best if n >= max(1, (len(low) + 1) // 2) else i
        numbers.append(of)
        for h in low:
            seen.setdefault(h, of)
    return numbers


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _by_family(samples: list[tuple[str, int]], families: list[int], y: int):
    """The words of each family of near copies that has the label, one family at a time."""
    members = defaultdict(list)
    for f, (text, v) in zip(families, samples, strict=True):
        if v == y:
            members[f].append(text)
    for texts in members.values():
        yield set().union(*map(_words, texts))


def _with_stems(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1)}


def learn_lexicon(samples: list[tuple[str, int]]) -> Lexicon:
    families = _families([t for t, _ in samples])
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    total = {0: 0, 1: 0}
    for words in _by_family(samples, families, 1):
        counts[1].update(_with_stems(words))
        total[1] += 1
    candidates = {w for w, n in counts[1].items() if n >= 2}
    for words in _by_family(samples, families, 0):
        counts[0].update(candidates & _with_stems(words))
        total[0] += 1
    total = {y: n or 1 for y, n in total.items()}
    # so often that not one of all these words would be in toxic documents alone by chance
    by_chance = np.log(CHANCE / max(1, len(counts[1]))) / np.log(total[1] / (total[1] + total[0]))
    least = max(2, round(LEAST_SHARE * total[1]), int(np.ceil(by_chance)))
    strong = {}
    for w, n in counts[1].items():
        if n >= least and n / total[1] >= LEAST_RATIO * ((counts[0][w] + 0.5) / total[0]):
            strong[w] = n
    endings: dict[str, list[int]] = defaultdict(list)
    for w, n in counts[1].items():
        for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1):
            if w[-1] != "*" and w[:k] + "*" in strong:
                endings[w[:k] + "*"].append(n)
    # a stem has several endings, none of which is behind most of its documents: that would be a word
    strong = {w: n for w, n in strong.items() if w[-1] != "*" or len(endings[w]) >= 3 and 2 * max(endings[w]) <= n}
    stems: list[str] = []
    for s in sorted((w for w in strong if w[-1] == "*"), key=lambda w: (len(w), w)):
        if any(s.startswith(x) for x in stems):
            continue
        best = s[:-1]  # the longest stem that keeps nine tenths of this one's documents
        for longer in sorted((w for w in strong if w[-1] == "*" and w.startswith(s[:-1])), key=lambda w: (len(w), w)):
            if strong[longer] >= 0.9 * strong[s]:
                best = longer[:-1]
        stems.append(best)
    stems = sorted(set(stems))
    return Lexicon([w for w in strong if w[-1] != "*" and len(w) >= 3 and not any(w.startswith(s) for s in stems)], stems)


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> dict | None:
    samples = labelled_sample(docs, labels, "toxic", learn, per_class)
    y = np.array([v for _, v in samples], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    lexicon = learn_lexicon(samples)
    clean = {w for t, v in samples if not v for w in _words(t) if lexicon.match(w)}
    lexicon.known = {w for w in clean if (m := lexicon.match(w)) and m[1] < 1}
    hits = {w: m for t, _ in samples for w in _words(t) if (m := lexicon.match(w))}
    x = np.array([document_features(t, hits) for t, _ in samples])
    return {"terms": lexicon.terms, "stems": lexicon.stems, "known": sorted(lexicon.known), "weights": logistic(x, y)}


def score_texts(model: dict | None, lexicon: Lexicon | None, texts: list[str | None]) -> np.ndarray:
    scores = np.zeros(len(texts))
    if not model:
        return scores
    w = model["weights"]
    scores[:] = sigmoid(w[-1])
    for a, b in pieces(texts):
        sets = [set(_WORD.findall((t or "").lower())) for t in texts[a:b]]
        hits = {x: m for x in set().union(*sets) if (m := lexicon.match(x))}
        if hits:
            for i, s in enumerate(sets, a):
                if not hits.keys().isdisjoint(s):
                    scores[i] = sigmoid(np.dot(w[:-1], document_features(texts[i], hits)) + w[-1])
    return scores


def score(docs: DataFrame, model: dict | None, flag, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        lexicon = Lexicon(model["terms"], model["stems"], model["known"]) if model else None
        for batch in small(batches, "text"):
            s = score_texts(model, lexicon, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't rejected, with all their columns, in one pass over the table."""

    def run(batches):
        lexicon = Lexicon(model["terms"], model["stems"], model["known"]) if model else None
        for batch in small(batches, "text"):
            texts = batch.column("text").cast(pa.string()).to_pylist()
            yield batch.filter(pa.array(score_texts(model, lexicon, texts) < threshold))

    return frugal(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold("doc_id", 4) == 2
    return score(docs, fit(docs, labels, ~held_out), held_out)
