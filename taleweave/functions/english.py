"""The English analyzer of text search: words, stop words, stems and positions, in one Arrow pass over a column.

`stem` is the public Porter2 algorithm ("English" in the Snowball collection).  A worker remembers the stems of the
words that it has seen, so that a text costs a look-up for each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The stop words of English text search.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())  # fmt: skip
# Fixed values of Porter2: whole words, and the endings of each step with what takes their place.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_STARTS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_VOWEL = "aeiouy"
_REGION = re.compile("[aeiouy][^aeiouy]")
_WORDS = re.compile("[a-z0-9]+")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, looking from `start` on."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-1] not in _VOWEL and word[-1] not in "wxY" and word[-2] in _VOWEL and word[-3] not in _VOWEL


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        return w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    if not e or not any(c in _VOWEL for c in w[: -len(e)]):
        return w
    w = w[: -len(e)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if _short_end(w) and r1 >= len(w) else w


def _replaced(w: str, e: str, to: str, from_: int) -> str:
    return w[: len(w) - len(e)] + to if len(w) - len(e) >= from_ else w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    start = next((len(s) for s in LONG_STARTS if w.startswith(s)), None)
    r1 = _region(w, 0) if start is None else start
    r2 = _region(w, r1)
    w = _plural(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    e = _ending(w, STEP_2)
    if e and not (e == "ogi" and w[-4:-3] != "l") and not (e == "li" and w[-3:-2] not in LI_ENDINGS):
        w = _replaced(w, e, STEP_2[e], r1)
    e = _ending(w, STEP_3)
    if e:
        w = _replaced(w, e, STEP_3[e], r2 if e == "ative" else r1)
    e = _ending(w, STEP_4)
    if e and not (e == "ion" and w[-4:-3] not in ("s", "t")):
        w = _replaced(w, e, "", r2)
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str | None) -> tuple[list[str], list[int]]:
    """Stems of the words that are no stop words, and each one's place among all words, from 1."""
    found = [(stem(w), i) for i, w in enumerate(_WORDS.findall((text or "").lower()), 1) if w not in STOP_WORDS]
    return [s for s, _ in found], [i for _, i in found]


def query_lexemes(terms: list[str]) -> list[str]:
    """An OR query's distinct lexemes, in order; stop words go."""
    return list(dict.fromkeys(s for t in terms for s in lexemes(t)[0]))


#: Bytes of text that a worker holds as Python objects at a time.
SLICE = 1 << 20


def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Consecutive texts of so many bytes, or one longer text: what a worker holds doesn't follow the size of its batches."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield texts.slice(at, end - at)
            at = end
        if not len(texts):
            yield texts


@F.arrow_udf(StructType([StructField("terms", ArrayType(StringType())), StructField("at", ArrayType(IntegerType()))]))
def _analysed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in slices(batches):
        found = [lexemes(t) for t in texts.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([p for _, p in found], pa.list_(pa.int32()))], names=["terms", "at"])


def analysed(text) -> Column:
    """terms and at: the stems of a text in order, and their places.  Null has none."""
    return _analysed(F.col(text) if isinstance(text, str) else text)


def times_of(text, terms: list[str]) -> Column:
    """How often each of some stems stands in a text: an array of counts in the order of the stems."""
    places = {t: i for i, t in enumerate(terms)}

    @F.arrow_udf(ArrayType(IntegerType()))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            out = []
            for t in texts.to_pylist():
                n = [0] * len(places)
                for w in _WORDS.findall((t or "").lower()):
                    if w not in STOP_WORDS and (i := places.get(stem(w))) is not None:
                        n[i] += 1
                out.append(n)
            yield pa.array(out, pa.list_(pa.int32()))

    return counted(F.col(text) if isinstance(text, str) else text)


# A headline's fragments at most, the words of each, those shown where nothing matches, and how short a word at an end may not be.
FRAGMENTS, MOST_WORDS, LEAST_WORDS, SHORT_WORD = 5, 150, 30, 3
_ANY_WORD = re.compile("[A-Za-z0-9]+")


def fragments(text: str, terms: frozenset[str]) -> list[tuple[int, int]]:
    """Word ranges (first, last) of a headline, and none if no word matches.

    An OR query's minimal covers are its single matches.  The first one that no fragment holds yet is stretched to both
    sides, to half of the words that are left and then to the right as far as they go, never into another fragment; ends
    that are short words are given back.
    """
    words = [m[0].lower() for m in _ANY_WORD.finditer(text)]
    hit = [w not in STOP_WORDS and stem(w) in terms for w in words]
    poor = [len(w) <= SHORT_WORD and not h for w, h in zip(words, hit, strict=True)]
    taken = [False] * len(words)
    out: list[tuple[int, int]] = []
    for at in (i for i, h in enumerate(hit) if h):
        if taken[at]:
            continue
        if len(out) == FRAGMENTS:
            break
        first, last = at, at
        while first and at - first < (MOST_WORDS - 1) // 2 and not taken[first - 1]:
            first -= 1
        while first < at and poor[first]:
            first += 1
        while last + 1 < len(words) and last - first + 1 < MOST_WORDS and not taken[last + 1]:
            last += 1
        while last > at and poor[last]:
            last -= 1
        taken[first : last + 1] = [True] * (last + 1 - first)
        out.append((first, last))
    return sorted(out)


def marked(text: str | None, terms: frozenset[str]) -> str:
    """The headline: fragments in the text's order, matches in bold."""
    text = text or ""
    spans = [m.span() for m in _ANY_WORD.finditer(text)]
    found = fragments(text, terms)
    if not found:
        return text[spans[0][0] : spans[min(LEAST_WORDS, len(spans)) - 1][1]] if spans else ""
    parts = []
    for first, last in found:
        at, piece = spans[first][0], []
        for a, b in spans[first : last + 1]:
            w = text[a:b].lower()
            own = w not in STOP_WORDS and stem(w) in terms
            piece += [text[at:a], "<b>" if own else "", text[a:b], "</b>" if own else ""]
            at = b
        parts.append("".join(piece))
    return " ... ".join(parts)


def headline(text, terms: list[str]) -> Column:
    """Of a text column, for stems of a query."""
    wanted = frozenset(terms)

    @F.arrow_udf(StringType())
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([marked(t, wanted) for t in texts.to_pylist()], pa.string())

    return made(F.col(text) if isinstance(text, str) else text)


def _sql_steps(words: str) -> list[tuple[str, str]]:
    """The stemmer as a chain of selects over distinct words, in another engine's SQL: the checking queries' own way to the same stems."""
    vowel, other = "[aeiouy]", "[^aeiouy]"

    def whole(c: str) -> str:
        return f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in WHOLE.items()) + " END"

    def short(c: str) -> str:
        return f"regexp_matches({c}, '^{vowel}{other}$|{other}{vowel}[^aeiouywxY]$')"

    def first(pairs, region: str, extra: dict | None = None) -> str:
        """Longest ending first; it is replaced where it stands in the region, and else the word stays."""
        lines = []
        for e, to in sorted(pairs.items(), key=lambda p: -len(p[0])):
            cond = f"length(w) - {len(e)} >= {(extra or {}).get(e, (region, ''))[0]}" + (extra or {}).get(e, ("", ""))[1]
            lines.append(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {cond} THEN left(w, length(w) - {len(e)}) || '{to}' ELSE w END")
        return "CASE " + " ".join(lines) + " ELSE w END"

    rest = "word, r1, r2"
    return [
        ("x0", f"SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({vowel})y', '\\1Y', 'g') AS w FROM {words}"),
        ("x1", f"""SELECT word, w, CASE {' '.join(f"WHEN starts_with(w, '{s}') THEN {len(s)}" for s in LONG_STARTS)} WHEN regexp_matches(w, '{vowel}{other}') THEN length(regexp_extract(w, '^{other}*{vowel}+{other}')) ELSE length(w) END AS r1 FROM x0"""),
        ("x2", f"SELECT word, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{vowel}{other}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{other}*{vowel}+{other}')) ELSE length(w) END AS r2 FROM x1"),
        ("x3", f"SELECT {rest}, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{vowel}.+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM x2"),
        ("x4", f"""SELECT {rest}, w AS plural, CASE WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(w, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(w, 'eed(ly)?$', 'ee') ELSE w END
            WHEN regexp_matches(w, '{vowel}.*(ed|edly|ing|ingly)$') AND regexp_matches(regexp_replace(w, '(ed|edly|ing|ingly)$', ''), '{vowel}') THEN regexp_replace(w, '(ed|edly|ing|ingly)$', '') || '+' ELSE w END AS w FROM x3"""),
        ("x5", f"""SELECT {rest}, plural, CASE WHEN NOT ends_with(w, '+') THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN replace(w, '+', 'e') WHEN regexp_matches(w, '({'|'.join(DOUBLES)})[+]$') THEN left(w, length(w) - 2)
            WHEN {short("replace(w, '+', '')")} AND r1 >= length(w) - 1 THEN replace(w, '+', 'e') ELSE replace(w, '+', '') END AS w FROM x4"""),
        ("x6", f"SELECT {rest}, plural, CASE WHEN regexp_matches(w, '.{other}[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM x5"),
        ("x7", f"SELECT {rest}, plural, {first(STEP_2, 'r1', {'ogi': ('r1', ' AND substr(w, length(w) - 3, 1) = ' + chr(39) + 'l' + chr(39)), 'li': ('r1', f' AND regexp_matches(w, {chr(39)}[{LI_ENDINGS}]li$' + chr(39) + ')')})} AS w FROM x6"),
        ("x8", f"SELECT {rest}, plural, {first(STEP_3, 'r1', {'ative': ('r2', '')})} AS w FROM x7"),
        ("x9", f"SELECT {rest}, plural, {first(dict.fromkeys(STEP_4, ''), 'r2', {'ion': ('r2', f' AND regexp_matches(w, {chr(39)}[st]ion$' + chr(39) + ')')})} AS w FROM x8"),
        ("stems", f"""SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN {whole('word')} IS NOT NULL THEN {whole('word')} WHEN plural IN ({', '.join(f"'{k}'" for k in KEPT_AFTER_PLURAL)}) THEN plural
            WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {short('left(w, length(w) - 1)')} THEN left(lower(w), length(w) - 1) ELSE lower(w) END
            WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(lower(w), length(w) - 1) ELSE lower(w) END AS stem FROM x9"""),
    ]


def stems_sql(words: str) -> str:
    """WITH-list items that end in stems(word, stem), for the distinct words of a table words(word)."""
    return ",\n".join(f"{n} AS ({q})" for n, q in _sql_steps(words))


def lexemes_sql(rows: str, id: str, text: str) -> str:
    """WITH-list items that end in lexemes(id, pos, stem), for a text column of a table in the WITH list or beside it."""
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    return f"""said AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT {id} AS id, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {rows}) y),
vocabulary AS (SELECT DISTINCT word FROM said WHERE word NOT IN ({stop})),
{stems_sql('vocabulary')},
lexemes AS (SELECT id, pos, stem FROM said JOIN stems USING (word))"""
