"""Names, ids, keys and text pieces as column expressions.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and tokens that results depend on.
QUERY_STOP_WORDS = (
    "the and but for with this that these those what who when where why how which whose does did is are was were be been being "
    "him her his she they them their you your from into about over after before between say said says saying tell told telling "
    "one two three some any all more most"
).split()
FILLER_WORDS = "was is am are be been being feels feel felt seems seem appeared appears very somewhat quite rather a an the of at to for with by in on but and or from".split()
SNAPSHOT_TOKENS = "boarding weather ship cargo scene current_location battle pursuit alarm chase attack confrontation escape".split()

CHUNK_CHARS, CHUNK_STRIDE = 2000, 1600
#: Word boundaries of ASCII words, which Java's own are not.
_EDGE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def norm_name(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))


def _dashed(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(c) -> Column:
    return F.concat(F.lit("chr-"), _dashed(c))


def location_slug(c) -> Column:
    return F.concat(F.lit("loc-"), _dashed(c))


def item_slug(c) -> Column:
    return F.concat(F.lit("item-"), _dashed(c))


def chat_scoped_id(name, chat) -> Column:
    """The plain slug if there is no chat."""
    chat = F.col(chat) if isinstance(chat, str) else chat
    scoped = F.concat(F.lit("chr-"), F.substring(F.sha1(chat), 1, 6), F.lit("-"), _dashed(name))
    return F.when(_text(chat) == "", slug(name)).otherwise(scoped)


def content_id(prefix: str, key) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(_text(key)), 1, 16))


def fallback_ids(name, chats: Column) -> Column:
    return F.array_distinct(F.concat(F.array(slug(name)), F.transform(F.filter(chats, lambda x: _text(x) != ""), lambda x: F.concat(F.lit("chr-"), F.substring(F.sha1(x), 1, 6), F.lit("-"), _dashed(name)))))


def state_key(c) -> Column:
    """Possessives, punctuation and a trailing qualifier dropped; runs of space and dash as one underscore."""
    k = F.lower(F.regexp_replace(_text(c), r"^\s+|\s+$", ""))
    for pattern, to in ((r"['’]s\b", "s"), (r"[^\w\s_-]", ""), (r"[\s-]+", "_"), (r"_(status|state)$", ""), ("_+", "_"), ("^_+|_+$", "")):
        k = F.regexp_replace(k, pattern, to)
    return k


def is_snapshot_key(c) -> Column:
    some = "|".join(SNAPSHOT_TOKENS)
    return state_key(c).rlike(f"^({some})(_|$)|_({some})$")


def approx_stem(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for pattern, to in (("ies$", "i"), ("sses$", "ss"), ("ied$", "i"), ("(ing|ed|ly|ness|ion|ions|ful|er|est|s)$", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def meaningful_words(c) -> Column:
    found = F.split(F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z]+", " ")), r"\s+")
    return F.filter(found, lambda w: (w != "") & ~F.array_contains(strings(FILLER_WORDS), w))


def is_transient(c, stems: list[str]) -> Column:
    """Up to four meaningful words of which the first is a state word or has a state stem."""
    w = meaningful_words(c)
    first = F.get(w, F.lit(0))
    state = strings(stems)
    return F.coalesce((F.size(w) <= 4) & (F.array_contains(state, approx_stem(first)) | F.array_contains(state, first)), F.lit(False))


def disposition(content, category, accept: list[str], emotions: list[str], arousal: dict[str, float], reject_from: float = 0.55) -> Column:
    """accept, reject or verify.  The lexicons are the caller's and are small; larger ones are joined (operators.traits)."""
    first = F.get(meaningful_words(content), F.lit(0))
    stem = approx_stem(first)
    has = lambda words: F.array_contains(strings(words), first) | F.array_contains(strings(words), stem)
    levels = F.create_map(*[F.lit(x) for kv in arousal.items() for x in kv]) if arousal else F.expr("cast(map() as map<string,double>)")
    level = F.coalesce(F.try_element_at(levels, first), F.try_element_at(levels, stem))
    judged = F.when(level.isNull() | (level >= reject_from), "reject").otherwise("verify")
    return F.when(F.coalesce(category, F.lit("personality")) != "personality", "verify").when(first.isNull(), "verify").when(has(accept), "accept").when(has(emotions), judged).otherwise("verify")


def norm_content(c) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]", "")


def tokens(c) -> Column:
    """Lower-cased runs of letters and digits, with repeats: the `simple` analyzer."""
    return F.filter(F.split(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def query_terms(c) -> Column:
    """Distinct terms of an OR query: longer than two letters and no stop words."""
    found = F.split(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(QUERY_STOP_WORDS), w)))


def chunks(c) -> Column:
    """Windows of 2000 characters every 1600, the last one reaching the end."""
    c = _text(c)
    last = F.greatest(F.ceil((F.length(c) - CHUNK_CHARS) / CHUNK_STRIDE), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * CHUNK_STRIDE + 1, F.lit(CHUNK_CHARS)))


def quotes(c) -> Column:
    """Spans of 4 to 400 characters between straight or curly double quotes, trimmed."""
    found = F.regexp_extract_all(_text(c), F.lit('["“]([^"“”\\n]{4,400})["”]'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) >= 4)


def strip_blocks(c, tags=("info_board", "think")) -> Column:
    """Closed blocks, and a block that isn't closed up to the end."""
    c = _text(c)
    for t in tags:
        c = F.regexp_replace(F.regexp_replace(c, f"(?is)<{t}>.*?</{t}>", " "), f"(?is)<{t}>.*$", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentiment_label(s) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s >= 0.7, "very positive").when(s >= 0.3, "positive").when(s >= -0.3, "neutral").when(s >= -0.7, "negative").otherwise("very negative")


def sentiment_sign(s) -> Column:
    return F.when(s > 0.3, "positive").when(s < -0.3, "negative").otherwise("neutral")


def sentiment_panel(s) -> Column:
    return F.when(s >= 0.6, "very positive").when(s >= 0.2, "positive").when(s > -0.2, "neutral").when(s > -0.6, "negative").otherwise("very negative")


def _rule(text: Column, words: str) -> Column:
    return text.rlike(f"{_EDGE[0]}({words}){_EDGE[1]}")


def lore_domain(comment, keys: Column, content) -> Column:
    """Ordered rules; the first that fits decides."""
    t = F.lower(F.concat_ws(" ", _text(comment), F.array_join(keys, " "), _text(content)))
    # fixed values, as are _PERSON and _PLACE below
    rules = (
        ("lore", "race|species|class|ability|magic|spell|skill"),
        ("secret", "secret|hidden|unknown|forbidden|only .* knows"),
        ("rule", "rule|law|custom|tradition|taboo|must|always|never"),
        ("backstory", "born|childhood|past|history|origin|backstory|used to"),
    )
    out = F.lit("lore")
    for name, words in reversed(rules):
        out = F.when(_rule(t, words), name).otherwise(out)
    return out


_GENERIC = "(?i)^(the|a|an|about|info|note)"
_PERSON = "he|she|they|his|her|their|personality|appearance|age|hair|eyes"
_PLACE = "located|situated|lies|stands|built|area|region|place|land|realm|city|town|village|forest|mountain|castle|tavern|temple"


def _named(comment: Column) -> Column:
    return (_text(comment) != "") & (F.length(comment) < 40) & ~comment.rlike(_GENERIC)


def lore_character(comment, content) -> Column:
    return F.when(_rule(F.lower(_text(content)), _PERSON) & _named(comment), comment)


def lore_location(comment, keys: Column, content) -> Column:
    key = F.get(keys, F.lit(0))
    return F.when(_rule(F.lower(_text(content)), _PLACE), F.when(_named(comment), comment).when((_text(key) != "") & (F.length(key) < 40), key))


def fill_template(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), r"(?i)\{\{user\}\}", "(user)"), r"(?i)\{\{char\}\}", "(character)")


def mentions(text: Column, name: Column) -> Column:
    """The name as a whole word, any case; names of one letter never."""
    return (F.length(name) >= 2) & F.regexp_like(text, F.concat(F.lit(rf"(?i){_EDGE[0]}\Q"), name, F.lit(rf"\E{_EDGE[1]}")))


def event_text(summary, quote) -> Column:
    both = F.when(_text(quote) != "", F.concat(_text(summary), F.lit("\n\n"), _text(quote))).otherwise(_text(summary))
    return F.substring(both, 1, 8000)


def snapshot_text(summary, tone, present: Column) -> Column:
    tone = F.when(_text(tone) != "", F.concat(F.lit("tone: "), _col(tone)))
    people = F.when(F.size(present) > 0, F.concat(F.lit("present: "), F.array_join(present, ", ")))
    return F.substring(F.concat_ws("\n", F.when(_text(summary) != "", _col(summary)), tone, people), 1, 8000)


def alias_entry(content, evidence) -> Column:
    return F.when(_text(evidence) != "", F.concat_ws(": ", _col(content), _col(evidence))).otherwise(_col(content))


def trait_text(name, content, evidence) -> Column:
    return F.concat(_text(name), F.lit(" is "), alias_entry(content, evidence))


def chat_label(c) -> Column:
    return F.split_part(F.regexp_replace(_text(c), r"\.jsonl$", ""), F.lit(" - "), F.lit(1))


def description_of(traits: Column) -> Column:
    return F.array_join(F.filter(traits, lambda x: _text(x) != ""), "; ")


def merge_tone(base, fragments: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(_text(base)), fragments), lambda x: F.trim(x) != ""), " | ")


def stale_tag(value, age: Column, limit: int = 15) -> Column:
    return F.when(age >= limit, F.concat(value, F.lit(" [stale: not seen in "), age.cast("string"), F.lit(" turns]"))).otherwise(value)


def arc_title(level: str, summary) -> Column:
    return F.concat(F.lit({"super": "Super Arc: ", "arc": "Arc: ", "episode": "Episode: "}[level]), F.substring(_text(summary), 1, 80))


def file_date(c) -> Column:
    return F.regexp_extract(_text(c), r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1)


def redacted(c) -> Column:
    """What may be shown of a secret: that it is set, and its first four characters; null if it isn't."""
    return F.when(_text(c) != "", F.concat(F.lit("set:"), F.substring(_col(c), 1, 4), F.lit("…")))


def loose_json(c) -> Column:
    """Byte-order mark, line comments and trailing commas removed."""
    c = F.regexp_replace(F.regexp_replace(_text(c), r",(\s*[}\]])", "$1"), "^\ufeff", "")
    return F.regexp_replace(c, "//[^\\n]*\\n", "\n")


def json_forms(c) -> list[Column]:
    """The raw text, a fenced block in it, and the stretch from the first to the last brace."""
    c = _text(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return [loose_json(c), loose_json(fenced), loose_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1))]


def json_candidates(c) -> Column:
    return F.array(*json_forms(c))
