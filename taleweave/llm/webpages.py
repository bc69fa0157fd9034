"""HTML extraction by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens: tags, each with its role (the path of tag names and classes above it, digits
made alike), and text blocks with the role they stand in.  A token's occurrence vector says how often each
page of the host holds it.  Vectors are never built: each is represented by a sum over pages of a hash of
(page, count), which adds up in partial aggregates, so a hot host needs no task of its own.

1. Tokens of a host with equal vectors are an equivalence class.  A text is valid in a class if at least
   `LEAST_PAGES` different pages support it, and if it nests: a tag of its class stands above it.  Valid
   texts are the template's; the tags that hold them are its nodes.
2. What is left of each role are the slots.  A node that each page has once, that may group others, and that
   holds at least `SHARE` of the host's slot text, and of its headings, lies on the way to the article; the
   deepest of them is the article's place.  A role whose slot text is nearly all links is a menu.
3. A page's text is what its slots in the article's place hold.  Template text there goes too, unless
   four fifths of the text there are template: then the host publishes the same articles again and again.

Hosts with fewer pages share the tags' statistics of all pages with the same layout, whatever their host.
Inside the article's place, forms, scripts, asides, reader comments and the like go by their tag or by a
class, id or role name; for a page without any template (a layout that hardly any page has) these rules are
all there is, and article or main elements are the place.

A page is parsed twice, for the template and for its text; only hashes and sums are written in between.

Defined results: null and empty html give an empty text; a null url or one without a host belongs to the
host ""; repeated pages count as one page of the template; an element nested deeper than `DEEPEST` belongs to
the one at that depth; the reading of a page takes time in proportion to its length, however broken it is; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, frugal, join_small, small
from .urls import host_of

LEAST_PAGES, SHARE, LINKED, NEARLY, AGAIN = 5, 0.5, 0.8, 0.9, 0.8
OTHER, GROUP, HEADING = 0, 1, 2
#: Levels that roles tell apart, and levels that elements nest to.
ROLE_LEVELS, DEEPEST = 32, 512
#: As many template texts, all hosts together, as are broadcast; beyond that each page gets its own by a join.
BROADCAST_TEXTS = 1_000_000
#: Elements of HTML, and the names that layouts give to what isn't content.
_UNSEEN = frozenset("script style noscript template head select textarea iframe svg object button form".split())
_ASIDE = frozenset("nav header footer aside dialog menu".split())
_RAW = frozenset("script style noscript textarea title iframe template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_GROUPS = frozenset("body div section article main center table tbody tr td".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation navi breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside rail widget related recommended notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login form search share sharing social comment comments respond reply replies disqus discussion skip pagination pager".split())
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
#: A tag whose values hold no angle brackets; what this doesn't match is read with more care.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>")
_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?+")
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_LAYOUT = r"(?i)<((?:article|main|section|div|nav|aside|header|footer|table)\b[^<>]{0,200})"


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


@lru_cache(20_000)
def _names(attributes: str) -> tuple[str, bool, bool]:
    """The classes of a tag, whether it is hidden, and whether its names say that it isn't content."""
    classes, hidden, named = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key in ("class", "id", "role"):
            classes += "." + _DIGITS.sub("#", value) if key == "class" else ""
            named |= any(x in _NAMES for x in _NAME.findall(value))
    return classes, hidden, named


@lru_cache(100_000)
def _role(above: int, label: str) -> int:
    return signed(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), above % 2**64))


class Element(NamedTuple):
    name: str
    role: int
    aside: bool  # by a tag or name that isn't content
    inside: bool  # an article or main element
    link: bool


class Block(NamedTuple):
    text: str
    role: int
    linked: int  # characters in links
    aside: bool
    inside: bool

    def token(self) -> int:
        return signed(xxhash.xxh64_intdigest(self.text.encode("utf-8", "replace"), self.role % 2**64))


class Page:
    """roles: of the opening tags, with their number.  paths: of each role, the roles from the root to it.
    kinds: of each role, its element's name, and whether that isn't content.  blocks: what can be seen, in order."""

    def __init__(self, source: str):
        self.roles: dict[int, int] = {}
        self.paths: dict[int, tuple[int, ...]] = {0: ()}
        self.kinds: dict[int, tuple[str, bool]] = {0: ("", False)}
        self.blocks: list[Block] = []
        self._stack = [Element("", 0, False, False, False)]
        self._unseen = 0  # the level of the outermost element that isn't seen
        self._parts: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self) -> None:
        if not self._parts:
            return
        text, self._parts = "".join(self._parts), []
        linked, self._linked = self._linked, 0
        if self._unseen:
            return
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            of = next(x for x in reversed(self._stack) if x.name not in _INLINE)
            self.blocks.append(Block(text, of.role, min(linked, len(text)), self._stack[-1].aside, of.inside))

    def _cut(self, level: int) -> None:
        del self._stack[level:]
        if self._unseen >= level:
            self._unseen = 0

    def _open(self, name: str, attributes: str) -> None:
        stack = self._stack
        if name not in _INLINE:
            self._flush()
        if name in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name not in _INLINE:
                    if stack[i].name == "p":
                        self._cut(i)
                    break
        elif name in _ENDS:
            same, stop = _ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in same:
                    self._cut(i)
                    break
                if stack[i].name in stop:
                    break
        above = stack[-1]
        named_by = _names if len(attributes) < 200 else _names.__wrapped__  # what is long isn't remembered
        classes, hidden, named = named_by(attributes) if attributes and not attributes.isspace() else ("", False, False)
        aside = above.aside or name in _ASIDE or named and name not in ("html", "body", "article", "main")
        path = self.paths[above.role]
        role = _role(above.role, name + classes) if len(path) < ROLE_LEVELS else above.role
        if role not in self.paths:
            self.paths[role], self.kinds[role] = (*path, role), (name, aside)
        if not self._unseen and len(path) < ROLE_LEVELS:
            self.roles[role] = self.roles.get(role, 0) + 1
        if name not in _VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
            if not self._unseen and (hidden or name in _UNSEEN):
                self._flush()
                self._unseen = len(stack)
            stack.append(Element(name, role, aside, above.inside or name in ("article", "main"), above.link or name == "a"))

    def _close(self, name: str) -> None:
        inline = name in _INLINE
        if not inline:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].name == name:
                if self._unseen >= i:
                    self._flush()
                self._cut(i)
                return
            if inline and self._stack[i].name not in _INLINE:
                return  # an inline element doesn't close the block around it

    def _text(self, piece: str) -> None:
        self._parts.append(piece)
        if self._stack[-1].link:
            self._linked += len(piece)

    def _read(self, source: str) -> None:
        at, failed, size = 0, set(), len(source)
        last = source.rfind(">")
        while (start := source.find("<", at)) >= 0:
            if start > at:
                self._text(source[at:start])
            m = _TAG.match(source, start)
            if m:
                at, closes, name, attributes = m.end(), m[1], m[2].lower(), m[3]
            elif source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                continue
            elif m := _START.match(source, start):
                end = _tag_end(source, m.end(), failed)
                if end < 0:  # no bracket ends it: the rest is text
                    self._text(source[start:])
                    at = size
                    break
                at, closes, name, attributes = end + 1, m[1], m[2].lower(), source[m.end() : end]
            else:
                end = source.find(">", start) if start < last and source[start + 1 : start + 2] in ("!", "?", "/") else -1
                if end >= 0:
                    at = end + 1
                else:
                    self._text("<")
                    at = start + 1
                continue
            if closes:
                self._close(name)
                continue
            self._open(name, attributes)
            if name == "br":
                self._parts.append(" ")
            elif name in _RAW:
                end = re.compile(rf"</{name}\s*+>", re.I).search(source, at)
                at = end.start() if end else size
        if at < size:
            self._text(source[at:])
        self._flush()


def _tag_end(source: str, at: int, failed: set[int]) -> int:
    """Where the tag's bracket is, outside quotation marks, or else the next bracket; -1 if there is none.

    failed: marks from which an earlier call has run to the end of the page; none is passed twice.
    """
    first, passed = at, []
    while m := _SPECIAL.search(source, at):
        if m.group() == ">":
            return m.start()
        if m.start() in failed:
            break
        passed.append(m.start())
        end = source.find(m.group(), m.end())
        if end < 0:
            break
        at = end + 1
    failed.update(passed)
    return source.find(">", first)


class Template(NamedTuple):
    """The article's place (0: anywhere), the roles that are menus, the texts that go."""

    place: int
    menus: frozenset[int]
    texts: frozenset[int]


def main_text(source: str | None, template: Template | None = None, names: bool = True) -> str:
    """names: whether tags and names decide inside the article's place."""
    page = Page(source or "")
    if template is None or template.place and template.place not in page.paths:
        article = any(b.inside and not b.aside for b in page.blocks)
        return " ".join(b.text for b in page.blocks if not b.aside and (b.inside or not article))
    place, menus, texts = template
    names = names and not page.kinds[place][1]  # where the place itself goes by such a name, names say nothing
    within = {}
    for role, path in page.paths.items():
        below = path[path.index(place) + 1 :] if place in path else path
        within[role] = (not place or place in path) and menus.isdisjoint(below)
    return " ".join(b.text for b in page.blocks if within[b.role] and not (names and b.aside) and not (texts and b.token() in texts))


def _rows(host: int, layout: int, source: str | None, own: int) -> list[tuple]:
    """group, token, of (the text's role, null for a tag), vector, n, chars, linked, path, kind."""
    page = Page(source or "")
    chars, linked, texts = {}, {}, {}
    for b in page.blocks:
        chars[b.role] = chars.get(b.role, 0) + len(b.text)
        linked[b.role] = linked.get(b.role, 0) + b.linked
        t = b.token()
        texts[t] = (b.role, texts[t][1] + 1 if t in texts else 1, len(b.text))
    out = []
    for role in page.roles.keys() | chars.keys():
        name, aside = page.kinds[role]
        kind = GROUP if name in _GROUPS else HEADING if name in ("h1", "h2") and not aside else OTHER
        n = page.roles.get(role, 0)
        for group in (host, layout):
            out.append((group, role, None, signed(own * (2 * n + 1) % 2**64), n, chars.get(role, 0), linked.get(role, 0), list(page.paths[role]), kind))
    out += [(host, t, role, signed(own * (2 * n + 1) % 2**64), n, n * size, 0, None, None) for t, (role, n, size) in texts.items()]
    return out


_FOUND = pa.schema([("group", pa.int64()), ("token", pa.int64()), ("of", pa.int64()), ("page", pa.int64()), ("vector", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("path", pa.list_(pa.int64())), ("kind", pa.int32())])


def _tokens(pages: DataFrame, least: int) -> DataFrame:
    """One row for each token of a group: its vector, the pages that hold it, and sums.  Texts of fewer pages than `least` are left out.

    pages: host, layout, page, html.
    """

    def run(batches):
        for batch in small(batches, "html"):
            out: list[tuple] = []
            for host, layout, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "page", "html")), strict=True):
                out += [(*r[:3], page, *r[3:]) for r in _rows(host, layout, source, page % 2**64)]
            columns = list(zip(*out, strict=True)) or [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    rows = pages.select("host", "layout", "page", "html").mapInArrow(run, "group long, token long, of long, page long, vector long, n long, chars long, linked long, path array<long>, kind int")
    # a page that the table repeats counts as one: each of its rows has its share
    many = lambda group: pages.groupBy(F.col(group).alias("group"), "page").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    repeats, one = durable(many("host").unionByName(many("layout"))), F.lit(1.0)
    if not repeats.isEmpty():
        rows, one = join_small(rows, repeats, ["group", "page"]), 1 / F.coalesce("times", F.lit(1))
    # path and kind belong to the token: as keys they keep the sums in a hash map
    vector = F.sum(F.col("vector").cast("decimal(20,0)"))
    sums = rows.groupBy("group", "token", "of", "path", "kind").agg(vector.alias("vector"), F.sum(one).alias("pages"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    return durable(sums.where(F.col("of").isNull() | (F.col("pages") >= least - 1e-6)))


def _template_texts(tokens: DataFrame) -> DataFrame:
    """group, token, of, chars of the texts that are valid in a class: a tag above them has their vector."""
    roles = tokens.where("of IS NULL").select("group", F.col("token").alias("role"), "vector", "path")
    texts = tokens.where("of IS NOT NULL").select("group", "token", "of", "vector", "chars")
    above = texts.join(roles.select("group", F.col("role").alias("of"), F.explode("path").alias("role")), ["group", "of"])
    return above.join(roles.select("group", "role", "vector"), ["group", "role", "vector"]).select("group", "token", "of", "chars").distinct()


def templates(pages: DataFrame, least: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Two tables.  group, place, menus: of groups with at least `least` pages.  group, token: the template's texts that go.

    pages: host, layout, page, html; a group is a host or a layout.
    """
    tokens = _tokens(pages, least)
    texts = durable(_template_texts(tokens))
    fixed = texts.groupBy("group", F.col("of").alias("role")).agg(F.sum("chars").alias("fixed"))
    roles = tokens.where("of IS NULL").withColumnRenamed("token", "role").join(fixed, ["group", "role"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    roles = durable(roles.withColumn("slot", F.greatest(F.col("chars") - F.col("fixed"), F.lit(0))))
    headed = F.when(F.col("kind") == HEADING, F.col("slot")).otherwise(0)
    whole = roles.groupBy("group").agg(F.sum("slot").alias("all"), F.sum(headed).alias("all_heads"), F.max("pages").alias("most"))
    whole = durable(whole.where(F.col("most") >= least - 1e-6))
    under = roles.select("group", F.explode("path").alias("role"), "slot", "fixed", headed.alias("heads")).groupBy("group", "role").agg(F.sum("slot").alias("slot"), F.sum("fixed").alias("fixed"), F.sum("heads").alias("heads"))
    nodes = roles.where((F.col("kind") == GROUP) & (NEARLY * F.col("n") <= F.col("rows"))).select("group", "role", "pages", F.size("path").alias("level"))
    way = nodes.join(under, ["group", "role"]).join(whole, "group")
    # nearly each page has it, once, and it holds the share of all slot text and headings
    way = way.where((F.col("pages") >= NEARLY * F.col("most")) & (F.col("slot") > 0) & (F.col("slot") >= SHARE * F.col("all")) & (F.col("heads") >= SHARE * F.col("all_heads")))
    place = way.groupBy("group").agg(F.max(F.struct("level", "role", (F.col("fixed") > AGAIN * (F.col("slot") + F.col("fixed"))).alias("again"))).alias("p"))
    menus = roles.where((F.col("linked") >= LINKED * F.col("chars")) & (F.col("chars") > 0) & (F.col("pages") >= least - 1e-6)).groupBy("group").agg(F.collect_set("role").alias("menus"))
    found = whole.select("group").join(place, "group", "left").join(menus, "group", "left")
    found = durable(found.select("group", F.coalesce("p.role", F.lit(0)).alias("place"), F.coalesce("menus", F.array().cast("array<long>")).alias("menus"), F.coalesce("p.again", F.lit(False)).alias("again")))
    gone = texts.join(found.where("NOT again").select("group"), "group", "left_semi").select("group", "token")
    return found.drop("again"), durable(gone)


def extract(pages: DataFrame, least: int = LEAST_PAGES, broadcast_texts: int = BROADCAST_TEXTS, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    source = F.coalesce("html", F.lit(""))
    layout = F.xxhash64(F.lit("layout"), F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(_LAYOUT), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"[0-9]+|\s+$", ""))), "<"))
    own = frugal(pages).select(F.col("page_id"), "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"), layout.alias("layout"), F.xxhash64(source).alias("page"))
    found, gone = templates(own, least)
    placed = join_small(own, found.select(F.col("group").alias("host"), F.col("place").alias("host_place"), F.col("menus").alias("host_menus")), ["host"], salt=F.col("page"))
    placed = join_small(placed, found.select(F.col("group").alias("layout"), F.col("place").alias("layout_place"), F.col("menus").alias("layout_menus")), ["layout"], salt=F.col("page"))
    if gone.count() <= broadcast_texts:
        lists = gone.groupBy(F.col("group").alias("host")).agg(F.collect_list("token").alias("texts"))
        placed = join_small(placed, durable(lists), ["host"], salt=F.col("page"))
    else:  # each page's own texts among them: no list is longer than its page
        def run_own(batches):
            for batch in small(batches, "html"):
                rows = [(h, p, b.token()) for h, p, s in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True) for b in Page(s or "").blocks]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "page", "token"])

        blocks = own.select("host", "page", "html").mapInArrow(run_own, "host long, page long, token long").distinct()
        lists = blocks.join(gone.withColumnRenamed("group", "host"), ["host", "token"], "left_semi").groupBy("host", "page").agg(F.collect_list("token").alias("texts"))
        placed = placed.join(lists, ["host", "page"], "left")

    def run(batches):
        for batch in small(batches, "html"):
            texts = []
            for source, place, menus, gone, other, others in zip(*(batch.column(c).to_pylist() for c in ("html", "host_place", "host_menus", "texts", "layout_place", "layout_menus")), strict=True):
                if place is not None:
                    t = Template(place, frozenset(menus), frozenset(gone or ()))
                elif other is not None:
                    t = Template(other, frozenset(others), frozenset())
                else:
                    t = None
                texts.append(main_text(source, t, names))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return placed.select("page_id", "url", "html", "host_place", "host_menus", "texts", "layout_place", "layout_menus").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
