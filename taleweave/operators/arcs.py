"""Story arcs: the weighted event graph, communities at three resolutions, and what describes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.random import Mulberry32
from ..functions.text import arc_title, content_id
from ..session import durable, stored
from .nearest import units

# Weights, floors, sizes and resolutions.
WEIGHTS = {"causal": 0.5, "cosine": 0.6, "people": 0.2, "place": 0.4, "gap": 1.0}
PRUNE, PEOPLE_FLOOR = 0.5, 0.4
LEAST_EVENTS, LEAST_MEMBERS, HIERARCHY_FROM, SEED = 4, 3, 100, 42
LEVELS = {"super": (0, 0.25), "arc": (1, 0.5), "episode": (2, 1.0)}
#: Events of a block (a fourth of it in the order of places), of a tile of it that is weighed at once, and pairs whose vectors are gathered at once.
BLOCK, TILE, PART = 524_288, 256, 8192
#: Events below which a chat stays one block, columns of a product, pairs of a tile, near vectors and numbers of a vector table that is sent to all tasks.
SMALL, WIDE, PICKED, NEAR, TABLE = 4096, 4096, 2_000_000, 4_000_000, 16_000_000


def _side(rows: pa.Table, table) -> dict:
    """What the weighing of a block's events needs, in the chat's order; an event's vector is a row of the distinct ones."""
    rows = rows.take(pc.sort_indices(rows, [("n", "ascending")])).combine_chunks()
    get = lambda c: rows.column(c).chunk(0) if rows.num_rows else rows.column(c).combine_chunks()
    if table is None:
        vectors, sizes = units(get("vector"))
        own = np.arange(len(sizes))
    else:
        keys, embeddings = table
        place = np.searchsorted(keys, get("vector").fill_null(0).to_numpy(zero_copy_only=False))
        found, own = np.unique(place, return_inverse=True)
        vectors, sizes = units(embeddings.take(pa.array(np.minimum(found, len(keys) - 1))) if len(keys) else pa.nulls(len(found), embeddings.type))
        none = np.flatnonzero(get("vector").is_null().to_numpy(zero_copy_only=False))
        if len(none):  # a row of zeros for the events without a vector
            own[none], place[none] = len(vectors), len(keys)
            vectors, sizes = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]), np.append(sizes, 0)
    return {c: get(c) for c in rows.column_names} | {"at": get("message_index").to_numpy(zero_copy_only=False).astype(float), "units": vectors, "sizes": sizes, "own": own, "place": own if table is None else place}


def _index(x: dict, y: dict, field: str, other: str) -> tuple:
    """(row of x, code), and sorted code * rows of y + row of y, of two columns' numbers (lists or not), coded alike."""
    flat = []
    for side, name in ((x, field), (y, other)):
        c = side[name]
        listed = pa.types.is_list(c.type)
        at, values = (pc.list_parent_indices(c).to_numpy(), c.flatten()) if listed else (np.arange(len(c)), c)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        flat.append((at[there], values.drop_null().to_numpy(zero_copy_only=False)))
    codes = np.unique(np.concatenate([v for _, v in flat]), return_inverse=True)[1]
    cut, n = len(flat[0][0]), len(y["at"])
    return flat[0][0], codes[:cut].astype(np.int64), np.sort(codes[cut:].astype(np.int64) * n + flat[1][0]), n


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places from lo to hi."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def _range(index: tuple, start: int, stop: int, lo: int, hi: int) -> tuple:
    """(row, code * n, first place, last place) of what rows start to stop share with rows lo to hi of the other side."""
    xr, xc, keys, n = index
    own = slice(*np.searchsorted(xr, [start, stop]))
    c = xc[own] * n
    return xr[own], c, np.searchsorted(keys, c + lo), np.searchsorted(keys, c + hi)


def _met(index: tuple, start: int, of: tuple, lo: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """((row - start) * width + column - lo, members shared) of the pairs of a range that share any, in order."""
    r, c, a, b = of
    which, at = _spread(a, b)
    return np.unique((r[which] - start) * width + index[2][at] - c[which] - lo, return_counts=True)


def _cosines(x: dict, y: dict, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of rows of the two sides' distinct vectors, in double precision."""
    dims = min(x["units"].shape[1], y["units"].shape[1])
    parts = [np.einsum("ij,ij->i", x["units"][r[k : k + PART], :dims], y["units"][c[k : k + PART], :dims]) for k in range(0, len(r), PART)]
    cos = np.concatenate(parts) if parts else np.zeros(0)
    cos[x["sizes"][r] != y["sizes"][c]] = 0.0
    return cos


def _near_vectors(spark, sent, least: float, work: float):
    """(starts by vector, vectors, cosines) of the table's vectors that are at least so alike, if they are few and found with less work; else None."""
    n = 0 if sent is None else len(sent.value[0])
    if not n or least < 0.05 or 2 * n * n > work:
        return None

    def run(batches: Iterator[pa.RecordBatch], count: bool) -> Iterator[pa.RecordBatch]:
        table, sizes = units(sent.value[1])
        small = table.astype(np.float32)
        for batch in batches:
            for start in (batch.column("id").to_numpy() * TILE).tolist():
                u, v = [], []
                for lo in range(0, n, WIDE):
                    part = small[lo : lo + WIDE]
                    r, c = np.divmod(np.flatnonzero(small[start : start + TILE] @ part.T >= least - 1e-5), len(part))
                    u.append(r + start)
                    v.append(c + lo)
                u, v = np.concatenate(u), np.concatenate(v)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([len(u)])], names=["n"])
                else:
                    side = {"units": table, "sizes": sizes}
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(_cosines(side, side, u, v))], names=["u", "v", "cos"])

    tiles = -(-n // TILE)
    tiles = spark.range(0, tiles, 1, min(tiles, 200))
    if (tiles.mapInArrow(lambda b: run(b, True), "n long").agg(F.sum("n")).first()[0] or 0) > NEAR:
        return None
    found = tiles.mapInArrow(lambda b: run(b, False), "u long, v long, cos double").toArrow()
    u, v, cos = (found.column(c).to_numpy() for c in ("u", "v", "cos"))
    by = np.argsort(u, kind="stable")
    return spark.sparkContext.broadcast((np.searchsorted(u[by], np.arange(n + 2)), v[by], cos[by]))


def _weigh(x: dict, y: dict, same_block: bool, here: bool, span: float, prune: float, near=None):
    """(rows of x, rows of y, weight) of the unlinked pairs that reach the limit, a tile at a time.  here: pairs of one place, else of different ones.

    Pairs that vectors, place and time bring near the limit are picked, by single precision or (near) through the near ones of few
    distinct vectors; those whose people are alike come along.  Only they are weighed, in double precision.
    """
    w = WEIGHTS
    stay = w["place"] if here else 0.0
    alone, reach = ((w["cosine"] + people + stay - prune) / w["gap"] + 1e-9 for people in (0.0, w["people"] * (1 - PEOPLE_FLOOR)))
    people, linked = _index(x, y, "people", "people"), _index(x, y, "links", "key")
    nx, ny = (side["people"].value_lengths().to_numpy(zero_copy_only=False) for side in (x, y))
    px, py = (side["spot"].fill_null(0).to_numpy(zero_copy_only=False) for side in (x, y))
    placed = x["spot"].is_valid().to_numpy(zero_copy_only=False)
    if near is not None:
        starts, others, likes = near
        events = np.sort(y["place"].astype(np.int64) * len(y["at"]) + np.arange(len(y["at"])))
    # y comes after x, so the weight but for people is a product: 0.6 u.v + t(x) - t(y)
    tx, ty = ((side["at"] - x["at"][0])[:, None] * (w["gap"] / span) for side in (x, y))
    if near is None:
        dims = min(x["units"].shape[1], y["units"].shape[1])
        small = [side["units"][:, :dims].astype(np.float32) for side in (x, y)]
        left = np.hstack([small[0][x["own"]] * np.float32(w["cosine"]), tx.astype(np.float32), np.ones((len(tx), 1), np.float32)])
        right = np.hstack([small[1][y["own"]], np.ones((len(ty), 1), np.float32), -ty.astype(np.float32)]).T.copy()
    until = lambda t, far: int(np.searchsorted(y["at"], t + (far + 1e-6) * span, "right"))
    for start in range(0, len(tx), TILE):
        stop = min(start + TILE, len(tx))
        first, last, ends = start + 1 if same_block else 0, until(x["at"][stop - 1], reach), until(x["at"][stop - 1], alone)
        todo = [(first, last)] if near is not None else [(k, min(k + WIDE, last)) for k in range(first, last, WIDE)][::-1]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            width = hi - lo
            shares = _range(people, start, stop, lo, hi)
            many = (shares[3] - shares[2]).sum()
            if near is not None:
                of, at = _spread(starts[x["place"][start:stop]], starts[x["place"][start:stop] + 1])
                row, other = of + start, others[at]
                begin = np.maximum(lo, row + 1) if same_block else np.full(len(row), lo)
                end = np.minimum(hi, np.searchsorted(y["at"], x["at"][row] + ((w["cosine"] * likes[at] + stay - prune) / w["gap"] + 1e-6) * span, "right"))
                a, b = (np.searchsorted(events, other * len(y["at"]) + np.maximum(k, begin)) for k in (begin, end))
                many += (b - a).sum()
            if many > PICKED and width > 1:
                todo += [(lo + width // 2, hi), (lo, lo + width // 2)]
                continue
            if near is not None:
                which, at = _spread(a, b)
                picked = np.unique(of[which] * width + events[at] - other[which] * len(y["at"]) - lo)
            elif lo < ends:
                base = left[start:stop] @ right[:, lo:hi]
                if prune - stay <= 1e-4:  # then time alone may do, without a likeness
                    np.maximum(base, tx[start:stop].astype(np.float32) - ty[lo:hi, 0].astype(np.float32), out=base)
                picked = np.flatnonzero(base >= prune - stay - 1e-4)
            else:
                picked = np.zeros(0, np.int64)
            key, both = _met(people, start, shares, lo, width)
            r, c = key // width + start, key % width + lo
            likeness = both / (nx[r] + ny[c] - both)
            alike = likeness > PEOPLE_FLOOR
            key, likeness = key[alike], likeness[alike]
            if len(key):
                known = np.minimum(np.searchsorted(picked, key), len(picked) - 1)
                more = key if not len(picked) else key[picked[known] != key]
                picked = np.sort(np.concatenate([picked, more]), kind="stable") if len(more) else picked
            r, c = picked // width + start, picked % width + lo
            gap = (y["at"][c] - x["at"][r]) / span
            fits = gap <= reach
            if same_block:
                fits &= c > r
            if not here:
                fits &= ~placed[r] | (px[r] != py[c])
            picked, r, c, gap = picked[fits], r[fits], c[fits], gap[fits]
            if not len(r):
                continue
            shared = np.zeros(len(r))
            if len(key):
                known = np.minimum(np.searchsorted(key, picked), len(key) - 1)
                shared = np.where(key[known] == picked, likeness[known], 0.0)
            cos = _cosines(x, y, x["own"][r], y["own"][c])
            weight = w["cosine"] * np.maximum(0.0, cos) + w["people"] * np.maximum(0.0, shared - PEOPLE_FLOOR) + stay - w["gap"] * gap
            weight = np.floor(weight * 1e9 + 0.5) / 1e9
            out = (weight >= prune) & ~np.isin(picked, _met(linked, start, _range(linked, start, stop, lo, hi), lo, width)[0])
            yield r[out], c[out], weight[out]


def _sums(x: dict, y: dict, pairs: Iterator) -> Iterator[tuple]:
    """(label, n, total, most, least): of all pairs (no label), and of those whose ends share a label."""
    whole, inside = [], {}
    codes = pa.concat_arrays([x["labels"].flatten(), y["labels"].flatten()]).dictionary_encode()
    at, tables = 0, []
    for side in (x, y):
        rows = pc.list_parent_indices(side["labels"]).to_numpy()
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        table = np.full((len(side["at"]), int(place.max(initial=-1)) + 1), -1)
        table[rows, place] = codes.indices.to_numpy(zero_copy_only=False)[at : at + len(rows)]
        at += len(rows)
        tables.append(table)
    for r, c, w in pairs:
        if not len(r):
            continue
        whole.append((len(w), w.sum(), w.max(), w.min()))
        for a in range(tables[0].shape[1]):
            for b in range(tables[1].shape[1]):
                one = tables[0][r, a]
                same = np.flatnonzero((one >= 0) & (one == tables[1][c, b]))
                by = np.argsort(one[same], kind="stable")
                same = same[by]
                names, cuts = np.unique(one[same], return_index=True)
                for k, part in zip(names.tolist(), np.split(w[same], cuts[1:]) if len(names) else [], strict=True):
                    inside.setdefault(k, []).append((len(part), part.sum(), part.max(), part.min()))
    for label, found in [(None, whole), *((codes.dictionary[k].as_py(), v) for k, v in inside.items())]:
        if found:
            n, total, most, least = zip(*found, strict=True)
            yield label, sum(n), float(np.sum(total)), max(most), min(least)


def _vector_table(vectors: DataFrame):
    """(keys in order, embeddings) of the distinct vectors, if they are few enough to be sent to all tasks; else None."""
    known = stored(vectors.where("embedding IS NOT NULL").select(F.xxhash64("embedding").alias("vector"), "embedding").distinct())
    rows, keys, size = known.agg(F.count(F.lit(1)), F.count_distinct("vector"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    if keys < rows or size > TABLE:
        return None
    table = known.orderBy("vector").toArrow()
    return table.column("vector").to_numpy(), table.column("embedding").combine_chunks()


def _pairs(events: DataFrame, participated: DataFrame, chains: DataFrame, prune: float, vectors: DataFrame | None, form: str, labels: DataFrame | None = None) -> DataFrame:
    """The pairs of a chat whose weight is at least `prune`, as `pair_weights` or (form "sums") `pair_sums` gives them.

    Without a chain the weight can't reach the limit beyond 0.62 of the chat's span, nor beyond 0.22 of it if the places
    differ.  So events are put into blocks twice, by their order in the chat and by their order in the chat's places, and only
    blocks that are near enough meet, once each, with the rows that are near enough.  An event carries a key of its vector, and the
    distinct vectors are sent along, unless they are too many: blocks are large, so a row is copied a few times only.  The pairs of
    two blocks are weighed as products of their matrices, a tile at a time.  Pairs that a chain links, of any distance, are joined
    and weighed by themselves.
    """
    spark = events.sparkSession
    events = events.where("message_index IS NOT NULL AND chat_id IS NOT NULL")
    table = _vector_table(events if vectors is None else vectors)
    sent = None if table is None else spark.sparkContext.broadcast(table)
    vector = F.col("embedding").alias("vector") if table is None else F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("vector")
    base = events.select("chat_id", "id", "message_index", F.xxhash64("location_id").alias("_spot"), "location_id", *([vector] if vectors is None else []))
    base = base.withColumn("spot", F.when(F.col("location_id").isNotNull(), F.col("_spot"))).drop("_spot", "location_id")
    if vectors is not None:
        base = base.join(vectors.select("id", vector), "id")
    people = participated.groupBy(F.col("event_id").alias("id")).agg(F.collect_set(F.xxhash64("character_id")).alias("people"))
    linked = chains.select(F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")).where("lo <> hi").distinct()
    links = linked.select(F.explode(F.array(F.struct(F.col("lo").alias("id"), F.xxhash64("hi").alias("other")), F.struct(F.col("hi").alias("id"), F.xxhash64("lo").alias("other")))).alias("l")).groupBy("l.id").agg(F.collect_list("l.other").alias("links"))
    spans = base.groupBy("chat_id").agg(F.greatest(F.max("message_index") - F.min("message_index"), F.lit(1)).cast("double").alias("span"), F.count(F.lit(1)).alias("_n"))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("message_index", "id")) - 1
    rows = base.withColumns({"n": order("chat_id"), "place_block": F.when(F.col("spot").isNotNull(), F.floor(order("chat_id", "spot") / max(1, BLOCK // 4)).cast("int"))})
    rows = rows.join(spans, "chat_id").withColumn("block", F.floor(F.col("n") / F.least(F.lit(BLOCK), F.greatest(F.lit(SMALL), F.ceil(F.col("_n") / 4)))).cast("int"))
    rows = rows.join(people, "id", "left").join(links, "id", "left")
    rows = rows.join(labels.groupBy("id").agg(F.collect_set("label").alias("labels")), "id", "left") if labels is not None else rows.withColumn("labels", F.lit(None).cast("array<string>"))
    none = lambda c, of: F.coalesce(c, F.expr(f"cast(array() as array<{of}>)")).alias(c)
    rows = stored(rows.select("chat_id", "span", "id", F.xxhash64("id").alias("key"), "message_index", "spot", "vector", none("people", "bigint"), none("links", "bigint"), none("labels", "string"), "n", "block", "place_block"))

    w = WEIGHTS
    reach = (w["cosine"] + w["people"] * (1 - PEOPLE_FLOOR) - prune) / w["gap"] + 1e-6
    near_by = _near_vectors(spark, sent, prune / w["cosine"], 0.1 * (rows.groupBy("chat_id").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0))
    sides, blocks = None, 0
    sent_columns = ["id", "key", "message_index", "spot", "vector", "people", "links", "labels", "n"]
    for here, of, place, far in ((False, "block", F.lit(0).cast("long"), reach), (True, "place_block", F.col("spot"), reach + w["place"] / w["gap"])):
        own = rows.where(F.col(of).isNotNull()).withColumns({"place": place, "own": F.col(of)})
        ends = durable(own.groupBy("chat_id", "place", "own").agg(F.min("message_index").alias("lo"), F.max("message_index").alias("hi"), F.first("span").alias("_span")))
        x, y = ends.select("chat_id", "place", F.col("own").alias("i"), "hi", "_span"), ends.select("chat_id", "place", F.col("own").alias("j"), "lo")
        met = durable(x.join(y, ["chat_id", "place"]).where((F.col("i") <= F.col("j")) & ((F.col("lo") - F.col("hi")) / F.col("_span") <= far)).select("chat_id", "place", "i", "j", "lo", "hi"))
        blocks += met.count()
        for side, c in ((0, "i"), (1, "j")):
            to = met if side == 0 else met.where("i < j")
            part = own.join(to.withColumn("own", F.col(c)), ["chat_id", "place", "own"])
            part = part.where((F.col("i") == F.col("j")) | ((F.col("lo") - F.col("message_index") if side == 0 else F.col("message_index") - F.col("hi")) / F.col("span") <= far))
            part = part.select("chat_id", F.lit(here).alias("here"), "place", "i", "j", F.lit(side).alias("side"), "span", *(c for c in sent_columns if c != "id" or form == "pairs"))
            sides = part if sides is None else sides.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        head = {c: group.column(c)[0].as_py() for c in ("chat_id", "here", "i", "j", "span")}
        known = None if sent is None else sent.value
        x = _side(group.filter(pc.equal(group.column("side"), 0)), known)
        y = x if head["i"] == head["j"] else _side(group.filter(pc.equal(group.column("side"), 1)), known)
        del group
        if not len(x["at"]) or not len(y["at"]):
            return
        found = _weigh(x, y, y is x, head["here"], head["span"], prune, None if head["here"] or near_by is None else near_by.value)
        if form == "sums":
            sums = list(zip(*_sums(x, y, found), strict=True))
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([head["chat_id"]] * len(sums[0]), pa.string()), pa.array(sums[0], pa.string()), pa.array(sums[1], pa.int64()), *(pa.array(c, pa.float64()) for c in sums[2:])], names=["chat_id", "label", "n", "total", "most", "least"])
            return
        name = "id" if form == "pairs" else "n"
        for r, c, weight in found:
            if len(r):
                chat = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(r), np.int32)), pa.array([head["chat_id"]], pa.string())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([chat, x[name].take(pa.array(r)), y[name].take(pa.array(c)), pa.array(weight)], names=["chat_id", "a", "b", "w"])

    # as many tasks as there are blocks that meet, fewer if they are small
    tasks = max(1, min(2 * blocks, 2000, -(-rows.count() // SMALL)))
    by = ["chat_id", "here", "place", "i", "j"]
    kind = "string" if form == "pairs" else "int"
    shape = "chat_id string, label string, n long, total double, most double, least double" if form == "sums" else f"chat_id string, a {kind}, b {kind}, w double"
    near = sides.repartition(tasks, *by).groupBy(*by).applyInArrow(run, shape)

    cols = ["message_index", "spot", "vector", "people", "labels", "n", *(["id"] if form == "pairs" else [])]
    x, y = rows.select("chat_id", "span", F.col("id").alias("lo"), F.struct(*cols).alias("l")), rows.select("chat_id", F.col("id").alias("hi"), F.struct(*cols).alias("h"))
    pairs = linked.join(x, "lo").join(y, ["chat_id", "hi"])
    first = F.col("l.n") < F.col("h.n")
    pairs = pairs.select("chat_id", "span", F.when(first, F.col("l")).otherwise(F.col("h")).alias("x"), F.when(first, F.col("h")).otherwise(F.col("l")).alias("y"))
    if table is None:
        size = V.norm(F.col("x.vector")) * V.norm(F.col("y.vector"))
        cos = F.when((size > 0) & (F.size("x.vector") == F.size("y.vector")), V.dot(F.col("x.vector"), F.col("y.vector")) / size).otherwise(0.0)
    else:

        @F.arrow_udf("double")
        def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
            keys, embeddings = sent.value
            out = np.zeros(len(a))
            there = np.flatnonzero(pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False))
            for k in range(0, len(there), PART):
                some = pa.array(there[k : k + PART])
                (m, p), (q, o) = (units(embeddings.take(pa.array(np.searchsorted(keys, c.take(some).to_numpy())))) for c in (a, b))
                dims = min(m.shape[1], q.shape[1])
                out[there[k : k + PART]] = np.where(p == o, np.einsum("ij,ij->i", m[:, :dims], q[:, :dims]), 0.0)
            return pa.array(out)

        cos = cosine.asNondeterministic()(F.col("x.vector"), F.col("y.vector"))  # so that it runs once a row
    shared = F.greatest(F.lit(0.0), V.jaccard(F.col("x.people"), F.col("y.people")) - PEOPLE_FLOOR)
    stays = F.when(F.col("x.spot") == F.col("y.spot"), w["place"]).otherwise(0.0)
    weight = w["causal"] + w["cosine"] * F.greatest(F.lit(0.0), F.col("cos")) + w["people"] * shared + stays - w["gap"] * F.abs(F.col("x.message_index") - F.col("y.message_index")) / F.col("span")
    far = pairs.withColumn("cos", cos).withColumn("w", F.round(weight, 9)).where(F.col("w") >= prune)
    if form != "sums":
        name = "id" if form == "pairs" else "n"
        return near.unionByName(stored(far.select("chat_id", F.col(f"x.{name}").alias("a"), F.col(f"y.{name}").alias("b"), "w")))
    far = far.select("chat_id", "w", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_intersect("x.labels", "y.labels"))).alias("label"))
    sums = lambda n, total, most, least: [F.sum(n).alias("n"), F.sum(total).alias("total"), F.max(most).alias("most"), F.min(least).alias("least")]
    far = stored(far.groupBy("chat_id", "label").agg(*sums(F.lit(1).cast("long"), "w", "w", "w")))
    return near.unionByName(far).groupBy("chat_id", "label").agg(*sums("n", "total", "most", "least"))


def pair_weights(events: DataFrame, participated: DataFrame, chains: DataFrame, prune: float = PRUNE, vectors: DataFrame | None = None, numbers: bool = False) -> DataFrame:
    """chat_id, a, b, w for the pairs of a chat whose weight is at least `prune`.

    events: id, chat_id, message_index, location_id, and embedding unless vectors (id, embedding) are given.  numbers: a and b are the events' places in
    their chat (by message_index and id, from 0) in place of their ids.
    """
    return _pairs(events, participated, chains, prune, vectors, "numbers" if numbers else "pairs")


def pair_sums(events: DataFrame, participated: DataFrame, chains: DataFrame, prune: float = PRUNE, vectors: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """chat_id, label, n, total, most, least of the same pairs' weights: of all pairs of a chat (label null), and of those whose ends share a label (id, label).

    Pairs are summed in the tasks that find them, so none is written, shuffled or handed to the JVM.
    """
    return _pairs(events, participated, chains, prune, vectors, "sums", labels)


#: Neighbours of a vertex from which on they are summed as arrays.
FEW = 200


def _neighbours(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(starts by vertex, neighbours in order, weights) of both ways of the pairs; repeated ones are summed."""
    key = np.concatenate([a * n + b, b * n + a])
    by = np.argsort(key, kind="stable")
    key, w = key[by], np.concatenate([w, w])[by]
    if len(key):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, w = key[first], np.add.reduceat(w, first)
    return np.searchsorted(key, np.arange(n + 1) * n), key % n, w


def louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float, seed: int = SEED) -> np.ndarray:
    """Communities of n vertices by local moves and aggregation until modularity stops rising."""
    community = np.arange(n)
    draw = Mulberry32(seed)
    size = n
    a, b, w = np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(w, float)
    loops = np.zeros(n)
    while True:
        starts, near, links = _neighbours(a, b, w, size)
        degree = np.bincount(a, w, size) + np.bincount(b, w, size) + 2 * loops
        total = degree.sum()
        if total <= 0:
            return community
        place = np.arange(size)
        own, held = place.tolist(), degree.tolist()
        begin, pull, size_of = starts.tolist(), (resolution * degree / total).tolist(), degree.tolist()
        moved_ever = False
        for _ in range(100):
            order = list(range(size))
            for i in range(size - 1, 0, -1):
                j = int(draw() * (i + 1))
                order[i], order[j] = order[j], order[i]
            moved = False
            for v in order:
                lo, hi = begin[v], begin[v + 1]
                if hi - lo > FEW:  # many neighbours are summed as arrays
                    c = place[near[lo:hi]]
                    by = c.argsort(kind="stable")
                    c = c[by]
                    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    sums = dict(zip(c[first].tolist(), np.add.reduceat(links[lo:hi][by], first).tolist(), strict=True))
                else:
                    sums = {}
                    for u, z in zip(near[lo:hi].tolist(), links[lo:hi].tolist(), strict=True):
                        c = own[u]
                        sums[c] = sums.get(c, 0.0) + z
                mine, p = own[v], pull[v]
                held[mine] -= size_of[v]
                best, top = mine, sums.get(mine, 0.0) - p * held[mine]
                most = top + 1e-12
                for c, z in sums.items():
                    gain = z - p * held[c]
                    if gain > most and (gain > top or (gain == top and c < best)):
                        best, top = c, gain
                if best != mine:
                    own[v] = place[v] = best
                    moved = True
                held[best] += size_of[v]
            moved_ever |= moved
            if not moved:
                break
        own = place
        names, own = np.unique(own, return_inverse=True)
        community = own[community]
        if not moved_ever or len(names) == size:
            return community
        merged = np.bincount(own, loops, len(names))
        x, y = own[a], own[b]
        inside = x == y
        merged += np.bincount(x[inside], w[inside], len(names))
        starts, others, sums = _neighbours(x[~inside], y[~inside], w[~inside], len(names))
        x = np.repeat(np.arange(len(names)), np.diff(starts))
        once = x < others
        a, b, w, loops, size = x[once], others[once], sums[once], merged, len(names)


def communities(events: DataFrame, weights: DataFrame, resolution: float = 0.5, least: int = LEAST_MEMBERS, seed: int = SEED) -> DataFrame:
    """chat_id, id, community (from 0, by the first member's index); small communities and chats go.

    weights: chat_id, a, b, w; a and b are ids, or numbers of these events as `pair_weights` gives them.
    """
    return _communities(events, weights, {"": resolution}, least, seed).select("chat_id", "id", "community")


def _communities(events: DataFrame, weights: DataFrame, resolutions: dict[str, float], least: int = LEAST_MEMBERS, seed: int = SEED) -> DataFrame:
    """level, chat_id, id, community, inside (pairs inside it), edges (all pairs of the chat): one task for a chat at a resolution."""

    def run(key: tuple, nodes: pa.Table, pairs: pa.Table) -> pa.Table:
        level = key[1].as_py()
        nodes = nodes.take(pc.sort_indices(nodes, [("message_index", "ascending"), ("id", "ascending")])).combine_chunks()
        out = {"level": pa.array([], pa.string()), "chat_id": pa.array([], pa.string()), "id": pa.array([], pa.string()), "community": pa.array([], pa.int32()), "inside": pa.array([], pa.int64()), "edges": pa.array([], pa.int64())}
        n = nodes.num_rows
        if n < LEAST_EVENTS:
            return pa.table(out)
        number = lambda c: (pc.index_in(c, nodes.column("id").combine_chunks()) if pa.types.is_string(c.type) else c).to_numpy().astype(np.int64)
        a, b, w = number(pairs.column("a")), number(pairs.column("b")), pairs.column("w").to_numpy()
        del pairs
        by = np.argsort(a * n + b, kind="stable")
        a, b, w = a[by], b[by], w[by]
        found = louvain(a, b, w, n, resolutions[level], seed)
        members = np.bincount(found, minlength=found.max() + 1)
        kept = found[members[found] >= least]
        names, first = np.unique(kept, return_index=True)
        place = np.full(len(members), -1)
        place[names[np.argsort(first)]] = np.arange(len(names))  # nodes are in order, so communities get their numbers by their first member
        inside = np.bincount(found[a][found[a] == found[b]], minlength=len(members))
        some = np.flatnonzero(place[found] >= 0)
        columns = [pa.array([level] * len(some), pa.string()), nodes.column("node_chat").take(pa.array(some)).combine_chunks(), nodes.column("id").take(pa.array(some)).combine_chunks(), pa.array(place[found[some]], pa.int32()), pa.array(inside[found[some]]), pa.array(np.full(len(some), len(a)))]
        return pa.table(dict(zip(out, columns, strict=True)))

    each = F.explode(F.array(*[F.lit(x) for x in resolutions]))
    nodes = events.where("message_index IS NOT NULL").select(F.col("chat_id").alias("node_chat"), each.alias("node_level"), "id", "message_index")
    pairs = weights.select(F.col("chat_id").alias("pair_chat"), each.alias("pair_level"), "a", "b", "w")
    return nodes.groupBy("node_chat", "node_level").cogroup(pairs.groupBy("pair_chat", "pair_level")).applyInArrow(run, "level string, chat_id string, id string, community int, inside long, edges long")


def describe(members: DataFrame) -> DataFrame:
    """community, spine, size, first, last, importance.  members: community, id, significance, message_index, summary."""
    spine = F.min(F.struct((-F.col("significance")).alias("s"), "message_index", "id", "summary")).alias("m")
    out = members.groupBy("community").agg(spine, F.count(F.lit(1)).alias("size"), F.min("message_index").alias("first"), F.max("message_index").alias("last"), F.max("significance").alias("top"))
    return out.select("community", F.col("m.id").alias("spine"), "size", "first", "last", F.least(F.lit(5), F.greatest(F.lit(1), F.round(F.coalesce("top", F.lit(3))).cast("int"))).alias("importance"), F.substring(F.coalesce(F.nullif(F.trim("m.summary"), F.lit("")), F.lit("(no summary)")), 1, 80).alias("spine_text"))


def density(members: DataFrame, weights: DataFrame) -> DataFrame:
    """chat_id, community, inside, expected, density.  members: chat_id, id, community; weights: chat_id, a, b."""
    m = members.select("chat_id", "id", "community")
    edges = weights.groupBy("chat_id").agg(F.count(F.lit(1)).alias("edges"))
    inside = weights.join(m.select("chat_id", F.col("id").alias("a"), "community"), ["chat_id", "a"]).join(m.select("chat_id", F.col("id").alias("b"), F.col("community").alias("other")), ["chat_id", "b"]).where("community = other")
    return _density(members, edges, inside.groupBy("chat_id", "community").agg(F.count(F.lit(1)).alias("inside")))


def density_of(members: DataFrame, sums: DataFrame) -> DataFrame:
    """The same from `pair_sums` whose labels are the communities, so that no pair is joined."""
    inside = sums.where("label IS NOT NULL").select("chat_id", F.col("label").alias("community"), F.col("n").alias("inside"))
    return _density(members, sums.where("label IS NULL").select("chat_id", F.col("n").alias("edges")), inside)


def _density(members: DataFrame, edges: DataFrame, inside: DataFrame) -> DataFrame:
    n = F.col("n")
    chats = members.groupBy("chat_id").agg(F.max("nodes").alias("nodes")) if "nodes" in members.columns else members.groupBy("chat_id").agg(F.count(F.lit(1)).alias("nodes"))
    sizes = members.groupBy("chat_id", "community").agg(F.count(F.lit(1)).alias("n")).join(chats, "chat_id").join(edges, "chat_id", "left").join(inside, ["chat_id", "community"], "left").na.fill(0, ["inside", "edges"])
    expected = F.col("edges") * (n * (n - 1) / 2) / F.greatest(F.lit(1.0), F.col("nodes") * (F.col("nodes") - 1) / 2)
    return sizes.withColumn("expected", expected).select("chat_id", "community", "inside", "expected", F.when(F.col("expected") > 0, F.col("inside") / F.col("expected")).otherwise(0.0).alias("density"))


def modularity(pairs: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, q.  pairs: a, b, w; members: id, community."""
    whole = pairs.agg(F.sum("w").alias("m"))
    own = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    both = pairs.join(own("a", "ca"), "a").join(own("b", "cb"), "b")
    sums = both.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("cb").alias("c"), "w", F.lit(0.0).alias("i")))).alias("s")).groupBy("s.c").agg(F.sum("s.w").alias("t"), F.sum("s.i").alias("i"))
    share = F.col("t") / (2 * F.col("m"))
    return sums.crossJoin(F.broadcast(whole.limit(1))).agg(F.round(F.sum(F.col("i") / F.col("m") - resolution * share * share), 6).alias("q"))


def parents(children: DataFrame, above: DataFrame) -> DataFrame:
    """child, parent, n: the parent with the most members in common, the first of equals.  (child|parent, event_id)"""
    n = children.join(above, "event_id").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("child").agg(F.min(F.struct((-F.col("n")).alias("m"), "parent", "n")).alias("b")).select("child", "b.parent", "b.n")


def protagonists(arc_events: DataFrame, participated: DataFrame, characters: DataFrame) -> DataFrame:
    counts = arc_events.join(participated, "event_id").groupBy("arc_id", "character_id").agg(F.count(F.lit(1)).alias("n")).join(characters.select(F.col("id").alias("character_id"), "name"), "character_id")
    counts = counts.groupBy("arc_id", "name").agg(F.sum("n").alias("n"))
    return counts.groupBy("arc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "name")).alias("b")).select("arc_id", "b.name")


def recycled(arcs: DataFrame, old: DataFrame) -> DataFrame:
    """The old title of the same level and spine, unless it was a template's."""
    titles = old.where(~F.col("title").rlike("^(Super Arc|Arc|Episode): ")).select("hierarchy_level", "spine", F.col("title").alias("old_title")).dropDuplicates(["hierarchy_level", "spine"])
    return arcs.join(titles, ["hierarchy_level", "spine"], "left").withColumn("title", F.coalesce("old_title", "title")).withColumn("recycled", F.col("old_title").isNotNull()).drop("old_title")


def to_name(arcs: DataFrame, least: float = 1.5) -> DataFrame:
    """Arcs that are worth a name: dense, and without one."""
    return arcs.where((F.col("density") >= least) & ~F.col("recycled"))


def rebuild(events: DataFrame, participated: DataFrame, chains: DataFrame, durable=durable, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(arcs, arc_events) of all chats with enough events, at one level or, for long chats, three.  vectors: as for `pair_weights`."""
    keep = durable or (lambda x: x)
    sizes = events.where("message_index IS NOT NULL").groupBy("chat_id").agg(F.count(F.lit(1)).alias("nodes"))
    enough = events.where("message_index IS NOT NULL").join(sizes.where(F.col("nodes") >= LEAST_EVENTS), "chat_id")
    weights = pair_weights(enough, participated, chains, vectors=vectors, numbers=True)
    weights = stored(weights) if durable else weights
    resolutions = {name: resolution for name, (_, resolution) in LEVELS.items()}
    every = keep(_communities(enough.where(F.col("nodes") >= HIERARCHY_FROM), weights, resolutions).unionByName(_communities(enough.where(F.col("nodes") < HIERARCHY_FROM), weights.join(sizes.where(F.col("nodes") < HIERARCHY_FROM), "chat_id", "left_semi"), {"arc": resolutions["arc"]})))
    arcs = members = None
    for name, (level, _) in LEVELS.items():
        found = every.where(F.col("level") == name).withColumn("hierarchy_level", F.lit(level))
        keyed = found.join(enough.select("id", "significance", "message_index", "summary"), "id").withColumn("community", F.struct("chat_id", "community"))
        told = describe(keyed).select("community.chat_id", "community.community", F.lit(level).alias("hierarchy_level"), "spine", "size", F.col("first").alias("start_idx"), F.col("last").alias("end_idx"), "importance", arc_title(name, "spine_text").alias("title"))
        counts = found.groupBy("chat_id", "community").agg(F.first("inside").alias("inside"), F.first("edges").alias("edges"))
        dense = _density(found.select("chat_id", "id", "community"), counts.groupBy("chat_id").agg(F.first("edges").alias("edges")), counts.select("chat_id", "community", "inside"))
        told = told.join(dense.select("chat_id", "community", "density"), ["chat_id", "community"])
        told = told.withColumn("id", content_id("arc", F.concat_ws("|", "chat_id", "hierarchy_level", "spine")))
        found = found.select("chat_id", "id", "community", "hierarchy_level")
        arcs, members = (told, found) if arcs is None else (arcs.unionByName(told), members.unionByName(found))
    arcs = keep(arcs)
    order = Window.partitionBy("arc_id").orderBy("message_index", "event_id")
    links = members.join(arcs.select("chat_id", "community", "hierarchy_level", F.col("id").alias("arc_id")), ["chat_id", "community", "hierarchy_level"]).join(events.select("id", "message_index"), "id").select("arc_id", "hierarchy_level", F.col("id").alias("event_id"), "message_index")
    links = keep(links.select("arc_id", "hierarchy_level", "event_id", (F.row_number().over(order) - 1).alias("position")))
    up = None
    for level in (1, 2):
        p = parents(links.where(F.col("hierarchy_level") == level).select(F.col("arc_id").alias("child"), "event_id"), links.where(F.col("hierarchy_level") == level - 1).select(F.col("arc_id").alias("parent"), "event_id"))
        up = p if up is None else up.unionByName(p)
    return arcs.join(up.select(F.col("child").alias("id"), F.col("parent").alias("parent_arc_id")), "id", "left"), links.select("arc_id", "event_id", "position")
