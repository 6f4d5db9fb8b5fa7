"""Joins of ordered data without nested loops: as-of, interpolation, bins, segments, nearest points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lapwing.functions.lineage import cut
from lapwing.operators import tiles
from lapwing.operators.sequence import FIRST, HERE, LAST, turned_round

Names = Sequence[str]


def asof_hold(queries: DataFrame, source: DataFrame, keys: Names, at: str, tie: str, columns: Names) -> DataFrame:
    """``queries`` with the columns of the last source row at or before their place (ties: the last one).

    Before a key's first source row its values hold. Sources and queries are one sorted stream, so a
    key is read once and no pairs are formed.
    """
    held = F.struct(*columns).alias("__held")
    s = source.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__q"), F.col(tie).alias("__tie"), held, F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("__row"))
    q = queries.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__q"), F.lit(None).cast(source.schema[tie].dataType).alias("__tie"), F.lit(None).cast(source.select(held).schema[0].dataType).alias("__held"), F.struct(*queries.columns).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__at", "__q", "__tie")
    got = s.unionByName(q).withColumn("__got", F.coalesce(F.last("__held", True).over(w.rowsBetween(FIRST, HERE)), F.first("__held", True).over(w.rowsBetween(FIRST, LAST))))
    return got.where("__q = 1").select("__row.*", *[F.col(f"__got.{c}").alias(c) for c in columns])


def interpolate(queries: DataFrame, curve: DataFrame, keys: Names, x: str, y: str, out: str, clamp: bool = False) -> DataFrame:
    """``queries`` with y of the curve at their x, linear between its rows; outside: null, or the end values.

    Equal x of a key should be one row of the curve.
    """
    p = curve.select(*keys, F.col(x).cast("double").alias("__x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("__p"), F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("__row"))
    q = queries.select(*keys, F.col(x).cast("double").alias("__x"), F.lit(None).cast("struct<x:double,y:double>").alias("__p"), F.struct(*queries.columns).alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__x")
    rows = p.unionByName(q).withColumn("__a", F.last("__p", True).over(w.rangeBetween(FIRST, HERE))).withColumn("__b", F.last("__p", True).over(turned_round(keys, ["__x"]).rangeBetween(FIRST, HERE))).where("__row is not null")
    a, b = F.col("__a"), F.col("__b")
    inside = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("__x") - a["x"]) / (b["x"] - a["x"]))
    value = F.when(a.isNotNull() & b.isNotNull(), inside)
    return rows.select("__row.*", (F.coalesce(value, a["y"], b["y"]) if clamp else value).alias(out))


def band_join(left: DataFrame, right: DataFrame, keys: Names, l_at: str, r_at: str, reach: float) -> DataFrame:
    """Pairs of rows of a key at most ``reach`` apart: an equi-join on cells of that width, then the exact test.

    Columns of the two sides must differ but for the keys.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    r = right.withColumn("__c", F.explode(F.sequence(cell(r_at) - 1, cell(r_at) + 1)))
    return left.withColumn("__c", cell(l_at)).join(r, [*keys, "__c"]).where(F.abs(F.col(l_at) - F.col(r_at)) <= reach).drop("__c")


def segments(starts: DataFrame, start: str, label: str, end: float = float("inf")) -> DataFrame:
    """(label, lo, hi): half-open stretches from each start to the next."""
    w = Window.orderBy(start)
    return starts.select(F.col(label), F.col(start).alias("lo"), F.coalesce(F.lead(start).over(w), F.lit(end)).alias("hi"))


def in_spans(points: DataFrame, spans: DataFrame, keys: Names, at: str, lo: str, hi: str, cell: float, closed: bool = True) -> DataFrame:
    """Points with each span of their key that holds them, both columns of the span ``lo`` and ``hi`` finite.

    Spans are told in every cell of width ``cell`` that they touch, points in their one cell, so that they meet by equality, each pair once.
    Columns of the two sides must differ but for the keys; nulls are in no span.
    """
    number = lambda c: F.floor(F.col(c) / cell).cast("long")
    wide = spans.where(F.col(lo) <= F.col(hi)).withColumn("__cell", F.explode(F.sequence(number(lo), number(hi))))
    upper = F.col(at) <= F.col(hi) if closed else F.col(at) < F.col(hi)
    return points.withColumn("__cell", number(at)).join(wide, [*keys, "__cell"]).where((F.col(at) >= F.col(lo)) & upper).drop("__cell")


#: Cells that ranges of a dimension are told in.
CELLS = 256


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, keys: Names = (), closed: bool = False) -> DataFrame:
    """Points with each range (lo, hi) that holds them; ranges may have no end. The ranges' finite ends lay out ``CELLS`` cells, in which both sides meet by equality."""
    finite = lambda c: F.when((F.col(c) > float("-inf")) & (F.col(c) < float("inf")), F.col(c))
    first, last = ranges.agg(F.least(F.min(finite("lo")), F.min(finite("hi"))), F.greatest(F.max(finite("lo")), F.max(finite("hi")))).first()
    first, last = first or 0.0, last or 0.0
    number = lambda c: F.floor(F.least(F.greatest((F.col(c) - first) / max((last - first) / CELLS, 1e-300), F.lit(0.0)), F.lit(float(CELLS)))).cast("int")
    wide = ranges.where("lo <= hi").withColumn("__cell", F.explode(F.sequence(number("lo"), number("hi"))))
    upper = F.col(at) <= F.col("hi") if closed else F.col(at) < F.col("hi")
    return points.withColumn("__cell", number(at)).join(wide, [*keys, "__cell"]).where((F.col(at) >= F.col("lo")) & upper).drop("__cell")


#: Places of the ruler in a tile, most tiles, points of a tile that a task looks up at once, sampled places a tile that lay tiles out.
TILE, TILES, TAKEN, SAMPLED = 2048, 1024, 1 << 16, 16


def _looked_up(points: DataFrame, marks: DataFrame, point_id: str) -> DataFrame:
    """(point_id, x, y, tile, d2, r): the place of its tile nearest to each point. Tiles of many points are dealt out in parts, each with the tile's places."""
    load = points.groupBy("tile").agg(F.ceil(F.count("*") / TAKEN).cast("int").alias("parts"))
    own = points.join(F.broadcast(load), "tile").withColumn("part", F.pmod(F.xxhash64(point_id, "x", "y"), "parts").cast("int"))
    theirs = marks.join(F.broadcast(load), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def met(ours: pa.Table, places: pa.Table) -> pa.Table:
        if not (len(ours) and len(places)):
            return pa.table({f.name: pa.array([], f.type) for f in [*ours.schema]} | {"d2": pa.array([], pa.float64()), "r": pa.array([], places.schema.field("r").type)})
        order = places.select(["r"])
        while any(pa.types.is_struct(t) for t in order.schema.types):
            order = order.flatten()
        places = places.take(pc.sort_indices(order, sort_keys=[(c, "ascending") for c in order.column_names], null_placement="at_start"))
        pairs = lambda t, x, y: np.column_stack([t[x].to_numpy(), t[y].to_numpy()])
        d2, best = tiles.closest(pairs(ours, "x", "y"), pairs(places, "rx", "ry"))
        return ours.append_column("d2", pa.array(d2)).append_column("r", places["r"].take(pa.array(best)))

    columns = [point_id, "x", "y", "tile", "part"]
    shape = StructType([*own.select(*columns).schema, StructField("d2", DoubleType()), StructField("r", marks.schema["r"].dataType)])
    both = own.select(*columns).groupBy("tile", "part").cogroup(theirs.select("rx", "ry", "r", "tile", "part").groupBy("tile", "part"))
    return both.applyInArrow(met, shape).drop("part")


def nearest(points: DataFrame, ruler: DataFrame, cell: float, point_id: str, rank: str) -> DataFrame:
    """(point_id, rank, distance): the ruler row nearest to each point (columns x, y), ties to the smallest ``rank``.

    The plane is cut into tiles that hold about ``TILE`` places of the ruler each, whatever its density; equal places are one. A point first meets
    the places of its own tile, and then those of the tiles that the circle of its hit touches, so that its work does not grow with
    the ruler's rows around it. A sample of places lays out the tiles and decides nothing else. Points without x or y have none.
    Where a distance is not finite, all rows of the ruler of one kind (finite or not) are as far. ``cell``, once the width of cells, decides nothing now.
    """
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))  # NaN is larger
    marks = cut(ruler.where(known).groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(rank).alias("r")))
    near = marks.where(finite).withColumnsRenamed({"x": "rx", "y": "ry"})
    left = points.where(known).select(point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    count = near.count()
    kind = lambda c: F.when(F.abs(c) < float("inf"), 0.0).otherwise(F.col(c))
    kinds = marks.groupBy(kind("x").alias("rx"), kind("y").alias("ry")).agg(F.min("r").alias("r"))
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    found = [left.where(~finite if count else F.lit(True)).join(F.broadcast(kinds)).select(point_id, d2.alias("d2"), "r")]
    if count:
        number = min(TILES, -(-count // TILE))
        every = max(1, count // (SAMPLED * number))
        sample = np.array(near.where(F.pmod(F.xxhash64("rx", "ry"), F.lit(every)) == 0).select("rx", "ry").collect() or near.select("rx", "ry").head(1), dtype=float)
        plan = tiles.tree(sample, np.arange(len(sample)), -(-len(sample) // number))

        @F.pandas_udf("int")
        def tile(x: pd.Series, y: pd.Series) -> pd.Series:
            out = np.zeros(len(x), dtype=np.int32)
            tiles.number(plan, np.column_stack([x, y]), np.arange(len(x)), out)
            return pd.Series(out)

        near = cut(near.withColumn("tile", tile("rx", "ry")))
        own = cut(_looked_up(cut(left.where(finite).withColumn("tile", tile("x", "y"))), near, point_id))
        found.append(own.select(point_id, "d2", "r"))
        if plan[4] is not None:
            ends = near.groupBy("tile").agg(*[f(c) for f in (F.min, F.max) for c in ("rx", "ry")]).collect()
            boxes = {t: (np.array(e[:2]), np.array(e[2:])) for t, *e in ends}

            def others(batches):
                for b in batches:
                    xy = np.column_stack([b.column(c).to_numpy() for c in ("x", "y")])
                    home, far = b.column("tile").to_numpy(), b.column("d2").to_numpy()
                    for leaf, rows in tiles.reached(plan, boxes, xy, far, np.arange(len(xy))):
                        rows = rows[home[rows] != leaf]
                        if len(rows):
                            part = b.take(pa.array(rows))
                            yield pa.record_batch([part.column(point_id), part.column("x"), part.column("y"), pa.array(np.full(len(rows), leaf, np.int32))], names=[point_id, "x", "y", "tile"])

            asked = own.mapInArrow(others, own.select(point_id, "x", "y", "tile").schema)
            found.append(_looked_up(cut(asked), near, point_id).select(point_id, "d2", "r"))
    best = F.min(F.struct("d2", "r")).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy(point_id).agg(best).select(point_id, F.col("best.r").alias(rank), F.sqrt("best.d2").alias("distance"))


def nearest_per_anchor(points: DataFrame, anchors: DataFrame, keys: Names, most: float, order: Names) -> DataFrame:
    """(keys, anchor, dx, dy): each key's point nearest to each anchor (ax, ay), where within ``most``; met on cells of that width."""
    at = lambda c, d=0: (F.floor(F.col(c) / most) + d).cast("long")
    d2 = F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2)
    wide = anchors.select("*", F.explode(F.array(*[F.struct(at("ax", i).alias("__cx"), at("ay", j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("__c")).select(*anchors.columns, "__c.*")
    hit = F.min_by(F.struct((F.col("x") - F.col("ax")).alias("dx"), (F.col("y") - F.col("ay")).alias("dy")), F.struct(d2, *order))
    met = points.withColumns({"__cx": at("x"), "__cy": at("y")}).join(wide, ["__cx", "__cy"]).where(d2 <= most * most)
    return met.groupBy(*keys, "anchor").agg(hit.alias("h")).select(*keys, "anchor", "h.dx", "h.dy")


def margin_pairs(df: DataFrame, keys: Names, x: str, t: str, margin: float) -> DataFrame:
    """(keys, pairs, odd): ordered pairs of a key whose x differ by ``margin`` or more, and those with the smaller x at the later t.

    Rows of a key are gathered once into an array sorted by x, and each counts its partners there: no pairs come out as rows.
    """
    rows = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(t).alias("t")))).alias("__r"))
    own = rows.select(*keys, "__r", F.explode("__r").alias("__o"))
    far = F.filter("__r", lambda r: r["x"] - F.col("__o.x") >= margin)
    return own.select(*keys, F.size(far).cast("long").alias("pairs"), F.size(F.filter(far, lambda r: F.col("__o.t") > r["t"])).cast("long").alias("odd")).groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("odd").alias("odd"))


def neighbour_max(df: DataFrame, keys: Names, place: str, count: int, value: str, out: str) -> DataFrame:
    """The largest of a row's value and those at the places before and after it on a ring; nulls and missing places are passed over."""
    other = lambda name, d: df.select(*keys, F.pmod(F.col(place) - d, F.lit(count)).cast(df.schema[place].dataType).alias(place), F.col(value).alias(name))
    met = df.join(other("__before", -1), [*keys, place], "left").join(other("__after", 1), [*keys, place], "left")
    return met.withColumn(out, F.greatest(value, "__before", "__after")).drop("__before", "__after")


def keys_with_all(df: DataFrame, keys: Names, part: str, good: Column, count: int) -> DataFrame:
    """Keys that have a good row for each of ``count`` parts."""
    return df.where(good).groupBy(*keys).agg(F.countDistinct(part).alias("__n")).where(F.col("__n") == count).select(*keys)
