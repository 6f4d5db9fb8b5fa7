"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. Sorting each projection and pairing
all rows of a window would meet a fixed share of all pairs, so the windows that fetch pairs are
compound: each of several tables joins the sorted cells of a few projections, as many as keep
pairs of unlike vectors few among the rows of the largest label. Where two vectors meet, their
collisions are counted: on how many of further projections, kept in two words of eight bytes, does one
lie in the window centred on the other? Pairs that pass a count set for recall are verified by
cosine in double precision.

Only (cell, node, two words) are shuffled for each table. Vectors travel once for each bucket of
pairs that they take part in, and equal vectors are one node from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import cut, table
from lapwing.llm.components import connected_components

#: Links have at least this cosine.
COSINE = 0.98
#: Share of pairs at exactly that cosine that the tables are set to find; closer pairs are found more surely.
RECALL = 0.999
#: Cell width and window half-width in standard deviations of a projected difference at that cosine.
CELL, WINDOW = 8.0, 3.0
#: Unlike vectors that a vector may meet in a table.
MET = 4
#: Projections that count collisions, one byte each; steps of a byte to a standard deviation; collisions that a pair needs.
COUNTED, STEPS, LEAST = 16, 4, 13
#: Numbers in the vectors of a bucket of pairs that are verified together, counted by its pairs.
BUCKET = 2_500_000
SEED = 7


def _same_cell() -> float:
    """Chance that two vectors at the least cosine share a cell of one projection with a random offset."""
    x = np.linspace(-CELL, CELL, 20001)
    return float((np.clip(1 - np.abs(x) / CELL, 0, 1) * np.exp(-x * x / 2)).sum() / np.exp(-x * x / 2).sum() * math.erf(CELL / math.sqrt(2)))


def _unlike_cell() -> float:
    """Chance that two random unit vectors share a cell: normal projections, differing by sqrt(2) of their deviation."""
    width = CELL * math.sqrt(2 * (1 - COSINE))  # in standard deviations of one projection
    return min(0.99, width / (2 * math.sqrt(math.pi)))


def design(rows: int) -> tuple[int, int]:
    """(projections per table, tables) for the rows of one label."""
    near, unlike = _same_cell(), _unlike_cell()
    each = max(1, min(40, math.ceil(math.log(max(rows, 2) / MET) / -math.log(unlike))))
    return each, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**each)))


def _units(rows: pa.ListArray) -> np.ndarray:
    """Unit vectors of rows of one length."""
    unit = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)  # no overflow of squares
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _cells(points: DataFrame, each: int, tables: int) -> DataFrame:
    """(cell, node, near, nearer): a row for each node and table, with the node's places on the counting projections."""

    def project(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rng = np.random.default_rng([SEED, int(dim)])
                axes = rng.standard_normal((int(dim), each * tables + COUNTED))
                axes /= np.linalg.norm(axes, axis=0)
                offsets = rng.random(each * tables)
                place = _units(batch.column(3).take(pa.array(at))) @ axes / (math.sqrt(2 * (1 - COSINE)) / math.sqrt(dim))
                cells = np.floor(place[:, : each * tables] / CELL + offsets).astype(np.int64).reshape(len(at), tables, each)
                key = np.broadcast_to(labels[at].astype(np.uint64)[:, None] ^ (np.arange(tables, dtype=np.uint64) << np.uint64(48)) ^ np.uint64(dim << 32), (len(at), tables)).copy()
                for j in range(each):
                    key = (key ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                counted = np.clip(np.round(place[:, each * tables :] * STEPS), -127, 127).astype(np.int8).copy().view(np.int64)
                node = batch.column(0).to_numpy(zero_copy_only=False)[at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel().view(np.int64), np.repeat(node, tables), np.repeat(counted[:, 0], tables), np.repeat(counted[:, 1], tables))], names=["cell", "node", "near", "nearer"])

    return points.select("node", "label", "dim", "v").mapInArrow(project, "cell long, node long, near long, nearer long")


def _collisions(a: Column, b: Column) -> Column:
    """On how many of eight projections, a byte each, one place lies in the window centred on the other."""
    byte = lambda c, k: F.shiftright(F.shiftleft(c, 56 - 8 * k), 56)
    return sum((F.abs(byte(a, k) - byte(b, k)) <= math.ceil(WINDOW * STEPS) + 1).cast("int") for k in range(8))


def _candidates(points: DataFrame, each: int, tables: int) -> DataFrame:
    """(a, b), a below b: pairs of one label that share a cell of some table and pass the count of windows."""
    spread = _cells(points, each, tables)
    x, y = spread.alias("x"), spread.alias("y")
    met = _collisions(F.col("x.near"), F.col("y.near")) + _collisions(F.col("x.nearer"), F.col("y.nearer"))
    return x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") < F.col("y.node")) & (met >= LEAST)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def links(points: DataFrame, each: int, tables: int, dim: int, cosine: float = COSINE) -> DataFrame:
    """(a, b) of verified pairs, a below b; ``dim`` is the longest vector's.

    Pairs are dealt to buckets by the runs of nodes that their ends lie in, so that a large group's
    vectors go to few buckets, not to each of its pairs.
    """
    pairs = cut(_candidates(points, each, tables))
    runs = max(1, math.isqrt(2 * pairs.count() * dim // BUCKET))
    run = lambda c: F.pmod(F.xxhash64(c), F.lit(runs))
    dealt = pairs.select("a", "b", (run("a") * runs + run("b")).alias("bucket"))
    ends = dealt.select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct()
    vectors = ends.withColumnRenamed("bucket", "of").join(points.select("node", "v", "label", "dim"), "node")

    def verify(key, p: pa.Table, v: pa.Table) -> pa.Table:
        nodes, labels, dims = (v.column(c).to_numpy() for c in ("node", "label", "dim"))
        order = np.argsort(nodes)
        a, b = (order[np.searchsorted(nodes, p.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        linked = np.zeros(len(a), dtype=bool)
        vectors = v.column("v").combine_chunks()
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            unit, where = _units(vectors.take(pa.array(own))), np.zeros(len(dims), dtype=np.int64)
            where[own] = np.arange(len(own))
            some = np.flatnonzero((dims[a] == dim) & (dims[b] == dim) & (labels[a] == labels[b]))
            for at in range(0, len(some), 8192):
                k = some[at : at + 8192]
                linked[k] = np.einsum("ij,ij->i", unit[where[a[k]]], unit[where[b[k]]]) >= cosine
        return pa.table({c: p.column(c).filter(pa.array(linked)) for c in ("a", "b")})

    return dealt.groupBy("bucket").cogroup(vectors.groupBy("of")).applyInArrow(verify, "a long, b long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Vectors link when labels are equal and not null, lengths are equal, and the cosine in
    doubles is at least 0.98. Null and zero vectors, and those with null or non-finite
    components, link with nothing and are components of their own. Equal vectors of a label
    are one point with a count before any pair is formed; repeated rows are vectors of their
    own and count as links of each other. A null id counts as a vector and is a component's
    smallest id only where no other is. Extra columns are ignored, an empty table gives no rows.
    """
    v = F.col("v")
    finite = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    base = base.withColumn("usable", F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull())
    zero = F.lit(0).cast(rows.schema[vector_col].dataType.elementType)
    base = base.withColumn("v", F.when(F.col("usable"), F.transform("v", lambda e: e + zero)))  # -0.0 and 0.0 are one value
    same = [F.xxhash64("v", F.lit(i)).alias(f"h{i}") for i in (0, 1)]
    points = base.where("usable").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    points = cut(points.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))  # ids fixed by the checkpoint
    most, dim = points.groupBy("label", "dim").agg(F.count("*").alias("c")).agg(F.max("c"), F.max("dim")).first()
    found = cut(links(points, *design(most or 0), dim or 1))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    slim = points.select("node", "n", "least_id", "label", *same)
    degree = ends.join(slim.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    groups = connected_components(found, "a", "b")
    known = slim.join(degree, slim["node"] == degree["a"], "left").join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
    known = known.select("label", "h0", "h1", "least_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("group"))
    least_ids = known.groupBy("group").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_ids, "group").select("label", "h0", "h1", "n_links", "component_id")
    # a row finds its point again by 128 bits of hash, so that no vectors are shuffled
    linked = base.where("usable").select("id", "label", *same).join(known, ["label", "h0", "h1"]).select("id", "n_links", "component_id")
    alone = base.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
