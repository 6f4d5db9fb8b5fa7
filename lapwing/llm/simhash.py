"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints at most three bits
apart have a segment at most one bit apart, so each fingerprint is stored under its two
segments and looked up under the Hamming balls of radius one around them; complete distances
are then verified. A ball is enumerated from one end only: of two segments one bit apart,
exactly one has that bit set, and it alone visits the other by clearing it.

Texts with one fingerprint are one row before any lookup, so exact copies never meet in pairs.
Fingerprints of crowded segments are first linked at up to two bits through shared centres (a
fingerprint or a value one bit away), linear in their number; only pairs from different groups
of those are then fetched by multi-index hashing. No link is lost, and large groups of near
copies do not come out as pairs.

``drop_similar`` links texts by multi-index hashing in the same way, on fingerprints of longer shingles, and
then by the Jaccard similarity of their shingle sets as well, verified on the sets. At similarity 0.8 fingerprints of 64 bits differ in 10 bits on average and in 17 or more
once in 80 pairs: balls that wide around segments meet most of a table. Pairs are therefore fetched
by bands of min-hashes, and the fingerprint, with a radius of its own, only screens what is verified.
Members of a crowded band are compared with two leaders first. What is then still apart is joined on the
rarest shingles of each set, as many as two sets at the least similarity cannot all differ in, so
that copies with edits of their own meet nobody and are not paired with a whole crowd.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.common import cut, marks, runs, table
from lapwing.llm.components import connected_components

#: The words of a shingle, the seed of XXH64, bits that linked fingerprints may differ in.
SHINGLE, SEED, BITS = 3, 42, 3
#: Of links by similarity: words of a shingle, the least Jaccard similarity, bits that fingerprints of such texts may differ in.
SIMILAR_SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 26
#: Bands of min-hashes and rows of a band: a pair at similarity s shares a band with probability 1 - (1 - s^4)^16, 0.9998 at 0.8.
BANDS, BAND_ROWS = 16, 4
#: Fingerprints under one segment from which on they are linked through centres first.
CROWD = 8

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
#: Shingles whose hashes are held at once.
_BLOCK = 255 * 400


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set: eight byte-wide counters to a word, 255 rows at a time."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    full = len(lanes) // 255 * 255
    total = lanes[full:].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    if full:
        total += lanes[:full].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def _shingle_hashes(text: bytes, shingle: int):
    """XXH64 of the shingles of one UTF-8 text, in blocks; bytes.lower and bytes.split know ASCII only, as the rule asks."""
    words = text.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, max(1, len(words) - shingle + 1) if words else 0, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        grams = map(join, zip(*[part[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [join(words)]
        yield np.array([digest(x, SEED) for x in grams], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, shingle):
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a text of fewer words is one shingle, one without words has none."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *_shingle_hashes(text, shingle)]))


_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def _band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of min-hashes of a set."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp): the fingerprint as a signed 64-bit integer, and a hash by which a row finds its text again."""

    def score(batches):
        for batch in batches:
            fps = [fingerprint(x) for _, part in runs(batch.column(2)) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {kind}, text_hash long, fp long")


def _balls(fps: DataFrame, column: str, width: int) -> DataFrame:
    """Each fingerprint with its segment and all values reached by clearing one set bit of it."""
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(width)])
    around = F.transform(F.filter(bits, lambda b: F.col(column).bitwiseAND(b) != 0), lambda b: F.col(column).bitwiseXOR(b))
    return fps.withColumn("around", around)


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, ..., seg, value): the two halves of each fingerprint."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    halves = F.array(F.struct(F.lit(0).alias("seg"), high.alias("value")), F.struct(F.lit(1).alias("seg"), low.alias("value")))
    return fps.select("*", F.inline(halves))


def _crowded(fps: DataFrame) -> DataFrame:
    """The fingerprints that share a segment with many others."""
    cut_up = _segments(fps.select("fp"))
    full = cut_up.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("seg", "value")
    return cut_up.join(full, ["seg", "value"]).select("fp").distinct()


def _close_groups(fps: DataFrame) -> DataFrame:
    """(node, component) by links of at most two bits, each through a centre at most one bit from both ends."""
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    centres = fps.select("fp", F.explode(F.concat(F.array("fp"), F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b)))).alias("centre"))
    # one end of each shared centre stands for all of them: a star, not pairs
    stars = centres.groupBy("centre").agg(F.min("fp").alias("first"), F.max("fp").alias("last"), F.count("*").alias("n")).where("n > 1")
    simple = stars.where("n = 2").select("first", "last").distinct()
    many = stars.where("n > 2").select("centre", "first")
    rest = centres.join(many, "centre").select("first", F.col("fp").alias("last")).where("first <> last").distinct()
    return connected_components(simple.unionByName(rest), "first", "last")


def _lookups(nodes: DataFrame) -> DataFrame:
    """(u, v): the different groups in which the ends of a verified pair at most ``BITS`` apart lie."""
    cutup = _segments(nodes.select("fp", "close"))
    stored = cutup.select(F.col("fp").alias("a"), F.col("close").alias("close_a"), "seg", F.col("value").alias("key"))
    ball = _balls(cutup, "value", 32).select(F.col("fp").alias("b"), F.col("close").alias("close_b"), F.col("seg").alias("seg_b"), F.col("value").alias("own"), F.explode(F.concat(F.array("value"), F.col("around"))).alias("key_b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    once = (F.col("key_b") != F.col("own")) | (F.col("a") < F.col("b"))
    on = (F.col("seg") == F.col("seg_b")) & (F.col("key") == F.col("key_b")) & (F.col("close_a") != F.col("close_b")) & (F.bit_count(apart) <= BITS) & once
    return stored.join(ball, on).select(F.col("close_a").alias("u"), F.col("close_b").alias("v")).distinct()


def _with_close(fps: DataFrame) -> DataFrame:
    """``fps``, a row per fingerprint, with ``close``: the smallest fingerprint of its close group, or its own."""
    fps = cut(fps)
    close = _close_groups(cut(_crowded(fps)))
    return cut(fps.join(close, fps["fp"] == close["node"], "left").select(*fps.columns, F.coalesce("component", "fp").alias("close")))


def components(prints: DataFrame) -> DataFrame:
    """(fp, component, rep): for each distinct fingerprint of ``prints`` (id, fp) its group and the group's smallest id."""
    nodes = _with_close(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    merged = connected_components(_lookups(nodes.select("fp", "close")), "u", "v")
    grouped = nodes.join(merged, nodes["close"] == merged["node"], "left").select("fp", "least_id", F.coalesce("component", "close").alias("component"))
    reps = grouped.groupBy("component").agg(F.min("least_id").alias("rep"))
    return cut(grouped.join(reps, "component").select("fp", "component", "rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id, kept.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and
    repeated ids keep a row each; a null id takes part and is the smallest id of a group only if
    the group has no other (component_id is then null). Extra columns are ignored, an empty
    table gives no rows. ``kept`` marks the rows that carry their group's smallest id.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    groups = components(prints)
    out = prints.join(groups, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep").alias("component_id"), F.col("id").eqNullSafe(F.col("rep")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, then the smallest text hash; repeats of it go too."""
    prints = cut(fingerprints(docs, id_col, text_col))
    return _one_of_each(docs, prints.join(components(prints), "fp"), prints, id_col, text_col)


def _one_of_each(docs: DataFrame, grouped: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each component of ``grouped`` (id, text_hash, component, rep), found again by id and text hash.

    Rows that cannot be among those to drop or to thin out pass where they lie; the others are joined with the list.
    """
    # grouped by the row's own key first, so that no task gathers a whole group
    rows = grouped.where(F.col("id").eqNullSafe(F.col("rep"))).groupBy("component", "id").agg(F.min("text_hash").alias("text_hash")).select("id", "text_hash", F.lit(True).alias("keep"))
    every = prints.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    fate = every.join(rows, (every["text_hash"] == rows["text_hash"]) & every["id"].eqNullSafe(rows["id"]), "left").select(every["id"].alias("__id"), every["text_hash"].alias("__hash"), F.col("keep").isNull().alias("__drop"), "n")
    fate = cut(fate.where("__drop or n > 1").select("__id", "__hash", "__drop"))
    marked = marks(fate, "__hash")
    whole = docs.withColumn("__text_hash", F.xxhash64(text_col))
    names = whole.columns

    def part(wanted: bool):
        def pick(batches):
            for batch in batches:
                yield batch.filter(pa.array(marked(batch.column(len(names) - 1).to_numpy(zero_copy_only=False)) == wanted))

        return whole.mapInArrow(pick, whole.schema)

    some = part(True)
    some = some.join(fate, some[id_col].eqNullSafe(fate["__id"]) & (some["__text_hash"] == fate["__hash"]), "left")
    once = some.where("__drop is null").select(*docs.columns)
    again = some.where("not __drop").dropDuplicates([id_col, "__text_hash"]).select(*docs.columns)
    return part(False).select(*docs.columns).unionByName(once).unionByName(again)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(id, text_hash, node, fp, size, bands): a hash of the text's shingle set, its fingerprint, number of shingles and band keys."""

    def score(batches):
        for batch in batches:
            nodes, fps, sizes, bands = [], [], [], []
            for _, part in runs(batch.column(2)):
                for text in part:
                    hashes = shingle_set(text, shingle)
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    fps.append(int(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0]))
                    sizes.append(len(hashes))
                    bands += _band_keys(hashes)
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), signed(bands))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(nodes), signed(fps), pa.array(sizes, pa.int64()), lists], names=["id", "text_hash", "node", "fp", "size", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {kind}, text_hash long, node long, fp long, size long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the shingle sets of the nodes of ``wanted`` (node, id, text_hash). Texts are not shuffled: sets are, of the wanted and a few by chance."""
    marked = marks(wanted, "text_hash")

    def score(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked(batch.column(1).to_numpy(zero_copy_only=False))))
            for at, part in runs(batch.column(2)):
                sets = [shingle_set(text, shingle).view(np.int64) for text in part]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["id", "text_hash", "hashes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(score, f"id {kind}, text_hash long, hashes array<long>")
    return found.join(wanted, (found["text_hash"] == wanted["text_hash"]) & found["id"].eqNullSafe(wanted["id"])).select("node", "hashes").dropDuplicates(["node"])


def _rarest(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``members`` (node, component, ...) with each of their rarest shingles that others share, and its rank.

    Sets of n shingles at this similarity share all but n - ceil(n * similarity) of either, so one more of the
    rarest, in an order common to all, hold a shared one. A join on them finds every such pair.
    """
    shingles = sets.join(members.select("node", "component"), "node").select("node", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle"))
    spread = shingles.groupBy("shingle").agg(F.count("*").alias("many"), (F.min("component") < F.max("component")).alias("mixed"))
    rarest = Window.partitionBy("node").orderBy("many", "shingle")
    kept = shingles.drop("component").join(spread, "shingle").withColumn("rank", F.row_number().over(rarest)).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & F.col("mixed"))
    return members.join(kept.select("node", "shingle", "rank"), "node")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes (node, fp) that connect all whose fingerprints are linked at most ``BITS`` apart; a link for a row, no pairs of a group."""
    fps = _with_close(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    apart = fps.select(F.col("fp").alias("u"), F.col("close").alias("v")).where("u <> v").unionByName(_lookups(fps.select("fp", "close")))
    own = nodes.select("node", "fp").join(fps, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda c, of: fps.select(F.col("fp").alias(of), F.col("least").alias(c))
    return own.unionByName(apart.join(end("a", "u"), "u").join(end("b", "v"), "v").select("a", "b"))


def similar_components(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(node, component, rep): groups of shingle sets linked by their fingerprints, or at a Jaccard similarity of ``similarity`` or more.

    Fingerprints link as in ``components``, by multi-index hashing; the rest follows for what that cannot find.

    Texts with one set are one node. In a crowded band all nodes are compared with two of them
    first; only pairs that are then in different groups, and share a rare shingle, are compared with one another.
    """
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("least_id"), F.min(F.struct("text_hash", "id")).alias("doc"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    keys = nodes.where("size > 0").select("node", "fp", "size", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("many")).where("many > 1")
    met = cut(keys.join(shared, "band"))

    def close(a: str, b: str) -> Column:
        apart = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius
        return apart & (F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * similarity - 1e-9)

    def pairs(x: DataFrame, y: DataFrame, key: str, also: Column) -> DataFrame:
        found = x.alias("x").join(y.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & also & close("x", "y"))
        return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    def linked(found: DataFrame, sets: DataFrame) -> DataFrame:
        both = found.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("u")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("v")), "b")
        shared_size = F.size(F.array_intersect("u", "v"))
        return cut(both.where(shared_size >= similarity * (F.size("u") + F.size("v") - shared_size) - 1e-9).select("a", "b"))

    few, crowd = met.where(F.col("many") < CROWD), met.where(F.col("many") >= CROWD)
    # a band's leaders are its node that meets most others over all bands, so one amid the copies, and one by hash
    central = crowd.groupBy("node").agg(F.sum("many").alias("met"))
    whole = F.struct("node", "fp", "size").alias("n")
    leaders = [F.min(F.struct(*order, whole))["n"] for order in ([(-F.col("met")).alias("a"), F.xxhash64("node").alias("b")], [F.xxhash64("node").alias("b")])]
    stars = crowd.join(central, "node").groupBy("band").agg(F.array_distinct(F.array(*leaders)).alias("leaders")).select("band", F.inline("leaders"))
    found = cut(pairs(few, few, "band", F.col("x.node") < F.col("y.node")).unionByName(pairs(crowd, stars, "band", F.col("x.node") != F.col("y.node"))).distinct())
    ends = cut(found.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct())
    sets = cut(_sets(docs, id_col, text_col, nodes.join(ends, "node").select("node", "doc.id", "doc.text_hash"), shingle))
    first = cut(linked(found, sets).unionByName(_alike(nodes)))
    groups = cut(connected_components(first, "a", "b"))
    near = cut(crowd.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = near.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    apart = cut(near.join(mixed, "band").select("node", "fp", "size", "component").distinct())
    rare = cut(_rarest(apart, sets, similarity))
    # sets cannot share more than what follows their first common shingle
    most = F.least(F.col("x.size") - F.col("x.rank"), F.col("y.size") - F.col("y.rank")) + 1
    enough = most >= (F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-9
    rest = cut(pairs(rare, rare, "shingle", (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & enough).distinct())
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = connected_components(stars.unionByName(linked(rest, sets)), "a", "b")
    grouped = nodes.join(groups, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    reps = grouped.groupBy("component").agg(F.min("least_id").alias("rep"))
    return cut(grouped.join(reps, "component").select("node", "component", "rep"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of texts linked by similarity, chosen as in ``drop_near_duplicates``.

    Texts without words have the same, empty set and are one group.
    """
    prints = cut(sketches(docs, id_col, text_col, shingle))
    groups = similar_components(docs, prints, id_col, text_col, shingle, similarity, radius)
    slim = prints.select("id", "text_hash", "node")
    return _one_of_each(docs, slim.join(groups, "node"), slim, id_col, text_col)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
