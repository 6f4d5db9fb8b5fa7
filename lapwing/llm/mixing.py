"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end on a line of words, which is
cut into blocks of equal size. The schedule walks the van der Corput sequence: slot i has the
bit-reversed i as its point, and the source whose stretch of cumulative block counts holds the
point fills the slot. The points of a power of two are a permutation, so each source gets
exactly its number of slots, evenly spread. Slots are ranked per source, and the k-th slot of
a source takes its k-th block, starting over after the last word.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapwing.llm.common import cut, running, table, word_counts

#: Fixed values of the mix: weights by source in code point order, repeating; share of all words; most uses of a word.
WEIGHTS, SHARE, USES = (3, 1, 2), 1.5, 2
#: Words of a block.
BLOCK = 2048
#: Runs that a source's documents are shuffled into, and slots that are ranked together.
SHUFFLED_RUNS, SLOT_RUN = 1024, 4096


def sized(docs: DataFrame, text_col: str, size_col: str) -> DataFrame:
    """``docs`` with the number of words of the text (null: 0), counted over Arrow buffers."""
    names = [c for c in docs.columns if c != size_col]
    docs = docs.select(*names)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_counts(batch.column(names.index(text_col))))], names=[*names, size_col])

    return docs.mapInArrow(count, StructType([*docs.schema.fields, StructField(size_col, LongType())]))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, uses: int = USES) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size), one per source, nulls as a source of their own, last.

    Targets are shares of ``share`` times all words by weight; none is above ``uses`` times its
    source's size, and what is above goes to the others by weight. Sources in the order of size
    per weight reach their limits one after another, so running sums find the level at once.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * float(uses))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    s = s.withColumn("budget", F.sum("source_size").over(every) * share)
    # the level of those that are not below their limits, were all earlier ones at theirs
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(upto), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), zero)))
    s = s.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # the first that is not full sets the rate: later ones have the same or a lower trial level
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("rate", first)
    return s.select("source", "source_size", "weight", F.when(F.col("rate").isNull(), F.col("most")).otherwise(F.least("most", F.col("rate") * F.col("weight"))).alias("target"))


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, nth): the slots in order, the source that fills each, and the block of it."""
    blocks = targets.select("source", F.ceil(F.round("target") / block).cast("long").alias("blocks")).where("blocks > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    stretches = cut(blocks.select("source", "blocks", (F.sum("blocks").over(order) - F.col("blocks")).alias("lo"), F.sum("blocks").over(order).alias("hi")))
    total = stretches.agg(F.max("hi")).first()[0] or 0
    digits = max(1, (total - 1).bit_length()) if total else 1
    grain = max(0, digits - 12)  # stretches meet slots on 4096 equal cells of the line
    slots = spark.range(0, 1 << digits if total else 0).select(F.col("id").alias("slot"), F.conv(F.reverse(F.lpad(F.bin("id"), digits, "0")), 2, 10).cast("long").alias("point"))
    slots = slots.where(F.col("point") < total).withColumn("cell", F.shiftright("point", grain))
    cells = stretches.select("source", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", grain), F.shiftright(F.col("hi") - 1, grain))).alias("cell"))
    met = slots.join(cells, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "source")
    ranked = running(met, ["source"], (F.col("slot") / SLOT_RUN).cast("long"), ["slot"], {"nth": "1"})
    return ranked.select("slot", "source", "nth")


def laid_out(docs: DataFrame, id_col: str, source_col: str, size_col: str, key: Column) -> DataFrame:
    """``docs`` with ``__at``: the words before each document on its source's line, in shuffled order."""
    shuffled = docs.withColumn("__mix", F.xxhash64(F.lit("mix"), F.col(id_col), key))
    out = running(shuffled, [source_col], F.shiftrightunsigned("__mix", 64 - (SHUFFLED_RUNS.bit_length() - 1)), ["__mix", F.col(id_col), F.col(size_col)], {"__at": size_col})
    return out.drop("__mix")


def takes(laid: DataFrame, targets: DataFrame, source_col: str, size_col: str, uses: int = USES) -> DataFrame:
    """``laid`` with its source's size and target and ``__taken``: the words that each pass over the line takes of it."""
    t = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rows = laid.join(t, laid[source_col].eqNullSafe(t["__source"]), "left").drop("__source")
    goal = F.round("__target").cast("long")
    each = [F.greatest(F.lit(0).cast("long"), F.least(F.col(size_col), goal - F.col("__at") - F.col("__source_size") * e)) for e in range(uses)]
    return rows.withColumn("__taken", F.array(*each))


def spans(laid: DataFrame, targets: DataFrame, slots: DataFrame, id_col: str, source_col: str, size_col: str, block: int = BLOCK, uses: int = USES) -> DataFrame:
    """(slot, source, id, pass, start, length): the stretch of a document's words that each slot takes, by joining slots and blocks."""
    rows = takes(laid, targets, source_col, size_col, uses)
    begin = F.col("__at") + F.col("pass") * F.col("__source_size")
    parts = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "__at", "__source_size", "__row", F.posexplode("__taken").alias("pass", "most")).where("most > 0")
    parts = parts.select("id", "source", "pass", "most", "__row", begin.alias("begin")).withColumn("nth", F.explode(F.sequence((F.col("begin") / block).cast("long"), ((F.col("begin") + F.col("most") - 1) / block).cast("long"))))
    s = slots.select(F.col("source").alias("__s"), F.col("nth").alias("__n"), "slot")
    met = parts.join(s, (parts["nth"] == s["__n"]) & parts["source"].eqNullSafe(s["__s"]))
    lo = F.greatest("begin", F.col("nth") * block)
    hi = F.least(F.col("begin") + F.col("most"), (F.col("nth") + 1) * block)
    return met.select("slot", "source", "id", "__row", "pass", (lo - F.col("begin")).alias("start"), (hi - lo).alias("length"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with sizes and places, targets, spans of the schedule).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own,
    last in order; repeated rows are documents of their own. Extra columns are ignored.
    """
    rows = sized(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text", "size").drop("text")
    return _dealt(rows, F.lit(0), block)


def _dealt(rows: DataFrame, key: Column, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The results of ``mix`` from rows (id, source, size); ``key`` takes part in the shuffle."""
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    targets = cut(source_targets(rows))
    laid = cut(laid_out(rows, "id", "source", "size", key))
    slots = schedule(rows.sparkSession, targets, block)
    return laid, targets, spans(laid, targets, slots, "id", "source", "size", block)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """The mix as documents, in the order of the schedule: a row of ``docs`` for each pass that takes words of it.

    A row has the words of all its spans and stands where the first of its slots does. Only the
    document where a source's target ends is cut. ``size_col`` follows the text.
    """
    keyed = docs.withColumn("__key", F.xxhash64(*docs.columns))
    light = sized(keyed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), "__key"), "text", "size").drop("text")
    laid, _, taken = _dealt(light, F.col("__key"), block)
    uses = taken.groupBy("__row", "pass").agg(F.sum("length").alias("__words"), F.min("slot").alias("__slot"))
    uses = cut(uses.join(laid.select("__row", "__key", "__at", F.col("size").alias("__size")), "__row").withColumnRenamed("pass", "__pass"))
    # rows that are equal throughout are documents of their own in the mix, and have one text
    again = cut(laid.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"))
    texts = keyed.join(again, "__key", "left_anti").unionByName(keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    whole = F.col("__words") == F.col("__size")
    rows = texts.join(uses, "__key").withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(_first_words(F.col(text_col), F.col("__words"))))
    if size_col in docs.columns:
        rows = rows.withColumn(size_col, F.when(whole, F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return rows.orderBy("__slot", "__pass", "__at").select(*docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, single-spaced."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of all documents; with the number of slots that take of each, and the first of them (null: none)."""
    laid, targets, taken = mix(table(spark, sf_dir, "documents"))
    words = taken.groupBy("__row").agg(F.sum("length").alias("taken"), F.count("*").alias("slots"), F.min("slot").alias("first_slot"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    rows = laid.join(t, laid["source"].eqNullSafe(t["s"])).join(words, "__row", "left")
    none = F.lit(0).cast("long")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("slots", none).alias("slots"), "first_slot")
