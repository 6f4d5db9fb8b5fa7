"""Phrase collocations from stripes: each prefix keys a counter of the words that come next.

Level k has stripes of prefixes of k - 1 words; the empty prefix keys the vocabulary. Tasks count in their own
stripes first. Stripes of a prefix are merged elementwise; a frequent prefix's stripe is dealt out in parts by its next words, as many
as its share of all words asks for, so that no prefix is in one task. The merged stripes answer everything else: an entry is the count of an
extension and the total of the prefix that it makes, the empty prefix's total is the number of words, and the largest
entries behind and before a phrase tell whether a longer phrase subsumes it.

A level counts only sequences whose two halves (all but the last word, all but the first) were frequent a level before. They
are told by a bitmap of fixed size: it lets none of them be missed, and false hits are counted and then found infrequent.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapwing.llm.common import cut, marks, runs, same, table

#: Production parameters: words of a phrase, least count, places told per language, and the share (in percent) of a phrase's
#: count at which a longer phrase subsumes it.
LONGEST, LEAST, TOLD, SUBSUMES = 4, 30, 2000, 80
#: Scores are twice the extension's share of its parts, in millionths.
SCALE = 2000000
#: Parts that the empty prefix's stripe is dealt out in. Others have a part for each 1 / ``FINE`` of all words that their prefix makes up;
#: at most so many prefixes have two parts or more, and tasks know them.
ROOT_PARTS, FINE = 1024, 1 << 14
#: Language of rows without one.
UNKNOWN = "und"
#: A text is counted in stretches of about so many bytes, cut where a piece ends.
STRETCH = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_ENDS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def stretches(text: bytes):
    """A text in parts of about ``STRETCH`` bytes that end where a piece does."""
    at = 0
    while len(text) - at > STRETCH and (end := _ENDS.search(text, at + STRETCH)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


class Words:
    """The words of some texts: ``ids`` into ``words`` (distinct, as bytes), and how many words from each on lie in one piece."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", dtype=np.uint8)
        inside = ~_GAP[data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(starts)
        lengths = np.cumsum(ends - starts, dtype=np.int64)
        offsets = np.concatenate([[0], lengths]).astype(np.int64)
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
        coded = cells.dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # which piece a word is in: breaks before it, one at least between texts
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts] if self.n else np.zeros(0, dtype=np.int64)
        last = np.searchsorted(piece, piece, side="right")
        self.room = last - np.arange(self.n)
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(bounds, starts, side="right") - 1


def hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


def _folded(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of all but its last word and of this word."""
    x = (before ^ (before >> np.uint64(29))) * _MIX[0] + word
    return (x ^ (x >> np.uint64(32))) * _MIX[1]


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hashes that tasks give to sequences of words, of whole phrases."""
    out = np.zeros(len(phrases), dtype=np.uint64)
    split = [p.encode().split(b" ") for p in phrases]
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in langs], dtype=np.uint64)
    for n in {len(s) for s in split}:
        at = np.array([i for i, s in enumerate(split) if len(s) == n])
        h = seeds[at]
        for k in range(n):
            h = _folded(h, hashes(pa.array([split[i][k] for i in at], pa.binary())))
        out[at] = h
    return out


def stripes_of(words: Words, langs: list[str], level: int, alive, heavy: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """The stripes of ``level`` in some texts: lang, prefix, part, next words joined by spaces, and their counts (null where all are 1).

    ``langs`` has the language of each text. ``alive`` tests hashes of sequences of ``level`` - 1 words; ``heavy`` has the hashes,
    sorted, and numbers of parts of the prefixes that have more than one.
    """
    kinds, lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
    lang = lang.astype(np.int64)[words.text]
    at = np.flatnonzero(words.room >= level)
    word_hash = hashes(words.words)
    parts = np.full(len(at), ROOT_PARTS, dtype=np.uint64)
    if level > 1:
        # sequences of level - 1 words, then those whose neighbour one word on is alive as well
        fits = np.flatnonzero(words.room >= level - 1)
        h = np.array([xxhash.xxh64_intdigest(x) for x in kinds], dtype=np.uint64)[lang[fits]]
        for k in range(level - 1):
            h = _folded(h, word_hash[words.ids[fits + k]])
        good, prefix_hash = np.zeros(words.n + 1, dtype=bool), np.zeros(words.n + 1, dtype=np.uint64)
        good[fits], prefix_hash[fits] = alive(h.view(np.int64)), h
        at = at[good[at] & good[at + 1]]
        parts = np.ones(len(at), dtype=np.uint64)
        if len(heavy[0]):
            found = np.minimum(np.searchsorted(heavy[0], prefix_hash[at]), len(heavy[0]) - 1)
            parts = np.where(heavy[0][found] == prefix_hash[at], heavy[1][found], parts)
    # number the sequences exactly, a word at a time
    width = len(words.words) + 1
    group = lang[at]
    for k in range(level - 1):
        _, group = np.unique(group * width + words.ids[at + k], return_inverse=True)
    following = words.ids[at + level - 1]
    part = (word_hash[following] % parts).astype(np.int64)
    rank = np.empty(len(words.words), dtype=np.int64)
    rank[pc.sort_indices(words.words).to_numpy()] = np.arange(len(words.words))
    order = np.lexsort((rank[following], part, group))
    group, following, part, at = group[order], following[order], part[order], at[order]
    new_entry = np.ones(len(at), dtype=bool)
    new_entry[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
    entry = np.flatnonzero(new_entry)
    count = np.diff(np.append(entry, len(at)))
    g, p = group[entry], part[entry]
    new_row = np.ones(len(entry), dtype=bool)
    new_row[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    row = np.flatnonzero(new_row)
    offsets = pa.array(np.append(row, len(entry)), pa.int32())
    strings = words.words.cast(pa.large_string())
    where = at[entry[row]]
    prefix = pa.array([""] * len(row), pa.large_string())
    if level > 1:
        prefix = pc.binary_join_element_wise(*[strings.take(pa.array(words.ids[where + k])) for k in range(level - 1)], pa.scalar(" ", pa.large_string()))
    joined = lambda values: pc.binary_join(pa.ListArray.from_arrays(offsets, values.cast(pa.string())), " ")
    several = np.maximum.reduceat(count, row) > 1 if len(row) else np.zeros(0, dtype=bool)
    counts = pc.if_else(pa.array(several), joined(pa.array(count, pa.int64())), pa.scalar(None, pa.string()))
    columns = [pa.array(kinds, pa.string()).take(pa.array(lang[where])), prefix.cast(pa.string()), pa.array(p[row], pa.int32()), joined(strings.take(pa.array(following[entry]))), counts]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "part", "next", "n"])


def merged(docs: DataFrame, level: int, alive=None, heavy=None) -> DataFrame:
    """(lang, prefix, next, a): the stripes of a level over all ``docs`` (lang, text), as rows of entries, not yet cut by count.

    The parts of stripes travel as they are counted, a prefix once a part, and are added elementwise where they meet.
    """

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in runs(batch.column(1)):
                own = langs[start : start + len(texts)]
                if len(texts) == 1 and len(texts[0]) > 2 * STRETCH:
                    for x in stretches(texts[0]):
                        yield stripes_of(Words([x]), own, level, alive, heavy and heavy.value)
                else:
                    yield stripes_of(Words(texts), own, level, alive, heavy and heavy.value)

    found = docs.select("lang", "text").mapInArrow(count, "lang string, prefix string, part int, next string, n string")
    dealt = found.repartition("lang", "prefix", "part")
    ones = F.transform(F.split("next", " "), lambda w: F.struct(w.alias("next"), F.lit(1).cast("long").alias("n")))
    counted = F.zip_with(F.split("next", " "), F.split("n", " "), lambda w, n: F.struct(w.alias("next"), n.cast("long").alias("n")))
    entries = dealt.select("lang", "prefix", "part", F.inline(F.when(F.col("n").isNull(), ones).otherwise(counted)))
    return entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("a")).drop("part")


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))


def _hashed(entries: DataFrame) -> DataFrame:
    """(h, a) of the phrases that entries make."""

    def told(batches):
        for batch in batches:
            h = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2)], names=["h", "a"])

    return entries.select("lang", _phrase().alias("phrase"), "a").mapInArrow(told, StructType([StructField("h", LongType()), StructField("a", LongType())]))


def _heavy(hashed: DataFrame, n: int):
    """Hashes, sorted, and numbers of parts of the prefixes with more than ``n`` / ``FINE`` occurrences: fewer than ``FINE``."""
    rows = hashed.where(F.col("a") * FINE > n).groupBy("h").agg(F.max("a").alias("a")).collect()
    h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    parts = np.array([-(-r["a"] * FINE // n) for r in rows], dtype=np.uint64)
    order = np.argsort(h)
    return hashed.sparkSession.sparkContext.broadcast((h[order], parts[order]))


def stripes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): entries (lang, prefix, next, a) with ``least`` or more, of all levels, and (lang, n), its number of words.

    A null text has no words, a null language is ``und``. Every row counts, repeated ones as often as they come; extra columns
    are ignored. An empty table gives no rows. Texts are read once a level; what is shuffled is stripes.
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    whole = cut(merged(docs, 1))
    totals = whole.groupBy("lang").agg(F.sum("a").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 1
    levels = [whole.where(F.col("a") >= least)]
    for level in range(2, longest + 1):
        before = cut(_hashed(levels[-1]))
        levels.append(cut(merged(docs, level, marks(before, "h"), _heavy(before, words)).where(F.col("a") >= least)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(frequent: DataFrame, totals: DataFrame, told: int = TOLD, subsumes: int = SUBSUMES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``told`` phrases of two words or more.

    A phrase is cut where its score, ``SCALE`` times its count over the sum of its parts' counts, is lowest, at the first of equals.
    Phrases inside a longer one with ``subsumes`` percent of their count are left out: since no sequence is more frequent than
    one inside it, extensions by one word decide this. Ties of score and count go by the phrase's bytes.
    """
    known = frequent.select("lang", _phrase().alias("phrase"), "a")
    words = F.split("phrase", " ", -1)
    phrases = frequent.where("prefix <> ''").select("lang", _phrase().alias("phrase"), "prefix", "a")
    # the largest entry of a phrase's own stripe, and of the stripes whose prefix it ends
    inner = F.explode(F.array(F.col("prefix"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
    longer = phrases.where("instr(prefix, ' ') > 0").select("lang", inner.alias("inner"), "a")
    over = longer.groupBy("lang", "inner").agg(F.max("a").alias("over")).withColumnRenamed("lang", "over_lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    own = phrases.join(over, (F.col("lang") == F.col("over_lang")) & (F.col("phrase") == F.col("inner")), "left")
    own = own.where(F.col("over").isNull() | (wide("over") * 100 < wide("a") * subsumes)).select("lang", "phrase", "a")
    split = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("right")))
    cuts = own.select("lang", "phrase", "a", F.explode(split).alias("c")).select("lang", "phrase", "a", "c.*")
    for part, name in (("left", "l"), ("right", "r")):
        counts = known.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("a").alias(name))
        cuts = cuts.join(counts, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__part"))).drop("__lang", "__part", part)
    scored = cuts.withColumn("score", F.expr(f"cast((cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))).where(F.col("rank") <= told)
    return ranked.join(totals, same(ranked, totals, ["lang"])).select(ranked["lang"], F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*stripes(table(spark, sf_dir, "documents")))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, range(1, {LONGEST + 1}) ks(k), unnest(range(1, len(ws) - k + 2)) u(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST}),
i AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS inner_phrase, max(a) AS longer FROM c, range(2, {LONGEST}) ms(m), range(1, {LONGEST}) ss(s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.inner_phrase = c.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {SUBSUMES} * CAST(a AS HUGEINT)),
s AS (SELECT o.lang, o.phrase, o.a, x.cut, l.a AS l, r.a AS r, CAST({SCALE} * CAST(o.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score FROM o, range(1, {LONGEST}) x(cut), f l, f r WHERE x.cut < o.k AND l.lang = o.lang AND l.phrase = array_to_string(o.ws[:x.cut], ' ') AND r.lang = o.lang AND r.phrase = array_to_string(o.ws[x.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) QUALIFY rank <= {TOLD}
"""
