"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie; ordered runs of record hashes, each covering an offset range
of its file, are hashed into nodes, these into nodes above them, up to one root per file and
one for the collection. Two replicas are compared from the top: only children of nodes whose
hashes differ are joined, so an audit of a sound replica reads one row.

A record's place in the tree follows from its id, not from its rank, and offsets are told but not
hashed: each replica is laid out from its own bytes, and a lost record does not shift its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import cut, running, table

#: Children of a node; records of a file.
FANOUT, PER_FILE = 16, 512
#: Stands for a file's number in nodes over files.
OVER_FILES = -(1 << 62)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, record): each page as a response record. A null body is empty, a null url an empty target."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("id"), F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8")).alias("record"))


def digests(records: DataFrame, *more: Column) -> DataFrame:
    """(id, length, mix, hash, more...): what a tree needs of each record. Records are hashed where they lie and not shuffled."""
    return records.select("id", F.octet_length("record").cast("long").alias("length"), F.xxhash64("record").alias("mix"), F.sha2("record", 256).alias("hash"), *more)


def placed(rows: DataFrame) -> DataFrame:
    """(file, ordinal, first, past, hash): the places of a replica, its digests laid end to end in files of ids that lie together.

    The ordinal is the id's place in its file. Records without an id have places of their own by hash. Records that
    share a place are digested together, whatever their order: number and sums of their digests' parts.
    A file whose ids are repeated without end is still laid out in parts.
    """
    file = F.coalesce(F.floor(F.col("id") / PER_FILE), F.lit(-1).cast("long") - F.pmod("mix", F.lit(1 << 20)))
    ordinal = F.coalesce(F.pmod("id", F.lit(PER_FILE)), F.pmod(F.shiftright("mix", 20), F.lit(PER_FILE)))
    rows = rows.withColumns({"file": file.cast("long"), "ordinal": ordinal.cast("long")})
    laid = running(rows, ["file"], F.col("ordinal") * 64 + F.shiftrightunsigned("mix", 58), ["mix"], {"offset": "length"})
    parts = [F.sum(F.conv(F.substring("hash", 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    together = F.when(F.count("*") == 1, F.min("hash")).otherwise(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256))
    return laid.groupBy("file", "ordinal").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("past"), together.alias("hash"))


def shape(*replicas: DataFrame) -> tuple[int, int]:
    """(least, largest file) over replicas, so that their trees have the same levels."""
    found = [r.agg(F.min("file"), F.max("file")).first() for r in replicas]
    found = [f for f in found if f[0] is not None] or [(0, 0)]
    return min(f[0] for f in found), max(f[1] for f in found)


def tree(rows: DataFrame, of: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a replica's tree, from places to one root.

    Rows are (grp, node, up_grp, up_node, first, past, hash): a node, its parent, the offsets that
    it covers in its file, its digest. Runs of ``fanout`` make a node, inside files first, then over files.
    """
    lo, hi = of
    rows = rows.select(F.col("file").alias("grp"), F.col("ordinal").alias("node"), "first", "past", "hash")
    levels, most = [], PER_FILE - 1
    while True:
        # the last level inside files has the files themselves as parents
        top = most < fanout
        rows = cut(_with_parent(rows, F.lit(OVER_FILES) if top else F.col("grp"), F.col("grp") if top else F.floor(F.col("node") / fanout)))
        levels.append(rows)
        rows = _above(rows)
        if top:
            break
        most //= fanout
    while True:
        last = hi - lo < fanout
        up = F.lit(0) if last else F.floor(F.col("node") / fanout)
        rows = cut(_with_parent(rows, F.lit(OVER_FILES), up))
        levels.append(rows)
        rows = _above(rows)
        if last:
            return [*levels, cut(_with_parent(rows, F.lit(OVER_FILES), F.lit(0)))]
        lo, hi = lo // fanout, hi // fanout


def _with_parent(rows: DataFrame, grp: Column, node: Column) -> DataFrame:
    return rows.select("grp", "node", grp.cast("long").alias("up_grp"), node.cast("long").alias("up_node"), "first", "past", "hash")


def _above(nodes: DataFrame) -> DataFrame:
    """The parents: each the digest of its children's places and digests in order; a node has ``fanout`` children at most."""
    ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))
    told = F.concat_ws("|", F.transform(ordered, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])))
    return nodes.groupBy("up_grp", "up_node").agg(F.min("first").alias("first"), F.max("past").alias("past"), F.sha2(told, 256).alias("hash")).select(F.col("up_grp").alias("grp"), F.col("up_node").alias("node"), "first", "past", "hash")


def descend(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(file, ordinal, first, past, status) of the places in which tree ``b`` differs from the trusted ``a``, with the offsets of ``a``
    (of ``b`` where it has more).

    Status is "changed", "missing" (not in b) or "unexpected" (not in a). From the root down, only
    children of nodes that differ are compared.
    """
    suspects = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspects is not None:
            x, y = (t.join(suspects, ["up_grp", "up_node"], "left_semi") for t in (x, y))
        x, y = (t.select("grp", "node", *[F.col(c).alias(f"{c}_{side}") for c in ("first", "past", "hash")]) for t, side in ((x, "a"), (y, "b")))
        pairs = x.join(y, ["grp", "node"], "full")
        differ = pairs.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        suspects = cut(differ.select(F.col("grp").alias("up_grp"), F.col("node").alias("up_node"), F.coalesce("first_a", "first_b").alias("first"), F.coalesce("past_a", "past_b").alias("past"), F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "unexpected").otherwise("changed").alias("status")))
        if suspects.isEmpty():
            break
        found, suspects = suspects, suspects.select("up_grp", "up_node")
    else:
        return found.select(F.col("up_grp").alias("file"), F.col("up_node").alias("ordinal"), "first", "past", "status")
    return suspects.select(F.col("up_grp").alias("file"), F.col("up_node").alias("ordinal"), "first", "past", "status")


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Builds the trees of two replicas, each as ``placed`` from its own records, and descends them. Empty replicas and equal ones give no rows."""
    of = shape(a, b)
    return descend(tree(a, of, fanout), tree(b, of, fanout))


#: Fixed values of the query's damaged replica: of each 97 ids one has a byte changed and one is lost.
DAMAGE_EVERY, ROTTEN, LOST = 97, 3, 11


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a second replica of all pages, in which records were damaged by a rule on their ids."""
    records = warc_records(table(spark, sf_dir, "pages"))
    turn, middle = F.pmod("id", F.lit(DAMAGE_EVERY)), F.floor(F.octet_length("record") / 2).cast("int")
    rotten = F.concat(F.substring(F.col("record"), F.lit(1), middle), F.lit(bytearray(b"\x15")), F.substring(F.col("record"), middle + 2, F.octet_length("record")))
    copy = F.when(turn == ROTTEN, rotten).when(turn == LOST, F.lit(None)).otherwise(F.col("record"))
    both = cut(digests(records, F.octet_length(copy).cast("long").alias("copy_length"), F.xxhash64(copy).alias("copy_mix"), F.sha2(copy, 256).alias("copy_hash")))
    kept = both.where("copy_hash is not null").select("id", F.col("copy_length").alias("length"), F.col("copy_mix").alias("mix"), F.col("copy_hash").alias("hash"))
    return audit(cut(placed(both.select("id", "length", "mix", "hash"))), cut(placed(kept)))


RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE = f"""
WITH r AS (SELECT page_id, page_id // {PER_FILE} AS file, strlen({RECORD}) AS length FROM pages),
p AS (SELECT page_id, file, page_id % {PER_FILE} AS ordinal, sum(length) OVER w - length AS first, sum(length) OVER w AS past FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)),
d AS (SELECT *, page_id % {DAMAGE_EVERY} AS turn FROM p)
SELECT CAST(file AS BIGINT) AS file, CAST(ordinal AS BIGINT) AS ordinal, CAST(first AS BIGINT) AS first, CAST(past AS BIGINT) AS past, CASE turn WHEN {ROTTEN} THEN 'changed' ELSE 'missing' END AS status
FROM d WHERE turn IN ({ROTTEN}, {LOST})
"""
