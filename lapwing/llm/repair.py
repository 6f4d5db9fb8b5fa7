"""Repair of the structure of conversations at the least cost.

Each turn becomes a symbol of its role and fault, each conversation a signature. Signatures are read
from their ends: sorted by their reversal, they share the nodes of their suffixes, and a node holds for
each state of the grammar ``(s?(ua)+)?`` the cost to go and the first letters of the best audit from
there. A node is computed from the node after it; nodes whose costs differ by a constant and whose
audits are ranked alike are one, so that few are ever computed, whatever the number of conversations.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lapwing.llm.common import cut, same, table

#: White space, marks that end a sentence, costs of edits, and what a kept truncated turn costs.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar and where each role initial leads; a conversation may end in the first and the last.
START, SYSTEM, USER, ANSWER = range(4)
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ANSWER}, ANSWER: {"u": USER}}
FINAL = (START, ANSWER)
ROLES = {"u": "user", "a": "assistant"}
#: Symbols of a signature are joined in segments of so many.
SEGMENT = 4096
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


@dataclass(frozen=True)
class Node:
    """For each state: the cost to go over the node's least, the audit's letters up to the next turn, the state they lead
    to, and how the whole audit ranks among the four. ``least`` is what the node adds to the least of the next node."""

    least: int
    cost: tuple
    letters: tuple
    to: tuple
    rank: tuple


def _finished(best: list[tuple]) -> Node:
    """A node from each state's (cost, letters, rank of the rest, next state), with insertions where they pay."""
    for _ in range(len(best)):
        for q, moves in MOVES.items():
            for role in ROLES:
                if role in moves:
                    cost, letters, rest, to = best[moves[role]]
                    best[q] = min(best[q], (cost + INSERT, "I" + letters, rest, to))
    least = min(b[0] for b in best)
    order = sorted({b[1:3] for b in best})
    return Node(least, tuple(b[0] - least for b in best), tuple(b[1] for b in best), tuple(b[3] for b in best), tuple(order.index(b[1:3]) for b in best))


class Automaton:
    """The nodes met so far; ``END`` is the node of the empty signature."""

    def __init__(self):
        self.end = _finished([(0 if q in FINAL else 1 << 30, "", 0, q) for q in MOVES])
        self.known: dict[tuple, Node] = {}

    def before(self, symbol: str, then: Node) -> Node:
        """The node of a signature that begins with ``symbol`` and goes on as ``then``."""
        key = (symbol, then.cost, then.rank)
        if key not in self.known:
            best = []
            for q, moves in MOVES.items():
                options = [(DELETE, "D", q)]
                if symbol != "x":
                    late = TRUNCATED if symbol.isupper() else 0
                    options += [(late, "K", to) for role, to in moves.items() if role == symbol.lower()]
                    options += [(late + RE_ROLE, "R", to) for role, to in moves.items() if role in ROLES]
                best.append(min((cost + then.cost[to], letter, then.rank[to], to) for cost, letter, to in options))
            self.known[key] = _finished(best)
        return self.known[key]


class Suffixes:
    """Path of nodes from the end of the last signature to its start, kept as far as the next one shares it."""

    def __init__(self):
        self.automaton, self.read, self.cost, self.audit = Automaton(), "", 0, ""
        self.path = [self.automaton.end]
        self.total = [self.automaton.end.least]
        self._tell()

    def _tell(self):
        state, letters = START, []
        for node in reversed(self.path):
            letters.append(node.letters[state])
            state = node.to[state]
        self.cost, self.audit = self.total[-1] + self.path[-1].cost[START], "".join(letters)

    def best(self, reversed_signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature; those that come sorted share their work."""
        if reversed_signature != self.read:
            shared = 0
            for x, y in zip(self.read, reversed_signature):
                if x != y:
                    break
                shared += 1
            del self.path[shared + 1 :], self.total[shared + 1 :]
            for symbol in reversed_signature[shared:]:
                node = self.automaton.before(symbol, self.path[-1])
                self.path.append(node)
                self.total.append(self.total[-1] + node.least)
            self.read = reversed_signature
            self._tell()
        return self.cost, self.audit


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and a digest of role and text; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _order() -> list[Column]:
    """Turns in order, null ones first; those of one turn by role and digest, which puts equal ones side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def signatures(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, counts of faults as long, and ``ending``, its signature from the end.

    Signatures have a symbol a turn: x for blank and duplicate turns, else s, u, a or o (any other role), in capitals
    for truncated turns. Only digests, roles and turns are shuffled, once, by conversation, and sorted there.
    """
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    blank, last = ended == "", F.substring(ended, -1, 1)
    rows = _turns(turns).select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~last.isin(*ENDS)).alias("late"))
    w = Window.partitionBy("conv_id").orderBy(*_order())
    rows = rows.select("*", F.row_number().over(w).alias("place"), F.lag("initial").over(w).alias("before"), F.lag("turn").over(w).alias("turn_before"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("place")) > 1
    rows = rows.withColumn("duplicate", ~F.col("blank") & again).withColumn("truncated", F.col("late") & ~F.col("duplicate"))
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(kind)).otherwise(kind)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    parts = rows.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", symbol.alias("s")))), lambda x: x["s"]), "").alias("part"),
        F.min("turn").alias("first"), F.max("turn").alias("past"), count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")))("turns"),
        count(F.col("blank"))("blank"), count(F.col("duplicate"))("duplicate"), count(F.col("truncated"))("truncated"), count((F.col("place") > 1) & ~legal)("illegal"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "part"))), lambda x: x["part"]), "")
    gaps = F.coalesce(F.max("past") - F.min("first") + 1 - F.sum("turns"), F.lit(0))
    return parts.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in COUNTS[1:]], F.reverse(whole).alias("ending"))


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, counts of faults, cost (long) and audit, the letters of its cheapest edits in order.

    ``turns`` has conv_id, turn, role, text; extra columns are ignored. Null roles and texts are one space, null turns come
    first, null conversations are one conversation. Repeated rows are duplicates, blank ones blank. Ties of cost go to the
    audit that is least in ASCII. An empty table gives no rows. Signatures are dealt out in ranges of their ends, so that
    those that share a suffix meet in one task, and equal ones, however many, in as many tasks as they fill.
    """
    found = cut(signatures(turns))
    ranged = found.repartitionByRange("ending", "conv_id").sortWithinPartitions("ending")
    at, names = ranged.columns.index("ending"), [*[c for c in ranged.columns if c != "ending"], "cost", "audit"]

    def edit(batches):
        shared = Suffixes()
        for batch in batches:
            costs, letters = [], []
            for ending in batch.column(at).to_pylist():
                cost, audit = shared.best(ending)
                costs.append(cost)
                letters.append(audit)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.int64()), pa.array(letters, pa.string())], names=names)

    kept = [f for f in ranged.schema.fields if f.name != "ending"]
    return ranged.mapInArrow(edit, StructType([*kept, StructField("cost", LongType()), StructField("audit", StringType())]))


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns that ``plans`` (conv_id, audit) leave: conv_id, place (long, from 1), edit (K, R or I), role, text.

    A conversation's rows lie together and in order in one partition. They pass through it one by one behind their audit, so a
    task holds the letters of one conversation and a batch of turns, never all texts of a conversation. Conversations without a plan are left out.
    """
    rows = _turns(turns).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "digest")
    heads = plans.select("conv_id", "audit", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")])
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    both = both.select("conv_id", "audit", "role", "text")

    def emit(batches):
        audit, at, state, place, conv = "", 0, START, 0, None
        names = ["conv_id", "place", "edit", "role", "text"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string()]
        out = [[] for _ in names]

        def put(edit, role, text):
            nonlocal place, state
            place, state = place + 1, MOVES[state][role[0]]
            for column, value in zip(out, (conv, place, edit, role, text), strict=True):
                column.append(value)

        def insert():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", ROLES[next(r for r in MOVES[state] if r in ROLES)], "")
                at += 1

        def flush(conv_type):
            done = pa.RecordBatch.from_arrays([pa.array(c, conv_type if t is None else t) for c, t in zip(out, types, strict=True)], names=names)
            for column in out:
                column.clear()
            return done

        conv_type = None
        for batch in batches:
            conv_type = batch.column(0).type
            for key, head, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if head is not None:
                    insert()
                    audit, at, state, place, conv = head, 0, START, 0, key
                    continue
                if key != conv or at >= len(audit):
                    continue  # no plan for it
                insert()
                letter, at = audit[at], at + 1
                if letter == "K":
                    put("K", role, text)
                elif letter == "R":
                    put("R", ROLES[next(r for r in MOVES[state] if r in ROLES)], text)
            yield flush(conv_type)
        insert()
        if conv_type is not None:
            yield flush(conv_type)

    text = [StructField(c, StringType()) for c in ("edit", "role", "text")]
    return both.mapInArrow(emit, StructType([turns.schema["conv_id"], StructField("place", LongType()), *text]))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows as they lie: ``role:text`` joined by newlines, hashed as they pass."""

    def told(batches):
        conv, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.column(0).type, []
            for key, place, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place == 1:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "place", "role", "text").mapInArrow(told, StructType([rows.schema["conv_id"], StructField("repaired_sha256", StringType())]))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations hurt by a rule on their keys: turns lost, emptied, left without ends of sentences, repeated or given to the user."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    rows = rows.withColumn("fate", F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20)))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    turns = damaged(conversations)
    plans = cut(audits(turns))
    hashed = digests(repaired(turns, plans))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(plans, same(ids, plans, ["conv_id"]), "left").select(ids["conv_id"], *[plans[c] for c in (*COUNTS, "cost", "audit")])
    out = out.join(hashed, same(out, hashed, ["conv_id"]), "left")
    zeros = [F.coalesce(plans[c], F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return out.select(ids["conv_id"], *zeros, F.coalesce(plans["audit"], F.lit("")).alias("audit"), F.coalesce(hashed["repaired_sha256"], F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _best(q: int) -> str:
    """SQL of the best (cost, audit) of a state before a turn, from those after it (c[1..4], states in order)."""
    options = [f"{{'cost': c[{q + 1}].cost + {DELETE}, 'audit': 'D' || c[{q + 1}].audit}}"]
    for role, to in MOVES[q].items():
        options.append(f"CASE WHEN lower(symbol) = '{role}' THEN {{'cost': c[{to + 1}].cost + late, 'audit': 'K' || c[{to + 1}].audit}} END")
        if role in ROLES:
            options.append(f"CASE WHEN symbol <> 'x' THEN {{'cost': c[{to + 1}].cost + late + {RE_ROLE}, 'audit': 'R' || c[{to + 1}].audit}} END")
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _inserted(source: str) -> str:
    """SQL of a list of the four states' best, insertions allowed, from the list ``source``: at most two in a row pay."""
    add = lambda q: f"{{'cost': {q}.cost + {INSERT}, 'audit': 'I' || {q}.audit}}"
    once = lambda b: "[" + ", ".join(f"list_sort([{b}[{q + 1}], {add(f'{b}[{ANSWER + 1 if q == USER else USER + 1}]')}])[1]" for q in MOVES) + "]"
    return f"list_transform(list_transform([{source}], lambda b: {once('b')}), lambda b: {once('b')})[1]"


_W = "[^\\x20\\x09-\\x0D]"
ORACLE = f"""
WITH RECURSIVE table_steps AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM table_steps WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM table_steps WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
fated AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a // 256, tab[1 + xor(a, b) % 256])), 4294967295) % 20 AS fate FROM keyed k, crcs),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER w AS place, lag(role[1]) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '{_W}') AS blank, regexp_extract(text, '({_W})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS unended FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS truncated, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS kind FROM placed),
signed AS (SELECT *, CASE WHEN blank OR duplicate THEN 'x' ELSE kind END AS symbol, CAST(truncated AS BIGINT) * {TRUNCATED} AS late, count(*) OVER (PARTITION BY conv_id) AS n FROM marked),
walk AS (
  SELECT DISTINCT conv_id, n AS place, {_inserted("[{'cost': CAST(0 AS BIGINT), 'audit': ''}, {'cost': CAST(1000000 AS BIGINT), 'audit': ''}, {'cost': CAST(1000000 AS BIGINT), 'audit': ''}, {'cost': CAST(0 AS BIGINT), 'audit': ''}]")} AS c FROM signed
  UNION ALL
  SELECT s.conv_id, s.place - 1, {_inserted("[" + ", ".join(_best(q) for q in MOVES) + "]")} FROM walk w JOIN signed s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.place = w.place WHERE w.place > 0
),
plans AS (SELECT conv_id, c[1].cost AS cost, c[1].audit AS audit FROM walk WHERE place = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM plans WHERE audit <> ''),
edits AS (SELECT *, CASE WHEN letter = 'I' THEN NULL ELSE count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) END AS place FROM letters),
turned AS (SELECT e.conv_id, e.letter, e.pos, s.role, s.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.pos) AS k FROM edits e LEFT JOIN signed s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.place = e.place WHERE letter <> 'D'),
spoken AS (SELECT *, max(CASE WHEN k = 1 AND letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM turned),
told AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos)) AS hash FROM spoken GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE place > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM signed GROUP BY conv_id)
SELECT i.conv_id, {", ".join(f"CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}" for x in COUNTS)}, CAST(coalesce(p.cost, 0) AS BIGINT) AS cost, coalesce(p.audit, '') AS audit, coalesce(t.hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
