"""Structure repair against a plain search over audits, on odd rows."""

import hashlib
import random
import re
from functools import lru_cache

from lapwing.llm import repair

MOVES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """(counts, cost, audit, repaired text) of rows in order, (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, budget=2):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            cost, audit = best(i + 1, state)
            found.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                for r, to in MOVES[state].items():
                    cost, audit = best(i + 1, to)
                    late = faults[i] == "truncated"
                    if rows[i][1][:1] == r:
                        found.append((cost + late, "K" + audit))
                    if r in "ua":
                        found.append((cost + late + 2, "R" + audit))
        for r, to in MOVES[state].items():
            if r in "ua" and budget:
                cost, audit = best(i, to, budget - 1)
                found.append((cost + 2, "I" + audit))
        return min(found, default=(10**6, ""))

    cost, audit = best(0, "")
    out, state, at = [], "", 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = {"u": "user", "a": "assistant"}[next(r for r in MOVES[state] if r in "ua")]
        out.append(f"{role}:{text}")
        state = role[0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit), "\n".join(out)


def random_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        t = rng.choice([0, 0, 3])
        for _ in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No!", "why?  \n", "cut off", " \t", "", None, "。", "a.b", "Yes."])
            rows.append((conv, rng.choice([t, t, t, None]), role, text, "x", 1))
            t += rng.choice([1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, ending string, cost int"


def test_repair_against_a_plain_search(spark):
    turns = spark.createDataFrame(random_turns(5, 300), SCHEMA)
    plans = repair.audits(turns)
    rows = repair.repaired(turns, plans)
    hashed = {r.conv_id: r.repaired_sha256 for r in repair.digests(rows).collect()}
    by = {}
    for conv, turn, role, text, *_ in random_turns(5, 300):
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    got = {r.conv_id: r for r in plans.collect()}
    assert got.keys() == by.keys()
    for conv, own in by.items():
        want, text = plain(sorted(own, key=order))
        assert tuple(got[conv][c] for c in (*repair.COUNTS, "cost", "audit")) == want, conv
        assert hashed.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
    assert repair.audits(turns.limit(0)).count() == 0 and repair.repaired(turns.limit(0), plans.limit(0)).count() == 0


def test_one_conversation_with_most_of_the_rows(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}." if i % 1000 else "same", None, None) for i in range(20000)]
    got = repair.audits(spark.createDataFrame(rows, SCHEMA)).collect()
    want, _ = plain_long(rows)
    assert [(r.duplicate, r.truncated, r.illegal, r.cost, len(r.audit)) for r in got] == [want]


def plain_long(rows):
    """The user's turn "same" comes every 1,000: the first is truncated, the others go with a turn of the assistant, or the user's is put in anew."""
    n = sum(1 for i in range(len(rows)) if i % 1000 == 0)
    return (n - 1, 1, 0, 5 * (n - 1) + 1, len(rows) + n - 1), None


def test_suffixes_are_shared():
    shared = repair.Suffixes()
    signatures = sorted("".join(random.Random(i).choice("suaoxSUAO") for _ in range(random.Random(-i).randint(0, 12))) for i in range(3000))
    alone = {s: repair.Suffixes().best(s) for s in set(signatures[::17])}
    assert all(shared.best(s) == alone.get(s, shared.best(s)) for s in signatures)
    assert len(shared.automaton.known) < 400


def test_query_keeps_every_conversation(spark, tmp_path):
    rows = [(None, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, "assistant", "x " * 200000), (3, 5, "system", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_repair(spark, str(tmp_path))
    assert sorted(str(r.conv_id) for r in got.collect()) == ["1", "2", "3", "None"]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert repair.op11_repair(spark, f"{tmp_path}/e").count() == 0
