"""Collocations against plain counting, on odd rows."""

import random
import re
from collections import Counter, defaultdict

from lapwing.llm import collocations

SCHEMA = "doc_id long, text string, lang string, prefix string, a int, n int, part int"


def plain(rows, longest=4, least=30, told=2000, subsumes=80):
    found, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= subsumes * a and inside(p, q) for q, b in phrases.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:told], start=1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "of", "Über", "日本", "x|y", "\x1c", " z", "'s"]
    out = [(None, None), ("", "en"), ("a\tb  of\x0bthe the.the", None), (" \t\n.,;:!?", "en"), ("the of " * 5000, "de")]
    for _ in range(n):
        words = [rng.choices(vocabulary, [30, 20, 20, 10, 5, 5, 3, 2, 2, 3])[0] for _ in range(rng.randint(1, 60))]
        out.append(("".join(w + rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n"], [60, 5, 5, 5, 3, 3, 2])[0] for w in words), rng.choice(["en", "fr", "und", None, "en"])))
    return out + out[:40]


def test_against_plain_counting(spark):
    rows = rows_of(3, 400)
    docs = spark.createDataFrame([(i, t, x, "clash", 1, 2, 3) for i, (t, x) in enumerate(rows)], SCHEMA)
    got = collocations.collocations(*collocations.stripes(docs)).collect()
    assert [tuple(r) for r in sorted(got)] == plain(rows)
    few = collocations.collocations(*collocations.stripes(docs), told=7, subsumes=50)
    assert [tuple(r) for r in sorted(few.collect())] == plain(rows, told=7, subsumes=50)
    empty = collocations.stripes(docs.limit(0))
    assert collocations.collocations(*empty).count() == 0 and empty[1].count() == 0


def test_a_bitmap_that_is_full_changes_nothing(spark, monkeypatch):
    rows = rows_of(4, 150)
    docs = spark.createDataFrame([(i, t, x, "clash", 1, 2, 3) for i, (t, x) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(collocations, "marks", lambda rows, column: lambda h: h == h)
    got = collocations.collocations(*collocations.stripes(docs)).collect()
    assert [tuple(r) for r in sorted(got)] == plain(rows)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    text = "".join(random.Random(1).choices(["the ", "of ", "and ", "a", ". ", "\n"], [5, 5, 3, 2, 1, 1], k=30000))
    docs = spark.createDataFrame([(1, text, "en", "", 1, 2, 3)], SCHEMA)
    whole = collocations.collocations(*collocations.stripes(docs)).collect()
    assert b"".join(collocations.stretches(text.encode())) == text.encode()
    monkeypatch.setattr(collocations, "STRETCH", 1000)
    parts = list(collocations.stretches(text.encode()))
    assert len(parts) > 20 and b"".join(parts) == text.encode() and all(p[-1:] in b".\n" for p in parts[:-1])
    assert [tuple(r) for r in sorted(whole)] == plain([(text, "en")])


def test_scores_past_64_bits(spark):
    big = 1 << 62
    frequent = spark.createDataFrame([("en", "", "a", big), ("en", "", "b", big), ("en", "a", "b", big - 1)], "lang string, prefix string, next string, a long")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    assert [tuple(r) for r in collocations.collocations(frequent, totals).collect()] == [("en", 1, "a b", big - 1, big, big, big, 2000000 * (big - 1) // (2 * big))]
