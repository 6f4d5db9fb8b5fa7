"""Severity of toxic text by cumulative-link ordinal regression.

P(grade > k) is the logistic of w·x - t_k, with one weight vector for all ordered thresholds
t_0 < t_1 < t_2. Features are log(1 + count) of words and word beginnings chosen by how their
document frequency differs between labelled classes. The labels at hand are binary, so grade 0 is "not toxic",
and toxic rows are graded 1 to 3 at the terciles of how many marker words they hold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from lapwing.llm.common import runs, table

#: Labelled rows that the fit uses, per class; words that it keeps.
SAMPLE, WORDS = 2000, 1024
GRADES = 4
STEMS = (4, 5, 6)
#: The first threshold maximises caught toxic rows less so many times the clean rows it would catch, as shares of the sample.
CLEAN_COUNTS = 5

#: Letters to lower case, ASCII punctuation to spaces.
_FOLD = bytes(ord(" ") if (33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127) else c + 32 if 65 <= c < 91 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its first 4, 5 and 6 bytes where more follow."""
    return [word, *[word[:k] + b"*" for k in STEMS if len(word) > k]]


@dataclass
class OrdinalModel:
    """Words with weights, ordered thresholds. Without words nothing is toxic."""

    index: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 20.0) + np.arange(GRADES - 1))

    def __post_init__(self):
        self.roots = {f.removesuffix(b"*")[: STEMS[0]] for f in self.index}

    def found(self, text: bytes) -> Counter:
        """Counts of the model's features in a text; only words that begin like one are looked at closely."""
        index, roots, out = self.index, self.roots, Counter()
        for w, n in Counter([w for w in words(text) if w[:4] in roots]).items():
            for f in features(w):
                if f in index:
                    out[f] += n
        return out

    def latent(self, text: bytes) -> float:
        return float(sum(self.weights[self.index[f]] * np.log1p(n) for f, n in self.found(text).items()))

    def beyond(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - latent[:, None], -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[bytes, int]]:
    """(text, toxic) of at most ``per_class`` ids of each class, chosen by hash of the id; equal texts count once, and of an id's texts the least.

    The chosen ids are a table of bounded size, so the documents are not shuffled.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    picked = [marks.where(F.col("__toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    found = rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("__toxic").alias("toxic")).collect()
    return [(text.encode(), toxic) for text, toxic in sorted({(r["text"], r["toxic"]) for r in found})]


def _chosen_words(sample: list[tuple[bytes, int]], most: int) -> tuple[list[bytes], set[bytes]]:
    """Features whose document frequencies differ most in standard errors, and among them the markers of toxicity."""
    df, n = (Counter(), Counter()), [0, 0]
    for text, y in sample:
        df[y].update({f for w in set(words(text)) for f in features(w)})
        n[y] += 1
    scored = []
    for w in df[0].keys() | df[1].keys():
        a, b = df[1][w], df[0][w]
        if a + b >= 8:
            lift = np.log((a + 0.5) / n[1]) - np.log((b + 0.5) / n[0])
            share = (a + b) / (n[0] + n[1])
            scored.append((abs(a / n[1] - b / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12), lift, w))
    scored = [x for x in sorted(scored, key=lambda x: (-x[0], x[2])) if x[0] >= 5][:most]
    return [w for _, _, w in scored], {w for _, lift, w in scored if lift > 1.5}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE, most_words: int = WORDS) -> OrdinalModel:
    """Fits the model on a bounded sample of labelled rows; with one class only, a model that finds nothing."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    toxic = np.array([y for _, y in sample], dtype=int)
    if len(set(toxic.tolist())) < 2:
        return OrdinalModel()
    chosen, markers = _chosen_words(sample, most_words)
    if not chosen:
        return OrdinalModel()
    model = OrdinalModel({w: i for i, w in enumerate(chosen)})
    x, held = np.zeros((len(sample), len(chosen))), np.zeros(len(sample))
    for i, (text, _) in enumerate(sample):
        for f, n in model.found(text).items():
            x[i, model.index[f]] = np.log1p(n)
            held[i] += n * (f in markers)
    steps = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (held > steps[0]) + (held > steps[1]), 0)
    weights, thresholds = fit_cumulative(x, grade)
    # the steps between grades stay; the first is moved to the cut that separates the classes
    return OrdinalModel(model.index, weights, thresholds - thresholds[0] + best_cut(x @ weights, toxic))


def best_cut(latent: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap that separates the classes best, clean rows counting ``CLEAN_COUNTS`` times."""
    levels = np.unique(latent)
    caught = [(latent[toxic == c][:, None] > levels).mean(axis=0) for c in (0, 1)]
    at = int(np.argmax(caught[1] - CLEAN_COUNTS * caught[0]))
    return float(levels[at] + levels[at + 1]) / 2 if at + 1 < len(levels) else float(levels[-1]) + 1


def fit_cumulative(x: np.ndarray, grade: np.ndarray, l2: float = 5e-4, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) of the cumulative-link model by full-batch Adam on the sum of its binary splits."""
    k = max(GRADES, int(grade.max()) + 1) - 1
    above = grade[:, None] > np.arange(k)
    # thresholds are a start and positive steps
    w, start, steps = np.zeros(x.shape[1]), 1.0, np.zeros(k - 1)
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    balance = 1 / (2 * np.bincount((grade > 0).astype(int), minlength=2).clip(1))[(grade > 0).astype(int)]
    for i in range(1, rounds + 1):
        t = start + np.concatenate([[0], np.cumsum(np.exp(steps))])
        p = 1 / (1 + np.exp(np.clip(t - (x @ w)[:, None], -40, 40)))
        e = (p - above) * balance[:, None]
        gt = -e.sum(axis=0)
        g = np.concatenate([x.T @ e.sum(axis=1) + l2 * w, [gt.sum()], np.exp(steps) * np.cumsum(gt[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, start, steps = w - step[: len(w)], start - step[len(w)], steps - step[len(w) + 1 :]
    return w, start + np.concatenate([[0], np.cumsum(np.exp(steps))])


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", columns: tuple[str, str, str] = ("severity", "grade", "toxic")) -> DataFrame:
    """``docs`` with severity (the expected grade), grade (the number of thresholds passed) and toxic (a grade of 1 or more).

    Whole texts are scored; null and empty texts score as texts without words. Repeated rows,
    null ids and extra columns pass through; columns called as ``columns`` says are replaced. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in columns]

    def grade(batches):
        for batch in batches:
            latent = np.array([model.latent(x) for _, part in runs(batch.column(names.index(text_col))) for x in part], dtype=float)
            passed = (latent[:, None] > model.thresholds).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.beyond(latent).sum(axis=1).round(6)), pa.array(passed.astype(np.int32)), pa.array(passed > 0)], names=[*names, *columns])

    rows = docs.select(*names)
    return rows.mapInArrow(grade, StructType([*rows.schema.fields, *[StructField(c, kind) for c, kind in zip(columns, (DoubleType(), IntegerType(), BooleanType()), strict=True)]]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")
