"""Quality of documents by a sparse ensemble of rules.

Boosted trees over statistics of texts give candidate rules: each path from a root to a node is a conjunction of bounds
on statistics. A logistic regression with an L1 penalty on the rules keeps few of them, and what it keeps is compiled into one
Spark column expression over the statistics. Statistics come from the text alone, the whole of it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lapwing.llm.boosting import Boosted, fit_boosted
from lapwing.llm.common import table

#: Labelled ids that the fit uses, per class; one id in so many is held out; a document is good at this score.
SAMPLE, HOLD_OUT, GOOD = 4000, 5, 0.3
#: Trees and their depth; penalties that are tried, as shares of the largest that keeps any rule; folds that choose among them.
TREES, DEPTH, PENALTIES, FOLDS = 24, 3, (0.3, 0.1, 0.03, 0.01, 0.003), 4

#: What is known of a text, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "capitals", "digits", "spaces", "sentence_marks", "other_marks", "beyond_ascii", "shouts", "bars", "hashes",
    "marked_words", "different_words", "commonest_word", "same_as_before", "short_words", "long_words", "log_lines", "line_words", "repeated_lines",
)

_KIND = np.zeros(256, dtype=np.int64)
for _at, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:?", b"!", b"|", b"#<>{}[]\\^~", b"\"$%&'()*+-/=@_`"), start=1):
    _KIND[list(_chars)] = _at
_KIND[128:] = 9
_MARKS = b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~"


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a text, as numbers that a 32-bit float holds; those of an empty text are zeros."""
    words, n = text.split(), max(len(text), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=10)
    m, seen = max(len(words), 1), Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marked = sum(k for w, k in seen.items() if w.rstrip(b".,;:?")[-1:] in _MARKS and len(w.rstrip(b".,;:?")) > 0)
    out = [
        np.log1p(len(text)), np.log1p(len(words)), lengths.sum() / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, (kinds[5:9].sum()) / n, kinds[9] / n, kinds[5] / m, kinds[6] / m, kinds[7] / m,
        marked / m, len(seen) / m, max(seen.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m, (lengths <= 3).sum() / m, (lengths >= 12).sum() / m,
        np.log1p(len(lines)), np.log1p(len(words) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
    ]
    return np.array(out, dtype=np.float32)


@F.pandas_udf(ArrayType(DoubleType()))
def described(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics((t or "").encode()).astype(float).tolist() for t in texts])


#: A rule: bounds (statistic, above, threshold), all of which hold; above means more than the threshold, else at most it.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    """A bias and weighted rules; without rules every document has the same score."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The score as an expression over an array of statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = None
            for at, above, threshold in rule:
                bound = stats[at] > F.lit(float(threshold)) if above else stats[at] <= F.lit(float(threshold))
                holds = bound if holds is None else holds & bound
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def told(self) -> list[str]:
        """The rules in words, heaviest first."""
        bound = lambda b: f"{STATISTICS[b[0]]} {'>' if b[1] else '<='} {b[2]:.4g}"
        return [f"{weight:+.3f} if {' and '.join(map(bound, rule))}" for rule, weight in sorted(self.rules, key=lambda r: -abs(r[1]))]


def paths(trees: Boosted) -> list[Rule]:
    """All paths from a root to a node below it, bounds on one statistic and side drawn together; equal ones once."""
    found: dict[Rule, None] = {}
    inner = trees.feature.shape[1]
    for feature, threshold in zip(trees.feature.tolist(), trees.threshold.tolist(), strict=True):
        bounds: dict[int, dict] = {0: {}}
        for node in range(inner):
            if node not in bounds or not np.isfinite(threshold[node]):
                continue
            for child, above in ((2 * node + 1, False), (2 * node + 2, True)):
                own = dict(bounds[node])
                key, t = (feature[node], above), threshold[node]
                own[key] = (max if above else min)(own.get(key, t), t)
                bounds[child] = own
                found[tuple(sorted((f, a, t) for (f, a), t in own.items()))] = None
    return list(found)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rules hold in which rows."""
    out = np.ones((len(x), len(rules)), dtype=bool)
    for j, rule in enumerate(rules):
        for at, above, threshold in rule:
            out[:, j] &= (x[:, at] > threshold) == above
    return out


def fit_lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic regression with an L1 penalty on all but the bias, by accelerated proximal steps."""
    weight = weight / weight.sum()
    mean = float(np.clip(weight @ y, 1e-4, 1 - 1e-4))
    w, b = np.zeros(a.shape[1]), float(np.log(mean / (1 - mean)))
    wide = np.column_stack([np.ones(len(a)), a]) * np.sqrt(weight)[:, None]
    v = np.ones(wide.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        v = wide.T @ (wide @ v)
        v /= np.linalg.norm(v)
    step = 4 / max(float(np.linalg.norm(wide @ v)) ** 2 * 1.05, 1e-9)
    yw, yb, t = w, b, 1.0
    for _ in range(rounds):
        e = weight * (1 / (1 + np.exp(-np.clip(a @ yw + yb, -40, 40))) - y)
        near, near_b = yw - step * (a.T @ e), yb - step * e.sum()
        near = np.sign(near) * np.maximum(np.abs(near) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = near + (t - 1) / t2 * (near - w), near_b + (t - 1) / t2 * (near_b - b)
        w, b, t = near, near_b, t2
    return b, w


def _loss(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(score, -40, 40))), 1e-6, 1 - 1e-6)
    return float(-(weight @ (y * np.log(p) + (1 - y) * np.log(1 - p))) / weight.sum())


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighed by lasso; the penalty is the largest whose loss on left-out folds is near the least."""
    x = x.astype(np.float32)
    rules = paths(fit_boosted(x, y, weight / weight.mean(), trees=TREES, depth=DEPTH))
    a = holds(rules, x)
    # rules that hold in the same rows are one, and one that always or never holds is none
    first = {c.tobytes(): j for j, c in reversed(list(enumerate(np.packbits(a, axis=0).T))) if 0 < a[:, j].sum() < len(a)}
    kept = sorted(first.values())
    rules, a = [rules[j] for j in kept], a[:, kept].astype(float)
    mean = float(np.clip(weight @ y / weight.sum(), 1e-4, 1 - 1e-4))
    if not rules:
        return RuleModel(float(np.log(mean / (1 - mean))))
    most = float(np.abs(a.T @ (weight / weight.sum() * (mean - y))).max())
    fold = np.arange(len(y)) % FOLDS
    losses = []
    for share in PENALTIES:
        score = np.zeros(len(y))
        for k in range(FOLDS):
            b, w = fit_lasso(a[fold != k], y[fold != k], weight[fold != k], share * most, 200)
            score[fold == k] = a[fold == k] @ w + b
        losses.append(_loss(score, y, weight))
    share = next(s for s, loss in zip(PENALTIES, losses, strict=True) if loss <= min(losses) * 1.02 + 1e-4)
    b, w = fit_lasso(a, y, weight, share * most)
    return RuleModel(b, [(rule, float(v)) for rule, v in zip(rules, w, strict=True) if v != 0])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is never learnt from: the CRC-32 of its text is divisible by ``HOLD_OUT``. Not so for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(HOLD_OUT)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE) -> RuleModel:
    """Fits the ensemble on the labelled ids that are not held out, at most ``per_class`` of each class, those with the least hashes.

    Rows weigh as much as their class has labelled ids in all, so that scores are chances. Of an id's labels the largest counts, of its
    texts the one with the least statistics. Ids alone are ordered, statistics alone reach the driver. With labels of one
    class all scores are near that class, with none they are 0.5.
    """
    graded = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).alias("__good"))
    chosen = [graded.where(F.col("__good") == good).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for good in (False, True)]
    picked = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")  # at most 2 * per_class rows
    found = rows.select("__id", "__good", described("__text").alias("stats")).groupBy("__id").agg(F.min("stats").alias("stats"), F.first("__good").alias("good")).orderBy("__id").collect()
    y = np.array([float(r["good"]) for r in found])
    if not len(y):
        return RuleModel()
    sizes = {r["__good"]: r["n"] for r in graded.groupBy("__good").agg(F.count("*").alias("n")).collect()}
    if len(set(y)) < 2:
        return RuleModel(4.0 if y[0] else -4.0)
    weight = np.array([sizes[bool(v)] / (y == v).sum() for v in y])
    return fit_rules(np.array([r["stats"] for r in found]), y, weight)


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", columns: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for better texts, and predicted, 1 at ``GOOD`` or more, else 0.

    Null texts are empty ones; those are scored like any other. Equal texts have equal scores. Repeated rows, null ids and extra
    columns pass through; columns called as ``columns`` says are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in columns]
    rows = docs.select(*[F.col(c) for c in kept], described(F.col(text_col)).alias("__stats"))
    rows = rows.select(*kept, model.column(F.col("__stats")).alias(columns[0]))
    return rows.select(*kept, columns[0], (F.col(columns[0]) >= GOOD).cast("int").alias(columns[1]))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
