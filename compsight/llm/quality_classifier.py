"""Quality by a sparse ensemble of rules.

Statistics of a text feed shallow trees; every path from a root is a rule, a
conjunction of thresholds.  A lasso logistic model picks a few rules and weighs
them, and those are compiled into one Spark column expression over the statistics.

Trees and weights are fitted on a bounded sample of labelled rows (``per_class``).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compsight.llm.quality_rules import repeated_words
from compsight.llm.rows import add_columns, bytes_of, text_col
from compsight.llm.sampling import training_labels
from compsight.session import scratch_path

PER_CLASS = 6000
TREES = 24
DEPTH = 3
LASSO = 0.002
MAX_RULES = 60
SEED = 7

STATS = ("log_words", "word_length", "distinct_share", "symbol_share", "upper_share", "digit_share",
         "mark_share", "repeat_share", "echo_share", "dup_line_share", "line_words", "long_share")


def _without(chars: bytes) -> bytes:
    return bytes(b for b in range(256) if b not in chars)


UPPER, LOWER, DIGIT = (_without(bytes(range(lo, hi))) for lo, hi in ((65, 91), (97, 123), (48, 58)))
SYMBOL, MARK, HIGH = _without(b"#*$%&|<>{}[]@^~_=\\/"), _without(b".,;:!?'\"()-"), _without(bytes(range(192, 256)))


def statistics(raw: bytes) -> tuple[float, ...]:
    """The values of ``STATS`` for one text in UTF-8; shares of nothing are 0."""
    from math import log1p
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return (0.0,) * len(STATS)
    up, low = len(raw.translate(None, UPPER)), len(raw.translate(None, LOWER))
    letters = up + low + len(raw.translate(None, HIGH))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    return (log1p(n), sum(lengths) / n, len(set(words)) / n, len(raw.translate(None, SYMBOL)) / size,
            up / max(1, letters), len(raw.translate(None, DIGIT)) / size, len(raw.translate(None, MARK)) / size,
            repeated_words(words) / n, sum(map(operator.eq, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines), n / len(lines), sum([x > 20 for x in lengths]) / n)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the columns ``STATS`` (doubles); null texts are empty."""
    def make():
        def fn(texts):
            return [pa.array(c, pa.float64()) for c in zip(*[statistics(r) for r in bytes_of(texts)])]
        return fn
    return add_columns(docs, [text_col(docs, text)], ", ".join(f"{s} double" for s in STATS), make)


#: A condition: (statistic, is it "greater than", threshold).
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    rules: list[tuple[tuple[Condition, ...], float]]
    bias: float

    def column(self) -> Column:
        """The probability as an expression over the statistics."""
        logit = F.lit(self.bias)
        for rule, weight in self.rules:
            logit = logit + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    parts = [F.col(s) > t if more else F.col(s) <= t for s, more, t in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


CONDITION = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)$")


def tree_rules(description: str) -> list[tuple[Condition, ...]]:
    """All root paths of a forest's printed trees, each once; conditions on one statistic are merged."""
    rules: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.split("\n"):
        m = CONDITION.match(line)
        if not m:
            if "Tree " in line:
                path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATS[int(m[2])], m[3] == ">", float(m[4]))))
        tight: dict[tuple[str, bool], float] = {}
        for _, (s, more, t) in path:
            old = tight.get((s, more), t)
            tight[s, more] = max(old, t) if more else min(old, t)
        rules[tuple(sorted((s, more, t) for (s, more), t in tight.items()))] = None
    return list(rules)


def fit(stats: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleModel:
    """Rules for ``labels.quality`` from the statistics of rows with a ``doc_id``.

    Fewer than two classes in the sample give a model without rules: 1 or 0 for the
    class there is, and 0.5 without any.
    """
    spark = stats.sparkSession
    chosen, weight = training_labels(labels, "quality", per_class)
    if len(weight) < 2:
        return RuleModel([], 0.0 if not weight else (10.0 if 1 in weight else -10.0))
    path = scratch_path(spark, "quality-sample")
    w = F.when(F.col("label") == 1, float(weight[1])).otherwise(float(weight[0]))
    # About 2 * per_class ids are broadcast, whatever the number of labels.
    (stats.select("doc_id", *STATS).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATS, "label").coalesce(1)
     .select(*STATS, F.col("label").cast("double").alias("label"), w.alias("weight")).write.parquet(path))
    sample = spark.read.parquet(path)
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", weightCol="weight", numTrees=TREES,
                                    maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=SEED)
    rows = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(sample)
    rules = tree_rules(forest.fit(rows).toDebugString)
    if not rules:
        return RuleModel([], 0.0)
    flags = sample.select("label", "weight", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(flags)
    flags = flags.select("x", "label", "weight")

    def lasso(penalty: float) -> tuple[list[float], float]:
        m = LogisticRegression(labelCol="label", featuresCol="x", weightCol="weight", elasticNetParam=1.0,
                               regParam=penalty, standardization=True, maxIter=100).fit(flags)
        return m.coefficients.toArray().tolist(), float(m.intercept)

    coefficients, intercept = sparse_enough(lasso)
    kept = sorted(((abs(v), i, v) for i, v in enumerate(coefficients) if v), reverse=True)
    return RuleModel([(rules[i], v) for _, i, v in kept], intercept)


def sparse_enough(fit: Callable[[float], tuple[list[float], float]]) -> tuple[list[float], float]:
    """Coefficients and intercept of one fit: the first of growing penalties that leaves at most ``MAX_RULES`` rules."""
    penalty = LASSO
    while True:
        coefficients, intercept = fit(penalty)
        if sum(v != 0 for v in coefficients) <= MAX_RULES:
            return coefficients, intercept
        penalty *= 1.25


def score(stats: DataFrame, model: RuleModel) -> DataFrame:
    """``stats`` plus ``quality double`` from 0 to 1, by the compiled expression."""
    return stats.withColumn("quality", model.column())
