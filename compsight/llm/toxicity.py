"""Toxicity by a counterfactually regularised classifier.

A logistic model over letter n-grams.  In the labelled texts identity terms are
swapped for others of their kind; a change of the score between a text and its
counterfactual is penalised, so that naming a group is no sign of toxicity.

The model is fitted on a bounded sample of labelled rows (``per_class`` of each
class); its n-grams are found in whole texts by one Aho-Corasick pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compsight.llm.rows import add_columns, forget, give_back, text_col
from compsight.llm.sampling import training_labels
from compsight.session import scratch_path

PER_CLASS = 4000
FEATURES = 800
#: Toxic rows of the sample that must hold an n-gram for it to be a feature.
MIN_ROWS = 3
GRAMS = range(4, 8)
#: Different n-grams that a task counts before it hands them on.
HELD_GRAMS = 100_000
RIDGE = 0.3
COUNTERFACTUAL = 20.0

#: Kinds of identity terms: a term is swapped for the next one of its kind.
IDENTITY = [
    ["man", "woman"], ["men", "women"], ["boy", "girl"], ["he", "she"], ["male", "female"],
    ["black", "white", "asian", "latino", "arab"], ["african", "european", "american", "chinese", "mexican", "indian"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"], ["young", "old"], ["disabled", "blind", "deaf"],
    ["immigrant", "native", "refugee"], ["immigrants", "natives", "refugees"],
    ["mann", "frau"], ["männer", "frauen"], ["christ", "moslem", "jude"], ["deutsche", "türken", "polen"],
    ["homme", "femme"], ["hommes", "femmes"], ["chrétien", "musulman", "juif"], ["français", "arabe", "africain"],
    ["hombre", "mujer"], ["hombres", "mujeres"], ["cristiano", "musulmán", "judío"], ["negro", "blanco"],
]
SWAP = {t: kind[(i + 1) % len(kind)] for kind in reversed(IDENTITY) for i, t in enumerate(kind)}
WORD = re.compile(r"[^\W\d_]+")


def counterfactual(text: str) -> str:
    """The lower-cased text with its identity terms swapped."""
    return WORD.sub(lambda m: SWAP.get(m[0], m[0]), text)


def grams_of(text: str) -> set[str]:
    """Letter n-grams of the distinct words of a lower-cased text."""
    out = set()
    for w in set(WORD.findall(text)):
        for n in GRAMS:
            out.update([w[i:i + n] for i in range(len(w) - n + 1)])
    return out


@dataclass
class Model:
    grams: list[str] = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: float

    def automaton(self):
        a = ahocorasick.Automaton()
        for i, g in enumerate(self.grams):
            a.add_word(g, i)
        if self.grams:
            a.make_automaton()
        return a


def found(automaton, text: str) -> list[int]:
    """Sorted features in a lower-cased text; letters only can match, so words need not be cut."""
    return sorted({i for _, i in automaton.iter(text)}) if len(automaton) else []


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, clean) rows of (text, label) rows: a gram comes again after every ``HELD_GRAMS`` of them."""
    clean, toxic = counts = (Counter(), Counter())

    def flushed():
        names = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[g] for g in names], pa.int64()),
             pa.array([clean[g] for g in names], pa.int64())], ["gram", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[y].update(grams_of(t.lower()))
            if len(clean) + len(toxic) >= HELD_GRAMS:
                yield flushed()
    yield flushed()


def select_grams(sample: DataFrame, features: int = FEATURES) -> list[str]:
    """N-grams of more toxic than clean rows that tell most about the label, by the G statistic of their 2 x 2 table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from gram_counts(batches)
        give_back()

    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    total = max(1, pos + neg)

    def part(seen, with_gram, of_class: int):
        """Observed times log of observed over expected, for one cell."""
        seen = F.greatest(seen.cast("double"), F.lit(0.0)) + 0.5
        return seen * F.log(seen * total / ((with_gram.cast("double") + 1) * (of_class + 1)))

    both = F.col("toxic") + F.col("clean")
    g = (part(F.col("toxic"), both, pos) + part(F.col("clean"), both, neg)
         + part(pos - F.col("toxic"), total - both, pos) + part(neg - F.col("clean"), total - both, neg))
    top = (sample.select("text", "label").mapInArrow(count, "gram string, toxic long, clean long")
           .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
           .where(F.col("toxic") >= MIN_ROWS).where(F.col("clean") * (5 * pos) < F.col("toxic") * max(1, neg))
           .select("gram", g.alias("g")).where("g > 3").orderBy(F.desc("g"), "gram").limit(features))
    return [r.gram for r in top.collect()]


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, d: np.ndarray,
          ridge: float = RIDGE, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias: weighted log loss + ridge + penalty * sum of squared score changes ``d @ weights``.

    ``x`` has a last column of ones.  Newton steps; the Hessian is summed over blocks of rows.
    """
    k = x.shape[1]
    fixed = ridge * np.eye(k)
    fixed[-1, -1] = 1e-6
    d = d.astype(float)
    fixed[:-1, :-1] += penalty * (d.T @ d)
    beta = np.zeros(k)

    def scores(v):
        return x @ v.astype(x.dtype) if x.dtype == np.float32 else x @ v

    def loss(v):
        s = scores(v).astype(float)
        return (w * (np.logaddexp(0, s) - y * s)).sum() + 0.5 * v @ fixed @ v

    at = loss(beta)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scores(beta).astype(float), -40, 40)))
        g, h = fixed @ beta, fixed + 1e-9 * np.eye(k)
        for lo in range(0, len(x), 1024):
            s = slice(lo, lo + 1024)
            part = x[s].astype(float)
            g += part.T @ (w[s] * (p[s] - y[s]))
            h += (part * (w[s] * np.maximum(p[s] * (1 - p[s]), 1e-9))[:, None]).T @ part
        step = np.linalg.solve(h, g)
        size = 1.0
        while loss(beta - size * step) > at and size > 1e-6:
            size /= 2
        beta = beta - size * step
        last, at = at, loss(beta)
        if last - at < 1e-6 * max(1.0, abs(at)):
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text",
        id_col: str = "doc_id") -> Model:
    """The model of ``labels.toxic``; rows kept out by ``training_labels`` are not learnt from.

    A sample with one class or none gives a model without features that scores by the
    share of toxic rows (0 without any).
    """
    spark = docs.sparkSession
    chosen, weight = training_labels(labels, "toxic", per_class)
    path = scratch_path(spark, "toxic-sample")
    # About 2 * per_class ids are broadcast, whatever the number of labels.
    (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_col(docs, text).alias("text"))
     .join(F.broadcast(chosen), "doc_id").select("text", "label").write.parquet(path))
    sample = spark.read.parquet(path)
    grams = select_grams(sample) if len(weight) == 2 else []
    model = Model(grams, np.zeros(len(grams)), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            low = [t.lower() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([found(a, t) for t in low], pa.list_(pa.int32())),
                 pa.array([found(a, counterfactual(t)) for t in low], pa.list_(pa.int32())),
                 b.column(1)], ["x", "other", "label"])

    # Feature numbers of the bounded sample, no texts.
    got = sample.select("text", "label").mapInArrow(rows, "x array<int>, other array<int>, label int").collect()
    if not len(got):
        return Model([], np.zeros(0), -20.0)
    x = np.zeros((len(got), len(grams) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, r.x] = 1
    changed = [r for r in got if r.x != r.other]
    d = np.zeros((len(changed), len(grams)), np.float32)
    for i, r in enumerate(changed):
        d[i, r.x] += 1
        d[i, r.other] -= 1
    y = np.array([r.label for r in got], float)
    w = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    model.weights, model.bias = solve(x, y, w / w.mean(), d)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``toxicity double`` from 0 to 1; null and empty texts score as a text without features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``FEATURES`` n-grams at most

    def make():
        forget()
        m = shared.value
        automaton, weights = m.automaton(), m.weights

        def fn(texts):
            s = np.array([m.bias + weights[found(automaton, t.lower())].sum() for t in texts.to_pylist()])
            return [pa.array(1 / (1 + np.exp(-np.clip(s, -40, 40))))]
        return fn
    return add_columns(docs, [text_col(docs, text)], "toxicity double", make)
