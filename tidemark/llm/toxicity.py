"""Toxic text by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are needed. With class prior p, the risk of a scorer f is
p * E_pos[loss(f, +)] + max(0, E_all[loss(f, -)] - p * E_pos[loss(f, -)]); the second term corrects for the toxic
share of the unlabelled text and is kept from turning negative, which is where a flexible model would overfit.
The scorer adds the weights of the distinct terms of a text (words and their beginnings), chosen by how much more often
they occur in toxic examples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fold

EDGES = ".,;:!?\"'()[]{}<>|$%&*#@~`^_-+=/\\…«»„“”¡¿"
PREFIXES = (3, 4, 5, 6)
#: Words remembered per Python worker before the memory starts anew.
REMEMBERED = 150_000
#: Counted terms that a Python worker holds before it hands them on.
HELD_TERMS = 200_000


def terms_of(word: str) -> list[str]:
    """The word itself (marked by a full stop) and its beginnings."""
    word = word.strip(EDGES)
    if not word:
        return []
    return [word + "."] + [word[:n] for n in PREFIXES if len(word) >= n]


def text_terms(text: str | None) -> set[str]:
    return {t for w in set((text or "").lower().split()) for t in terms_of(w)}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def scores(self, texts: pd.Series, memory: dict[str, tuple]) -> np.ndarray:
        out = np.empty(len(texts))
        weights = self.weights
        for i, text in enumerate(texts):
            found = set()
            for w in set((text or "").lower().split()):
                hit = memory.get(w)
                if hit is None:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    hit = memory[w] = tuple(t for t in terms_of(w) if t in weights)
                if hit:
                    found.update(hit)
            out[i] = self.bias + sum(weights[t] for t in sorted(found))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _sample(docs: DataFrame, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, chosen by a hash of the text, so equal runs choose equally."""
    if total <= wanted:
        return docs
    cut = int(wanted / total * 2**31)
    return docs.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(2**31)) < cut)


def training_rows(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, max_positive: int, max_unlabelled: int):
    """(rows text, positive; class prior). Positives: texts of confirmed rows; the others: any text, labels unseen.

    The prior is the toxic share of the labelled rows. Equal texts count once.
    """
    known = labels.filter(col(label).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label)).alias("y"))
    counts = known.agg(F.count("*").alias("n"), F.sum((col("y") > 0).cast("long")).alias("pos")).first()
    n, pos = counts["n"], counts["pos"] or 0
    toxic = known.filter(col("y") > 0).select("id")
    if pos > max_positive:
        toxic = toxic.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2**31)) < int(max_positive / pos * 2**31))
    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    # max_positive bounds the ids, so they may be broadcast.
    positive = base.join(F.broadcast(toxic), "id", "left_semi").select("text", F.lit(True).alias("positive"))
    unlabelled = _sample(base, max_unlabelled, base.count()).select("text", F.lit(False).alias("positive"))
    rows = positive.unionByName(unlabelled).dropDuplicates(["text", "positive"])
    return rows, min(max(pos / n if n else 0.0, 1e-3), 0.9)


def choose_terms(rows: DataFrame, prior: float, min_rows: int, min_z: float, min_posterior: float, max_terms: int) -> list[str]:
    """Terms that occur in clearly more positive than unlabelled texts, the clearest first, ties by name.

    prior * share among positives / share among all is the chance that a text with the term is toxic; words that are
    merely commoner in toxic texts, because these are longer, stay below ``min_posterior``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, positive in zip(batch["text"], batch["positive"]):
                seen[bool(positive)].update(text_terms(text))
            if len(seen[True]) + len(seen[False]) > HELD_TERMS:
                yield from _counted(seen)
                seen = {True: Counter(), False: Counter()}
        yield from _counted(seen)

    totals = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    p, u = totals.get(True, 0), totals.get(False, 0)
    if not p or not u:
        return []
    sums = rows.mapInPandas(count, "term string, p long, u long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = col("p") / p, col("u") / u
    pooled = (col("p") + col("u")) / (p + u)
    z = (share_p - share_u) / F.sqrt(pooled * (1 - pooled) * (1 / p + 1 / u) + 1e-12)
    telling = (col("p") >= min_rows) & (prior * share_p >= min_posterior * share_u) & (z >= min_z)
    best = sums.withColumn("z", z).filter(telling)
    return [r["term"] for r in best.orderBy(col("z").desc(), "term").limit(max_terms).select("term").collect()]


def _counted(seen: dict[bool, Counter]) -> Iterator[pd.DataFrame]:
    names = list(seen[True].keys() | seen[False].keys())
    yield pd.DataFrame(
        {"term": pd.Series(names, dtype=str), "p": [seen[True][t] for t in names], "u": [seen[False][t] for t in names]}
    ).astype({"p": "int64", "u": "int64"})


def _sums(index: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[index])])
    return total[starts[1:]] - total[starts[:-1]]


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.concatenate([*rows, np.zeros(0)]).astype(np.int64), starts


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], terms: int, prior: float,
    steps: int = 400, rate: float = 0.05, l2: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss. Rows are arrays of term numbers.

    Each step sees all rows, so that the correction of the negative risk is not lost in the noise of small batches. A term
    never speaks against toxicity, and a text without known terms is no likelier toxic than the prior.
    """
    w = np.zeros(terms + 1)
    w[-1] = ceiling = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    (ip, sp), (iu, su) = _packed(positive), _packed(unlabelled)

    def gradient(index, starts, d):
        g = np.bincount(index, weights=np.repeat(d, np.diff(starts)), minlength=terms + 1)
        g[-1] += d.sum()
        return g / len(d)

    for step in range(1, steps + 1):
        fp, fu = _sums(ip, sp, w) + w[-1], _sums(iu, su, w) + w[-1]
        toxic_p, toxic_u = 1 / (1 + np.exp(-np.clip(fp, -500, 500))), 1 / (1 + np.exp(-np.clip(fu, -500, 500)))
        g = prior * gradient(ip, sp, toxic_p - 1)
        if np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() > 0:
            g += gradient(iu, su, toxic_u) - prior * gradient(ip, sp, toxic_p)
        g[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
        w[-1] = min(w[-1], ceiling)
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
    max_positive: int = 8_000, max_unlabelled: int = 24_000, max_terms: int = 4_096, min_rows: int = 5, min_z: float = 4.0,
    min_posterior: float = 0.6, prior: float | None = None,
) -> Model:
    """Learn from the rows of ``docs``; only ``labels`` equal to 1 teach.

    The class prior is the share of ones among the labelled rows if it is not given. The fit sees at most about ``max_positive`` confirmed and ``max_unlabelled`` other texts and keeps ``max_terms`` terms;
    these bounds hold at any size of the tables. Without positive rows the model scores every text with the prior.
    """
    rows, share = training_rows(docs, labels, text, id_col, label, max_positive, max_unlabelled)
    prior = share if prior is None else prior
    terms = choose_terms(rows, prior, min_rows, min_z, min_posterior, max_terms)
    if not terms:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    number = {t: i for i, t in enumerate(terms)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(number[t] for t in text_terms(x) if t in number) for x in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "terms": found})

    table = rows.mapInPandas(numbered, "positive boolean, terms array<int>").orderBy("positive", F.hash("terms"), "terms").toPandas()
    split = [[np.asarray(t, np.int64) for t in table.loc[table["positive"] == side, "terms"]] for side in (True, False)]
    weights, bias = train(split[0], split[1], len(terms), prior)
    return Model(dict(zip(terms, weights.tolist())), bias, prior)


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic. Null counts as empty; a text without known terms gets the model's base value."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, tuple] = {}
        for texts in batches:
            yield pd.Series(model.scores(texts, memory))

    return of(text)


def training_fold(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both tables without the held-out rows, those whose crc32 of the id as text is divisible by ``folds``."""
    return docs.filter(fold(col(id_col), folds) != 0), labels.filter(fold(col(id_col), folds) != 0)


def mark_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 5, **options) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    The model is fitted on the rows that are not held out. Repeated rows, null texts and null ids are scored like any other
    row (a null id is never held out nor labelled); an empty table gives no rows. Input columns stay, but results replace
    columns of their names.
    """
    model = fit(*training_fold(docs, labels, id_col, folds), text=text, id_col=id_col, **options)
    kept = [col(c) for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*kept, (fold(col(id_col), folds) == 0).alias("held_out"), score(model, col(text)).alias("score"))
    return scored.withColumn("predicted", (col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`mark_toxic` predicts 0 for, unchanged."""
    model = fit(*training_fold(docs, labels, id_col, folds), text=text, id_col=id_col, **options)
    return docs.filter(score(model, col(text)) < 0.5)
