"""Text quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins; boosting goes round the features and fits a shallow tree to the rest each
time, with a small step, so that no feature takes what belongs to another. The pairs whose joint tables explain most of
what is left are then boosted in the same way. A text's score is a sum of table entries, one for each feature and pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col
from tidemark.llm.toxicity import training_fold

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "mark", "symbol", "blank", "beyond_ascii", "word_length", "distinct_words",
    "top_word", "repeated_next", "symbol_words", "bare_marks", "repeated_lines", "sentence_ends",
)
MARKS = b".,;:!?'\"()-"
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_IS_MARK, _IS_SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True
_IS_SYMBOL[list(SYMBOLS)] = True


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; null counts as empty, whose shares are all 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
    words = raw.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ends = {bytes([c]) for c in SYMBOLS} | {b"!!"}
    odd = sum(k for word, k in counts.items() if word[-1:] in ends or word[-2:] in ends)
    bare = sum(k for word, k in counts.items() if not word.strip(MARKS + SYMBOLS))
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), seen[65:91].sum() / letters, seen[48:58].sum() / n, seen[_IS_MARK].sum() / n,
        seen[_IS_SYMBOL].sum() / n, seen[[9, 10, 11, 12, 13, 32]].sum() / n, seen[128:].sum() / n, len(raw) / w, len(counts) / w,
        max(counts.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w, odd / w, bare / w,
        1 - len(set(lines)) / max(len(lines), 1), seen[46] / w,
    ])


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges between about equally filled bins of each column; equal values share a bin."""
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def place(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1).astype(np.int32)


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return -g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values for each bin of a tree over ordered bins: the best next cut is made until there are ``leaves`` leaves."""
    cuts = [0, len(g)]
    score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - score(a, b)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table into four quadrants: (gain over no cut, values). ``g`` and ``h`` are sums for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    r, rh = cg[:-1, -1:], ch[:-1, -1:]
    c, chh = cg[-1:, :-1], ch[-1:, :-1]
    if a.size == 0:
        return 0.0, np.zeros_like(g)
    parts = ((a, b), (r - a, rh - b), (c - a, chh - b), (tg - r - c + a, th - rh - chh + b))
    gain = sum(x**2 / (y + ridge) for x, y in parts) - tg**2 / (th + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [_leaf(x[i, j], y[i, j], ridge) for x, y in parts]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: the sum of one entry of each table."""
        total = np.full(len(x), self.intercept)
        if len(x) and self.tables:
            fine, rough = place(x, self.edges), place(x, self.coarse)
            for f, t in enumerate(self.tables):
                total += t[fine[:, f]]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                total += t[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-total))


def train(
    x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 10,
    leaves: int = 3, rate: float = 0.1, ridge: float = 5.0,
) -> Model:
    """Cyclic boosting of the tables with Newton steps on the logistic loss. Without both labels the score is constant."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return Model(intercept, [], [], [], [], [])
    edges, coarse = bin_edges(x, bins), bin_edges(x, pair_bins)
    fine, rough = place(x, edges), place(x, coarse)
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)
    for _ in range(rounds):
        for f, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(fine[:, f], weights=p - y, minlength=len(table))
            h = np.bincount(fine[:, f], weights=p * (1 - p), minlength=len(table))
            step = rate * shallow_tree(g, h, leaves, ridge)
            table += step
            total += step[fine[:, f]]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(rough[:, a] * shape[1] + rough[:, b], weights=values, minlength=shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    gains = {
        (a, b): quadrants(cells(a, b, p - y), cells(a, b, p * (1 - p)), ridge)[0]
        for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])
    }
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    joint = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), table in zip(chosen, joint):
            p = 1 / (1 + np.exp(-total))
            step = rate * quadrants(cells(a, b, p - y), cells(a, b, p * (1 - p)), ridge)[1]
            table += step
            total += step[rough[:, a], rough[:, b]]
    return Model(intercept, edges, tables, coarse, chosen, joint)


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_rows: int = 40_000, **options) -> Model:
    """Learn ``label`` (1 if above 0) from at most about ``max_rows`` labelled rows, chosen by a hash of their id.

    Rows without a label teach nothing; equal rows of features and label count as often as they occur.
    """
    known = labels.filter(col(label).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label)).alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2**31)) < int(max_rows / total * 2**31))
    # max_rows bounds the labels, so they may be broadcast.
    rows = docs.select(col(id_col).alias("id"), col(text).alias("text")).join(F.broadcast(known), "id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": (batch["y"] > 0).astype("int32"), "x": list(_matrix(batch["text"]))})

    table = rows.select("id", "text", "y").mapInPandas(measured, "id long, y int, x array<double>").orderBy("id", "x").toPandas()
    x = np.array(table["x"].tolist()).reshape(-1, len(FEATURES))
    return train(x, table["y"].to_numpy(np.float64), **options)


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_matrix(texts)))

    return of(text)


def mark_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", folds: int = 5, threshold: float = 0.3, **options
) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    The model is fitted on the rows that are not held out. Repeated rows, null and empty texts and null ids are scored like
    any other row; an empty table gives no rows, and without both labels all texts get one score. Input columns stay, but
    results replace columns of their names.
    """
    model = fit(*training_fold(docs, labels, id_col, folds), text=text, id_col=id_col, **options)
    kept = [col(c) for c in docs.columns if c not in ("held_out", "score", "predicted")]
    held = F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    scored = docs.select(*kept, held.alias("held_out"), score(model, col(text)).alias("score"))
    return scored.withColumn("predicted", (col("score") >= threshold).cast("int"))
