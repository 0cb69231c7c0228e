"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over words. A later model also sees the
probabilities of the earlier categories; in training those are out-of-fold predictions, so that they
are as unsure as they will be on new text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, written
from .textkit import Bytes, byte_view, letter_words, portions

#: Category and its 0/1 label as SQL over the labels table, in the chain's order.
CATEGORIES: Mapping[str, str] = {"low_quality": "1 - quality", "toxic": "toxic"}
#: Bounds of the fit: labelled rows (by a hash of the key), words kept for each category.
TRAIN_ROWS, WORDS = 12000, 250
FOLDS, RIDGE, LEAST_ROWS = 3, 0.3, 3
#: What stands for no fold in place of one that is left out.
WHOLE = -1


@dataclass
class Chain:
    names: list[str]
    words: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # bias, words, earlier categories
    limits: list[float]

    def features(self, view: Bytes) -> np.ndarray:
        """[text, word]: 1 where the text has the word."""
        rows, found = present(view, self.words)
        out = np.zeros((len(view), len(self.words)), np.float32)
        out[rows, found] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, probability(np.column_stack([x, out]), w)])
        return out


def present(view: Bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = letter_words(view)
    if not len(w.starts) or not len(known):
        return np.zeros(0, int), np.zeros(0, int)
    h = w.hashes()
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    return w.rows[hit], at[hit]


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x]).astype(np.float64)
    w = np.zeros(a.shape[1])
    shrink = np.full(a.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(shrink), a.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, columns: Mapping[int, np.ndarray] | None = None) -> tuple[list[np.ndarray], list[float]]:
    """Weights of each category's model and the limits with the best out-of-fold F1.

    ``columns``: the words that the models may use, chosen without each fold's rows, and under WHOLE by all
    rows; by default all words. What a fold is predicted by has thus not seen its labels in any way.
    """
    weights, limits, earlier = [], [], np.zeros((len(x), 0))

    def fitted(rows: np.ndarray, chosen: np.ndarray, y: np.ndarray) -> np.ndarray:
        w = fit(np.column_stack([x[rows][:, chosen], earlier[rows]]), y[rows])
        out = np.zeros(1 + x.shape[1] + earlier.shape[1])
        out[0], out[1 + np.flatnonzero(chosen)], out[1 + x.shape[1] :] = w[0], w[1 : 1 + chosen.sum()], w[1 + chosen.sum() :]
        return out

    every = {f: np.ones(x.shape[1], bool) for f in [WHOLE, *np.unique(folds).tolist()]}
    columns = columns or every
    for k in range(labels.shape[1]):
        y = labels[:, k]
        unseen = np.full(len(y), y.mean() if len(y) else 0.0)
        for f in np.unique(folds).tolist():
            test = folds == f
            if not test.all():
                w = fitted(~test, columns[f], y)
                unseen[test] = probability(np.column_stack([x[test], earlier[test]]), w)
        weights.append(fitted(np.ones(len(x), bool), columns[WHOLE], y) if len(y) else np.zeros(1 + x.shape[1] + k))
        grid = np.linspace(0.1, 0.9, 33)
        f1 = [2 * (y * (unseen >= g)).sum() / max(1, y.sum() + (unseen >= g).sum()) for g in grid]
        near = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        limits.append(float(grid[near[len(near) // 2]]))
        earlier = np.column_stack([earlier, unseen])
    return weights, limits


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(folds)).cast("int")


def train(docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, words: int = WORDS) -> Chain:
    """A chain from at most about ``rows`` labelled texts.

    A key labelled twice counts as in the category if any row says so; rows with a null label or key are
    left out. The bounded sample is read from the texts once and written. Its words are counted in Spark by
    fold and label; for each fold the ``words`` words of each category with the greatest chi-square over the
    other folds are chosen, and over all folds for the final models. The driver fits on the 0/1 matrix.
    """
    bounded_batches(docs.sparkSession)
    names = list(categories)
    said = labels.select(F.col(key).cast("long").alias("key"), *[F.expr(sql).cast("int").alias(n) for n, sql in categories.items()]).dropna()
    said = said.groupBy("key").agg(*[F.max(n).alias(n) for n in names])
    share = min(1.0, rows / max(1, said.count()))
    said = said.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(said), "key")
    sample = written(sample.select("key", "text", fold_of(F.col("key")).alias("fold"), *names), "labelled")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                w = letter_words(byte_view(batch.column(1)))
                pairs = pd.DataFrame({"row": w.rows, "word": w.hashes()}).drop_duplicates()
                at = pa.array(pairs["row"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(pairs["word"].to_numpy().view(np.int64)), *(c.take(at) for c in batch.columns[2:])], names=["word", "fold", *names])

    kinds = ", ".join(f"{n} int" for n in ("fold", *names))
    sizes = {r.fold: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).collect()}
    if not sizes:
        return Chain(names, np.zeros(0, np.uint64), [np.zeros(1 + i) - 30 * (np.arange(1 + i) == 0) for i in range(len(names))], [0.5] * len(names))
    within = lambda c, f: F.sum(F.when(F.col("fold") != f, c).otherwise(0))
    sums = [within(F.col(n) if n else F.lit(1), f).alias(f"{n or 'df'}_{f}") for f in (WHOLE, *sorted(sizes)) for n in ("", *names)]
    counts = written(sample.mapInArrow(distinct, f"word long, {kinds}").groupBy("word").agg(*sums).where(F.col(f"df_{WHOLE}") >= LEAST_ROWS), "words")
    best: dict[int, set[int]] = {}
    for f in (WHOLE, *sorted(sizes)):
        others = [r for k, r in sizes.items() if k != f]
        total = sum(r["n"] for r in others)
        best[f] = set()
        for n in names if total else []:
            rate = sum(r[n] for r in others) / total
            df, hit = F.col(f"df_{f}"), F.col(f"{n}_{f}")
            want = df * F.lit(rate)
            gain = (hit - want) * (hit - want) / (want * F.lit(1 - rate) + F.lit(1.0))
            best[f] |= {r[0] for r in counts.where(df >= LEAST_ROWS).orderBy(gain.desc(), "word").limit(words).collect()}
    known = np.sort(np.array(sorted(set().union(*best.values())), np.int64).view(np.uint64))
    columns = {f: np.isin(known, np.array(sorted(b), np.int64).view(np.uint64)) for f, b in best.items()}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                where, found = present(byte_view(batch.column(1)), known)
                lists: list[list[int]] = [[] for _ in range(batch.num_rows)]
                for r, f in sorted(set(zip(where.tolist(), found.tolist(), strict=True))):
                    lists[r].append(f)
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(lists, pa.list_(pa.int32()))], names=["key", "fold", *names, "found"])

    table = sample.mapInArrow(rows_of, f"key long, {kinds}, found array<int>").toPandas().sort_values(["key", "fold", *names], kind="stable")
    x = np.zeros((len(table), len(known)), np.uint8)
    for i, f in enumerate(table.found):
        x[i, f] = 1
    weights, limits = fit_chain(x, table[names].to_numpy(np.float64), table.fold.to_numpy(), columns)
    used = columns[WHOLE]
    weights = [np.concatenate([w[:1], w[1 : 1 + len(known)][used], w[1 + len(known) :]]) for w in weights]
    return Chain(names, known[used], weights, limits)


def classifier_chain(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each category's probability and verdict for every whole text, in one pass without a shuffle.

    Columns: the key, p_<category> and <category> of each category, and kept (false where the last
    category is predicted). A null or empty text has no words and gets the base probabilities; rows are
    judged alone; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    columns = ["key", *[c for n in chain.names for c in (f"p_{n}", n)], "kept"]
    schema = "key long, " + ", ".join(f"p_{n} double, {n} boolean" for n in chain.names) + ", kept boolean"

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in portions(whole, "text"):
                p = own.probabilities(own.features(byte_view(batch.column(1))))
                flags = p >= np.array(own.limits)
                arrays = [a for i in range(len(own.names)) for a in (pa.array(p[:, i]), pa.array(flags[:, i]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(~flags[:, -1])], names=columns)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(judged, schema).withColumnRenamed("key", key)
