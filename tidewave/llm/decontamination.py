"""Benchmark decontamination.

All n-grams of a test item are seeds. Where a text has a seed of an item, the passage around it is
aligned with the item by Smith-Waterman over tokens, which scores copies with words changed, dropped or
put in. Passages with too few of the item's tokens to reach the score are not aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fits, mounted_folder
from .textkit import IS_TOKEN, Bytes, byte_view, pair_hash, portions, words

#: Tokens in a seed.
SEED = 3
#: Least score by the item's tokens (match 1, else -1), and least matches of a short item.
LEAST_SHARE, LEAST_SCORE = 0.4, 8
#: Items in a block of the index.
BLOCK = 20000
#: Passages aligned at a time, and their tokens with padding (one passage at least).
PASSAGES, TOKENS = 256, 1 << 18


def grams(h: np.ndarray, rows: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text, and where they begin."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    out = h[:m]
    for i in range(1, n):
        out = pair_hash(out, h[i : m + i])
    at = np.flatnonzero(rows[n - 1 :] == rows[:m])
    return out[at], at


class Items:
    """A block of test items: their tokens and seeds, all of them arrays."""

    ARRAYS = ("ids", "hashes", "first", "sizes", "seeds", "item", "place", "vocabulary")

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(byte_view(pa.array(texts, pa.large_string())), within=IS_TOKEN)
        self.ids, self.hashes, self.first = np.array(ids, np.int64), w.hashes, w.first
        # the n-grams of every item; one with fewer tokens is a single shorter one
        length = np.diff(w.first)
        parts = []
        for n in range(1, SEED + 1):
            own = length >= SEED if n == SEED else length == n
            h, at = grams(w.hashes, w.rows, n)
            kept = own[w.rows[at]]
            parts.append((h[kept], at[kept]))
        hashes, at = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.sizes = np.unique(np.minimum(length[length > 0], SEED))
        order = np.argsort(hashes, kind="stable")
        row = w.rows[at[order]]
        self.seeds, self.item, self.place = hashes[order], row, at[order] - w.first[row]
        self.vocabulary = np.unique(pair_hash(np.repeat(np.arange(len(ids), dtype=np.uint64), length), w.hashes))

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, a).nbytes for a in self.ARRAYS)

    def save(self, folder: str) -> None:
        for a in self.ARRAYS:
            np.save(f"{folder}.{a}.npy", getattr(self, a))

    @classmethod
    def load(cls, folder: str) -> Items:
        """The block as memory-mapped arrays."""
        out = cls.__new__(cls)
        for a in cls.ARRAYS:
            setattr(out, a, np.load(f"{folder}.{a}.npy", mmap_mode="r"))
        return out

    def found(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a seed, place in the texts) of every seed that occurs."""
        seeds, places = [], []
        for n in self.sizes.tolist():
            g, at = grams(h, rows, n)
            lo = np.searchsorted(self.seeds, g, "left")
            hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == g) if len(self.seeds) else np.zeros(0, int)
            times = np.searchsorted(self.seeds, g[hit], "right") - lo[hit]
            back = np.repeat(np.arange(len(hit)), times)
            seeds.append(lo[hit][back] + np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times))
            places.append(at[hit][back])
        return (np.concatenate(seeds), np.concatenate(places)) if seeds else (np.zeros(0, int), np.zeros(0, int))

    def shared(self, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Tokens of each passage that its item has: no alignment scores more."""
        out = np.zeros(len(item), np.int64)
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            size = (hi - lo)[a:b]
            at = np.arange(size.sum()) + np.repeat(lo[a:b] - np.cumsum(size) + size, size)
            pairs = pair_hash(np.repeat(item[a:b].astype(np.uint64), size), h[at])
            known = self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, pairs), len(self.vocabulary) - 1)] == pairs
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), size), known, b - a)
            a = b
        return out

    def hits(self, view: Bytes) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score by the item's tokens, first and end token) of the best passage of each
        text and item that scores enough."""
        w = words(view, within=IS_TOKEN)
        seed, place = self.found(w.hashes, w.rows)
        if not len(seed):
            return []
        item, row = self.item[seed], w.rows[place]
        length = np.diff(self.first)
        begin = place - self.place[seed]
        order = np.lexsort((begin, item, row))
        item, row, begin = item[order], row[order], begin[order]
        # seeds of one item closer than the item's length belong to one passage
        new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > length[item[1:]])]
        head = np.flatnonzero(new)
        last = np.r_[head[1:], len(new)] - 1
        slack = length[item[head]] // 4 + 2
        lo = np.maximum(w.first[row[head]], begin[head] - slack)
        hi = np.minimum(w.first[row[head] + 1], begin[last] + length[item[head]] + slack)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        least = np.maximum(LEAST_SHARE * length[item[head]], np.minimum(length[item[head]], LEAST_SCORE))
        may = np.flatnonzero(self.shared(w.hashes, item[head], lo, hi) >= least)
        by_size = may[np.argsort((hi - lo)[may], kind="stable")]
        at = 0
        while at < len(by_size):
            wide = (hi - lo)[by_size[at : at + PASSAGES]]
            some = by_size[at : at + max(1, int((wide * np.arange(1, len(wide) + 1) <= TOKENS).sum()))]
            at += len(some)
            a = [self.hashes[self.first[i] : self.first[i + 1]] for i in item[head[some]]]
            b = [w.hashes[x:y] for x, y in zip(lo[some], hi[some], strict=True)]
            score, end = align(a, b)
            good = np.flatnonzero(score >= least[some])
            _, rest = align([a[g][::-1] for g in good], [b[g][: end[g]][::-1] for g in good])
            for g, r in zip(good, rest, strict=True):
                k = head[some[g]]
                base = lo[some[g]] - w.first[row[k]]
                new_one = (float(score[g] / length[item[k]]), int(base + end[g] - r), int(base + end[g]))
                if new_one > best.get((int(row[k]), int(item[k])), (0.0, 0, 0)):
                    best[int(row[k]), int(item[k])] = new_one
        return [(r, int(self.ids[i]), *v) for (r, i), v in sorted(best.items())]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each pair (match 1, mismatch and gap -1) and where it ends in b."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, n = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), m), np.uint64), np.ones((len(b), n), np.uint64)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, : len(p)], y[i, : len(q)] = p, q
    slope = np.arange(1, n + 1, dtype=np.int32)
    h = np.zeros((len(a), n + 1), np.int32)
    best, end = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    for i in range(m):
        now = h[:, :-1] + np.where(x[:, i, None] == y, 1, -1)
        np.maximum(now, h[:, 1:] - 1, out=now)
        np.maximum(now, 0, out=now)
        h[:, 1:] = np.maximum.accumulate(now + slope, axis=1) - slope
        top = h.argmax(axis=1)
        value = h[np.arange(len(a)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[Items]:
    """The items, ``size`` at a time."""
    bounded_batches(benchmark.sparkSession)
    part: list = []
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), F.col(text))
    for r in rows.toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield Items([r[0] for r in part], [r[1] for r in part])
            part = []
    if part:
        yield Items([r[0] for r in part], [r[1] for r in part])


class Index:
    """All test items in blocks: sent along where they are small, else memory-mapped from the shared folder."""

    def __init__(self, benchmark: DataFrame, item: str, text: str, block: int):
        self.held: list[Items] = []
        self.saved: list[str] = []
        folder = None
        for n, items in enumerate(blocks(benchmark, item, text, block)):
            self.held.append(items)
            if folder is None and not fits(sum(x.nbytes for x in self.held)):
                folder = mounted_folder(benchmark.sparkSession, "items")
            if folder is not None:
                for x in self.held:
                    self.saved.append(f"{folder}/{n}-{len(self.saved)}")
                    x.save(self.saved[-1])
                self.held = []

    def hits(self, view: Bytes) -> list[tuple[int, int, float, int, int]]:
        """The hits of every block, by text."""
        if self.saved and not self.held:  # in a worker
            self.held = [Items.load(x) for x in self.saved]
        return sorted(h for items in self.held for h in items.hits(view))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each text and test item that it holds: the key, item, score (1: an exact copy), and
    the passage's first and end token (runs of letters and digits, lower-cased).

    The corpus is read once, whatever the number of items, and no text is shuffled. Null and empty
    texts or items match nothing; equal items each give rows, and repeated rows repeat; an item with fewer
    tokens than a seed marks every text that has them; without items or texts there are no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Index(benchmark, item, text, block))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for whole in batches:
            for batch in portions(whole, "text"):
                hits = sent.value.hits(byte_view(batch.column(1)))
                keys = batch.column(0).to_pylist()
                columns = [pa.array([keys[h[0]] for h in hits], pa.int64()), *(pa.array([h[i] for h in hits], t) for i, t in enumerate(kinds, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "score", "first_token", "end_token"])

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(aligned, "key long, item long, score double, first_token long, end_token long")
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "score", "first_token", "end_token")


def decontaminated(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item: one pass, as ``contaminated``."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(benchmark, item, text, block))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, text):
                hit = {h[0] for h in sent.value.hits(byte_view(batch.column(batch.schema.names.index(text))))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
