"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Tasks count the n-grams of their texts, merge the counts of a hash bucket and write each bucket as
sorted arrays into the cluster's shared folder; workers memory-map these to score texts, so the model's
size is bounded by the folder, not by anyone's memory. Words are known by 64-bit hashes; a bigram by the
upper halves of its words' hashes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, mounted_folder
from .textkit import Bytes, Words, byte_view, mix, portions, words

U64, U32 = np.uint64, np.uint32
START, END = U64(0x51A7D3E94B20C86F), U64(0xE3779B185EBCA871)
#: Least buckets, those (as a power of two) that a task deals to in one step, and the distinct n-grams that it
#: holds before it sends them on.
MIN_BUCKETS, STEP_BITS, HELD = 64, 12, 4_000_000
UNIGRAM, BIGRAM, CONTEXT, CONTINUATION, STAT = range(5)
SCHEMA = "kind int, bucket int, keys binary, counts binary"


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens (words, then one end), of the token before each, and the texts' rows."""
    n = len(w.first) - 1
    now = np.empty(len(w.hashes) + n, U64)
    now[np.arange(len(w.hashes)) + w.rows] = w.hashes
    ends = w.first[1:] + np.arange(n)
    now[ends] = END
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[w.first[:-1] + np.arange(n)] = START
    return now, before, np.repeat(np.arange(n), np.diff(w.first) + 1)


def bigrams(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (before >> U64(32) << U64(32)) | (now >> U64(32))


def spread(keys: np.ndarray, kind: int) -> np.ndarray:
    """What the bucket is taken from: bigrams of one frequent word must not share one."""
    return mix(keys) if kind == BIGRAM else keys


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (one row, or one row of columns, a key)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first, axis=0)


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: sorted keys and small counts shrink well."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(values.size, -1).T).tobytes()) if values.size else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def blobs(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, keys, counts) of each bucket that the sorted keys fall into."""
    bucket = (spread(keys, kind) >> U64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    return [(kind, b, pack(keys[order[x:y]]), pack(counts[order[x:y]])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]


def table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "bucket", "keys", "counts"])


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Atomically, so that a task run twice leaves the same file."""
    spare = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(spare)
    os.replace(spare, f"{folder}/{name}")


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: list[float]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    if min(n[:3]) <= 0:
        return [0.0, 0.5, 0.75, 1.0]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) for k in (1, 2, 3))]


@dataclass
class Model:
    folder: str
    bits: int
    n: int  # training tokens
    v: int  # distinct ones
    n_bigrams: int
    d: list[float]
    d_low: list[float]
    mass_low: float  # what the lower order leaves to all words alike

    def part(self, name: str, bucket: int, kind: type | None = None, n: int = 0) -> np.ndarray:
        """A bucket's array; counts have whatever type ``n`` of them fill the file with."""
        path = f"{self.folder}/{name}-{bucket}"
        got = _maps.get(path)
        if got is None:
            size = os.path.getsize(path) if os.path.exists(path) else 0
            got = _maps[path] = np.memmap(path, kind or f"<u{size // n}", "r") if size else np.zeros(0, U64)
        return got

    def look_up(self, kind: int, keys: np.ndarray, names: tuple[str, ...], key_kind: type = U64) -> list[np.ndarray]:
        """The values of each of the distinct keys, 0 where it is unknown."""
        out = [np.zeros(len(keys), np.float64) for _ in names[1:]]
        whole = keys if key_kind is U64 else keys.astype(U64) << U64(32)
        bucket = (spread(whole, kind) >> U64(64 - self.bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            known = self.part(names[0], int(b), key_kind)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                hit = known[at] == keys[own]
                for o, name in zip(out, names[1:], strict=True):
                    o[own[hit]] = self.part(name, int(b), n=len(known))[at[hit]]
        return out

    def scores(self, view: Bytes) -> dict[str, np.ndarray]:
        now, before, rows = tokens(words(view))
        n = len(view)
        types, back = np.unique(now, return_inverse=True)
        count, follows = self.look_up(UNIGRAM, types, ("uni", "uni-count", "uni-follows"))
        contexts, ctx = np.unique((before >> U64(32)).astype(U32), return_inverse=True)
        total, one, two, more = self.look_up(CONTEXT, contexts, ("ctx", "ctx-total", "ctx-1", "ctx-2", "ctx-3"), U32)
        pairs, pair = np.unique(bigrams(now, before), return_inverse=True)
        (seen,) = self.look_up(BIGRAM, pairs, ("bi", "bi-count"))

        cut = lambda c, d: np.maximum(c - np.array(d)[np.minimum(c, 3).astype(int)], 0)
        low = (cut(follows, self.d_low) / max(1, self.n_bigrams) + self.mass_low / (self.v + 1))[back]
        left = (self.d[1] * one + self.d[2] * two + self.d[3] * more)[ctx]
        total = total[ctx]
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.where(total > 0, (cut(seen, self.d)[pair] + left * low) / total, low)
        base = np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))[back]
        return {"n_tokens": np.bincount(rows, minlength=n), "n_known": np.bincount(rows, (count > 0)[back], n).astype(np.int64), "base_score": np.bincount(rows, base, n), "score": np.bincount(rows, np.log10(high), n)}


#: Of this worker, by path.
_maps: dict[str, np.ndarray] = {}


def train(docs: DataFrame, chosen: Column | None = None, text: str = "text") -> Model:
    """Counts over all texts for which ``chosen`` holds (null text: only an end), merged by bucket.

    Two shuffles of compressed blobs: the n-grams' counts, then what a bigram adds to its context (total,
    and how many words follow it once, twice, more often) and to its word (different words before it).
    Buckets grow with the partitions of the texts, so that one is merged in bounded memory at any size; from
    4096 on each shuffle takes two steps. The driver sees a row of numbers for each bucket.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.where(chosen) if chosen is not None else docs
    parts = docs.rdd.getNumPartitions()
    bits = (max(2 * parts, MIN_BUCKETS) - 1).bit_length()
    first_bits = min(bits, STEP_BITS)
    folder = mounted_folder(spark, "kneser-ney")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {UNIGRAM: [], BIGRAM: []}
        size = 0

        def flush() -> pa.RecordBatch:
            return table([r for kind, got in held.items() if got for r in blobs(kind, *summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got])), first_bits)])

        for whole in batches:
            for batch in portions(whole, "text"):
                now, before, _ = tokens(words(byte_view(batch.column(0))))
                for kind, keys in ((UNIGRAM, now), (BIGRAM, bigrams(now, before))):
                    distinct, times = np.unique(keys, return_counts=True)
                    held[kind].append((distinct, times.astype(U64)))
                    size += len(distinct)
                if size > HELD:
                    yield flush()
                    held, size = {UNIGRAM: [], BIGRAM: []}, 0
        if size:
            yield flush()

    def merged(rows: pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.zeros(0, U64), np.zeros((0, width), U64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            more = unpack(k, U64)
            waiting.append((more, unpack(c, U64).reshape(-1, width)))
            held += len(more)
            if held > max(HELD // 4, len(keys)):
                keys, counts = summed(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))
                waiting, held = [], 0
        return summed(np.concatenate([keys, *(w[0] for w in waiting)]), np.concatenate([counts, *(w[1] for w in waiting)]))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows by all bits of their buckets. Where there are more buckets than a task deals to in one step, the
        rows go to their step's bucket first, where a task takes many blobs apart and sends larger ones on."""
        if bits == first_bits:
            return rows

        def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            size = 0

            def flush() -> pa.RecordBatch:
                return table([r for kind, got in held.items() for r in blobs(kind, *summed(*(np.concatenate([g[i] for g in got]) for i in (0, 1))), bits)])

            for batch in batches:
                for r in batch.to_pylist():
                    if r["kind"] == STAT:
                        yield table([(STAT, r["bucket"], b"", r["counts"])])
                        continue
                    keys = unpack(r["keys"], U64)
                    held.setdefault(r["kind"], []).append((keys, unpack(r["counts"], U64).reshape(len(keys), -1)))
                    size += len(keys)
                    if size > HELD:
                        yield flush()
                        held, size = {}, 0
            if size:
                yield flush()

        return rows.repartition("kind", "bucket").mapInArrow(finer, SCHEMA)

    def stat(bucket: int, values: list[int]) -> tuple[int, int, bytes, bytes]:
        return STAT, bucket, b"", np.array(values, np.int64).tobytes()

    def first_merge(rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        keys, counts = merged(rows)
        counts = counts[:, 0]
        if kind == UNIGRAM:
            return pa.Table.from_batches([table([(UNIGRAM, bucket, pack(keys), pack(counts))])])
        save(folder, f"bi-{bucket}", keys)
        save(folder, f"bi-count-{bucket}", narrow(counts))
        context = np.column_stack([counts, counts == 1, counts == 2, counts > 2]).astype(U64)
        out = [stat(bucket, [1, len(keys), *count_of_counts(counts)])]
        for to, at, value in ((CONTEXT, keys >> U64(32) << U64(32), context), (CONTINUATION, keys << U64(32), np.ones((len(keys), 1), U64))):
            out += blobs(to, *summed(at, value), first_bits)
        return pa.Table.from_batches([table(out)])

    def second_merge(rows: pa.Table) -> pa.Table:
        kinds, bucket = rows.column("kind").to_numpy(), rows.column("bucket")[0].as_py()
        of = lambda kind, width=1: merged(rows.filter(pa.array(kinds == kind)), width)
        keys, counts = of(UNIGRAM)
        counts = counts[:, 0]
        halves, before = of(CONTINUATION)
        follows = np.zeros(len(keys), U64)
        if len(halves) and len(keys):
            at = np.minimum(np.searchsorted(halves, keys >> U64(32) << U64(32)), len(halves) - 1)
            hit = halves[at] == keys >> U64(32) << U64(32)
            follows[hit] = before[at[hit], 0]
        for name, values in (("uni", keys), ("uni-count", narrow(counts)), ("uni-follows", narrow(follows))):
            save(folder, f"{name}-{bucket}", values)
        context, values = of(CONTEXT, 4)
        save(folder, f"ctx-{bucket}", (context >> U64(32)).astype(U32))
        for i, name in enumerate(("ctx-total", "ctx-1", "ctx-2", "ctx-3")):
            save(folder, f"{name}-{bucket}", narrow(values[:, i]))
        low = follows.astype(np.int64)
        stats = [r for r, kind in zip(rows.to_pylist(), kinds, strict=True) if kind == STAT]
        own = stat(bucket, [0, int(counts.sum()), len(keys), *count_of_counts(low), int((low > 2).sum()), int(low.sum())])
        return pa.Table.from_batches([table([own, *((STAT, r["bucket"], b"", r["counts"]) for r in stats)])])

    first = dealt(docs.select(F.col(text).alias("text")).mapInArrow(counted, SCHEMA)).groupBy("kind", "bucket").applyInArrow(first_merge, SCHEMA)
    stats = [np.frombuffer(r[0], np.int64) for r in dealt(first).groupBy("bucket").applyInArrow(second_merge, SCHEMA).select("counts").collect()]
    high = np.sum([s[1:] for s in stats if s[0] == 1] or [np.zeros(5, np.int64)], axis=0)
    low = np.sum([s[1:] for s in stats if s[0] == 0] or [np.zeros(8, np.int64)], axis=0)
    d, d_low = discounts(high[1:].tolist()), discounts(low[2:6].tolist())
    follow = max(1, int(low[7]))
    spark._jvm.System.gc()  # the shuffles' files can go before anything is scored
    return Model(folder, bits, int(low[0]), int(low[1]), follow, d, d_low, (d_low[1] * low[2] + d_low[2] * low[3] + d_low[3] * low[6]) / follow if low[7] else 1.0)


def perplexity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens, known tokens, training tokens, the smoothed unigram base and the model's log10
    probability of every whole text.

    A null or empty text is one end; a word not trained on gets the share of unknown words; rows are
    judged alone; an empty table gives no rows. An untrained model spreads all evenly.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                got = model.scores(byte_view(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(batch.num_rows, model.n, np.int64)), pa.array(got["base_score"]), pa.array(got["score"])], names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(scored, "key long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
