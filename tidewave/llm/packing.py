"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket boundaries with the least
padding; inside each bucket, batches form under a budget of padded tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gapless, written

WORD = r"[^\x20\x09-\x0D]+"


def best_boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (each the padded length of its bucket) with the least total padding.

    ``counts[n]`` sequences have length n + 1. Exact: cost(i, j) is the padding of lengths i+1..j when
    padded to j; best[k][j] = min over i of best[k-1][i] + cost(i, j). Time buckets * len(counts)**2 in
    vector steps, memory buckets * len(counts), whatever the number of sequences.
    """
    lengths = np.flatnonzero(counts) + 1
    if not len(lengths):
        return []
    number = np.concatenate([[0], np.cumsum(counts[lengths - 1], dtype=np.float64)])
    total = np.concatenate([[0], np.cumsum(counts[lengths - 1] * lengths.astype(np.float64))])
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    came: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        now, back = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (total[j] - total[:j])
            back[j] = i = int(np.argmin(cost))
            now[j] = cost[i]
        came.append(back)
        best = now
    out, j = [], m
    for back in reversed(came):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(back[j])
    return out[::-1]


def word_tokens(text: Column) -> Column:
    """Words of the text, counted on the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_file_tokens(path: str, pattern: str) -> Callable[[Column], Column]:
    """A counter of byte-level BPE tokens: ``path`` is a file of ranks, ``pattern`` splits the text."""

    def count(text: Column) -> Column:
        @F.arrow_udf("long")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for texts in batches:
                yield pa.array([len(encoding.encode_ordinary(t or "")) for t in texts.to_pylist()], pa.int64())

        return counted(text)

    return count


def length_buckets(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 16, max_length: int = 4096, budget: int = 65536, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """Sequences of the documents, their buckets and batches.

    A text of n tokens gives pieces of ``max_length`` tokens and one of what is left, so nothing is cut
    off; a text without tokens gives none. Columns: the key, piece (0, 1, ...), n_tokens, first_token,
    bucket (0 is the shortest), padded (the bucket's length), batch (in the bucket), place (in the
    batch). A batch has ``budget // padded`` places (one at least) and only the last of a bucket may
    have fewer rows. Null or empty texts and empty tables give no rows; a repeated key gives its pieces
    again; other columns are not read.

    The histogram has at most ``max_length`` rows, which is what the driver sees. Numbering in a bucket
    is dealt over hash parts, so that a bucket with most rows is no single task's.
    """
    counted = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("n"))
    pieces = (
        counted.where("n > 0")
        .select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(max_length)).cast("long"))).alias("piece"))
        .select("key", "piece", F.least(F.lit(max_length).cast("long"), F.col("n") - F.col("piece") * max_length).alias("n_tokens"))
    )
    pieces = written(pieces, "pieces")
    histogram = np.zeros(max_length, np.int64)
    for n, c in pieces.groupBy("n_tokens").count().collect():  # at most max_length rows
        histogram[n - 1] = c
    bounds = best_boundaries(histogram, buckets)
    bucket = F.lit(None).cast("int")
    padded = F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        fits = F.col("n_tokens") <= b
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        padded = F.when(fits, F.lit(b).cast("long")).otherwise(padded)
    dealt = pieces.select("key", "piece", "n_tokens", bucket.alias("bucket"), padded.alias("padded"))
    numbered = gapless(dealt, ["bucket"], ["key", "piece", "n_tokens"], "slot", int(histogram.sum()))
    places = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded")).cast("long"))
    return numbered.select(
        F.col("key").alias(key), "piece", "n_tokens", (F.col("piece") * max_length).alias("first_token"), "bucket", "padded",
        F.floor(F.col("slot") / places).cast("long").alias("batch"), F.pmod(F.col("slot"), places).alias("place"),
    )
