"""Quality rules by compression bands.

The zstandard ratio (compressed bytes / bytes) of the whole text and of its fixed chunks must lie in a
band that depends on length: below it text repeats itself, above it text is noise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import bounded_batches
from .textkit import IS_SPACE, Bytes, byte_view, mix, pair_hash, per_row, portions, range_hashes, words

#: (bytes below, lowest ratio, highest ratio) of whole texts, by length; the first row that fits holds.
WHOLE_BANDS = (
    (200, 0.40, 1.20), (400, 0.52, 0.90), (800, 0.515, 0.80), (1600, 0.478, 0.75), (3200, 0.454, 0.72),
    (6400, 0.428, 0.70), (12800, 0.41, 0.70), (25600, 0.395, 0.70), (51200, 0.38, 0.70), (float("inf"), 0.36, 0.70),
)
#: The same for chunks: whole ones, the last reaching back to its full size; a shorter text by the bands above.
CHUNK_BYTES, CHUNK_BAND = 2048, (0.454, 0.75)
#: A text goes when more than this share of its chunks leaves the band.
BAD_CHUNKS = 0.25
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, LEVEL = 50, 50, 3

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, low_chunks long, high_chunks long, n_chunks long"


def band(n: int, bands: Sequence[tuple[float, float, float]] = WHOLE_BANDS) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands if n < most)


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, int, bool]:
    """Ratio of the whole, chunks below and above their band, chunks, and the verdict (True: keep)."""
    if not data:
        return 0.0, 0, 0, 0, False
    ratio = len(packer.compress(data)) / len(data)
    low = high = n = 0
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[max(0, min(at, len(data) - CHUNK_BYTES)) :][:CHUNK_BYTES]  # the last one reaches back
        lo, hi = CHUNK_BAND if len(chunk) == CHUNK_BYTES else band(len(chunk))
        r = len(packer.compress(chunk)) / len(chunk) if len(data) > CHUNK_BYTES else ratio
        low, high, n = low + (r < lo), high + (r > hi), n + 1
    lo, hi = band(len(data))
    return ratio, low, high, n, lo <= ratio <= hi and low + high <= BAD_CHUNKS * n


def counts(view: Bytes) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n, w = len(view), words(view, lower=False)
    rows = np.repeat(np.arange(n), np.diff(view.offsets))
    in_word = ~IS_SPACE[view.data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(w.first), "word_chars": per_row(rows[in_word & ((view.data & 0xC0) != 0x80)], n), "n_symbols": per_row(rows[symbol[view.data]], n)}

    breaks = np.flatnonzero(view.data == 10)
    starts = np.sort(np.concatenate([view.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, view.offsets[1:]]))
    seen = np.concatenate([[0], np.cumsum(in_word)])
    full = seen[ends] > seen[starts]
    starts, ends = starts[full], ends[full]
    owner = view.rows(starts)
    lines = mix(range_hashes(view.data, starts, ends) ^ mix(owner.astype(np.uint64)))
    _, first = np.unique(lines, return_index=True)
    out["n_dup_lines"] = per_row(owner, n) - per_row(owner[first], n)

    h = w.hashes
    if len(h) >= 3:
        whole = np.flatnonzero(w.rows[2:] == w.rows[:-2])
        triples = mix(pair_hash(pair_hash(h[:-2], h[1:-1]), h[2:])[whole] ^ mix(w.rows[whole].astype(np.uint64)))
        _, back, times = np.unique(triples, return_inverse=True, return_counts=True)
        hit = np.zeros(len(h), bool)
        again = whole[times[back] > 1]
        for k in range(3):
            hit[again + k] = True
        out["n_repeat_words"] = per_row(w.rows[hit], n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def compression_bands(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base rule and verdict of every text, in one pass without a shuffle.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept:
    not base_failed, the whole ratio inside the band of the text's length, and at most a quarter of its
    2048-byte chunks (the last reaches back to its full size) outside theirs. Null and empty texts have no words: base_failed, not kept, ratio 0. Rows are
    judged alone, so repeated rows give repeated results; an empty table gives no rows.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for batch in portions(whole, "text"):
                view = byte_view(batch.column(1))
                c = counts(view)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                ratio, low, high, n, good = zip(*(compression(view.text(i), packer) for i in range(len(view))), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & np.array(good)), pa.array(ratio, pa.float64()), *(pa.array(x, pa.int64()) for x in (low, high, n))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(judged, SCHEMA)
