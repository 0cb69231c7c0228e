"""Words, lines and their hashes for whole Arrow columns of texts, as NumPy passes over the UTF-8 bytes.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Nothing here makes a Python object for a word, so
a text of any length costs a few arrays of its own size; ``portions`` keeps those to a few MB of text
at a time (a single longer text is taken alone and whole).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair."""
    return mix(a * U64(3) + U64(0x632BE59BD9B4E019) + mix(b))


@dataclass
class Bytes:
    """The bytes of some texts, one after another: text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def rows(self, positions: np.ndarray) -> np.ndarray:
        """The text that each position falls into."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def byte_view(texts: pa.Array) -> Bytes:
    """The UTF-8 bytes of a string column; null counts as empty. No copy where there is no null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return Bytes(np.empty(0, np.uint8), np.zeros(1, np.int64))
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def portions(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``most`` bytes of ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    ends = byte_view(batch.column(batch.schema.names.index(column))).offsets
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def release() -> None:
    """Gives free memory back to the system: idle workers otherwise keep the most that they ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


#: Ranges of more bytes are hashed one by one, by XXH3.
LONG = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one little-endian number (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), U64, padded, 0, (1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: eight at a time into a state that is mixed every time,
    so that it is no polynomial that equal factors could cancel."""
    size = np.asarray(ends - starts, np.int64)
    out = mix(size.astype(U64) * U64(0xD1342543DE82EF95) + U64(0x2545F4914F6CDD1D))
    words = eights(data)
    alive = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(alive):
        left = size[alive] - at
        out[alive] = mix(out[alive] ^ (words[starts[alive] + at] & _MASKS[np.minimum(left, 8)]))
        alive = alive[left > 8]
        at += 8
    far = np.flatnonzero(size > LONG)
    if len(far):
        whole = memoryview(np.ascontiguousarray(data))
        out[far] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit XXH3 of the bytes of each range."""
    whole, one = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([one(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


@dataclass
class Words:
    """Words of some texts in order: byte ranges, the text of each, and a 64-bit hash of each."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i


#: Bytes of plain tokens: ASCII letters and digits and all that is not ASCII.
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(view: Bytes, lower: bool = True, within: np.ndarray | None = None) -> Words:
    """Words of each text, or runs of the bytes in ``within``."""
    data = (_LOWER if lower else _SAME)[view.data]
    starts, ends = runs(~IS_SPACE[data] if within is None else within[data], view.offsets)
    first = np.searchsorted(starts, view.offsets)
    rows = np.repeat(np.arange(len(view)), np.diff(first))
    return Words(starts, ends, rows, range_hashes(data, starts, ends), first)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross an offset."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


class Letters:
    """Tables over code points: letter or not, lower case, script. Built once by each worker."""

    #: First and last code point of the scripts told apart.
    SCRIPTS = (
        ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
        ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
        ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
        ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF),
    )
    NAMES = ("other", *dict.fromkeys(s[0] for s in SCRIPTS))
    SIZE = 0x20000
    _tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def tables(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls._tables is None:
            points = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(cls.SIZE)]
            lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points], np.uint32)
            script = np.zeros(cls.SIZE, np.uint8)
            for name, lo, hi in cls.SCRIPTS:
                script[lo : hi + 1] = cls.NAMES.index(name)
            cls._tables = np.array([c.isalpha() for c in points]), lower, script
        return cls._tables


@dataclass
class LetterWords:
    """Runs of letters, lower-cased: ``points`` are the texts' code points."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    n: int

    def hashes(self) -> np.ndarray:
        return range_hashes(np.ascontiguousarray(self.points, np.uint32).view(np.uint8), 4 * self.starts, 4 * self.ends)

    def scripts(self) -> np.ndarray:
        """The script of each word's first letter."""
        return Letters.tables()[2][np.minimum(self.points[self.starts], Letters.SIZE - 1)]


def letter_words(view: Bytes) -> LetterWords:
    letter, lower, _ = Letters.tables()
    points = np.frombuffer(view.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((view.data & 0xC0) != 0x80)])
    offsets = heads[view.offsets]
    known = np.minimum(points, Letters.SIZE - 1)
    points = np.where(points < Letters.SIZE, lower[known], points)
    starts, ends = runs(letter[known] | (points >= Letters.SIZE) & (points < 0x40000), offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return LetterWords(points, starts, ends, rows, len(view))


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
