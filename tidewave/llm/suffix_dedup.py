"""Exact substring dedup with suffix arrays, over any number of texts.

Every window of ``length`` bytes belongs to the least-hashed of its ``GRAM``-byte substrings, so equal
windows belong to equal anchors. Neighbouring windows with one anchor form a segment; a segment whose
anchor occurs nowhere else is unique, and equal segments are repeats as a whole. Only different segments
that share an anchor go, anchor by anchor, into blocks of bounded size, each with a suffix array (two-stage
sorting) and common prefixes of neighbours. The segments of a hot anchor are split over several blocks;
the digests of its windows then meet across blocks.

Hashes choose anchors only; what is called equal has equal bytes in a block or an equal 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fits, own_nodes, with_heavy, written
from .suffix_array import neighbours_agree, suffix_array
from .textkit import Bytes, byte_view, digests, eights, mix, portions, release

LENGTH, GRAM = 200, 32
#: Different segments of an anchor in a block, and bytes of a block (a whole anchor's share at least).
HOT, BLOCK = 500, 1 << 18
#: Bytes of a piece, or of a run, as a row that is broadcast.
PIECE_BYTES, RUN_BYTES = 40, 16
#: A window of a hot anchor, as blocks send it on: digests, owner, and whether it still lacks an equal.
WINDOW = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("id", "<i8"), ("start", "<i8"), ("open", "u1")])
#: Windows of hot anchors that meet in a group, about; least and most groups.
MET, MIN_GROUPS, MAX_GROUPS = 500_000, 64, 65536
U64 = np.uint64
BETWEEN = 0xFF  # no byte of UTF-8


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (eight at least) from each position on."""
    h = eights(data)[: max(0, len(data) - 7)] * U64(0x9E3779B97F4A7C15)
    width = 8
    while width < gram:
        step = min(width, gram - width)
        h = mix(h[: max(0, len(h) - step)] + U64(width)) + h[step:]
        width += step
    return mix(h)


def segments(view: Bytes, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All segments of the texts: row, anchor, two halves of the content's digest, first window in the text, windows."""
    data = view.data
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return {"row": empty, "anchor": empty.view(U64), "c1": empty.view(U64), "c2": empty.view(U64), "start": empty, "n": empty}
    hashes = gram_hashes(data, gram)
    least = sliding_least((hashes >> U64(32) << U64(32)) | np.arange(len(hashes), dtype=U64), length - gram + 1)
    ends = np.repeat(view.offsets[1:], np.diff(view.offsets))[: len(least)]
    valid = np.arange(len(least)) + length <= ends
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    # a window of the next text may follow directly
    heads = view.offsets[:-1][view.offsets[:-1] < len(least)]
    new[heads] = valid[heads]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.r_[~valid[1:] | new[1:], True]) + 1
    row = view.rows(first)
    c1, c2 = digests(data, first, stop - 1 + length)
    return {"row": row, "anchor": hashes[(least[first] & U64(0xFFFFFFFF)).astype(np.int64)], "c1": c1, "c2": c2, "start": first - view.offsets[row], "n": stop - first}


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the spans cover; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return starts[first], reach[np.r_[first[1:] - 1, len(starts) - 1]]


def repeats(bodies: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of a block of segments, by one suffix array: for each window its segment, place, whether an equal
    one stands elsewhere in the block, and whether it is the first of its equals; then the block's text
    and where each segment begins in it."""
    text = np.frombuffer(bytes([BETWEEN]).join([*bodies, b""]), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    heads = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    order = suffix_array(text, length)
    segment = np.searchsorted(heads, order, side="right") - 1
    place = order - heads[segment]
    keep = place + length <= sizes[segment]
    order, segment, place = order[keep], segment[keep], place[keep]
    agree = neighbours_agree(text, order, length) >= length
    again = np.zeros(len(order), bool)
    again[:-1] |= agree
    again[1:] |= agree
    return segment, place, again, np.r_[True, ~agree][: len(order)], text, heads


def repeated_spans(nodes: DataFrame, node: str, text: str, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(id, starts, ends): the maximal runs of repeated bytes of each text that has any; ``id`` is the
    text's number in ``node``, which no two rows share.

    With ``keep_first``, the first of equal strings (by number, then place) is not one that repeats.
    """
    bounded_batches(nodes.sparkSession)
    source = nodes.select(F.col(node).alias("id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column(0).to_numpy()
            done = 0
            for batch in portions(whole, "text", 1 << 18):
                s = segments(byte_view(batch.column(1)), length, gram)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(s[c].view(np.int64)) for c in ("anchor", "c1", "c2")), pa.array(ids[done + s["row"]]), pa.array(s["start"].astype(np.int64)), pa.array(s["n"].astype(np.int32))],
                    names=["anchor", "c1", "c2", "id", "start", "n"],
                )
                done += batch.num_rows

    table = written(source.mapInArrow(cut, "anchor long, c1 long, c2 long, id long, start long, n int"), "segments")
    rows = table.count()
    counts = table.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.min("c1").alias("lo"), F.max("c1").alias("hi"))
    shared = written(counts.where("all > 1").select("anchor", "all", (F.col("lo") != F.col("hi")).alias("differ")), "shared")
    found = written(with_heavy(table, shared, ["anchor"], "all", rows).drop("all"), "shared-segments")
    content = ["anchor", "c1", "c2"]
    contents = written(found.groupBy(*content).agg(F.count(F.lit(1)).alias("times"), F.first("differ").alias("differ"), F.min(F.struct("id", "start", "n")).alias("one")), "contents")

    # equal segments, as a whole
    again = contents.where("times > 1").select(*content, "times", F.col("one.id").alias("first_id"), F.col("one.start").alias("first_start"))
    whole = with_heavy(found, again, content, "times", rows)
    if keep_first:
        whole = whole.where("id <> first_id OR start <> first_start")
    spans = whole.select("id", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))

    # different segments with one anchor: their bytes, in blocks
    wanted = contents.where("differ").select("anchor", "c1", "one.*")
    hot = written(wanted.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", "count", F.ceil(F.col("count") / HOT).cast("long").alias("parts")), "hot")
    hot_windows = (hot.agg(F.sum("count")).first()[0] or 0) * (length - gram + 1) // 2
    groups = int(np.clip(hot_windows // MET, MIN_GROUPS, MAX_GROUPS))
    split = F.when(F.col("parts").isNotNull(), F.pmod("c1", "parts")).otherwise(F.lit(-1)).alias("part")
    wanted = with_heavy(wanted, hot, ["anchor"], "count", rows, "left").select("anchor", split, "id", "start", "n")
    by_text = written(wanted.groupBy("id").agg(F.collect_list(F.struct("start", "n", "anchor", "part")).alias("pieces")), "wanted")
    pieces = by_text.agg(F.sum(F.size("pieces"))).first()[0] or 0

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text", 1 << 18):
                view = byte_view(batch.column(1))
                lists, ids = batch.column(2), batch.column(0).to_numpy()
                inner = lists.flatten()
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                start, n, anchor, part = (inner.field(f).to_numpy() for f in ("start", "n", "anchor", "part"))
                at = view.offsets[row] + start
                bodies = [view.data[a:b].tobytes() for a, b in zip(at, at + n - 1 + length, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part), pa.array(ids[row]), pa.array(start), pa.array(bodies, pa.binary())], names=["anchor", "part", "id", "start", "body"])

    pieced = source.join(F.broadcast(by_text) if fits(pieces * PIECE_BYTES) else by_text, "id").select("id", "text", "pieces")
    bodies = pieced.mapInArrow(taken, "anchor long, part long, id long, start long, body binary")

    def edges(rows: pa.Table) -> np.ndarray:
        anchor, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        return np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1

    def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size > BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                edge = edges(rows)
                if len(edge):
                    yield from blocks(rows.slice(0, edge[-1]), edge)
                    rows = rows.slice(edge[-1])
                held, size = rows.to_batches(), rows.nbytes
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from blocks(rows, edges(rows))

    def blocks(rows: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole (anchor, part) groups, as many as fill a block."""
        ends = np.append(edges[edges < rows.num_rows], rows.num_rows)
        sizes = np.cumsum([len(b) for b in rows.column(4).to_pylist()]) if rows.num_rows else np.zeros(0)
        lo = 0
        while lo < rows.num_rows:
            base = sizes[lo - 1] if lo else 0
            inside = ends[(ends > lo) & (sizes[ends - 1] - base <= BLOCK)]
            hi = int(inside[-1]) if len(inside) else int(ends[ends > lo][0])
            yield block(rows.slice(lo, hi - lo))
            lo = hi
        release()

    def block(rows: pa.Table) -> pa.RecordBatch:
        part, ids, start = (rows.column(i).to_numpy() for i in (1, 2, 3))
        segment, place, again, head, text, heads = repeats(rows.column(4).to_pylist(), length)
        kind = np.cumsum(head) - 1
        rank = np.empty(len(segment), np.int64)
        rank[np.lexsort((start[segment] + place, ids[segment]))] = np.arange(len(segment))
        first = rank == np.minimum.reduceat(rank, np.flatnonzero(head))[kind] if len(rank) else np.zeros(0, bool)
        gone = again & ~first if keep_first else again
        # runs of repeated windows as spans
        order = np.lexsort((place[gone], segment[gone]))
        s, p = segment[gone][order], place[gone][order]
        new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)]) if len(s) else np.zeros(0, int)
        last = np.r_[new[1:] - 1, len(s) - 1][: len(new)]
        out = [(0, i, x, y, None, None) for i, x, y in zip(ids[s[new]].tolist(), (start[s[new]] + p[new]).tolist(), (start[s[new]] + p[last] + length).tolist(), strict=True)]
        # the first window of each kind of a hot anchor, for the other blocks
        some = np.flatnonzero(first & (part[segment] >= 0)) if len(segment) else np.zeros(0, int)
        if len(some):
            s, p = segment[some], place[some]
            at = heads[s] + p
            sent = np.empty(len(some), WINDOW)
            sent["d1"], sent["d2"] = digests(text, at, at + length)
            sent["id"], sent["start"], sent["open"] = ids[s], start[s] + p, keep_first | ~again[some]
            group = (sent["d2"] % U64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            out += [(1, None, None, None, int(g), sent[order[cuts[g] : cuts[g + 1]]].tobytes()) for g in np.flatnonzero(np.diff(cuts))]
        kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["kind", "id", "start", "stop", "meet", "sent"])

    def met(rows: pa.Table) -> pa.Table:
        """Windows without an equal in their own block that have one in another (an earlier one)."""
        w = np.frombuffer(b"".join(rows.column("sent").to_pylist()), WINDOW)
        w = w[np.lexsort((w["start"], w["id"], w["d2"], w["d1"]))]
        same = (w["d1"][1:] == w["d1"][:-1]) & (w["d2"][1:] == w["d2"][:-1])
        before, after = np.r_[False, same], np.r_[same, False]
        found = w[(before if keep_first else before | after) & (w["open"] > 0)]
        return pa.table({"id": found["id"], "start": found["start"], "stop": found["start"] + length})

    dealt = bodies.withColumn("deal", F.xxhash64("anchor", "part")).repartition("deal").sortWithinPartitions("deal", "anchor", "part").drop("deal")
    sorted_ = written(dealt.mapInArrow(sorted_blocks, "kind int, id long, start long, stop long, meet long, sent binary"), "sorted")
    spans = spans.unionAll(sorted_.where("kind = 0").select("id", "start", "stop"))
    spans = spans.unionAll(sorted_.where("kind = 1").select("meet", "sent").groupBy("meet").applyInArrow(met, "id long, start long, stop long"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            inner, sizes = lists.flatten(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            x, y = inner.field("start").to_numpy(), inner.field("stop").to_numpy()
            far = int(y.max(initial=0)) + 2  # rows lie apart, so that their spans never touch
            x, y = merged(x + row * far, y + row * far)
            cuts = pa.array(np.searchsorted(x // far, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(cuts, pa.array(v - x // far * far)) for v in (x, y))], names=["id", "starts", "ends"])
            release()

    grouped = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return written(grouped.mapInArrow(joined, "id long, starts array<long>, ends array<long>"), "runs")


def kept_bytes(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def with_runs(nodes: DataFrame, runs: DataFrame, node: str) -> DataFrame:
    """``nodes`` without ``node``, with columns ``__starts`` and ``__ends`` (null where nothing repeats)."""
    named = runs.select(F.col("id").alias("__id"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    size = runs.agg(F.sum(F.size("starts") + 2)).first()[0] or 0
    return nodes.join(F.broadcast(named) if fits(size * RUN_BYTES) else named, F.col(node) == F.col("__id"), "left").drop("__id", node)


def substring_dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", spans: bool = True, keep_first: bool = False) -> DataFrame:
    """What repeats in every text: a byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else in the texts, the same one included; all are judged on the input.

    Columns: the key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (hex, of the bytes
    left) and, if asked for, starts and ends of the runs. A null text counts as empty; texts under
    ``length`` bytes keep all. Rows are texts of their own, whatever their keys: rows that repeat a key
    and a text repeat each other, and null keys are allowed. An empty table gives no rows.
    """
    nodes = own_nodes(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "node")
    found = with_runs(nodes, repeated_spans(nodes, "node", "text", length, keep_first=keep_first), "node")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                view = byte_view(batch.column(1))
                runs = [(x or [], y or []) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                left = [hashlib.sha256(kept_bytes(view.text(i), *r)).hexdigest() for i, r in enumerate(runs)]
                removed, n = [sum(r[1]) - sum(r[0]) for r in runs], [len(r[0]) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(view.offsets)), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.string()), *(pa.array([r[i] for r in runs], pa.list_(pa.int64())) for i in (0, 1))],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"],
                )

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    out = found.mapInArrow(digested, schema).withColumnRenamed("id", key)
    return out if spans else out.drop("starts", "ends")


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs``, all columns and rows, without the bytes that repeat earlier ones: of equal strings of
    ``length`` bytes the first (by key, then place) stays, so that no passage leaves the corpus. A character
    cut in two goes whole; ``size``, where there is such a column, is the new number of characters. Null
    texts stay null; of rows that repeat a key and a text one keeps the text.
    """
    nodes = own_nodes(docs, key, "__node")
    found = with_runs(nodes, repeated_spans(nodes, "__node", text, length, keep_first=True), "__node")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.names.index(text)
            for batch in portions(whole, text):
                view = byte_view(batch.column(at))
                old = batch.column(at).is_valid().to_pylist()
                starts, ends = (c.to_pylist() for c in batch.columns[-2:])
                new = [kept_bytes(view.text(i), x or [], y or []).decode("utf-8", "ignore") if ok else None for i, (x, y, ok) in enumerate(zip(starts, ends, old, strict=True))]
                columns = list(batch.columns[:-2])
                columns[at] = pa.array(new, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-2]))

    out = found.mapInArrow(edited, docs.schema)
    if size not in docs.columns:
        return out
    return out.withColumn(size, F.when(F.col(text).isNull(), F.col(size)).otherwise(F.length(text)).cast(docs.schema[size].dataType))
