"""Near-duplicate groups by SetSketch.

A text's set of word shingles becomes registers: for each register the minimum of an exponential
variable over the set, kept as a truncated power of a base close to 1. Registers of a union are the
maxima of the registers, and equal registers are likelier the more alike two sets are. Bands of
registers propose pairs, the joint likelihood of all registers leaves those that may reach the
similarity, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, fits, in_few, own_nodes, with_heavy, written
from .textkit import Bytes, Words, byte_view, mix, pair_hash, portions, words

#: Base, rate and largest exponent of the registers (two bytes each).
B, RATE, TOP = 1.001, 20.0, 65534
#: Bands and registers in a band: a pair at 0.8 is missed with probability (1 - 0.8**6)**36 = 2e-5.
BANDS, ROWS = 36, 6
#: Rounds in which each bucket holds its sets against one of them. Afterwards components of more than SMALL
#: sets, and buckets with more than CROWD sets of smaller ones, are met in blocks of about ELEMENTS elements.
ROUNDS, SMALL, CROWD, ELEMENTS = 2, 16, 32, 16384
#: Pairs that a task holds against each other by their registers, and by their full sets.
ESTIMATED, CONFIRMED = 20_000, 2000
#: A pair is dropped unverified when its likelihood at the wanted similarity is so far (in nats) below the best; 12 nats are 4.9 standard deviations.
DOUBT = 12.0

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)


def shingles(w: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each of n texts, as hashes, and where each text's begin (n + 1
    places). A text with fewer than k words has its whole sequence as one; without words it has none."""
    count = np.diff(w.first)
    h = w.hashes
    out, rows = [], []
    if len(h) >= k:
        m = len(h) - k + 1
        full = h[:m]
        for i in range(1, k):
            full = pair_hash(full, h[i : m + i])
        at = np.flatnonzero(w.rows[k - 1 :] == w.rows[:m])
        out.append(full[at])
        rows.append(w.rows[at])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = h[w.first[short]]
        for i in range(1, k - 1):
            more = count[short] > i
            whole[more] = pair_hash(whole[more], h[w.first[short[more]] + i])
        out.append(mix(whole + count[short].astype(np.uint64)))
        rows.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    hashes, row = np.concatenate(out), np.concatenate(rows)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(n + 1))


def registers(hashes: np.ndarray, first: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """[set, register] of the sets that are not empty: floor(1 - log_B of the least exponential value)."""
    least = np.empty((len(first), m), np.uint64)
    value = np.empty_like(hashes)
    for i in range(m):
        np.multiply(hashes, _FACTORS[i], out=value)
        np.add(value, _SHIFTS[i], out=value)
        least[:, i] = np.minimum.reduceat(value, first)
    u = ((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[set, band] 64-bit keys of the bands' values."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(regs), BANDS))
    for i in range(ROWS):
        key = pair_hash(key, parts[:, :, i])
    return key


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, doubt: float = DOUBT) -> np.ndarray:
    """Whether each pair of register rows may have a similarity of ``least`` or more, by the likelihood
    of how many registers of the one are above, below or equal to the other's, given the set sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.unique(np.append(np.linspace(0, 1, 81), least))[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)
    hi, lo = p(u - v * grid), p(v - u * grid)
    value = above * np.log(hi) + below * np.log(lo) + same * np.log(np.clip(1 - hi - lo, 1e-12, 1))
    value = np.where(grid <= np.minimum(u / v, v / u) + 1e-9, value, -np.inf)
    good = np.where(grid >= least - 1e-9, value, -np.inf).max(axis=1)
    return good >= value.max(axis=1) - doubt


def sketched(nodes: DataFrame, k: int) -> DataFrame:
    """nodes(id, node, text) as (id, node, n, s, t, regs): set size, a 128-bit hash of the set (0 where empty) and the registers (null where empty)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                view = byte_view(batch.column(2))
                h, first = shingles(words(view), len(view), k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                regs: list[bytes | None] = [None] * len(n)
                if len(some):
                    for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        sums[j, some] = np.add.reduceat(mix(h ^ np.uint64(salt)), first[some])
                    for i, r in zip(some, registers(h, first[some]), strict=True):
                        regs[i] = r.tobytes()
                found = [pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["id", "node", "n", "s", "t", "regs"])

    return nodes.select("id", "node", "text").mapInArrow(sketch, "id long, node long, n long, s long, t long, regs binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def proposed(classes: DataFrame) -> DataFrame:
    """(band, id, n): one row for each set and band."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))], names=["band", "id", "n"])

    return classes.select("id", "n", "regs").mapInArrow(banded, "band long, id long, n long")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose registers may come from sets alike enough."""
    a = classes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru"))
    b = classes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                u, v, nu, nv, ru, rv = batch.columns
                keep = likely(matrix(ru), matrix(rv), nu.to_numpy(), nv.to_numpy(), percent / 100)
                yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep))

    both = pairs.join(a, "u").join(b, "v").select("u", "v", "nu", "nv", "ru", "rv")
    return in_few(both, pairs.count(), ESTIMATED).mapInArrow(judged, "u long, v long")


def full_sets(ids: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, n, members): the sorted shingles of the texts with the given numbers; few are sent to the texts,
    many are joined."""
    ids = written(ids.select("id").distinct(), "ids")
    texts = nodes.select(F.col("node").alias("id"), "text").join(F.broadcast(ids) if fits(8 * ids.count()) else ids, "id", "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                view = byte_view(batch.column(1))
                h, first = shingles(words(view), len(view), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["id", "n", "members"])

    return written(texts.mapInArrow(sets_of, "id long, n long, members binary"), "sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v), each given once, whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.count()
    if not rows:
        return pairs
    sets = full_sets(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))), nodes, k)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], percent)[0]) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("id").alias("u"), F.col("members").alias("x"))
    b = sets.select(F.col("id").alias("v"), F.col("members").alias("y"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y")
    return in_few(both, rows, CONFIRMED).mapInArrow(compared, "u long, v long")


def alike(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= percent * union with ``own``."""
    sizes = np.array([len(o) for o in others])
    if not len(own) or not sizes.sum():
        return np.zeros(len(others), bool)
    every = np.concatenate(others)
    hit = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every)])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return (both > 0) & (100 * both >= percent * (len(own) + sizes - both))


def spanning(own: list[dict], others: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links (u, v) of components that join all alike sets of two blocks: fewer than there are components."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    sets = [np.frombuffer(o["members"], np.uint64) for o in others]
    for q in own:
        for i in np.flatnonzero(alike(np.frombuffer(q["members"], np.uint64), sets, percent)):
            u, v = find(q["component"]), find(others[i]["component"])
            if u != v:
                top[max(u, v)] = min(u, v)
                out.append((q["component"], others[i]["component"]))
    return out


def met_in_blocks(queries: DataFrame, members: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) links between components: every text of queries(target, id, component) is held against every
    text of members(target, id, component) with its target. Each block of queries meets each block of members
    once, in one row; no pair of texts is ever a row. The blocks of a target are dealt over tasks by the
    number of the query's block, so that no task holds a target.
    """
    sets = full_sets(members.select("id").unionAll(queries.select("id")), nodes, k)

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Lists of sets by (target, block), and the number of blocks of each target."""
        sizes = rows.join(sets.select("id", "n"), "id").groupBy("target").agg(F.count(F.lit(1)).alias("texts"), F.ceil(F.sum("n") / ELEMENTS).cast("int").alias("parts"))
        sizes = written(sizes, "block-sizes")
        dealt = with_heavy(rows, sizes, ["target"], "texts", rows.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(sets, "id")
        return dealt.groupBy("target", "block").agg(F.collect_list(F.struct("component", "members")).alias(name)), sizes

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                links = spanning(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["u", "v"])

    own, sizes = blocks(queries, "own")
    others, _ = blocks(members, "others")
    others = written(others.drop("block"), "blocks").join(sizes.select("target", "parts"), "target")
    sent = others.select("target", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "others")
    return own.join(sent, ["target", "block"]).select("own", "others").mapInArrow(met, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the key, n_shingles, component_id and kept.

    Two documents are linked when their sets of k-word shingles (words lower-cased A-Z) have
    100 * intersection >= percent * union; component_id is the smallest key that links reach, and kept is
    true for it. Null, empty and wordless texts have no shingles and are linked with nothing. A null key
    is linked with nothing and has component_id null and kept true. Rows that repeat a key are one document:
    each gives a row with its own n_shingles, a link of any of them is a link of all, and they share the
    component. An empty table gives no rows.

    Equal sets are one class, which stands for all its rows, so copies never meet. In rounds, each bucket of a
    band holds its classes against one of them, another in each round. Where a bucket then still has more than
    one component, a few sets of small ones meet in pairs; many, and large components, meet in blocks. Pairs
    inside a component are never rows. Classes are verified, whatever the keys of their rows.
    """
    bounded_batches(docs.sparkSession)
    nodes = own_nodes(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", "node")
    table = written(sketched(nodes, k), "sketches")
    known = table.where("n > 0 AND id IS NOT NULL")
    same = ["n", "s", "t"]
    least = F.min(F.struct("node", "regs")).alias("least")
    single = known.groupBy(*same).agg(least, F.count(F.lit(1)).alias("rows"))
    single = written(single.select(F.col("least.node").alias("id"), *same, "rows", F.col("least.regs").alias("regs")), "classes")
    rows_known = known.count()
    several = not known.where("node <> id").isEmpty()
    placed = with_heavy(known.select("id", "node", *same), single.select(*same, "rows", F.col("id").alias("class")), same, "rows", rows_known).drop("rows")

    bands = written(proposed(single), "bands")
    # what a hot band or hub is joined with is written first: then both sides are plain exchanges, which are split
    shared = written(in_few(bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("band"), bands.count()), "shared")
    members = written(in_few(bands.join(shared, "band"), bands.count()), "buckets")
    in_buckets = members.count()

    near = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    groups: DataFrame | None = None

    def mixed() -> DataFrame:
        """The buckets with more than one component: (band, id, n, component)."""
        if groups is None:
            return members.withColumn("component", F.col("id"))
        placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
        several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
        return written(in_few(placed.join(written(in_few(several, in_buckets), "several"), "band"), in_buckets), "mixed")

    def joined(links: DataFrame) -> DataFrame:
        links = written(links, "links")
        if groups is not None:
            if links.isEmpty():
                return groups
            links = links.unionAll(groups.select(F.col("node").alias("u"), F.col("component").alias("v")))
        return written(components(links), "groups")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(in_few(pairs, in_buckets), "pairs")
        return confirmed(written(estimated(pairs, single, percent), "likely"), nodes, k, percent)

    for r in range(ROUNDS):
        rows = mixed()
        leaders = written(in_few(rows.groupBy("band").agg(F.min(F.struct((F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))).alias("order"), "id", "n", "component")).alias("l")).select("band", F.col("l.id").alias("leader"), F.col("l.n").alias("n_leader"), F.col("l.component").alias("c_leader")), in_buckets), "leaders")
        stars = in_few(rows.join(leaders, "band").where((F.col("component") != F.col("c_leader")) & near(F.col("n"), F.col("n_leader"))).select(F.col("id").alias("u"), F.col("leader").alias("v")), in_buckets).distinct()
        groups = joined(linked(stars))

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= SMALL).select("component", F.lit(True).alias("large"))
    rest = written(mixed().join(sizes, "component", "left").withColumn("large", F.coalesce("large", F.lit(False))), "rest")
    small = rest.where("NOT large")
    crowds = small.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where(f"size > {CROWD} AND lo <> hi").select("band")
    few = small.join(crowds, "band", "left_anti")
    a, b = few.alias("a"), few.alias("b")
    across = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") > F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & near(F.col("a.n"), F.col("b.n"))).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()

    large = rest.where("large").select("band", F.col("component").alias("target")).distinct()
    apart = rest.join(large, "band").where("component <> target AND (NOT large OR component > target)").select(F.struct(F.lit("component").alias("kind"), F.col("target").alias("of")).alias("target"), "id", "component").distinct()
    crowd = small.join(crowds, "band").select(F.struct(F.lit("band").alias("kind"), F.col("band").alias("of")).alias("target"), "id", "component")
    queries = written(apart.unionAll(crowd), "queries")
    whole = groups.select(F.col("node").alias("id"), "component").unionAll(groups.select(F.col("component").alias("id"), "component").distinct())
    met = whole.join(apart.select(F.col("target.of").alias("component")).distinct(), "component").select(F.struct(F.lit("component").alias("kind"), F.col("component").alias("of")).alias("target"), "id", "component")
    last = linked(across)
    if not queries.isEmpty():
        last = last.unionAll(met_in_blocks(queries, written(met.unionAll(crowd), "members"), nodes, k, percent))

    if several:  # the classes of a key's rows belong together
        placed = written(placed, "placed")
        spread = placed.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
        last = last.unionAll(placed.join(spread, "id").select(F.col("class").alias("u"), F.col("lo").alias("v")))
    groups = joined(last)
    component = single.select(*same, "rows", "id").alias("c").join(groups.alias("g"), F.col("c.id") == F.col("g.node"), "left").select(*same, "rows", F.coalesce("component", "id").alias("component"))
    found = with_heavy(known.select("id", *same), written(component, "components"), same, "rows", rows_known).select("id", "n", "component")
    if several:  # numbers given to repeated rows are no keys
        found = written(found, "found")
        keys = found.groupBy("component").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("rows"))
        found = with_heavy(found, keys, ["component"], "rows", rows_known).select("id", "n", F.col("smallest").alias("component"))
    rest = table.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = found.unionByName(rest)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one row of each group, with its smallest key.

    Unlike in ``near_duplicates``, every row is a document: of rows that repeat a key and of rows with a null
    key, too, one of each group stays, and texts that are not alike all stay.
    """
    nodes = own_nodes(docs, key, "__node")
    groups = near_duplicates(nodes, k, percent, "__node", text)
    gone = written(groups.where(~F.col("kept")).select(F.col("__node").alias("__gone")).distinct(), "gone")
    return nodes.join(F.broadcast(gone) if fits(8 * gone.count()) else gone, F.col("__node") == F.col("__gone"), "left_anti").drop("__node")
