"""SimHash near-duplicates: 64-bit fingerprints, linked where few bits differ, by the generalised pigeonhole principle.

Bits are grouped into partitions, those that vary together in one, so that skew gathers there. For a fingerprint that allows a
difference of t_i bits in partition i, with the sum of all (t_i + 1) at least TAU + 1, every fingerprint within TAU bits agrees with it
to t_i bits in some partition. How much each partition is allowed is chosen for each fingerprint by dynamic programming on the estimated
cost: values probed, and candidates met there. A partition where the fingerprint's value is frequent gets no probe at all, if others
are cheaper. Estimates steer the cost alone; the links are exact.

Equal fingerprints are one point. Points next to each other in the order of each partition are linked first, so that a large group
of look-alikes is one component, or few, before any candidates are made; candidates are pairs of points of different components, and
what leaves a task are links between components.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import BROADCAST_IDS, documents, partitions, prepare, written
from twinframe.llm.components import components

WORDS, SEED, BITS = 4, 42, 64
#: Most differing bits of a link.
TAU = 4
#: Largest difference that is probed within one partition, and the numbers of partitions that are weighed against each other.
REACH, WAYS = 2, (2, 3, 4, 5)
#: Points whose values in the partitions tell which values are frequent, for estimates alone, and how many frequent values are kept.
SAMPLE, FREQUENT = 16_384, 256
#: What a probe costs, in comparisons.
PROBE = 40
#: Hashes whose bits are counted at once.
COUNTED = 65_536
#: Points of one value above which probes and points of one component don't meet, and rows that such a value sends to a task.
HOT, SLOT = 1_024, 4_096


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text, unsigned: bits set in over half the hashes of its shingles; zero for a text without words."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    cuts = zip(starts, ends[WORDS - 1 :]) if len(words) >= WORDS else [(0, len(whole))]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(whole[s:e], SEED) for s, e in cuts]), "u1").reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[at : at + COUNTED], axis=1).sum(axis=0, dtype="i8") for at in range(0, len(hashes), COUNTED))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint of each row's whole text, as a signed long."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def together(points: DataFrame) -> np.ndarray:
    """How often each two bits are set together in all points, 64 x 64; each bit's own count on the diagonal. A table of 4,096 sums."""

    def count(batches):
        both = np.zeros((BITS, BITS), "i8")
        for batch in batches:
            bits = _bits(_numbers(batch, "fp")).astype("f4")  # exact: a batch has under 2 ** 24 rows
            both += (bits.T @ bits).astype("i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype="i4")), pa.array(both.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for cell, n in points.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, that of weight 1 first."""
    return np.unpackbits(np.ascontiguousarray(fps).view("u1").reshape(-1, 8), axis=1, bitorder="little")


def grouped(both: np.ndarray, n: int, ways: int) -> list[list[int]]:
    """The bits in so many partitions of near-equal width: each starts with a bit and takes, one by one, the one most correlated with its own."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(ways):
        width = -(-len(left) // (ways - k))
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(part) < width:
            part.append(max((b for b in left if b not in part), key=lambda b: (corr[b, part].sum(), -b)))
        left = [b for b in left if b not in part]
        out.append(part)
    return out


def project(fps: np.ndarray, part: list[int]) -> np.ndarray:
    u = fps.view("u8")
    out = np.zeros(len(u), "u8")
    for k, b in enumerate(part):
        out |= (u >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


@cache
def masks(width: int, reach: int) -> np.ndarray:
    """All values of so many bits with at most ``reach`` set."""
    return np.array([sum(1 << b for b in c) for t in range(reach + 1) for c in combinations(range(width), t)], "u8")


class Plan:
    """The partitions, and what probing each would cost a fingerprint. Small: sent to every task."""

    def __init__(self, parts: list[list[int]], sample: np.ndarray, n: int):
        self.parts, self.n = parts, n
        self.frequent = []
        for part in parts:
            values, counts = np.unique(project(sample, part), return_counts=True)
            top = np.argsort(-counts, kind="stable")[:FREQUENT]
            top = top[counts[top] > 1]
            self.frequent.append((values[top], counts[top] * (n / max(len(sample), 1))))

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[partition, t + 1, row] for t from -1 (no probe) to REACH."""
        out = np.zeros((len(self.parts), REACH + 2, len(fps)))
        for i, (part, (values, counts)) in enumerate(zip(self.parts, self.frequent)):
            apart = np.bitwise_count(project(fps, part)[:, None] ^ values[None, :]) if len(values) else np.zeros((len(fps), 0), "u1")
            for t in range(REACH + 1):
                probes = len(masks(len(part), t))
                out[i, t + 1] = probes * (PROBE + self.n / 2.0 ** len(part)) + (apart <= t) @ counts
        return out

    def allowances(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """t of each partition and row, of least total cost, whose sum of (t + 1) is TAU + 1; and that cost."""
        costs, need = self.costs(fps), TAU + 1
        best = np.full((need + 1, len(fps)), np.inf)
        best[0] = 0
        took = np.zeros((len(self.parts), need + 1, len(fps)), "i1")
        for i in range(len(self.parts)):
            new = np.full_like(best, np.inf)
            for units in range(REACH + 2):
                for have in range(need + 1):
                    total = min(have + units, need)
                    cost = best[have] + costs[i, units]
                    better = cost < new[total]
                    new[total][better] = cost[better]
                    # what it took, and how much there was before, in one number
                    took[i, total][better] = units * (need + 1) + have
            best = new
        out, at, rows = np.zeros((len(self.parts), len(fps)), "i1"), np.full(len(fps), need), np.arange(len(fps))
        for i in reversed(range(len(self.parts))):
            out[i], at = np.divmod(took[i, at, rows], need + 1)
            out[i] -= 1
        return out, best[need]


def planned(points: DataFrame, n: int) -> Plan:
    """The plan of least estimated cost over the sampled points, of those with 2 to 5 partitions."""
    both = together(points)
    sample = np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], "i8")
    plans = [Plan(grouped(both, n, ways), sample, n) for ways in WAYS]
    return min(plans, key=lambda p: p.allowances(sample[:1024])[1].sum())


def _key(i: int, values: np.ndarray) -> np.ndarray:
    return (values | np.uint64(i << 40)).view("i8")  # values have 32 bits at most


def neighbours(points: DataFrame, plan: Plan, n: int) -> DataFrame:
    """Links a, b between points next to each other (up to eight places) where those are sorted by a partition's bits, then the others.

    Ranges of distinct numbers: no value is too frequent for a task.
    """

    def turn(batches):
        for batch in batches:
            fps = _numbers(batch, "fp")
            for i, part in enumerate(plan.parts):
                others = [b for other in plan.parts if other is not part for b in other]
                order = project(fps, [*reversed(others), *reversed(part)])  # the first bit of the partition weighs most
                order ^= np.uint64(1 << 63)  # unsigned order in signed numbers
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, "i4")), pa.array(order.view("i8")), batch.column("fp")], names=["way", "place", "fp"])

    def link(batches):
        tail = np.zeros(0, "i8"), np.zeros(0, "i4")
        for batch in batches:
            fps, way = (np.concatenate([t, _numbers(batch, c)]) for t, c in zip(tail, ("fp", "way")))
            fresh, out = len(tail[0]), []
            open_ = np.arange(len(fps)) >= fresh
            for lag in range(1, 9):
                near = (np.bitwise_count((fps[lag:] ^ fps[:-lag]).view("u8")) <= TAU) & (way[lag:] == way[:-lag]) & open_[lag:]
                hits = np.flatnonzero(near) + lag
                out.append((fps[hits], fps[hits - lag]))
                open_[hits] = False
            a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            tail = fps[-8:], way[-8:]

    turned = points.select("fp").mapInArrow(turn, "way int, place long, fp long")
    ordered = turned.repartitionByRange(partitions(points.sparkSession, n * len(plan.parts), 1_000_000), "way", "place").sortWithinPartitions("way", "place")
    return ordered.mapInArrow(link, "a long, b long")


def probed(points: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(key, fp, component) of every point by its value in each partition, and of every probe that its allowances ask for."""

    def values(batches):
        for batch in batches:
            fps, same = _numbers(batch, "fp"), _numbers(batch, "component")
            for i, part in enumerate(plan.parts):
                yield _rows(_key(i, project(fps, part)), fps, same)

    def probes(batches):
        for batch in batches:
            fps, same = _numbers(batch, "fp"), _numbers(batch, "component")
            for at in range(0, len(fps), 4_096):
                some, of = fps[at : at + 4_096], same[at : at + 4_096]
                allowed, _ = plan.allowances(some)
                for i, part in enumerate(plan.parts):
                    own = project(some, part)
                    for t in range(REACH + 1):
                        rows = np.flatnonzero(allowed[i] == t)
                        if len(rows):
                            near = masks(len(part), t)
                            keys = _key(i, (own[rows, None] ^ near[None, :]).ravel())
                            yield _rows(keys, np.repeat(some[rows], len(near)), np.repeat(of[rows], len(near)))

    schema = "key long, fp long, component long"
    d = points.select("fp", "component")
    return d.mapInArrow(values, schema), d.mapInArrow(probes, schema)


def _rows(key, fp, component) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(component)], names=["key", "fp", "component"])


def across(points: DataFrame, plan: Plan) -> DataFrame:
    """Links a, b between components of points (fp, component): all that points within TAU bits of each other make.

    Where a value has over HOT points, its largest component is at home there: points at home aren't met by probes from home, and the
    value's rows are dealt to as many tasks as they need.
    """
    values, probes = probed(points, plan)
    values = written(values, "values")
    each = values.groupBy("key", "component").agg(F.count("*").alias("n"))
    hot = each.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("home")).where(F.col("n") > HOT)
    hot = written(hot.select("key", "home", F.ceil(F.col("n") / SLOT).cast("int").alias("slots")), "hot")
    few = hot.count() <= BROADCAST_IDS
    at_home = F.coalesce(F.col("component") == F.col("home"), F.lit(False))
    slots = F.coalesce("slots", F.lit(1))
    every = F.transform(F.sequence(F.lit(0), slots - 1), lambda k: k)
    mine = F.array(F.pmod(F.xxhash64("fp"), slots).cast("int"))
    # Side 0: points away from home, to all slots, with a probe in one slot; side 1: points at home, one slot each, with probes from away in all.
    to = F.explode(F.transform(F.when(at_home, mine).otherwise(every), lambda k: F.struct(at_home.cast("int").alias("side"), k.alias("slot"))))
    side = lambda n, of: F.transform(of, lambda k: F.struct(F.lit(n).alias("side"), k.alias("slot")))
    asked = F.explode(F.when(F.col("home").isNull() | at_home, side(0, mine)).otherwise(F.concat(side(0, mine), side(1, every))))
    with_hot = lambda d: d.join(F.broadcast(hot) if few else hot, "key", "left")
    points_ = with_hot(values).select("key", "fp", "component", to.alias("x")).select("key", "x.side", "x.slot", F.col("fp").alias("p"), F.col("component").alias("pc"))
    probes_ = with_hot(probes).select("key", "fp", "component", asked.alias("x")).select("key", "x.side", "x.slot", F.col("fp").alias("q"), F.col("component").alias("qc"))
    near = probes_.join(points_, ["key", "side", "slot"]).where((F.col("pc") != F.col("qc")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= TAU))
    return near.select(F.least("pc", "qc").alias("a"), F.greatest("pc", "qc").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs: the smallest doc_id that links of at most TAU bits reach.

    Null, empty and white-space-only texts have fingerprint zero, which is linked like any other. Rows of null doc_id link as all do but
    never name a component; one of them alone has a null component_id. Rows that repeat a doc_id are rows each. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    every = written(fingerprints(docs), "fingerprints")
    points = written(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    n = points.count()
    plan = planned(points, n)
    first = written(components(written(neighbours(points, plan, n), "neighbours")), "components")
    joined = lambda of: F.coalesce(of, F.col("fp")).alias("component")
    placed = written(points.join(first, points["fp"] == first["node"], "left").select("fp", "least", joined(F.col("component"))), "placed")
    more = written(components(written(across(placed, plan), "links")), "components").withColumnRenamed("component", "root")
    whole = placed.join(more, F.col("component") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "component").alias("root"))
    whole = written(whole, "whole")
    named = written(whole.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of = written(whole.join(named, "root").select("fp", "component_id"), "of")
    return every.join(of, "fp").select("doc_id", "fp", "component_id")


def op12_simhash_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
