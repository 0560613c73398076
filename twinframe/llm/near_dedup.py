"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact verification, connected components.

Texts with equal shingle sets form a class and are represented by their smallest doc_id, so copies, however many, cost one signature.
Signatures of representatives are cut into bands; representatives that agree on a band share a bucket. Instead of all pairs of a
bucket, first each member is compared with the bucket's smallest one; links found there are joined to components. A second search
takes the buckets that still hold several components and compares only members of different ones: no link that could join two
groups is lost, and a large group of near copies, one component by then, isn't compared with itself. That search works on blocks: the
members of a bucket are cut into chunks of bounded size, any two chunks that may hold different components meet in a task, and
only links leave it.

A candidate pair is compared one batch of hash values after another. After each batch, the posterior of the similarity (uniform prior)
bounds it: a pair is dropped when the chance of reaching the threshold is under MISS. Survivors are verified on their full sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import BROADCAST_IDS, documents, fresh, numbered, prepare, release, without, written
from twinframe.llm.components import components

SHINGLE = 5
#: Link when NUMBER * intersection >= threshold * union. THRESHOLD is the contract of op6.
THRESHOLD, NUMBER = 85, 100
#: There are so many bands that a pair at the threshold shares none with a probability of NO_BAND at most: 25 at 85, 37 at 80.
ROWS, NO_BAND = 5, 4.4e-7
BATCH, MISS = 25, 1e-9
#: Members of a bucket that a chunk holds, on average.
CHUNK = 1_024
#: A link by so many more shingles than it needs counts as sure in a block; others don't spare later comparisons.
SLACK = 8
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 300_000

_words: dict[bytes, int] = {}


def hashes_for(threshold: int) -> int:
    """Hash values of a signature: ROWS for each band."""
    return ROWS * math.ceil(math.log(NO_BAND) / math.log(1 - (threshold / NUMBER) ** ROWS))


@lru_cache
def _parameters(hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, hashes, "u4"), rng.integers(0, 1 << 31, hashes, "u4") * 2 + 1, rng.integers(0, 1 << 63, SHINGLE, "u8") * 2 + 1


PLACE = _parameters(hashes_for(THRESHOLD))[2]


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's word shingles as sorted distinct 64-bit hashes; under SHINGLE words, the whole sequence is one."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, "u8")
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in parts:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, parts), "u8", len(parts))
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], "u8")
    n = len(h) - SHINGLE + 1
    mixed = h[:n] * PLACE[0]
    for k in range(1, SHINGLE):
        mixed = (mixed ^ (mixed >> np.uint64(29))) + h[k : k + n] * PLACE[k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(found: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The least value of each hash over the set. ``room`` is scratch space of one row per hash, so that nothing large is allocated."""
    xor, factor, _ = _parameters(len(room))
    out = np.full(len(room), 0xFFFFFFFF, "u4")
    x = (found >> np.uint64(32)).astype("u4")
    for at in range(0, len(x), room.shape[1]):
        part = x[at : at + room.shape[1]]
        here = room[:, : len(part)]
        np.bitwise_xor(part, xor[:, None], out=here)
        np.multiply(here, factor[:, None], out=here)
        np.minimum(out, here.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is mixed in."""
    key = np.arange(1, len(sig) // ROWS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for v in sig.reshape(-1, ROWS).T.astype("u8"):
        key = (key ^ v) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view("i8")


@lru_cache
def least_matches(threshold: int) -> list[tuple[int, int]]:
    """(n, m): after n hash values a pair with under m equal ones has a chance below MISS of reaching the threshold."""
    t = threshold / NUMBER

    def reach(n: int, m: int) -> float:  # P(similarity >= t) under Beta(m + 1, n - m + 1)
        return sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))

    return [(n, next(m for m in range(n + 1) if reach(n, m) >= MISS)) for n in range(BATCH, hashes_for(threshold) + 1, BATCH)]


def survives(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Of rows of two signature matrices: which pairs no batch drops. Dropped pairs take no part in later batches."""
    alive, equal, at = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, m in least_matches(threshold):
        equal[alive] += (a[alive, at:n] == b[alive, at:n]).sum(1)
        alive, at = alive[equal[alive] >= m], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def signed(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null if empty), signature, keys."""

    def sign(batches):
        room = np.empty((hashes_for(threshold), 512), "u4")
        for batch in batches:
            n, digest, sig, keys = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text)
                n.append(len(found))
                if len(found):
                    s = signature(found, room)
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sig.append(s.tobytes())
                    keys.append(band_keys(s))
                else:
                    digest.append(None)
                    sig.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "signature", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, found (array of shingle hashes) of the documents in ``ids``."""

    def make(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.sort(shingles(t).view("i8")) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))], names=["node", "found"])

    return texts_of(docs, ids).mapInArrow(make, "node long, found array<long>")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, text of the documents whose doc_id is in ``ids`` (node); texts are shuffled only if the ids are too many to broadcast."""
    ids = written(ids, "ids")
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs a, b (distinct) that are links, on their full sets."""

    def prune(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u4").reshape(-1, hashes_for(threshold)) for c in ("sa", "sb"))
            keep = pa.array(survives(a, b, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    sig = reps.select("node", "signature", "n_shingles")
    two = pairs.join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
    two = two.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
    two = two.where(NUMBER * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    left = written(two.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long"), "survivors")
    full = sets_of(docs, left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    full = written(full, "sets")
    both = left.join(full.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b").join(full.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a")
    common = F.size(F.array_intersect("fa", "fb"))
    # Pairs are distinct already; an aggregate here would keep Spark from splitting the rows of a star's centre.
    links = written(both.where(NUMBER * common >= threshold * (F.size("fa") + F.size("fb") - common)).select("a", "b"), "links")
    release(left, full)
    return links


def blocks_of(placed: DataFrame) -> DataFrame:
    """key, block, node, component: the rows of each block of the buckets that hold several components.

    Members in the component of the bucket's first member are chunks of kind C, the others of kind X. Blocks are each C with each X
    and each two X; a small bucket is one block.
    """
    home = F.max(F.when(F.col("node") == F.col("first"), F.col("component"))).alias("home")
    stats = placed.groupBy("key").agg(home, F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    mixed = placed.join(stats.where("low < high").select("key", "home", "n"), "key").withColumn("at_home", F.col("component") == F.col("home"))
    sides = mixed.groupBy("key").agg(F.sum(F.when(F.col("at_home"), 1).otherwise(0)).alias("nc"), F.sum(F.when(F.col("at_home"), 0).otherwise(1)).alias("nx"))
    d = mixed.join(sides.select("key", F.ceil(F.col("nc") / CHUNK).cast("int").alias("kc"), F.ceil(F.col("nx") / CHUNK).cast("int").alias("kx")), "key")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("at_home"), F.col("kc")).otherwise(F.col("kx"))).cast("int")
    d = d.select("key", "node", "component", "n", "at_home", "kc", "kx", mine.alias("mine"))
    all_x, all_c = F.sequence(F.lit(0), F.col("kx") - 1), F.sequence(F.lit(0), F.col("kc") - 1)
    number = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    home_blocks = F.transform(all_x, lambda j: F.concat(F.lit("c"), number(F.col("mine"), j)))
    x_blocks = F.concat(F.transform(all_c, lambda c: F.concat(F.lit("c"), number(c, F.col("mine")))), F.transform(all_x, lambda j: F.concat(F.lit("x"), number(F.least(j, F.col("mine")), F.greatest(j, F.col("mine"))))))
    block = F.when(F.col("n") <= CHUNK, F.array(F.lit(""))).when(F.col("at_home"), home_blocks).otherwise(x_blocks)
    return d.select("key", F.explode(block).alias("block"), "node", "component")


def across(placed: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links a, b between different components of the same bucket: enough of them to join all that are linked.

    Blocks hold the low 32 bits of the shingles' hashes, in which no common shingle is missed; what looks like a link there is verified
    on the full sets.
    """
    rows = written(blocks_of(placed), "blocks")

    def shorten(batches):
        for batch in batches:
            found = [np.sort(shingles(t).astype("u4")).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "found"])

    full = texts_of(docs, rows.select("node").distinct()).mapInArrow(shorten, "node long, found binary")
    full = written(full.join(reps.select("node", "signature"), "node"), "members")
    full_rows = rows.join(full, "node").repartition("key", "block").sortWithinPartitions("key", "block")

    def search(batches):
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            out = []
            if len(rows) < 2:
                return out
            nodes, comps = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            sigs = np.frombuffer(b"".join(r[4] for r in rows), "u4").reshape(len(rows), -1)
            keys = np.array([band_keys(x) for x in sigs])
            found = [np.frombuffer(r[5], "u4") for r in rows]
            sizes = np.array([len(f) for f in found])
            root = {c: c for c in comps.tolist()}
            band = np.argmax(keys[0] == rows[0][0])

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i in range(len(rows) - 1):
                j = i + 1 + np.flatnonzero(comps[i + 1 :] != comps[i])
                j = j[NUMBER * np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i])]
                j = j[~(keys[j, :band] == keys[i, :band]).any(1)]  # a pair is compared in the first band that it shares
                j = j[survives(sigs[j], np.broadcast_to(sigs[i], (len(j), sigs.shape[1])), threshold)]
                for k in j.tolist():
                    if top(comps[i].item()) != top(comps[k].item()):
                        common = (found[k][np.minimum(np.searchsorted(found[k], found[i]), sizes[k] - 1)] == found[i]).sum()
                        union = sizes[i] + sizes[k] - common
                        if NUMBER * common >= threshold * union:
                            out.append((nodes[i].item(), nodes[k].item()))
                            if NUMBER * (common - SLACK) >= threshold * (union + SLACK):
                                root[top(comps[i].item())] = top(comps[k].item())
            return out

        now, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != now:
                    out += links(rows)
                    now, rows = row[:2], []
                rows.append(row)
            yield _pairs(out)
        yield _pairs(links(rows))

    seen = full_rows.select("key", "block", "node", "component", "signature", "found").mapInArrow(search, "a long, b long")
    seen = written(seen.distinct(), "seen")
    release(rows, full)
    links = verified(seen, reps, docs, threshold)
    release(seen)
    return links


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, at a similarity of ``threshold`` hundredths or more.

    Null, empty and white-space-only texts have no shingles and are linked with nothing, and so are rows of null doc_id, whose
    component_id is null and which stay. Rows that repeat a doc_id count as one document that has the links of each. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    every = written(signed(docs, threshold), "signed")
    some = every.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "signature", "keys"), "doc_id").alias("x")).select("node", "digest", "x.*"), "reps")
    bands = reps.select("node", F.explode("keys").alias("key"))
    crowded = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("key", "first")
    buckets = written(bands.join(crowded, "key").select("key", "node", "first"), "buckets")
    stars = buckets.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(stars, reps, docs, threshold)
    found = written(components(links), "components")
    placed = buckets.join(found, "node", "left").select("key", "node", "first", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    release(buckets)
    more = across(placed, reps, docs, threshold)
    release(placed)
    if not more.isEmpty():
        found = written(components(links.unionAll(more)), "components")
    release(links, more)
    of = reps.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = every.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, threshold: int) -> DataFrame:
    """One row of docs of each group of near-duplicates, that of the smallest doc_id, then of the smallest number (null comes last).

    Every row is a document of its own, whatever its doc_id, and is dropped for its own text alone.
    """
    prepare(docs.sparkSession)
    row = fresh("row", docs)
    every = numbered(docs, row)
    found = written(near_groups(every.select(F.col(row).alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias(row), "component_id"), "groups")
    # A table of its own: next to an aggregate in the same stage, the rows of a very large group couldn't be split.
    several = written(found.where(F.col(row) != F.col("component_id")).select("component_id").distinct(), "several")
    members = found.join(several, "component_id").join(every.select(row, F.col("doc_id").cast("long").alias("own_id")), row)
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", F.col(row).alias("number"))).alias("x")).select(F.col("x.number").alias(row))
    return without(every, members.select(row).join(stays, row, "left_anti"), row)


def op6_minhash_near_dedup(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
component AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id,
       coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN component ON node = w.doc_id
"""
