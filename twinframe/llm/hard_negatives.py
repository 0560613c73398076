"""Hard negatives by maximum inner product over k-means inverted lists, exact by bounds on each list.

Centroids are fitted on a bounded sample; every row is put in the list of its nearest one, and the list keeps the largest distance to its
centroid over all its rows, its radius. For a query q, a list's scores lie within |q| times the radius of q times the centroid
(Cauchy-Schwarz). A query visits lists by upper bound, highest first, in rounds that grow; it passes over lists whose scores all lie outside
its windows, and stops once the next bound is strictly below its kth score, as a score equal to that could still win by its smaller id.

Lists are cut into blocks of vectors, and the queries that visit a list into chunks; one matrix product takes a chunk and a block. Blocks,
not lists, are the keys of the join, so that a list of any size is many tasks. A product passes on k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.common import partitions, prepare, table, written

#: Rows that centroids are fitted on, most centroids, and rounds of the fit.
SAMPLE, CENTROIDS, FITS = 32_768, 1_024, 10
#: Vectors of a block.
BLOCK = 2_048
#: Lists that a query visits in each round but the last, which takes all that may matter.
ROUNDS = (8, 64)
#: Scores up to which products of doubles are exact.
EXACT = 1 << 53
LOW, HIGH = -(1 << 62), 1 << 62
FOUND = "query long, w int, score long, vec_id long"


def fit(rows: np.ndarray, k: int) -> np.ndarray:
    """k centroids or fewer of the rows, the same ones for the same rows."""
    rng = np.random.default_rng(0)
    start = np.unique(rows, axis=0)
    centroids = start[rng.permutation(len(start))[:k]].astype("f8")
    for _ in range(FITS):
        near = nearest(rows, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it (the true one: how it was chosen doesn't matter)."""
    near = np.argmax(rows @ centroids.T - (centroids**2).sum(1) / 2, axis=1)
    return near, np.sqrt(((rows - centroids[near]) ** 2).sum(1))


def _matrix(cells: list, dim: int) -> np.ndarray:
    """Lists of integers as rows of doubles; shorter ones end in zeros."""
    out = np.zeros((len(cells), dim))
    for k, c in enumerate(cells):
        out[k, : len(c)] = c
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; those beyond 62 bits are the limit."""
    if a.size and b.size and np.abs(a).max() * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        return np.clip(a.astype(object) @ b.astype(object).T, LOW, HIGH).astype("i8")
    return (a.astype("f8") @ b.astype("f8").T).astype("i8")


class Index:
    """Inverted lists of vectors: blocks (a table), and centroids, radii and sizes of the lists (at most 1,024)."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, vec (array of long), query (whether it is one)."""
        spark = rows.sparkSession
        size = rows.agg(F.count("*"), F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
        self.n, self.dim = size[0], max(size[2] or 0, 1)
        self.kind = next(d for d in ("<i2", "<i4", "<i8") if (size[1] or 0) < 1 << 8 * int(d[2]) - 1)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
        k = int(min(CENTROIDS, max(1, self.n**0.5)))
        self.centroids = fit(_matrix([r.vec for r in sample], self.dim), k) if sample else np.zeros((1, self.dim))
        centroids, dim, kind = self.centroids, self.dim, self.kind

        def assign(batches):
            for batch in batches:
                vecs = _matrix(batch.column("vec").to_pylist(), dim)
                near, far = nearest(vecs, centroids)
                vec = pa.array([v.tobytes() for v in (vecs.astype(kind) if kind != "<i8" else _longs(batch, dim))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype("i4")), pa.array(far), *(batch.column(c) for c in ("vec_id", "label", "query")), vec], names=["list", "far", "vec_id", "label", "query", "vec"])

        placed = rows.mapInArrow(assign, "list int, far double, vec_id long, label long, query boolean, vec binary")
        self.rows = written(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
        self.radii, self.sizes = np.zeros(len(centroids)), np.zeros(len(centroids), "i8")
        for r in self.rows.groupBy("list").agg(F.max("far"), F.count("*")).collect():
            self.radii[r[0]], self.sizes[r[0]] = r[1] * (1 + 1e-9) + 1e-9, r[2]
        parts = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(self.sizes.tolist())], "list int, blocks int")
        self.parts = F.broadcast(parts)  # a row for each list
        dealt = self.rows.join(self.parts, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        dealt = dealt.repartition(partitions(spark, self.n, 250_000), "list", "block").sortWithinPartitions("list", "block", "vec_id", "row")
        packed = dealt.select("list", "block", "vec_id", "row", "label", "vec").mapInArrow(_packed, "list int, block int, ids binary, rows binary, labels binary, vecs binary")
        self.blocks = written(packed, "blocks")

    def queries(self) -> DataFrame:
        return self.rows.where("query").select(F.col("row").alias("query"), "vec_id", "label", "vec")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """query, w, score, vec_id: the first k rows by score, then smaller vec_id, for each window w of each query.

        queries: query (the number of its row), label, vec, windows (array of struct<w, lo, hi>, lowest and highest score). ``same``: rows of
        the query's label other than itself; else rows of other labels.
        """
        spark = queries.sparkSession
        found, done = spark.createDataFrame([], FOUND), 0
        for batch in (*ROUNDS, len(self.centroids)):
            if done >= len(self.centroids):
                break
            kth = found.groupBy("query", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            kth = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
            floor = lambda x: F.greatest(x["lo"], F.coalesce(F.try_element_at("kth", x["w"]), F.lit(LOW)))
            asked = queries.join(kth, "query", "left") if done else queries.withColumn("kth", F.create_map().cast("map<int,bigint>"))
            asked = asked.select("query", "label", "vec", F.transform("windows", lambda x: F.struct(x["w"].alias("w"), floor(x).alias("lo"), x["hi"].alias("hi"))).alias("windows"))
            visits = written(asked.mapInArrow(self._visits(done, batch), "list int, chunk binary, q_labels binary, q_vecs binary, windows binary"), "visits")
            each = visits.join(self.parts, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            new = each.join(self.blocks, ["list", "block"]).mapInArrow(self._scores(k, same), FOUND)
            first = Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id")
            best = found.unionByName(new).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
            found, done = written(best, "found"), done + batch
        return found

    def _visits(self, done: int, batch: int):
        """Chunks of queries for each list that they visit in this round: those from place ``done`` on in each query's order of bounds."""
        centroids, radii, sizes, kind = self.centroids, self.radii, self.sizes, self.kind

        def run(batches):
            for b in batches:
                vecs = np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(b.num_rows, -1).astype("f8")
                windows = _windows(b.column("windows").to_pylist())
                norm = np.sqrt((vecs**2).sum(1))[:, None]
                middle = vecs @ centroids.T
                slack = norm * (radii + np.sqrt((centroids**2).sum(1))) * 1e-9 + 1e-6  # more than rounding can take away
                top, bottom = middle + norm * radii + slack, middle - norm * radii - slack
                place = np.argsort(np.argsort(-top, axis=1, kind="stable"), axis=1)
                turn = (place >= done) & (place < done + batch) & (sizes > 0)
                # a list may hold a row in some window that beats, or ties with, the kth found there
                wanted = ((top[:, :, None] >= windows[:, None, :, 1]) & (bottom[:, :, None] <= windows[:, None, :, 2]) & (windows[:, None, :, 1] <= windows[:, None, :, 2])).any(2)
                ids = b.column("query").to_numpy(zero_copy_only=False).astype("i8")
                labels = b.column("label").to_numpy(zero_copy_only=False).astype("i8")
                raw = vecs.astype(kind) if kind != "<i8" else np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).reshape(b.num_rows, -1)
                out = []
                for i in np.flatnonzero((turn & wanted).any(0)).tolist():
                    q = np.flatnonzero(turn[:, i] & wanted[:, i])
                    out.append((i, ids[q].tobytes(), labels[q].tobytes(), raw[q].tobytes(), windows[q].tobytes()))
                for at in range(0, len(out), 64):
                    cells = list(zip(*out[at : at + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cells[1:])], names=["list", "chunk", "q_labels", "q_vecs", "windows"])

        return run

    def _scores(self, k: int, same: bool):
        dim, kind = self.dim, self.kind

        def run(batches):
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("chunk", "q_labels", "q_vecs", "windows", "ids", "rows", "labels", "vecs"))
                for chunk, q_labels, q_vecs, windows, ids, rows, labels, vecs in zip(*columns):
                    chunk, q_labels, ids, rows, labels = (np.frombuffer(x, "i8") for x in (chunk, q_labels, ids, rows, labels))
                    windows = np.frombuffer(windows, "i8").reshape(len(chunk), -1, 3)
                    score = dot(np.frombuffer(q_vecs, kind).reshape(-1, dim), np.frombuffer(vecs, kind).reshape(-1, dim))
                    fits = (q_labels[:, None] == labels) & (chunk[:, None] != rows) if same else q_labels[:, None] != labels
                    out = []
                    for j in range(windows.shape[1]):
                        w, lo, hi = (windows[:, j, x] for x in range(3))
                        ok = fits & (score >= lo[:, None]) & (score <= hi[:, None])
                        some = np.flatnonzero(ok.any(1))
                        if not len(some):
                            continue
                        q, at = _first(score[some], ok[some], k)
                        out.append((chunk[some[q]], w[some[q]].astype("i4"), score[some[q], at], ids[at]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query", "w", "score", "vec_id"])

        return run


def _first(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k scores of each row among those that are ok; ties go to the smaller column, whose vec_id is smaller."""
    if ok.shape[1] > k:
        kth = -np.partition(-np.where(ok, score, LOW), k - 1, axis=1)[:, k - 1]
        above = ok & (score > kth[:, None])
        level = ok & (score == kth[:, None])
        ok = above | level & (np.cumsum(level, axis=1) + above.sum(axis=1)[:, None] <= k)
    return np.nonzero(ok)


def _windows(cells: list) -> np.ndarray:
    """[query, window, (w, lo, hi)]; those of fewer windows get empty ones."""
    out = np.zeros((len(cells), max([len(c) for c in cells] + [1]), 3), "i8")
    out[:, :, 1] = 1
    for k, c in enumerate(cells):
        for j, x in enumerate(c):
            out[k, j] = x["w"], x["lo"], x["hi"]
    return out


def _longs(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, dim), "i8")
    for k, c in enumerate(batch.column("vec").to_pylist()):
        out[k, : len(c)] = c
    return out


def _packed(batches):
    """Sorted rows to one row for each block."""
    now, kept = None, []

    def row():
        ids, rows, labels, vecs = zip(*kept)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, *(np.array(c, "i8").tobytes() for c in (ids, rows, labels)), b"".join(vecs)), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["list", "block", "ids", "rows", "labels", "vecs"])

    for batch in batches:
        for lst, block, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (lst, block) != now:
                if kept:
                    yield row()
                now, kept = (lst, block), []
            kept.append(rest)
    if kept:
        yield row()


def vectors(rows: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label, vec, query of the rows that take part: those with an id, a label and a vector whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("query"))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, embedding) where ``anchor`` holds.

    A component is floor(256 x). Positives are the first rows of the anchor's label, itself left out; negatives the first rows of other
    labels whose score is from ``low`` to ``high`` hundredths of the positive's. Order is by score, then smaller vec_id.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. A vector that is shorter than others
    counts as ended by zeros. Rows that repeat a vec_id are rows each. A negative positive_score has no window. Components are
    64-bit integers; scores beyond 62 bits are the limit. Anchors without a positive or negative give no row; so does an empty table.
    """
    spark = rows.sparkSession
    prepare(spark)
    index = Index(vectors(rows, anchor))
    asked = index.queries()
    one = F.array(F.struct(F.lit(0).alias("w"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    near = index.search(asked.select("query", "label", "vec", one.alias("windows")), positives, True)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    near = near.select("query", place.alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near.where("positive_score >= 0"), "positives")
    window = F.struct("w", F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"), F.expr(f"positive_score * {high} div 100").alias("hi"))
    windows = near.groupBy("query").agg(F.array_sort(F.collect_list(window)).alias("windows"))  # one for each positive
    far = index.search(asked.select("query", "label", "vec").join(windows, "query"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id"))
    far = far.select("query", "w", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(far, ["query", "w"]).join(asked.select("query", F.col("vec_id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(d.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""
