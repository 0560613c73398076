"""Exact deduplication over a cuckoo-filter index of content digests.

Texts are equal when identical after ASCII white space is deleted. A text's key is the SHA-256 of that form; the index
holds a 16-bit fingerprint per live key in a cuckoo table, and each fingerprint slot points to the stored record, so a
filter hit is verified against the content of its bucket: the full 256-bit key. When an insertion runs out of kicks, the
table doubles and is refilled from the stored keys. A key takes some 300 bytes, so the index of a bucket of 250,000 keys takes 75 MB.

At scale, each map task folds its rows into a small index first, so a group of copies, however large, leaves one row per
task; those rows meet in the bucket that their key names, and one index per bucket settles the group.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import WHITE, documents, fresh, numbered, partitions, prepare, text_of, without, written

SLOTS = 4
MAX_KICKS = 500


class CuckooIndex:
    """Live keys (bytes of 16 or more, uniformly distributed) with a payload each: insert, get, delete."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.payload: list = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = 0
        self.false_hits = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.slots = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & self.mask
        return fp, one, self._other(one, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """The slot of a live key or -1. Every fingerprint hit is checked against the record it points to."""
        fp, one, two = self._places(key)
        for bucket in (one, two) if one != two else (one,):
            at = bucket * SLOTS
            if fp in self.prints[at : at + SLOTS]:
                for s in range(at, at + SLOTS):
                    if self.prints[s] == fp:
                        if self.keys[self.slots[s]] == key:
                            return s
                        self.false_hits += 1
        return -1

    def _put(self, record: int) -> bool:
        fp, bucket, two = self._places(self.keys[record])
        kicks = record
        for n in range(MAX_KICKS):
            for b in (bucket, two) if n == 0 else (bucket,):
                at = b * SLOTS
                for s in range(at, at + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.slots[s] = fp, record
                        return True
            kicks = kicks * 6364136223846793005 + 1442695040888963407 & 0xFFFFFFFFFFFFFFFF
            s = bucket * SLOTS + (kicks >> 33) % SLOTS
            fp, self.prints[s] = self.prints[s], fp
            record, self.slots[s] = self.slots[s], record
            bucket = self._other(bucket, fp)
        return False

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._empty(buckets)
            if all(self._put(r) for r, key in enumerate(self.keys) if key is not None):
                return

    def get(self, key: bytes):
        s = self._slot(key)
        return None if s < 0 else self.payload[self.slots[s]]

    def insert(self, key: bytes, payload) -> None:
        """Adds a key, or replaces the payload of a live one."""
        s = self._slot(key)
        if s >= 0:
            self.payload[self.slots[s]] = payload
            return
        if self.free:
            record = self.free.pop()
            self.keys[record], self.payload[record] = key, payload
        else:
            record = len(self.keys)
            self.keys.append(key)
            self.payload.append(payload)
        self.live += 1
        if self.live > 0.95 * SLOTS * (self.mask + 1) or not self._put(record):
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Removes a live key. An absent one whose fingerprint collides with a live one is left alone."""
        s = self._slot(key)
        if s < 0:
            return False
        record, self.prints[s] = self.slots[s], 0
        self.keys[record] = self.payload[record] = None
        self.free.append(record)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, p) for k, p in zip(self.keys, self.payload) if k is not None)


FOLDED = "digest binary, n_chars long, keep_id long, row long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("row", pa.int64()), ("group_size", pa.int64())])
#: Keys that an index of a map task holds before it hands them on.
LOCAL_KEYS = 200_000


def _rank(x: tuple) -> tuple:
    """Of (chars, id, row): the longer text, then the smaller id, then the smaller row number; a null id comes last."""
    return x[0], x[1] is not None, -(x[1] or 0), -x[2]


def _fold(limit: int | None):
    """Folds rows of FOLDED by key through a cuckoo index; with a limit, hands on what it has each time it holds so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            rows = [(k, *p) for k, p in index.items()]
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        index = CuckooIndex()
        for batch in batches:
            for key, chars, doc, row, n in zip(*(c.to_pylist() for c in batch.columns)):
                seen, new = index.get(key), (chars, doc, row)
                index.insert(key, (*new, n) if seen is None else (*max(seen[:3], new, key=_rank), seen[3] + n))
            if limit and index.live >= limit:
                yield from out()
                index = CuckooIndex()
        yield from out()

    return run


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (SHA-256 of the text without ASCII white space)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text_of()).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.regexp_replace(text_of(), f"{WHITE}+", ""), 256)).alias("digest"),
        *(["row"] if "row" in docs.columns else []),
    )


def groups(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row per key of ``digests`` (with row, a number of its own): the row that stays and the number of copies."""
    start = rows.select("digest", "n_chars", F.col("doc_id").alias("keep_id"), "row", F.lit(1).cast("long").alias("group_size"))
    local = start.mapInArrow(_fold(LOCAL_KEYS), FOLDED)
    return local.repartition(partitions(rows.sparkSession, n_rows, 250_000), "digest").mapInArrow(_fold(None), FOLDED)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars: one row for each row of docs.

    Null text counts as empty, and empty texts are copies of each other. Ties go to the smallest doc_id; a null doc_id loses
    to any other. Rows that repeat a doc_id and a text share one outcome. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = digests(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "digests")  # 60 bytes a document: the texts are read once
    group = groups(rows, rows.count()).select("digest", "keep_id", "group_size")
    return rows.join(group, "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, the same that exact_dedup keeps; of rows that also share the doc_id, one."""
    prepare(docs.sparkSession)
    row = fresh("row", docs)
    every = numbered(docs, row)
    rows = written(digests(every.select("doc_id", "text", F.col(row).alias("row"))), "digests")
    group = groups(rows, rows.count()).select(F.col("row").alias(row))
    return without(every, rows.select(F.col("row").alias(row)).join(group, row, "left_anti"), row)


INDEX = "bucket int, digest binary, doc_id long, n_chars long"


def build_index(docs: DataFrame, buckets: int) -> DataFrame:
    """The stored keys of an index over ``docs``, one row per document, dealt to ``buckets`` by key."""
    return digests(docs).select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest", "doc_id", "n_chars")


def lookup(index: DataFrame, docs: DataFrame, deleted: DataFrame | None, buckets: int) -> DataFrame:
    """doc_id, known: whether a live document of the index has the text of each document of ``docs``.

    ``deleted`` holds doc_id of index rows to delete first. Each bucket loads its live digests, counted per key, into a cuckoo
    filter, applies the deletions and answers its share of the queries.
    """
    live = index.select("bucket", "digest", F.lit(1).alias("op")).groupBy("bucket", "digest", "op").agg(F.count("*").alias("n"))
    live = live.withColumn("doc_id", F.lit(None).cast("long"))
    parts = live
    if deleted is not None:
        gone = index.join(deleted.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_semi")
        gone = gone.groupBy("bucket", "digest").agg(F.count("*").alias("n"))
        parts = parts.unionByName(gone.select("bucket", "digest", F.lit(2).alias("op"), "n", F.lit(None).cast("long").alias("doc_id")))
    ask = build_index(docs, buckets).select("bucket", "digest", F.lit(3).alias("op"), F.lit(0).cast("long").alias("n"), "doc_id")
    parts = parts.unionByName(ask).repartition(max(1, min(buckets, 4096)), "digest").sortWithinPartitions("op")

    def answer(batches):
        cuckoo = CuckooIndex()
        for batch in batches:
            rows = batch.to_pydict()
            ids, known = [], []
            for key, op, n, doc in zip(rows["digest"], rows["op"], rows["n"], rows["doc_id"]):
                have = cuckoo.get(key)
                if op == 1:
                    cuckoo.insert(key, (have or 0) + n)
                elif op == 2 and have is not None:
                    cuckoo.insert(key, have - n) if have > n else cuckoo.delete(key)
                elif op == 3:
                    ids.append(doc)
                    known.append(have is not None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(known, pa.bool_())], names=["doc_id", "known"])

    return parts.mapInArrow(answer, "doc_id long, known boolean")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, length(text) AS n, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM t),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
