"""Stupid-backoff scores: n-gram count tables, partitioned by hash, joined to the exploded n-grams and summed per document.

With c the counts over the corpus, a token w after the words u v scores c(u v w) / c(u v) where the corpus has u v w, else 0.4 times what
it scores after v alone, and at last c(w) / N; N is the count of the empty n-gram. Every n-gram of every order counts, however rare.

Texts are exploded in batches. Of each batch, every distinct n-gram goes once, as its 64-bit hash with the batch's count, to the hash
partition that owns it, so a frequent n-gram costs as many entries as there are batches, never one per occurrence. A partition adds the
counts up to its part of the tables, joins them to the batches' n-grams, and answers each batch with the counts in ascending order of
hash. The batch's own words travel along, as numbers; with the answers, each token is scored and each document summed.

An entry of a shuffle holds all that one batch and one partition exchange. Batches are numbered by task and order, the same in a retry of a
table scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import documents, prepare

BACKOFF = 0.4
#: Words and documents of a batch, and bytes of text whose n-grams a hash partition owns, on average.
BATCH_WORDS, BATCH_DOCS, PART_BYTES = 1_000_000, 100_000, 24_000_000
#: Spark tasks of a shuffle at most; a task takes its hash partitions one after another.
MAX_TASKS = 20_000
CACHE_WORDS = 200_000

_words: dict[bytes, int] = {}


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words: ASCII-lower-cased runs without ASCII white space."""
    parts = (text or b"").lower().split()
    if len(_words) > CACHE_WORDS:
        _words.clear()
    for w in parts:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, parts), "u8", len(parts))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(one: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of the n-grams of each order from 1 that end at a position; place is a word's place in its document."""
    out = [(np.arange(len(one)), one)]
    full = one
    for k in range(2, order + 1):
        full = np.r_[full[:0], np.zeros(min(1, len(full)), "u8"), pair_hash(full[:-1], one[1:])]
        at = np.flatnonzero(place >= k - 1)
        out.append((at, full[at]))
    return out


def token_scores(counts: list[np.ndarray], place: np.ndarray, total: int) -> np.ndarray:
    """The logarithm of each token's score. counts[k] is the count of the (k + 1)-gram that ends at a position.

    A word that the corpus lacks counts as 0.4 of an occurrence.
    """
    score = np.log(np.maximum(counts[0], BACKOFF)) - math.log(max(total, 1))
    for k in range(1, len(counts)):
        known = counts[k] > 0
        before = np.r_[np.ones(min(1, len(score))), counts[k - 1][:-1]]
        hit = np.log(np.maximum(counts[k], 1)) - np.log(np.maximum(before, 1))
        score = np.where(known, hit, np.where(place >= k, score + math.log(BACKOFF), score))
    return score


ROWS = "p long, kind int, batch long, a binary, b binary, c binary"
_ROWS = pa.schema([("p", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
#: Kinds of rows: a batch's words; n-grams that are counted and asked for, only counted, only asked for; answers.
WORDS, BOTH, COUNT, ASK, ANSWER = range(5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _ROWS)], schema=_ROWS)


def _press(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones: the higher bytes of small numbers take next to nothing."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).view("u1").reshape(-1, x.itemsize).T.tobytes())


def _unpress(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _split_keys(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as their low 48 bits, which don't compress, and their high 16, which do."""
    four = keys.astype("<u8").view("<u2").reshape(-1, 4)
    return four[:, :3].tobytes(), _press(four[:, 3])


def _join_keys(low: bytes, high: bytes) -> np.ndarray:
    top = _unpress(high, "<u2")
    return np.hstack([np.frombuffer(low, "<u2").reshape(-1, 3), top[:, None]]).view("<u8").ravel()


def exploded(docs: DataFrame, order: int, n_parts: int, kind: int) -> DataFrame:
    """The rows of each batch of docs: its n-grams by hash partition and, unless they are only counted, its words."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        number, size, texts, ids = 0, 0, [], []

        def out():
            batch, lens = task + number, np.array([len(t) for t in texts], "i8")
            one = np.concatenate([*texts, np.empty(0, "u8")])
            place = np.arange(len(one)) - np.repeat(np.cumsum(lens) - lens, lens)
            keys, runs = np.unique(np.concatenate([h for _, h in grams(one, place, order)]), return_counts=True)
            keys, runs = np.r_[np.zeros(1, "u8"), keys], np.r_[len(one), runs]  # 0: the empty n-gram
            part = (keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
            rows = [(int(part[a]), kind, batch, *_split_keys(keys[a:b]), _press(runs[a:b])) for a, b in zip(cuts, cuts[1:])]
            if kind != COUNT:
                words, at, often = np.unique(one, return_inverse=True, return_counts=True)
                rank = np.argsort(-often, kind="stable")  # frequent words get small numbers
                number_of = np.empty(len(rank), "u4")
                number_of[rank] = np.arange(len(rank), dtype="u4")
                nulls = np.array([d is None for d in ids], "u1")
                about = np.array([d or 0 for d in ids], "i8").tobytes() + lens.tobytes() + nulls.tobytes()
                rows.append((((task >> 32) + number) % n_parts, WORDS, batch, words[rank].tobytes(), _press(number_of[at]), about))
            return _rows(rows)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = word_hashes(text)
                if ids and (size + len(found) > BATCH_WORDS or len(ids) >= BATCH_DOCS):
                    yield out()
                    number, size, texts, ids = number + 1, 0, [], []
                texts.append(found)
                ids.append(doc)
                size += len(found)
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def _answered(batches):
    """Adds up the counts of a hash partition and joins them to the n-grams that are asked for; words pass through."""
    now, rows = None, []

    def out():
        keys = [_join_keys(r[3], r[4]) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        runs = np.concatenate([np.zeros(len(k)) if r[1] == ASK else _unpress(r[5], "<i8") for r, k in zip(rows, keys)])
        counts = np.bincount(at, runs)[at].astype("<i8")
        ends = np.cumsum([len(k) for k in keys]).tolist()
        return _rows([(r[0], ANSWER, r[2], _press(counts[a:b]), None, None) for r, a, b in zip(rows, [0, *ends], ends) if r[1] != COUNT])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] == WORDS:
                yield _rows([row])
                continue
            if row[0] != now:
                if rows:
                    yield out()
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield out()


SCORES = "doc_id long, n_tokens long, log_score double, log_mean double"


def _scored(order: int):
    def run(batches):
        now, rows = None, []

        def out():
            words, at, about = rows[0][3:]
            n = len(about) // 17
            ids, lens, nulls = np.frombuffer(about, "i8", n), np.frombuffer(about, "i8", n, 8 * n), np.frombuffer(about, "u1", n, 16 * n)
            one = np.frombuffer(words, "u8")[_unpress(at, "<u4")]
            place = np.arange(len(one)) - np.repeat(np.cumsum(lens) - lens, lens)
            found = grams(one, place, order)
            answers = np.concatenate([_unpress(r[3], "<i8") for r in rows[1:]])
            keys, back = np.unique(np.concatenate([h for _, h in found]), return_inverse=True)
            if rows[0][1] != WORDS or len(answers) != len(keys) + 1:
                raise ValueError("a batch of texts came out otherwise in a retry: score a stored table")
            each, counts, begun = answers[1:][back], [], 0
            for positions, h in found:
                full = np.zeros(len(one), "i8")
                full[positions] = each[begun : begun + len(h)]
                counts.append(full)
                begun += len(h)
            sums = np.bincount(np.repeat(np.arange(n), lens), token_scores(counts, place, int(answers[0])), n).astype("f8")
            mean = np.divide(sums, lens, out=np.zeros(n), where=lens > 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), pa.array(lens), pa.array(sums), pa.array(mean)], names=["doc_id", "n_tokens", "log_score", "log_mean"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] != now:
                    if rows:
                        yield out()
                    now, rows = row[2], []
                rows.append(row)
        if rows:
            yield out()

    return run


def lm_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, log_score (natural logarithm, summed over tokens), log_mean (per token).

    Counts are those of ``corpus`` (a table with ``text``), or of docs themselves; there nothing backs off but by a word that begins a
    document. Null and empty texts have no tokens and score 0 for both. Every row is scored for itself, and counts for the corpus, also
    if it repeats a doc_id or has none. An empty table gives an empty result; with an empty corpus all words are unknown.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = corpus is None
    texts = docs.select("text") if own else docs.select("text").unionAll(corpus.select("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    tasks = min(n_parts, MAX_TASKS)
    rows = exploded(docs, order, n_parts, BOTH if own else ASK)
    if not own:
        rows = rows.unionAll(exploded(corpus.select(F.lit(None).alias("doc_id"), "text"), order, n_parts, COUNT))
    counted = rows.repartitionById(tasks, F.expr(f"int(p % {tasks})")).sortWithinPartitions("p", "kind", "batch").mapInArrow(_answered, ROWS)
    slot = F.expr(f"int(((batch >> 32) + (batch & 4294967295)) % {tasks})")
    return counted.repartitionById(tasks, slot).sortWithinPartitions("batch", "kind", "p").mapInArrow(_scored(order), SCORES)


def op10_lm_scores(spark, sf_dir):
    scores = lm_scores(documents(spark, sf_dir))
    return scores.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("log_mean", 6).alias("log_mean"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM w),
p AS (SELECT t.*, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
one AS (SELECT w, count(*) AS c FROM t GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT p.doc_id, CASE WHEN p.v IS NULL THEN ln(b.c / n.n) WHEN two.c IS NOT NULL THEN ln(two.c / a.c) ELSE ln(0.4 * b.c / n.n) END AS x
  FROM p JOIN one b ON b.w = p.w LEFT JOIN one a ON a.w = p.v LEFT JOIN two ON two.v = p.v AND two.w = p.w CROSS JOIN n)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_tokens, round(coalesce(sum(s.x), 0), 4) AS log_score,
       round(coalesce(sum(s.x) / len(w.w), 0), 6) AS log_mean
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, len(w.w)
"""
