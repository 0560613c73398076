"""Bounded-space online best-fit packing of token pieces into sequences.

A packer keeps a fixed number of open bins and a bitset with one bit per amount of free space; best fit is the lowest set bit at
or above the piece's length. When a new bin is due and all are open, the fullest one closes. Packers are independent, so they run
side by side, each over its share of the pieces, in an order fixed by a hash of the piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm import tokens
from twinframe.llm.common import documents, prepare, text_of, written

CAPACITY = 2048
OPEN_BINS = 1024
#: Tokens that one packer takes; each packer leaves at most its open bins part-filled.
PACKER_TOKENS = 32_000_000
END_ID = 0


class BestFit:
    """place(length) -> (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free places
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.n_open = self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            number, free = self.bins, self.capacity
            self.bins += 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        of = self.by_free[free]
        number = of.pop()
        if not of:
            self.bits &= ~(1 << free)
        return number


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the end id, cut only where longer than a sequence."""

    def cut(batches):
        import numpy as np

        enc = tokens.encoder(tokenizer)
        end, most = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield _batch(out, PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens. A sequence's pieces lie gapless from offset 0."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // packer_tokens))
    dealt = parts.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)).cast("long"))
    dealt = dealt.repartition(packers, "packer").sortWithinPartitions("packer", F.xxhash64("ids_crc32", "piece", "doc_id"), "doc_id", "piece", "ids_crc32")

    def run(batches):
        now, bins = None, None
        for batch in batches:
            out = []
            for *row, packer in zip(*(c.to_pylist() for c in batch.columns)):
                if packer != now:
                    now, bins = packer, BestFit(capacity, open_bins)
                number, offset = bins.place(row[3])
                out.append((*row, (packer << 40) + number, offset))
            yield _batch(out, PACKED)

    return dealt.select(*PIECES.names, "packer").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed as often as they occur; a null doc_id is kept.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    parts = written(pieces(docs, tokenizer or tokens.default_path(), capacity, end_id), "pieces")  # 30 bytes a piece: texts are encoded once
    return pack(parts, capacity, open_bins)


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
