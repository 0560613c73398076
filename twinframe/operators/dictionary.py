"""A dictionary of any size against texts: an index of patterns by piece, joined to the pieces that texts hold.

A pattern is filed under one of its pieces, six characters in a row (the whole pattern, if shorter): the one that fewest patterns have. Texts
look their pieces up in a Bloom filter of those that are filed, and the few that pass are joined to the patterns by hash. So every text
meets the patterns that may stand in it, and the caller settles these in place, leftmost longest, as it would with all of them: a pattern
that doesn't occur in a text changes nothing there. Neither the patterns nor the texts are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 6
#: Bits of the filter for each filed piece, and most bits of all (32 MB; with more pieces it lets more through, and loses none).
BITS_EACH, MAX_BITS = 16, 1 << 28
_FACTOR, _MIX = np.uint64(0x100000001B3), np.uint64(0xFF51AFD7ED558CCD)


def hashes(text: str, size: int) -> np.ndarray:
    """The 64-bit hash of each piece of so many characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    h = np.full(n, size + 0x9E3779B97F4A7C15, "u8")
    for k in range(size):
        h = (h ^ codes[k : k + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(31))


def filed(patterns: DataFrame) -> DataFrame:
    """patterns (pattern, distinct and not empty, and any other columns) with size and piece: the length and the hash that each is filed under."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("pattern").to_pylist()
            sizes = [min(len(t), PIECE) for t in texts]
            found = [np.unique(hashes(t, n)).view("i8") for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["pattern", "size", "pieces"])

    each = patterns.select("pattern").mapInArrow(pieces, "pattern string, size int, pieces array<long>").select("pattern", "size", F.explode("pieces").alias("piece"))
    common = each.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = each.join(common, "piece").groupBy("pattern").agg(F.min(F.struct("n", "piece", "size")).alias("x")).select("pattern", "x.size", "x.piece")
    return patterns.join(rarest, "pattern")


def bloom(index: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter of an index's pieces, as 64-bit words, and the lengths of its pieces (six at most). What comes here has a bound: MAX_BITS."""
    n, sizes = index.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()
    bits = 1 << min(max(int(n) * BITS_EACH, 1024) - 1, MAX_BITS - 1).bit_length()
    words = np.zeros(bits >> 6, "u8")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(batch.column("piece").to_numpy(zero_copy_only=False).view("u8"), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view("i8")), pa.array((np.uint64(1) << (at & np.uint64(63))).view("i8"))], names=["word", "mask"])

    set_ = index.select("piece").mapInArrow(places, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    for batch in set_.toArrow().to_batches():
        words[batch.column("word").to_numpy(zero_copy_only=False)] = batch.column("mask").to_numpy(zero_copy_only=False).view("u8")
    return words, list(sizes)


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32) ^ h * _FACTOR) & mask


def candidates(texts: DataFrame, index: DataFrame, fold) -> DataFrame:
    """row and the columns of ``index`` but size and piece: each pattern of the index whose piece stands in the text of a row, after ``fold``.

    texts: row, text. A row with many patterns is many rows here; a frequent piece is a key with many rows on one side alone.
    """
    words, sizes = bloom(index)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    bits = len(words) << 6

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                for size in sizes if text else ():
                    h = hashes(fold(text), size)
                    one, two = _probes(h, bits)
                    here = np.unique(h[(_bit(words, one) & _bit(words, two)).astype(bool)])
                    rows += [row] * len(here)
                    found.append(here.view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate([*found, np.zeros(0, "i8")]))], names=["row", "piece"])

    met = texts.select("row", "text").mapInArrow(pieces, "row long, piece long")
    return met.join(index, "piece").drop("piece", "size").distinct()


def _bit(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
