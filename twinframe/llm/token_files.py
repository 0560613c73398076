"""Token ids in compressed binary files with a shared dictionary, and back.

File format, all integers little-endian: magic ``TFZ1``, SHA-256 of the dictionary (32 bytes), one zstandard frame per
document over its ids (unsigned 32-bit), then the index: per document doc_id (int64; the flag says if it is null), n_tokens
(uint64), frame offset (uint64), null flag (uint8), then the number of documents (uint64), the index's offset (uint64) and
the magic again. Any document is read with one seek. The dictionary is a file of its own beside them, named by its hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm import tokens
from twinframe.llm.common import documents, filesystem, new_path, partitions, prepare, text_of, written

MAGIC = b"TFZ1"
INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u8"), ("offset", "<u8"), ("null", "u1")])
TAIL = "<QQ4s"
TAIL_BYTES = struct.calcsize(TAIL)
#: The dictionary is trained on at most so many documents, those of smallest hash of doc_id, and so many bytes of ids of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1_024, 32 * 1024, 64 * 1024
#: Documents per file.
FILE_DOCS = 20_000
#: Files whose places are summed up in one task; only the sums of such bands of files meet in one.
BAND_FILES = 4_096
LEVEL = 3


def train(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary over serialized id arrays of a bounded sample. What is too little to train on is the dictionary itself."""

    def encode(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            ids = [x[:SAMPLE_BYTES] for x in enc.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = [r.doc_id for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()]
    known = F.col("doc_id").isin([d for d in least if d is not None])
    chosen = rows.where(known | F.col("doc_id").isNull() if None in least else known).mapInArrow(encode, "doc_id long, ids binary")
    arrays = [bytes(r.ids) for r in chosen.orderBy("doc_id", "ids").limit(SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, arrays)) // 8)), [x for x in arrays if len(x) >= 8], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICT_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def bounds_of(docs: DataFrame, files: int) -> list[float]:
    """Values of doc_id that cut the table into about equal ranges."""
    if files < 2:
        return []
    return sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / files for i in range(1, files)], 0.2 / files)))


MANIFEST = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, files: int | None = None) -> tuple[DataFrame, bytes]:
    """Writes all documents in ascending doc_id order (null first); returns the manifest file_no, path, n_docs, n_tokens and
    the dictionary. A retried task writes a file of another name; only the files of finished tasks are in the manifest."""
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer)
    files = files or partitions(spark, docs.count(), FILE_DOCS)
    bounds = np.array(bounds_of(docs, files))

    def encode(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x + end for x in enc.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            doc = batch.column("doc_id")
            no = np.searchsorted(bounds, doc.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())], names=["file_no", "doc_id", "n_tokens", "frame"])

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, now, stream, index, at = [], None, None, [], 0

        def close():
            data = np.array(index, INDEX).tobytes()
            stream.write(data + struct.pack(TAIL, len(index), at, MAGIC))
            stream.close()
            done.append((now, name, len(index), sum(x[1] for x in index)))

        for batch in batches:
            for no, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if no != now:
                    if stream:
                        close()
                    now, name, index = no, f"{folder}/{no:08d}-{uuid.uuid4().hex}.tfz", []
                    stream = fs.open_output_stream(filesystem(name)[1])
                    at = stream.write(MAGIC + hashlib.sha256(dictionary).digest())
                index.append((doc or 0, n, at, doc is None))
                at += stream.write(frame)
        if stream:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * 4, MANIFEST)], schema=MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encode, "file_no long, doc_id long, n_tokens long, frame binary")
    rows = rows.repartition(files, "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first())
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{hashlib.sha256(dictionary).hexdigest()}.dict") as out:
        out.write(dictionary)
    return written(rows.mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long"), "manifest"), dictionary


def read_document(path: str, k: int, dictionary: bytes) -> np.ndarray:
    """The ids of a file's k-th document: two short reads and one frame."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        index = read_index(f, dictionary)
        end = int(index["offset"][k + 1]) if k + 1 < len(index) else f.size() - TAIL_BYTES - index.nbytes
        f.seek(int(index["offset"][k]))
        frame = f.read(end - int(index["offset"][k]))
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    return np.frombuffer(press.decompress(frame, max_output_size=int(index["n_tokens"][k]) * 4), "<u4")


def read_index(f, dictionary: bytes) -> np.ndarray:
    """Checks the file's two marks and the dictionary's hash."""
    head = f.read(36)
    f.seek(f.size() - TAIL_BYTES)
    n, at, magic = struct.unpack(TAIL, f.read(TAIL_BYTES))
    if head[:4] != MAGIC or magic != MAGIC or head[4:] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    f.seek(at)
    return np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


def read_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, from the files alone."""
    spark = manifest.sparkSession
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    grouped = manifest.withColumn("band", F.floor(F.col("file_no") / BAND_FILES))
    bands = grouped.groupBy("band").agg(F.sum("n_tokens").alias("n_tokens")).select("band", before(Window.orderBy("band")).alias("start"))
    inside = grouped.select("band", "path", before(Window.partitionBy("band").orderBy("file_no")).alias("base"))
    files = inside.join(bands, "band").select("path", (F.col("base") + F.col("start")).alias("base"))

    def scan(batches):
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    index = read_index(f, dictionary)
                    ends = [*index["offset"][1:].tolist(), f.size() - TAIL_BYTES - index.nbytes]
                    f.seek(36)
                    crc = []
                    for at, end, n in zip(index["offset"].tolist(), ends, index["n_tokens"].tolist()):
                        crc.append(zlib.crc32(press.decompress(f.read(end - at), max_output_size=n * 4)))
                n = index["n_tokens"].astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"], mask=index["null"].astype(bool)), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return files.repartition(min(n, 100_000), "path").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs' ids to token files in the shared folder and returns what the files say: doc_id, start, n_tokens, ids_crc32.

    Null text has no ids but the end id. Rows of one doc_id keep all their documents, next to each other in no fixed order; a
    null doc_id sorts first. An empty table gives no file and an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    manifest, dictionary = write_files(docs, tokenizer or tokens.default_path(), new_path(spark, "tokens"), end_id)
    return read_files(manifest, dictionary)


def op7_token_files(spark, sf_dir):
    return write_and_read(documents(spark, sf_dir))
