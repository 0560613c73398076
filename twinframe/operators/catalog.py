"""Catalog tables: files, identities, occurrences, redactions and the audit log; rescans, upserts and lookups over them."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the catalog's layout: since 2, snapshots name the versions of tables.
SCHEMA_VERSION = 2


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed, modified or unchanged between two snapshots (path, checksum)."""
    a = before.select("path", F.col("checksum").alias("_old"))
    b = after.select("path", F.col("checksum").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def stale(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Recorded files whose content is no longer there."""
    return recorded.join(now.select("path", "checksum"), ["path", "checksum"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """All rows of the named files give way to new ones."""
    return old.join(files.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def locate(identities: DataFrame, occurrences: DataFrame, files: DataFrame, name: str | None = None) -> DataFrame:
    """Identities of a name (any case) or alias with their places; those without any are kept."""
    if name is not None:
        identities = identities.where((F.lower("real_name") == name.lower()) | (F.col("alias") == name))
    return identities.join(occurrences.join(files.select("file_id", "path"), "file_id"), "uuid", "left")


def secret_sites(redactions: DataFrame, files: DataFrame) -> DataFrame:
    return redactions.join(files.select("file_id", "path"), "file_id").select("path", "byte_start", "byte_end", "secret_type")


def last_entries(log: DataFrame, n: int, order: str = "id") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


# Keys never stand in a plan: a one-row table carries them to the expressions, and plans show its column's name alone.
SCRYPT = {"n": 1 << 14, "r": 8, "p": 1, "maxmem": 1 << 26}


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """A key of 32 bytes by scrypt, on the driver."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, dklen=32, **SCRYPT)


def subkey(key: bytes, purpose: str) -> bytes:
    """A key of its own for each purpose (such as the blind index), from which the master key can't be told."""
    return hmac.new(key, purpose.encode(), hashlib.sha256).digest()


def wrap_key(spark: SparkSession, data_key: bytes, passphrase: str) -> bytes:
    """salt, nonce and the data key sealed by a key of the passphrase: what a catalog stores. A new passphrase rewraps this alone."""
    salt, nonce = os.urandom(16), os.urandom(12)
    return salt + nonce + _gcm(spark, 1, derive_key(passphrase, salt), nonce, data_key)


def unwrap_key(spark: SparkSession, wrapped: bytes, passphrase: str) -> bytes:
    """The data key; raises ValueError for another passphrase."""
    from py4j.protocol import Py4JJavaError

    try:
        return _gcm(spark, 2, derive_key(passphrase, wrapped[:16]), wrapped[16:28], wrapped[28:])
    except Py4JJavaError as e:
        raise ValueError("wrong passphrase") from e


def _gcm(spark: SparkSession, mode: int, key: bytes, nonce: bytes, data: bytes) -> bytes:
    """AES-GCM on the driver's JVM: mode 1 seals, 2 opens."""
    crypto = spark.sparkContext._jvm.javax.crypto
    cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
    cipher.init(mode, crypto.spec.SecretKeySpec(bytearray(key), "AES"), crypto.spec.GCMParameterSpec(128, bytearray(nonce)))
    return bytes(cipher.doFinal(bytearray(data)))


def _keyed(df: DataFrame, key: bytes) -> DataFrame:
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(bytearray(key),)], "_key binary")), F.lit(True))


def _place(table: str, column: str, row: str) -> Column:
    return F.concat_ws(":", F.lit(table), F.lit(column), F.col(row).cast("string"))


def sealed(df: DataFrame, table: str, column: str, row: str, key: bytes) -> DataFrame:
    """Encrypts a text column by AES-GCM, bound to its table, column and row. The nonce is a keyed hash of place and text."""
    place = _place(table, column, row)
    nonce = F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", F.hex("_key"), place, column), 256), 1, 24))
    closed = F.aes_encrypt(F.col(column), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, place)
    return _keyed(df, key).withColumn(column, F.when(F.col(column).isNotNull(), closed)).drop("_key")


def unsealed(df: DataFrame, table: str, column: str, row: str, key: bytes) -> DataFrame:
    return _keyed(df, key).withColumn(column, F.aes_decrypt(F.col(column), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _place(table, column, row)).cast("string")).drop("_key")


#: The column by which rows of a sealed table are found without opening any.
INDEX = "name_idx"


def blind(value: str, key: bytes) -> str:
    """The blind index of a value: its HMAC, in lower case, by a key of its own."""
    return hmac.new(subkey(key, "blind index"), value.lower().encode(), hashlib.sha256).hexdigest()


def indexed(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """Adds the blind index of a text column. Equal values, in any case, have equal ones; nothing else can be told without the key."""
    own = subkey(key, "blind index").ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in own) for pad in (0x36, 0x5C))
    keys = F.broadcast(df.sparkSession.createDataFrame([(inner, outer)], "_inner binary, _outer binary"))
    inside = F.unhex(F.sha2(F.concat("_inner", F.encode(F.lower(column), "UTF-8")), 256))
    return df.join(keys, F.lit(True)).withColumn(INDEX, F.sha2(F.concat("_outer", inside), 256)).drop("_inner", "_outer")


def rotated(df: DataFrame, table: str, column: str, row: str, old: bytes, new: bytes) -> DataFrame:
    return sealed(unsealed(df, table, column, row, old), table, column, row, new)


def without_index(redactions: DataFrame) -> DataFrame:
    """Redactions after a rotation: hashes by the old key tell nothing any more, and the secrets they were made of aren't kept."""
    return redactions.withColumn("match_idx", F.lit(None).cast("string"))
