"""A project: one catalog of Parquet tables in a shared folder, and the engine's commands over it.

A table's versions are folders of their own, and a snapshot is one small file that names a version of every table. A command works on the
snapshot that it began with, writes what it changes to new folders, and commits them all by the next snapshot's file, which only one
writer can make. A command that fails anywhere before leaves the former state; one that finds that others have changed what it read or
writes is run again.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from twinframe.operators import catalog, detect, diff, gate, identity, redaction, restore, score
from twinframe.plans import sanitize

TABLES = {
    "identities": "uuid string, scope_path string, entity_type string, real_name string, number bigint, alias string",
    "files": "file_id bigint, path string, checksum string, twin_path string, outcome string",
    "occurrences": "uuid string, file_id bigint, byte_start int, byte_end int",
    "redactions": "file_id bigint, byte_start int, byte_end int, secret_type string, match_idx string",
    "terms": "real_name string, entity_type string",
    "allowed": "number bigint, real_name string",
    "concepts": "uuid string, concept string",
    "audit": "id bigint, at timestamp, action string, count bigint",
    "keys": "id bigint, wrapped binary",
}
#: Columns that are sealed in a project with a passphrase, and the columns that name their rows.
SEALED = {"identities": ("real_name", "alias"), "terms": ("real_name", "entity_type"), "allowed": ("real_name", "number")}


class ExportRefused(Exception):
    """What the gate found: ``high_secrets`` credentials and ``leaks`` names are left in the twins or their paths."""

    def __init__(self, high_secrets: int, leaks: int):
        super().__init__(f"{high_secrets} secrets, {leaks} leaks")
        self.high_secrets, self.leaks = high_secrets, leaks


class Conflict(Exception):
    """Others have committed changes to what a command read or writes."""


#: Times that a command is run before a conflict is given up, and snapshots whose tables are kept for those who still read them.
ATTEMPTS, KEPT = 4, 2


def atomic(command):
    """Makes a command one transaction: all of its tables change at once, or none does."""

    @functools.wraps(command)
    def run(self, *args, **named):
        for attempt in range(ATTEMPTS):
            try:
                with self.transaction():
                    return command(self, *args, **named)
            except Conflict:
                if self._open is not None or attempt == ATTEMPTS - 1:
                    raise

    return run


class Project:
    """With a passphrase, names are stored sealed by a random key that the passphrase wraps; the catalog then opens with that alone."""

    def __init__(self, spark: SparkSession, root: str, passphrase: str | None = None):
        self.spark, self.root, self._key, self._open = spark, root.rstrip("/"), None, None
        self._migrate()
        kept = self.table("keys").orderBy(F.desc("id")).first()
        if kept is None and passphrase is not None and "identities" not in self._snapshot()[1]:
            self._set_key(os.urandom(32), passphrase)
        elif kept is not None:
            if passphrase is None:
                raise ValueError("the catalog is sealed: it takes a passphrase")
            self._key = catalog.unwrap_key(spark, bytes(kept.wrapped), passphrase)

    @atomic
    def _set_key(self, key: bytes, passphrase: str) -> None:
        self.put("keys", self.spark.createDataFrame([(1, bytearray(catalog.wrap_key(self.spark, key, passphrase)))], TABLES["keys"]))
        self._key = key

    @atomic
    def passphrase(self, new: str) -> None:
        """Wraps the key anew; no table changes."""
        if self._key is None:
            raise ValueError("the catalog isn't sealed")
        self._set_key(self._key, new)
        self.log("passphrase", 1)

    @atomic
    def escrow(self, code: str) -> bytes:
        """The key wrapped by a recovery code, to be kept apart from the catalog."""
        if self._key is None:
            raise ValueError("the catalog isn't sealed")
        self.log("escrow", 1)
        return catalog.wrap_key(self.spark, self._key, code)

    @staticmethod
    def open_escrow(spark: SparkSession, root: str, blob: bytes, code: str, passphrase: str) -> Project:
        """Opens a catalog whose passphrase is lost, by what ``escrow`` gave, and sets a new passphrase."""
        p = Project.__new__(Project)
        p.spark, p.root, p._key, p._open = spark, root.rstrip("/"), catalog.unwrap_key(spark, blob, code), None
        if "identities" in p._snapshot()[1]:
            p.table("identities").agg(F.count("real_name")).first()  # fails for the key of another catalog
        p._set_key(p._key, passphrase)
        return p

    def context(self) -> DataFrame:
        return identity.context(self.table("identities"))

    @atomic
    def rotate_key(self, passphrase: str) -> None:
        """Seals every name by a new key, all at once. Hashes of secrets by the old one are cleared."""
        if self._key is None:
            raise ValueError("the catalog isn't sealed")
        tables = {name: sanitize.cut(self.table(name)) for name in SEALED}
        redactions = sanitize.cut(catalog.without_index(self.table("redactions")))
        self._set_key(os.urandom(32), passphrase)
        for name, df in tables.items():
            self.put(name, df)
        self.put("redactions", redactions)
        self.log("rotate-key", 1)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _snapshot(self) -> tuple[int, dict[str, str]]:
        """The number of the newest snapshot (0: none yet) and each table's folder in it."""
        fs, where = self._fs(f"{self.root}/_log")
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        last = max((int(n.split(".")[0]) for n in found if n.endswith(".json")), default=0)
        return (last, self._manifest(last)["tables"]) if last else (0, {})

    def _manifest(self, number: int) -> dict:
        fs, where = self._fs(f"{self.root}/_log/{number}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, tables: dict[str, str]) -> bool:
        """Makes a snapshot's file, whole or not at all; false where another writer has made it."""
        jvm, made = self.spark.sparkContext._jvm, f"{self.root}/_log/{uuid.uuid4().hex}.part"
        fs, part = self._fs(made)
        out = fs.create(part, False)
        out.write(bytearray(json.dumps({"schema": catalog.SCHEMA_VERSION, "tables": tables}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.valueOf("NONE")  # never over a file that is there
        try:
            context.rename(part, self._fs(f"{self.root}/_log/{number}.json")[1], how)
            return True
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    @contextmanager
    def transaction(self):
        """What is put inside is committed at its end, all at once; one within another is part of it."""
        if self._open is not None:
            yield
            return
        number, tables = self._snapshot()
        self._open = {"base": dict(tables), "tables": dict(tables), "read": set(), "written": set()}
        key = self._key
        try:
            yield
            work = self._open
            while work["written"]:
                now, latest = self._snapshot()
                others = {t for t in {*latest, *work["base"]} if latest.get(t) != work["base"].get(t)}
                if others & (work["read"] | work["written"]):
                    raise Conflict(", ".join(sorted(others)))
                if self._publish(now + 1, latest | {t: work["tables"][t] for t in work["written"]}):
                    self._drop_old(now + 1)
                    break
        except BaseException:
            self._key = key
            for name in self._open["written"]:
                fs, where = self._fs(f"{self.root}/{self._open['tables'][name]}")
                fs.delete(where, True)
            raise
        finally:
            self._open = None

    def _drop_old(self, number: int) -> None:
        """Deletes the tables that were in the snapshot before the last KEPT ones and are in none of these."""
        if number <= KEPT:
            return
        used = {f for n in range(number - KEPT + 1, number + 1) for f in self._manifest(n)["tables"].values()}
        for folder in set(self._manifest(number - KEPT)["tables"].values()) - used:
            fs, where = self._fs(f"{self.root}/{folder}")
            fs.delete(where, True)

    def _migrate(self) -> None:
        """Brings a catalog of an earlier schema up to this one: schema 1 had no snapshots, and a table was its newest committed version."""
        number, _ = self._snapshot()
        if number:
            if self._manifest(number)["schema"] > catalog.SCHEMA_VERSION:
                raise ValueError("the catalog was written by a later version")
            return
        tables = {}
        for name in TABLES:
            fs, where = self._fs(f"{self.root}/{name}")
            found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
            done = sorted(int(v[1:]) for v in found if v[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[1]))
            if done:
                tables[name] = f"{name}/v{done[-1]}"
        if tables:
            self._publish(1, tables)

    def table(self, name: str) -> DataFrame:
        """A table of the newest snapshot, or of the one that the open transaction began with and its own changes; empty where it has none."""
        if self._open is not None:
            self._open["read"].add(name)
        folder = (self._open["tables"] if self._open is not None else self._snapshot()[1]).get(name)
        if folder is None:
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.schema(self._stored(name)).parquet(f"{self.root}/{folder}")
        return self._opened(name, df)

    def _opened(self, name: str, df: DataFrame) -> DataFrame:
        return catalog.unsealed(df, name, *SEALED[name], self._key).drop(catalog.INDEX) if self._key and name in SEALED else df

    def named(self, name: str, value: str) -> DataFrame:
        """The rows of a table whose name is a value, in any case, or whose alias it is. Of a sealed table, nothing but these is opened."""
        folder = (self._open["tables"] if self._open is not None else self._snapshot()[1]).get(name)
        column = SEALED[name][0]
        is_alias = F.col("alias") == value if "alias" in StructType.fromDDL(TABLES[name]).names else F.lit(False)
        if not self._key or folder is None:
            return self.table(name).where((F.lower(column) == value.lower()) | is_alias)
        if self._open is not None:
            self._open["read"].add(name)
        df = self.spark.read.schema(self._stored(name)).parquet(f"{self.root}/{folder}")
        # Tables of before this index have none; their rows are opened.
        mine = F.col(catalog.INDEX).isNull() | (F.col(catalog.INDEX) == catalog.blind(value, self._key)) | is_alias
        return self._opened(name, df.where(mine)).where((F.lower(column) == value.lower()) | is_alias)

    def _stored(self, name: str) -> StructType:
        """A table's schema as it is stored: sealed columns are bytes."""
        schema = StructType.fromDDL(TABLES[name])
        closed = SEALED[name][0] if self._key and name in SEALED else None
        if closed:
            schema = schema.add(catalog.INDEX, "string")
        return StructType([StructField(f.name, BinaryType() if f.name == closed else f.dataType) for f in schema])

    @atomic
    def put(self, name: str, df: DataFrame) -> None:
        """Writes a new version of a table, which the transaction commits."""
        df = df.select(*StructType.fromDDL(TABLES[name]).names)
        if self._key and name in SEALED:
            df = catalog.sealed(catalog.indexed(df, SEALED[name][0], self._key), name, *SEALED[name], self._key)
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self._open["tables"][name] = folder
        self._open["written"].add(name)

    @atomic
    def log(self, action: str, count: int) -> None:
        audit = self.table("audit")
        last = audit.agg(F.max("id")).first()[0] or 0
        row = self.spark.range(1).select(F.lit(last + 1).cast("bigint").alias("id"), F.current_timestamp().alias("at"), F.lit(action).alias("action"), F.lit(count).cast("bigint").alias("count"))
        self.put("audit", audit.unionByName(row))

    # Settings: hundreds of rows, as people enter them.
    @atomic
    def term(self, name: str, entity_type: str) -> None:
        row = self.spark.createDataFrame([(name, entity_type)], TABLES["terms"])
        self.put("terms", catalog.upsert(self.table("terms"), row, "real_name"))

    @atomic
    def allow(self, name: str) -> None:
        have = self.table("allowed")
        if self.named("allowed", name).where(F.col("real_name") == name).isEmpty():
            last = have.agg(F.max("number")).first()[0] or 0
            self.put("allowed", have.unionByName(self.spark.createDataFrame([(last + 1, name)], TABLES["allowed"])))

    def _allowed(self) -> frozenset[str]:
        return frozenset(r.real_name for r in self.table("allowed").collect())

    def _terms(self) -> dict[str, str]:
        allowed = {r.real_name.lower() for r in self.table("allowed").collect()}
        return {r.real_name: r.entity_type for r in self.table("terms").collect() if r.real_name.lower() not in allowed}

    def scan(self, docs: DataFrame) -> DataFrame:
        """A dry run over docs (doc_id, path, text): doc_id, found, findings."""
        return sanitize.candidates(sanitize.redacted(docs), self._terms(), self._allowed()).select("doc_id", "found", "findings")

    @atomic
    def export(self, docs: DataFrame, key: bytes, strict: bool = False, before: DataFrame | None = None) -> DataFrame:
        """Twins of docs: doc_id, path, twin_path, twin, outcome, checksum, applied. Identities issued before keep their aliases; the catalog records the run.

        ``key`` hashes the secrets for the catalog and must be kept secret. Refuses, and records nothing, where a credential is left in a
        twin or, if ``strict``, a known name in a twin or a path. With ``before``, what an earlier export of this project returned, only texts
        that changed since, or that hold a name learned since, are done anew; names must not have been taken back meanwhile.
        """
        if before is None:
            twins, known = sanitize.export(docs, self._terms(), self.table("identities"), self._allowed())
        else:
            twins, known = sanitize.refresh(docs, before, self.table("identities"), self._terms(), self._allowed())
        known, twins = sanitize.cut(known), sanitize.cut(twins)
        paths = sanitize.twin_paths(docs.select("path").distinct(), known)
        out = sanitize.cut(twins.withColumn("checksum", F.sha2("source", 256)).drop("source").join(paths, "path", "left"))
        left = out.select(F.explode(redaction.scan(F.coalesce("twin", F.lit("")))).alias("x")).select("x.confidence")
        policy = gate.export_policy(left, self._leaks(out.select("doc_id", "path", F.col("twin").alias("text"), "twin_path"), known), strict).first()
        if policy.refused:
            raise ExportRefused(policy.high_secrets, policy.leaks)
        files = out.select(F.col("doc_id").alias("file_id"), "path", "checksum", "twin_path", "outcome")
        places = out.select(F.col("doc_id").alias("file_id"), F.explode("applied").alias("x")).select("file_id", F.col("x.s").alias("byte_start"), F.col("x.e").alias("byte_end"), F.col("x.r").alias("alias"))
        places = places.join(known.select("uuid", "alias"), "alias").drop("alias")
        index = redaction.secret_index(key)
        hits = docs.select(F.col("doc_id").alias("file_id"), F.explode(redaction.scan(F.coalesce("text", F.lit("")))).alias("x"))
        hits = hits.select("file_id", F.col("x.s").alias("byte_start"), F.col("x.e").alias("byte_end"), F.col("x.type").alias("secret_type"), index("x.t").alias("match_idx"))
        self.put("identities", known)
        for name, rows in (("occurrences", places), ("redactions", hits)):
            self.put(name, catalog.replace_by_file(self.table(name), rows, files))
        self.put("files", catalog.upsert(self.table("files"), files, "file_id"))
        self.log("export", out.count())
        return out.select("doc_id", "path", "twin_path", "twin", "outcome", "checksum", "applied", *(["redone"] if before is not None else []))

    def _leaks(self, twins: DataFrame, known: DataFrame) -> DataFrame:
        names = known.where(F.col("entity_type").isin(*detect.vocab.IDENTITY)).select("real_name").distinct()
        parts = [F.struct(F.lit("text").alias("part"), F.col("text").alias("t"))]
        if "twin_path" in twins.columns:
            parts.append(F.struct(F.lit("path").alias("part"), F.col("twin_path").alias("t")))
        each = twins.select("doc_id", F.explode(F.array(*parts)).alias("x")).select("doc_id", "x.part", F.col("x.t").alias("text"))
        found = gate.places(each, names, sorted(self._allowed())).select("doc_id", "part", F.explode("leaks").alias("x"))
        return found.select("doc_id", "part", "x.*")

    def verify(self, twins: DataFrame) -> DataFrame:
        """doc_id, part (text or path), real_name, matched, byte_start, byte_end, line, col: the catalog's names that twins (doc_id, text and, if
        there, twin_path) still hold. Refuses a catalog without any name."""
        known = self.table("identities")
        if known.where(F.col("entity_type").isin(*detect.vocab.IDENTITY)).isEmpty():
            raise ValueError("no names to look for: such a check can't fail")
        return self._leaks(twins, known)

    def _pairs(self) -> list[tuple[str, str]]:
        rows = self.table("identities").select("alias", "real_name").limit(detect.MAX_TERMS + 1).collect()
        if len(rows) > detect.MAX_TERMS:
            raise ValueError("too many names for one vocabulary; restore by scope")
        return [(r.alias, r.real_name) for r in rows]

    def restore(self, docs: DataFrame) -> DataFrame:
        return restore.restore_text(docs, self._pairs())

    def review(self, docs: DataFrame) -> DataFrame:
        return diff.review(docs, self._pairs())

    @atomic
    def resolve(self, alias: str, name: str, entity_type: str) -> None:
        self.put("identities", identity.resolve(self.table("identities"), alias, name, entity_type))
        self.log("resolve", 1)

    def rescan(self, docs: DataFrame) -> DataFrame:
        return catalog.changes(self.table("files"), docs.select("path", F.sha2("text", 256).alias("checksum")))

    def where(self, name: str) -> DataFrame:
        return catalog.locate(self.named("identities", name), self.table("occurrences"), self.table("files"), name)

    def secrets(self) -> DataFrame:
        return catalog.secret_sites(self.table("redactions"), self.table("files"))

    def unify(self) -> DataFrame:
        return identity.propose(self.table("identities"))

    @atomic
    def confirm(self, concept: str, uuids: list[str]) -> None:
        rows = self.spark.createDataFrame([(u, concept) for u in uuids], TABLES["concepts"])
        self.put("concepts", catalog.upsert(self.table("concepts"), rows, "uuid"))

    @atomic
    def rekey(self) -> int:
        """Renumbers all identities; returns how many aliases changed. Twins made before can't be restored any more."""
        d = sanitize.cut(identity.rekey(self.table("identities")))
        number = F.regexp_extract("new_alias", "([0-9]+)$", 1).cast("bigint")
        again = d.withColumn("number", number).withColumn("alias", F.col("new_alias")).drop("new_alias")
        self.put("identities", identity.confirm_concepts(again, self.table("concepts")))
        changed = again.where("changed").count()
        self.log("rekey", changed)
        return changed

    def recover(self) -> DataFrame:
        return identity.type_counts(self.table("identities"))

    def audit(self, n: int = 20) -> DataFrame:
        return catalog.last_entries(self.table("audit"), n)

    def backup(self, to: str) -> None:
        """Copies every table to another project's empty folder."""
        copy_tables(self.spark, self.root, to)

    @staticmethod
    def restore_backup(spark: SparkSession, backup: str, root: str) -> None:
        """Makes a catalog of a backup, in an empty folder; it opens with the passphrase that the backup had."""
        copy_tables(spark, backup, root)

    def report(self, labels: DataFrame, docs: DataFrame) -> DataFrame:
        """Scores a dry run over docs (doc_id, path, text) against labels (see sources.labels): type (null: all), tp, fp, fn, recall, precision."""
        found = self.scan(docs).join(docs.select("doc_id", "path"), "doc_id").select(F.col("path").alias("file"), F.explode("found").alias("x"))
        found = found.select("file", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.type").alias("type"), F.col("x.confidence").alias("confidence"))
        return score.corpus_report(found.where(F.col("confidence") >= detect.CONFIDENT), labels)


def copy_tables(spark: SparkSession, source: str, to: str) -> None:
    """Copies the newest version of every table, as it is stored, to an empty folder."""
    old, new = Project.__new__(Project), Project.__new__(Project)
    old.spark, old.root, new.spark, new.root = spark, source.rstrip("/"), spark, to.rstrip("/")
    old._migrate()
    if new._snapshot()[0]:
        raise FileExistsError(to)
    tables = old._snapshot()[1]
    for folder in tables.values():
        spark.read.parquet(f"{old.root}/{folder}").write.parquet(f"{new.root}/{folder}")
    if tables:
        new._publish(1, tables)
