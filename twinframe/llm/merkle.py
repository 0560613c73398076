"""Merkle manifest of a dataset: one leaf a row, one tree per group of rows, one tree over the groups' roots.

Nodes live in external memory: Parquet tables, one folder per level. Leaves are sorted into runs by range, and a prefix scan over
the runs' counts gives each its coordinate. A row of a level is a page, all the nodes of that level above 4,096 consecutive
leaves, so a level is made by one pass over the level before it, without a shuffle; every fourth level, 4,096 pages' single nodes
are dealt into new pages. Proofs come from merge joins of the levels by page, from the root downwards: a page takes the path above
it, and its leaves add what lies within. No text is ever shuffled, no tree is ever in one place, and a group may hold any share
of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.llm.common import BROADCAST_IDS, ascii_lower, documents, new_path, partitions, prepare, written

#: Children of a node, levels that a page spans, and leaves of a page.
FANOUT, SPAN = 8, 4
PAGE = FANOUT**SPAN
#: Leaves of a run: 25 MB at some 100 bytes each.
RUN_ROWS = 250_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(column: Column) -> Column:
    """``-`` for null, else the value behind its length in UTF-8 bytes."""
    value = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(text: Column | None = None) -> Column:
    """The digest of a row of documents, or of that row with another text."""
    return F.unhex(F.sha2(F.concat(*(field(text if c == "text" and text is not None else F.col(c)) for c in FIELDS)), 256))


def _hex(node: Column) -> Column:
    return F.lower(F.hex(node))


def joined(nodes: Column) -> Column:
    """H of nodes in a row: the digest of their hexadecimal texts."""
    return F.sha2(F.array_join(F.transform(nodes, _hex), ""), 256)


@dataclass
class Tree:
    """The node store of the trees of all groups: a table a level, four levels a hop, from the leaves to one node a group."""

    levels: list[DataFrame]
    group: str
    keep: tuple[str, ...]
    tops: DataFrame

    def subroots(self) -> DataFrame:
        """group, node: the one node that remains of each group."""
        return self.tops

    def proofs(self, above: DataFrame) -> DataFrame:
        """group, the columns of ``keep``, node, path of every leaf, and the columns of ``above`` (group, path and others, one row a group).

        path is an array of struct<nodes, at>, a leaf's run and its place there, level by level up to the root.
        """
        up = above.withColumn("_page", F.lit(0).cast("long"))
        for hop in reversed(range(len(self.levels) // SPAN)):
            up = self._down(hop, up)
        return up

    def _down(self, hop: int, up: DataFrame) -> DataFrame:
        """From the paths above the pages of a hop to the paths above each of their nodes."""
        base, *others = self.levels[hop * SPAN : hop * SPAN + SPAN]
        same = lambda a, b: a[self.group].eqNullSafe(b[self.group]) & (a["_page"] == b["_page"])
        extra = [c for c in up.columns if c not in (self.group, "_page")]
        d = base.withColumnRenamed("nodes", "_0")
        for k, more in enumerate(others, 1):
            d = d.join(more, same(d, more)).select(*(d[c] for c in d.columns), more["nodes"].alias(f"_{k}"))
        d = d.join(up, same(d, up)).select(*(d[c] for c in d.columns), *(up[c] for c in extra))
        several = lambda k: F.col("_several") | (F.size(f"_{k}") > 1)
        some = lambda k, run: F.slice(f"_{k}", F.floor(run / FANOUT**k).cast("int") * FANOUT + 1, F.lit(FANOUT))

        def run(r: Column) -> Column:
            """The leaves of a run, and for each level above the run there and the place in it. Small, so that a leaf's row doesn't carry its page."""
            above = (F.when(several(k), F.struct(some(k, r).alias("nodes"), (F.floor(r / FANOUT ** (k - 1)) % FANOUT).cast("int").alias("at"))) for k in range(1, SPAN))
            return F.struct(F.slice("items", r * FANOUT + 1, F.lit(FANOUT)).alias("items"), F.when(several(0), some(0, r)).alias("nodes"), F.filter(F.array(*above), lambda x: x.isNotNull()).alias("above"))

        last = F.floor((F.size("items") - 1) / FANOUT).cast("int")
        d = d.select(self.group, *extra, F.explode(F.transform(F.sequence(F.lit(0), last), run)).alias("_r"))
        d = d.select(self.group, *extra, "_r.nodes", "_r.above", F.posexplode("_r.items").alias("_at", "_x"))
        own = F.filter(F.array(F.when(F.col("nodes").isNotNull(), F.struct("nodes", F.col("_at").alias("at")))), lambda x: x.isNotNull())
        path = F.concat(own, "above", "path").alias("path")
        rest = [c for c in extra if c != "path"]
        if hop:
            return d.select(self.group, F.col("_x.at").alias("_page"), path, *rest)
        return d.select(self.group, *(F.col(f"_x.{c}").alias(c) for c in self.keep), F.col("_x.node").alias("node"), path, *rest)


def build(rows: DataFrame, group: str, order: list[str], keep: tuple[str, ...], path: str) -> Tree:
    """Writes the node store of rows (group, node, the columns of ``order`` and ``keep``) below ``path``; leaves ascend in ``order``, nulls first.

    Rows that tie in all of ``order`` must have equal nodes: then either sequence is the same tree. ``rows`` must be a table, as it is
    read twice.
    """
    spark = rows.sparkSession
    sort = [F.col(group), *(F.col(c) for c in order)]
    columns = list(dict.fromkeys([group, "node", *order, *keep]))
    runs = rows.select(*columns).repartitionByRange(partitions(spark, rows.count(), RUN_ROWS), *sort).sortWithinPartitions(*sort)
    runs = written(runs.withColumn("_number", F.monotonically_increasing_id()), "runs").withColumn("_run", F.shiftright("_number", 33))
    # A row for each run and group within it: as many as there are runs and groups, whatever the number of leaves.
    counts = runs.groupBy(group, "_run").agg(F.min("_number").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy(group))
    counts = written(counts.select(F.col(group).alias("_g"), F.col("_run").alias("_r"), "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), total.alias("_total")), "counts")
    size = counts.agg(F.count("*"), F.coalesce(F.max("_total"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    counts = F.broadcast(counts) if size[0] <= BROADCAST_IDS else counts
    placed = runs.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r"))).drop("_n")
    placed = placed.withColumn("_at", F.col("_number") - F.col("_first") + F.col("_before"))
    most, levels = size[1], []

    def store(df: DataFrame) -> DataFrame:
        where = f"{path}/level={len(levels)}"
        df.write.parquet(where)
        levels.append(spark.read.schema(df.schema).parquet(where))
        return levels[-1]

    while True:
        here = store(_pages(placed, group, keep if not levels else (), size[2]))
        for k in range(1, SPAN + 1):
            here = here.select(group, "_page", "_several", "_total", _parents().alias("nodes"))
            here = store(here) if k < SPAN else here
        ends = here.select(group, F.col("_page").alias("_at"), F.col("nodes")[0].alias("node"), F.ceil(F.col("_total") / PAGE).cast("long").alias("_total"))
        most, placed = -(-most // PAGE), written(ends, "ends")
        if most <= 1:
            return Tree(levels, group, keep, placed.select(group, "node"))


def _pages(placed: DataFrame, group: str, keep: tuple[str, ...], rows: int) -> DataFrame:
    """The lowest level of a hop: the pages of nodes (at most so many) that have a place (_at) in their group."""
    spark = placed.sparkSession
    item = F.struct(F.col("_at").alias("at"), "node", *keep)
    d = placed.withColumn("_page", F.floor(F.col("_at") / PAGE).cast("long"))
    d = d.repartition(partitions(spark, rows, RUN_ROWS), group, "_page")
    d = d.groupBy(group, "_page").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("_total").alias("_total"))
    return d.withColumn("_several", F.col("_total") > PAGE).withColumn("nodes", F.transform("items", lambda x: x["node"]))


def _parents() -> Column:
    """A page's nodes one level up. A tree that is down to one node stays as it is."""
    last = F.floor((F.size("nodes") - 1) / FANOUT).cast("int")
    parents = F.transform(F.sequence(F.lit(0), last), lambda k: F.unhex(joined(F.slice("nodes", k * FANOUT + 1, F.lit(FANOUT)))))
    return F.when(F.col("_several") | (F.size("nodes") > 1), parents).otherwise(F.col("nodes"))


def proof(path: Column) -> Column:
    """H of the siblings along a path, from the leaf's run to the root's, left to right."""
    others = F.transform(path, lambda x: F.array_join(F.transform(F.filter(x["nodes"], lambda n, i: i != x["at"]), _hex), ""))
    return F.sha2(F.array_join(others, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""

    def step(node, x):
        return F.sha2(F.array_join(F.transform(x["nodes"], lambda n, i: F.when(i == x["at"], node).otherwise(_hex(n))), ""), 256)

    return F.aggregate(path, _hex(leaf), step)


def tampered() -> Column:
    """The text with its A-Z in lower case where 3 divides the CRC of doc_id; null for all other rows."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_of(ascii_lower(F.col("text"))))


def manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs; nodes are kept below ``path``.

    A null field of a row is told from an empty one. Rows of null lang are a group of their own, the first. Rows of null doc_id come first in
    their group and are never tampered with. Rows that share a doc_id are ordered by their leaves; equal rows are leaves each. Columns
    other than the five are not read. An empty table gives an empty result. folded_root is made of the tampered leaf where there is
    one (see ``tampered``), and of the siblings as stored.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or new_path(spark, "merkle")
    leaves = written(docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("node"), tampered().alias("altered")), "leaves")
    trees = build(leaves, "lang", ["doc_id", "node", "altered"], ("doc_id", "altered"), f"{path}/rows")
    tops = trees.subroots().select(F.lit(0).alias("all"), "lang", "node")
    top = build(tops, "all", ["lang"], ("lang",), f"{path}/groups")
    root = top.subroots().select("all", F.array().cast("array<struct<nodes:array<binary>,at:int>>").alias("path"), _hex(F.col("node")).alias("root"))
    above = written(top.proofs(root).select("lang", _hex(F.col("node")).alias("subroot"), "path", "root"), "above")
    d = trees.proofs(above).withColumn("folded_root", folded(F.coalesce("altered", "node"), F.col("path")))
    return d.select("doc_id", "lang", _hex(F.col("node")).alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir):
    return manifest(documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 9) -> str:
    """Trees of up to 8 ** levels leaves, a table per level; crc32 by its bits."""
    cell = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(cell(text if c == "text" else c) for c in FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

    def tree(t: str, base: str) -> str:
        """base: g, pos, node. Tables {t}0 ... of nodes, {t}r0 ... of runs."""
        out = [f"{t}0 AS MATERIALIZED (SELECT g, pos, node, count(*) OVER (PARTITION BY g) AS n FROM {base})"]
        for k in range(levels):
            node = "CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END"
            out.append(f"{t}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, pos // 8 AS pos, {node} AS node FROM {t}{k} GROUP BY g, pos // 8))")
            out.append(f"{t}r{k} AS MATERIALIZED (SELECT g, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM {t}{k} WHERE n > 1 GROUP BY g, pos // 8)")
        return ",\n".join(out)

    def fold(t: str, base: str, tail: str) -> str:
        """base: g, pos, acc, sib and whatever else; the same rows with acc folded up and sib the siblings so far."""
        out = []
        for k in range(levels):
            at = f"(s.pos // {8**k})"
            out.append(
                f"{tail}{k + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (acc, sib), CASE WHEN r.nodes IS NULL THEN acc ELSE sha256(array_to_string(r.nodes[:{at} % 8], '') || acc || array_to_string(r.nodes[{at} % 8 + 2:], '')) END AS acc, "
                f"CASE WHEN r.nodes IS NULL THEN sib ELSE sib || array_to_string(r.nodes[:{at} % 8], '') || array_to_string(r.nodes[{at} % 8 + 2:], '') END AS sib "
                f"FROM {base if k == 0 else f'{tail}{k}'} s LEFT JOIN {t}r{k} r ON r.g = s.g AND r.run = s.pos // {8 ** (k + 1)})"
            )
        return ",\n".join(out)

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, {row("text")} AS leaf, {row(low)} AS low, ({crc}) % 3 = 0 AS hit FROM documents),
x AS MATERIALIZED (SELECT *, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{tree("a", "x")},
sub AS MATERIALIZED (SELECT g AS lang, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, node FROM a{levels}),
{tree("b", "sub")},
f0 AS MATERIALIZED (SELECT doc_id, leaf, g, pos, CASE WHEN hit THEN low ELSE leaf END AS acc, '' AS sib FROM x),
{fold("a", "f0", "f")},
h0 AS MATERIALIZED (SELECT f.* EXCLUDE (g, pos), s.node AS subroot, s.g, s.pos FROM f{levels} f JOIN sub s ON s.lang = f.g),
{fold("b", "h0", "h")}
SELECT doc_id, leaf, subroot, (SELECT node FROM b{levels}) AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = (SELECT node FROM b{levels}) AS verified FROM h{levels}"""


SQL = _sql()
