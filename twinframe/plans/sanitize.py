"""Collections to twins: learn identities over all documents, allocate aliases, rewrite, verify, gate."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions import spans, text as fn
from twinframe.operators import detect, dictionary, identity, redaction
from twinframe.sources import structure
from twinframe.sources.rows import cut

def redacted(docs: DataFrame, secrets: Collection[str] | None = None) -> DataFrame:
    """row, doc_id, path, text (redacted), source, findings of docs (doc_id, path, text). ``row`` tells rows apart that share a doc_id or have
    none; only what ``cut`` has stored keeps it. ``secrets`` names the rules to redact by; all, if it isn't given."""
    d = docs.select("doc_id", "path", "text", redaction.scan(F.coalesce("text", F.lit("")), secrets).alias("findings"), F.monotonically_increasing_id().alias("row"))
    return d.select("row", "doc_id", "path", redaction.redact(F.coalesce("text", F.lit("")), F.col("findings")).alias("text"), F.col("text").alias("source"), "findings")


def candidates(docs: DataFrame, terms: dict[str, str] | DataFrame | None = None, allow: frozenset[str] = frozenset()) -> DataFrame:
    """Adds found: the settled candidates of each redacted text; structural names of its format claim their spans first."""
    d = detect.dictionary_matches(docs, {} if terms is None else terms, allow)
    d = d.withColumn("parser", fn.format_of(F.coalesce("path", F.lit("")), F.col("text")))
    declared = F.transform(structure.declared("parser", "text"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["name"].alias("t"), x["type"].alias("type"), F.lit(1.0).alias("confidence"), x["scope"].alias("scope")))
    d = d.withColumn("declared", declared).withColumn("regions", structure.regions("parser", "text"))
    # What the parser claims stands first; prose is looked for where the format has prose at all.
    prose = detect.scan_text(F.col("text"), F.col("terms"), F.col("variants"), allow)
    # Columns of their own: a Python function takes no argument that has a lambda within a lambda.
    d = d.withColumn("inside", detect.in_prose(prose, F.col("regions")))
    d = d.withColumn("found", detect.settle(F.concat("declared", "inside"), detect.protected(F.col("text"))))
    d = d.withColumn("inside", detect.document_variants(F.col("text"), F.col("found"), allow, F.col("regions")))
    d = d.withColumn("found", detect.settle(F.col("inside"), detect.protected(F.col("text")), F.col("found")))
    return d.withColumn("found", resolved(F.col("found"), F.col("declared"))).drop("regions", "inside")


def resolved(found: Column, declared: Column) -> Column:
    """Mentions in prose under the parser's own key, where it declares just one of that name and both are identities or neither is."""

    def one(x):
        keys = F.array_distinct(F.transform(F.filter(declared, lambda d: d["t"] == x["t"]), lambda d: F.struct(d["scope"], d["type"])))
        key = F.get(keys, F.lit(0))
        same = (x["scope"] == "") & (F.size(keys) == 1) & (fn.is_identity(key["type"]) == fn.is_identity(x["type"]))
        kind, scope = F.when(same, key["type"]).otherwise(x["type"]), F.when(same, key["scope"]).otherwise(x["scope"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), kind.alias("type"), x["confidence"].alias("confidence"), scope.alias("scope"))

    return F.transform(found, one)


def scope(declared: Column) -> Column:
    """The parser's scope, or the one of all names that no parser declares."""
    return F.when(declared != "", declared).otherwise("file")


def identities(found: DataFrame, confirmed: dict[str, str] | None = None, existing: DataFrame | None = None) -> DataFrame:
    """uuid, scope_path, entity_type, real_name, number, alias of all that is to be aliased, numbered by first path and place."""
    each = found.select("path", "doc_id", F.explode("found").alias("x")).select("path", "doc_id", scope(F.col("x.scope")).alias("scope_path"), F.col("x.type").alias("entity_type"), F.col("x.t").alias("real_name"), F.col("x.s").alias("s"), F.col("x.confidence").alias("confidence"))
    names = each.sparkSession.createDataFrame([(n,) for n in confirmed or {}], "_sure string")  # a dictionary's terms, as many as its automaton holds
    each = each.join(F.broadcast(names), each["real_name"] == names["_sure"], "left")
    kept = each.where((F.col("confidence") >= detect.CONFIDENT) & detect.should_alias(F.col("real_name"), F.col("entity_type"), F.col("_sure").isNotNull()))
    seen = identity.first_seen(kept, "path", "doc_id", "s")
    numbered = identity.allocate(seen, F.struct("place", "real_name"), existing)
    return numbered.withColumn("uuid", identity.key_of(F.col("scope_path"), F.col("entity_type"), F.col("real_name"))).drop("place")


def twins(found: DataFrame, known: DataFrame) -> DataFrame:
    """row, doc_id, path, source, twin, applied, outcome: rewritten texts, one for each row of ``found``, whatever its doc_id.

    A rewrite that changes a format's structure is given up; redactions stay.
    """
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    each = each.withColumn("_scope", identity.scope_of(F.col("type"), scope(F.col("scope"))))
    hits = each.join(known.select("scope_path", "entity_type", "real_name", "alias"), (F.col("type") == F.col("entity_type")) & (F.col("t") == F.col("real_name")) & (F.col("_scope") == F.col("scope_path")))
    plan = hits.where(F.col("confidence") >= detect.CONFIDENT).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", F.col("alias").alias("r")))).alias("edits"))
    d = found.select("row", "doc_id", "path", "source", "parser", "text").join(plan, "row", "left")
    chosen = spans.select(F.coalesce("edits", F.array().cast("array<struct<s:int,e:int,r:string>>")), "struct<s:int,e:int,r:string>")
    d = d.withColumn("edits", chosen)
    d = d.withColumn("twin", bytes_applied(F.col("text"), F.col("edits")))
    before, after = structure.fingerprint(F.col("parser"), F.col("text")), structure.fingerprint(F.col("parser"), F.col("twin"))
    outcome = F.when(F.size("edits") == 0, "unchanged").when(F.col("parser") == "text", "not_structured").when(before.isNull(), "original_did_not_parse").when(after.isNull(), "twin_did_not_parse").when(F.size(structure.differences(before, after)) > 0, "structure_changed").otherwise("verified")
    d = d.withColumn("outcome", outcome)
    failed = F.col("outcome").isin("twin_did_not_parse", "structure_changed")
    return d.select("row", "doc_id", "path", "source", F.when(failed, F.col("text")).otherwise(F.col("twin")).alias("twin"), F.when(failed, F.array().cast("array<struct<s:int,e:int,r:string>>")).otherwise(F.col("edits")).alias("applied"), "outcome")


def bytes_applied(text, edits):
    """Applies edits given in byte offsets, on character boundaries."""
    raw = F.encode(text, "UTF-8")
    ends = F.concat(F.array(F.lit(0)), F.transform(edits, lambda x: x["e"]))
    cut_ = lambda raw, a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")

    def whole(raw):
        parts = F.zip_with(edits, F.slice(ends, F.lit(1), F.size(edits)), lambda x, at: F.concat(cut_(raw, at, x["s"]), x["r"]))
        return F.concat(F.array_join(parts, ""), cut_(raw, F.element_at(ends, -1), F.octet_length(text)))

    return spans.bound(raw, whole)


def export(docs: DataFrame, terms: dict[str, str] | None = None, existing: DataFrame | None = None, allow: frozenset[str] = frozenset(), secrets: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(twins, identities) of docs (doc_id, path, text). Two passes: a name learned in any document is found in every other.

    Every row is a text of its own: rows that share a doc_id, or whose doc_id is null, each get the twin of their own text. A null text
    counts as empty, and a null path as the first.

    Identities issued before (``existing``) keep their aliases and are looked for as well; names in ``allow`` stay readable.
    ``secrets`` names the rules to redact by; all, if it isn't given.
    """
    safe = cut(redacted(docs, secrets))
    first = identities(candidates(safe, terms, allow), terms, existing)
    first = cut(first if existing is None else existing.unionByName(first.select(*existing.columns)))
    second = cut(candidates(safe, _dictionary(first, terms), allow))
    known = first.unionByName(identities(second, terms, first).select(*first.columns))
    return twins(second, known), known


def _dictionary(known: DataFrame, terms: dict[str, str] | None) -> DataFrame:
    """real_name, entity_type of the known names and the confirmed terms, whose own type counts."""
    sure = known.sparkSession.createDataFrame(list((terms or {}).items()), "real_name string, entity_type string")
    return known.select("real_name", "entity_type").join(sure, "real_name", "left_anti").unionByName(sure)


def holders(texts: DataFrame, names: DataFrame) -> DataFrame:
    """row of the texts (row, text) that may hold one of the names (real_name) in any spelling: all that do, and few others."""
    patterns = detect.spelled(names.select("real_name").distinct()).select(F.col("variant").alias("pattern")).distinct()
    return dictionary.candidates(texts, cut(dictionary.filed(patterns)), detect.ascii_lower).select("row").distinct()


def refresh(docs: DataFrame, before: DataFrame, existing: DataFrame, terms: dict[str, str] | None = None, allow: frozenset[str] = frozenset(), secrets: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``export`` gives for docs after an earlier export, at the price of what changed: (twins with ``redone``, identities).

    ``before`` holds the earlier twins (path, checksum of the original, twin, applied, outcome) and ``existing`` the identities they were made
    with; ``terms``, ``allow`` and ``secrets`` are those of that export, but for terms that came since. Passes run over texts that are new or have changed,
    and over those that may hold a name learned since: names are all that one document's twin takes from others. The rest keep their
    twins. A path that occurs more than once, now or before, or is null, is done anew.
    """
    safe = cut(redacted(docs, secrets).withColumn("checksum", F.sha2("source", 256)))
    once = lambda d: d.groupBy("path").agg(F.count("*").alias("n")).where("n = 1 AND path IS NOT NULL").select("path")
    old = before.select("path", "checksum", "twin", "applied", "outcome").join(once(before), "path").join(once(safe), "path")
    same = cut(safe.select("row", "path", "checksum").join(old, ["path", "checksum"]).select("row", "twin", "applied", "outcome"))
    changed = safe.join(same.select("row"), "row", "left_anti")
    first = identities(candidates(changed, terms, allow), terms, existing)
    first = cut(existing.unionByName(first.select(*existing.columns)))
    dictionary_ = _dictionary(first, terms)
    new = cut(dictionary_.join(existing.select("real_name", "entity_type").distinct(), ["real_name", "entity_type"], "left_anti"))
    touched = same.select("row").limit(0)
    if not new.isEmpty():
        touched = holders(safe.select("row", "text").join(same.select("row"), "row", "left_semi"), new)
    kept = cut(same.join(touched, "row", "left_anti"))
    second = cut(candidates(safe.join(kept.select("row"), "row", "left_anti"), dictionary_, allow))
    known = first.unionByName(identities(second, terms, first).select(*first.columns))
    again = twins(second, known).withColumn("redone", F.lit(True))
    rest = safe.select("row", "doc_id", "path", "source").join(kept, "row").withColumn("redone", F.lit(False))
    return again.unionByName(rest), known


def twin_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, twin_path: components that are known names are aliased whole, known names inside other components where they stand.

    The resolver's extension of the last component stays.
    """
    parts = paths.select("path", F.posexplode(fn.components(F.col("path"))).alias("pos", "part"))
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("path"))
    cut_ = F.when(last, fn.split_module_stem(F.col("part"))).otherwise(F.struct(F.col("part").alias("stem"), F.lit("").alias("extension")))
    parts = parts.withColumn("_c", cut_).select("path", "pos", F.col("_c.stem").alias("text"), F.col("_c.extension").alias("ext"))
    names = known.select(fn.fold_name(F.col("real_name")).alias("folded"), "alias").groupBy("folded").agg(F.min("alias").alias("alias"))
    whole = parts.select("text").distinct().withColumn("folded", fn.fold_name(F.col("text"))).join(names, "folded", "left")
    terms = known.where(fn.is_identity(F.col("entity_type"))).select("real_name", "entity_type")
    inner = detect.dictionary_matches(whole.where("alias IS NULL").select("text"), terms, variants=False)
    hits = inner.select("text", F.explode("terms").alias("x")).join(known.select("entity_type", "real_name", F.col("alias").alias("r")), (F.col("x.type") == F.col("entity_type")) & (F.col("x.t") == F.col("real_name")))
    edits = hits.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("x.s", "x.e", "r"))).alias("edits"))
    twins_ = whole.join(edits, "text", "left").select("text", F.coalesce("alias", bytes_applied(F.col("text"), F.col("edits")), "text").alias("twin"))
    d = parts.join(twins_, "text").select("path", F.struct("pos", F.concat("twin", "ext").alias("p")).alias("x"))
    return d.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "/").alias("twin_path"))
