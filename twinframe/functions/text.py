"""Scalar text functions as column expressions; all run on the JVM inside whole-stage code generation where Spark allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe import vocab

_PREFIXES = "|".join(sorted(set(vocab.PREFIX.values()), key=lambda p: (-len(p), p)))
ALIAS = f"^({_PREFIXES})_([0-9]+)$"
HUMP = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=[\p{L}\p{N}])(?=\p{Lu}\p{Ll})"
ENVELOPE = "Names such as {example} stand for real ones. Keep them exactly as written, and write NEW_1, NEW_2 and so on for names you invent."


def prefix_of(entity_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in vocab.PREFIX.items() for x in pair))
    return table[entity_type]


def is_identity(entity_type: Column) -> Column:
    return entity_type.isin(*vocab.IDENTITY)


def format_alias(entity_type: Column, number: Column) -> Column:
    """ORG_001: three digits at least."""
    digits = number.cast("string")
    return F.concat(prefix_of(entity_type), F.lit("_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))


def parse_alias(token: Column) -> Column:
    """struct<prefix, number>, or null where the token isn't an alias or its number exceeds 32 bits."""
    number = F.try_to_number(F.regexp_extract(token, ALIAS, 2), F.lit("9" * 38)).cast("bigint")
    return F.when(F.rlike(token, F.lit(ALIAS)) & (number < 2**32), F.struct(F.regexp_extract(token, ALIAS, 1).alias("prefix"), number.alias("number")))


def is_alias(token: Column) -> Column:
    return parse_alias(token).isNotNull()


def canonical(token: Column) -> Column:
    """Upper-case ASCII letters and digits, without the plural s of a number and without leading zeros."""
    kept = F.upper(F.regexp_replace(token, "[^A-Za-z0-9]", ""))
    return F.regexp_replace(F.regexp_replace(kept, "([0-9])S$", "$1"), "(?<![0-9])0+(?=[0-9])", "")


def split_words(name: Column) -> Column:
    """Words of an identifier: cut at separators, at humps and before the last capital of an acronym run."""
    return F.filter(F.split(F.regexp_replace(name, HUMP, " "), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def case_variants(name: Column) -> Column:
    """Sorted distinct spellings of a name in the usual cases, each also with a plural s."""
    words = split_words(name)
    lower = F.transform(words, F.lower)
    capital = F.transform(lower, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    joined = lambda parts, by="": F.array_join(parts, by)
    camel = F.concat(F.get(lower, F.lit(0)), joined(F.slice(capital, 2, F.size(capital))))
    base = F.array(name, joined(capital), camel, joined(lower, "_"), joined(lower, "-"), joined(lower, "."), joined(lower, " "), F.upper(joined(lower)), joined(capital, " "), F.upper(joined(lower, "_")))
    plural = F.transform(F.filter(base, lambda v: ~F.endswith(v, F.lit("s"))), lambda v: F.concat(v, F.lit("s")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(base, plural))))


def is_identifying(name: Column, common: Sequence[str] = vocab.COMMON_WORDS) -> Column:
    """Three bytes at least, and either several words or no ordinary one."""
    return (F.octet_length(name) >= 3) & ((F.size(split_words(name)) > 1) | ~F.lower(name).isin(*common))


def fold_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def classify_pascal(word: Column) -> Column:
    """The type that the longest matching ending tells; the word must be longer than it. Null if none matches."""
    out = F.lit(None).cast("string")
    for suffix, kind in sorted(vocab.TYPED_SUFFIXES, key=lambda s: len(s[0])):
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix)), kind).otherwise(out)
    return out


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def column_of(text: Column, offset: Column, in_bytes: bool = False) -> Column:
    """1-based column of a code-point offset, counted in characters or bytes."""
    last = F.element_at(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n"), -1)
    return ((F.octet_length(last) if in_bytes else F.length(last)) + 1).cast("bigint")


def split_module_stem(component: Column) -> Column:
    """struct<stem, extension>: what an import names, and what the resolver adds."""
    pattern = "^(.+)(" + "|".join(e.replace(".", r"\.") for e in vocab.MODULE_EXTENSIONS) + ")$"
    hit = F.rlike(component, F.lit(pattern))
    return F.struct(F.when(hit, F.regexp_extract(component, pattern, 1)).otherwise(component).alias("stem"), F.when(hit, F.regexp_extract(component, pattern, 2)).otherwise("").alias("extension"))


def split_extension(component: Column) -> Column:
    """struct<stem, extension>: cut at the last dot, which belongs to the extension; a name that only begins with a dot has none."""
    pattern = r"(?s)^(.+)(\.[^.]*)$"
    hit = F.rlike(component, F.lit(pattern))
    return F.struct(F.when(hit, F.regexp_extract(component, pattern, 1)).otherwise(component).alias("stem"), F.when(hit, F.regexp_extract(component, pattern, 2)).otherwise("").alias("extension"))


def components(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")


def is_entity_segment(stem: Column, known_folded: Column) -> Column:
    """Whether a path segment carries a name: it has a separator, or its folded form is a known name."""
    return (stem != "") & (F.rlike(stem, F.lit("[-_]")) | F.array_contains(known_folded, fold_name(stem)))


def resolve_import(module: Column, specifier: Column) -> Column:
    """The module that a relative import names, without extension; null for a dependency or a path above the root."""
    start = F.slice(components(module), F.lit(1), F.greatest(F.size(components(module)) - 1, F.lit(0)))
    begin = F.struct(start.alias("at"), F.lit(True).alias("ok"))

    def step(acc, part):
        up = part == ".."
        at = F.when(part == ".", acc["at"]).when(up, F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(F.concat(acc["at"], F.array(part)))
        return F.struct(at.alias("at"), (acc["ok"] & ~(up & (F.size(acc["at"]) == 0))).alias("ok"))

    end = F.aggregate(components(specifier), begin, step)
    path = F.array_join(end["at"], "/")
    return F.when(F.rlike(specifier, F.lit(r"^\.\.?(/|$)")) & end["ok"], split_module_stem(path)["stem"])


def cloud_sync_root(path: Column) -> Column:
    """The sync service whose folder a path lies in, or null."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("string")
    for part, name in (("onedrive", "OneDrive"), ("dropbox", "Dropbox"), ("google drive", "Google Drive"), ("icloud", "iCloud")):
        out = F.when(F.contains(p, F.lit(f"/{part}")), name).otherwise(out)
    return out


def format_of(path: Column, content: Column) -> Column:
    """The parser for a file: markdown, sql, openapi, plantuml, yaml, json, typescript or text; the first that can handle it."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 40), "\n")
    is_openapi = F.rlike(head, F.lit(r"(?m)^(openapi|swagger):")) | F.rlike(content, F.lit(r'"(openapi|swagger)"'))
    has = lambda name: ext.isin(*vocab.FORMATS[name])
    out = F.when(has("markdown"), "markdown").when(has("sql"), "sql").when((has("yaml") | has("json")) & is_openapi, "openapi")
    out = out.when(has("plantuml") | F.startswith(F.ltrim(content), F.lit("@start")), "plantuml")
    return out.when(has("yaml"), "yaml").when(has("json"), "json").when(has("typescript"), "typescript").otherwise("text")
