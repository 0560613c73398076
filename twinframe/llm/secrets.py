"""Secret scans: known shapes, and a battery of randomness tests over encoded-looking tokens. Built-in functions only.

Base kinds are patterns. For the rest, every maximal run of encoding characters that mixes character classes is a candidate; its
encoding (hex, base32, base62, base64, base64url) is inferred from the characters it uses, and its symbols are tested:

* chi-squared uniformity over the encoding's alphabet,
* Wald-Wolfowitz runs about the middle of the alphabet,
* lag-1 serial correlation of symbol numbers.

A token counts as random only if no test of the three rejects randomness, and if it is too even for text: under the hypothesis
that its symbols have the index of coincidence of text, its number of equal symbol pairs gives a p-value, whose power grows with
the length. Benjamini-Hochberg then bounds the share of false discoveries, for each stratum of lengths by itself, so the many short
tokens that can't be told from text don't use up the level of the long ones. The p-values are kept as a histogram of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import documents, prepare, text_of, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
ENCODED = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Candidates mix digits and letters, or have a capital after a small letter.
MIXED = r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z][A-Z]"
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Encoding, what its tokens look like, its alphabet, and two moments of text over that alphabet: the sums of squared and of cubed
#: symbol shares.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", 0.125, 0.022),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.125, 0.022),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", 0.066, 0.0055),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.06, 0.0048),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", 0.06, 0.0048),
    ("base64", r"", UPPER + LOWER + DIGITS + "+/", 0.06, 0.0048),
)
#: Lower ends of the length strata.
STRATA = (16, 24, 32, 48, 96)
#: Level of each uniformity test (two-sided), false-discovery level, steps of the p-value histogram per factor of ten, last step.
ALPHA, FDR, STEPS, LAST = 0.003, 0.05, 20, 200


def normal_cdf(z: Column) -> Column:
    """Logistic form, within 1.5e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<s, e, t>>: the matches' starts and ends in code points, and their text or that of a group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    inner = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(gaps.alias("g"), hits.alias("h"), inner.alias("t"))
    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<s:int,e:int,t:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["h"])
        new = F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))
        more = F.when(x["h"].isNull(), acc["out"]).when(acc["out"].isNull(), new).otherwise(F.concat(acc["out"], new))
        return F.struct(F.coalesce(e, s).alias("at"), more.alias("out"))

    found = F.aggregate(parts, empty, step)["out"]
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.coalesce(found, none)).otherwise(none)


def encoding_of(token: Column):
    """struct<number, body> of a token's encoding, and a function that picks a field of ENCODINGS by the number in ``_e``."""
    body = F.rtrim(token, F.lit("="))
    number = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        number = F.when(F.rlike(token, F.lit(ENCODINGS[k][1])), k).otherwise(number)

    def pick(field):
        return F.element_at(F.array(*(F.lit(field(e)) for e in ENCODINGS)), F.col("_e") + 1)

    return F.struct(number.alias("number"), body.alias("body")), pick


def evaluated(cands: DataFrame) -> DataFrame:
    """Adds encoding, the three tests' z values and p_text to rows with a token ``t``."""
    first, pick = encoding_of(F.col("t"))
    d = cands.select("*", first.alias("_f")).select("*", F.col("_f.number").alias("_e"), F.col("_f.body").alias("_b"))
    d = d.select("*", pick(lambda e: e[2]).alias("_abc"), pick(lambda e: e[3]).alias("_ioc"), pick(lambda e: e[4]).alias("_cubes"), pick(lambda e: e[0]).alias("encoding"))
    d = d.select("*", F.transform(F.filter(F.split("_b", ""), lambda c: c != ""), lambda c: (F.instr(F.col("_abc"), c) - 1).cast("double")).alias("_x"))
    n, k = F.size("_x").cast("double"), F.length("_abc").cast("double")
    zero = F.lit(0.0)
    total = F.aggregate("_x", zero, lambda a, v: a + v)
    squares = F.aggregate("_x", zero, lambda a, v: a + v * v)
    pairs = F.aggregate(F.array_distinct("_x"), zero, lambda a, v: a + F.pow(F.size(F.filter("_x", lambda y: y == v)).cast("double"), F.lit(2.0)))
    after = F.slice(F.col("_x"), F.lit(2), F.size("_x"))
    cross = F.aggregate(F.zip_with("_x", after, lambda a, b: F.coalesce(a * b, zero)), zero, lambda a, v: a + v)
    high = F.aggregate("_x", zero, lambda a, v: a + F.when(v >= k / 2, 1.0).otherwise(0.0))
    turns = F.aggregate(F.zip_with("_x", after, lambda a, b: F.when(b.isNotNull() & ((a >= k / 2) != (b >= k / 2)), 1.0).otherwise(0.0)), F.lit(1.0), lambda a, v: a + v)
    d = d.select("*", n.alias("_n"), k.alias("_k"), total.alias("_s"), squares.alias("_ss"), pairs.alias("_p"), cross.alias("_c"), high.alias("_h"), turns.alias("_r"))
    n, k, h, low = F.col("_n"), F.col("_k"), F.col("_h"), F.col("_n") - F.col("_h")
    over = F.try_divide  # null for a zero divisor, whichever branch Spark evaluates
    chi2 = over(k, n) * F.col("_p") - n
    variance = over(F.col("_ss"), n) - F.pow(over(F.col("_s"), n), F.lit(2.0))
    covariance = over(F.col("_c"), n) - F.pow(over(F.col("_s"), n), F.lit(2.0))
    mu, inner = over(2 * h * low, n) + 1, over(2 * h * low * (2 * h * low - n), n * n * (n - 1))
    same, q, c = F.col("_p") - n, F.col("_ioc"), F.col("_cubes")
    spread = F.sqrt(2 * n * (n - 1) * q * (1 - q) + 4 * n * (n - 1) * (n - 2) * F.greatest(c - q * q, zero))
    return d.select(
        *cands.columns,
        "encoding",
        over(chi2 - (k - 1), F.sqrt(2 * (k - 1))).alias("chi2"),
        F.when(inner > 0, over(F.col("_r") - mu, F.sqrt(inner))).otherwise(F.lit(-99.0)).alias("runs"),
        F.when(variance > 0, over(F.sqrt(n) * covariance, variance) + over(F.lit(1.0), F.sqrt(n))).otherwise(F.lit(99.0)).alias("serial"),
        F.coalesce(normal_cdf(over(same - n * (n - 1) * q, spread)), F.lit(1.0)).alias("p_text"),
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found (array of struct<s, k, e>: the base spans by start, then kind), tokens (array of struct<s, e, t, k>).

    Tokens are candidates apart from the base spans, of kind 3, and the encoded values of base spans under the kind of those.
    """
    text = text_of()

    def kind(k: int, x: Column) -> Column:
        return F.transform(x, lambda v: F.struct(v["s"].alias("s"), F.lit(k).alias("k"), v["e"].alias("e")))

    def token(k: int, x: Column) -> Column:
        return F.transform(x, lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e"), v["t"].alias("t"), F.lit(k).alias("k")))

    base = [F.filter(spans(text, ASSIGN, 2), lambda v: F.length(v["t"]) >= 6), spans(text, ACCESS), spans(text, HEX)]
    tokens = F.filter(spans(text, TOKEN), lambda v: F.rlike(v["t"], F.lit(MIXED)))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(x.alias(n) for x, n in zip([*base, tokens], ("assign", "access", "hex", "tokens"))))
    names = ("assign", "access", "hex")
    row = row.select("*", F.array_sort(F.concat(*(kind(k, F.col(n)) for k, n in enumerate(names)))).alias("found"))
    apart = F.filter("tokens", lambda t: ~F.exists("found", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    encoded = F.filter(F.concat(*(token(k, F.col(n)) for k, n in enumerate(names))), lambda v: F.rlike(v["t"], F.lit(f"^{ENCODED}$")))
    return row.select("doc_id", "found", F.concat(token(3, apart), encoded).alias("tokens"))


def candidates(rows: DataFrame) -> DataFrame:
    """The tokens of ``base_spans`` with their figures, one row each."""
    each = rows.where(F.size("tokens") > 0).select("doc_id", F.explode("tokens").alias("x")).select("doc_id", "x.s", "x.e", "x.t", "x.k")
    stratum = F.lit(0)
    for k, least in enumerate(STRATA):
        stratum = F.when(F.length("t") >= least, k).otherwise(stratum)
    limit = 2.97  # the normal quantile of 1 - ALPHA / 2
    even = (F.abs("runs") <= limit) & (F.abs("serial") <= limit) & (F.abs("chi2") <= 2 * limit)
    bin_ = F.least(F.floor(-STEPS * F.log10(F.greatest("p_text", F.lit(1e-300)))), F.lit(LAST)).cast("int")
    return evaluated(each).select("doc_id", "s", "e", "k", stratum.alias("stratum"), bin_.alias("bin"), even.alias("even"))


def thresholds(cands: DataFrame) -> dict[int, int]:
    """The first histogram step of each stratum that is a discovery; at most one entry per stratum reaches the driver."""
    from pyspark.sql import Window

    w = Window.partitionBy("stratum")
    h = cands.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    h = h.select("stratum", "bin", F.sum("n").over(w).alias("m"), F.sum("n").over(w.orderBy(F.col("bin").desc())).alias("found"))
    ok = h.where(F.pow(F.lit(10.0), -F.col("bin") / STEPS) * F.col("m") <= FDR * F.col("found"))
    return {r.stratum: r.bin for r in ok.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of struct<s, k, e> (start and end in code points, end exclusive; k numbers KINDS) by start, then kind; and
    confirmed: those base spans whose value the battery finds random too.

    Base spans stay as they are; random tokens that touch none of them are added. Null and empty texts have no spans. Repeated rows
    and null doc_ids are each scanned for themselves. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = written(base_spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans")  # no texts but the candidates
    cands = written(candidates(rows.withColumn("doc_id", F.col("row"))).withColumnRenamed("doc_id", "row"), "tokens")
    first = thresholds(cands)
    hit = F.lit(False)
    for stratum, least in first.items():
        hit = hit | ((F.col("stratum") == stratum) & (F.col("bin") >= least))
    each = F.struct("s", "k", "e")
    random = cands.where(hit & F.col("even")).groupBy("row").agg(F.collect_list(F.when(F.col("k") == 3, each)).alias("random"), F.array_sort(F.collect_list(F.when(F.col("k") < 3, each))).alias("confirmed"))
    both = rows.select("row", "doc_id", "found").join(random, "row", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return both.select("doc_id", F.array_sort(F.concat("found", F.coalesce("random", none))).alias("spans"), F.coalesce("confirmed", none).alias("confirmed"))


def _joined(spans_: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda v: F.concat_ws(":", F.element_at(names, v["k"] + 1), v["s"], v["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(k):
        return F.size(F.filter("spans", lambda v: v["k"] == k)).cast("long")

    base = F.filter("spans", lambda v: v["k"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("confirmed").cast("long").alias("n_confirmed"))


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with each union of overlapping spans replaced by [SECRET]; null text stays null. doc_id must be unique."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, v):
        fresh = v["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], v["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, v["s"] - acc["at"]), F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    joined = docs.select("doc_id", "text").join(found.select("doc_id", "spans"), "doc_id", "left")
    folded = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int>>")), start, step)
    return joined.select("doc_id", F.when(F.col("text").isNull(), None).otherwise(F.concat(folded["out"], F.substring(F.col("text"), folded["at"] + 1, F.length("text")))).alias("text"))


def op1_secret_scans(spark, sf_dir):
    return digest(find_secrets(documents(spark, sf_dir)))
