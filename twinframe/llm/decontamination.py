"""Benchmark decontamination by spaced seeds. Built-in functions only.

A seed is a hash of five words at the places that a fixed mask keeps; words at the other places may differ. Seeds of the benchmark
items are joined to seeds of the documents at every word position. A hit fixes an alignment of item and document, and the words on
that alignment are compared one by one. An overlap is a segment of ten words or more, or of the item's length if that is less, with
at least 0.8 of its words equal: where an equal word counts 1 and a substituted one -4, its score is 0 or more. Items of under six
words have no such seeds; a seed of all their words finds them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import documents, fresh, numbered, prepare, table, text_of, without, written

#: Places that the masks keep. Each keeps five words; the first is the shortest, so items of under six words have none of these seeds.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
SPAN = 6
MIN_WORDS = 10
PENALTY = 4
#: Up to so many benchmark seeds (some 40 bytes each) are broadcast; more are joined by shuffling both sides.
BROADCAST_SEEDS = 500_000


def words(column: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeds(rows: DataFrame, id_column: str, short: list[int], whole: bool = False) -> DataFrame:
    """id, words, place, seed: one row per mask and word position at which the mask fits.

    ``short`` has the lengths of items of under SPAN words, each a mask of its own; with ``whole``, of texts of that length only.
    """
    span = min([SPAN, *short])
    places = F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span)).otherwise(F.array().cast("array<int>"))
    at = rows.select(id_column, "words", F.explode(places).alias("place"))

    def seed(k: int, mask: tuple[int, ...]) -> Column:
        h = F.xxhash64(F.lit(k), *(F.get(F.col("words"), F.col("place") + p) for p in mask))
        if k < 0 and whole:
            return F.when(F.size("words") == len(mask), h)
        return h if mask[-1] < span else F.when(F.col("place") + mask[-1] < F.size("words"), h)

    every = [seed(k, mask) for k, mask in enumerate(MASKS)] + [seed(-n, tuple(range(n))) for n in short]
    return at.select(id_column, "words", "place", F.explode(F.array(*every)).alias("seed")).where(F.col("seed").isNotNull())


def best_segment(a: Column, b: Column, least: Column) -> Column:
    """struct<equal, first, last> of the segment of at least ``least`` words of two aligned word arrays with the highest score, its first
    place and its last; last is -1 if none has a score of 0 or more.

    ``sum`` is the score of all words so far, ``back`` that of all but the last ``least``, and ``low`` the least of those: the best
    start for a segment that ends here.
    """
    both = F.least(F.size(a), F.size(b))  # a segment lies within the item and the text
    same = F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: x == y)
    names = (("at", 0), ("sum", 0), ("all", 0), ("back", 0), ("back_all", 0), ("low", 0), ("low_all", 0), ("from", 0), ("top", -1), ("equal", 0), ("first", 0), ("last", -1))
    start = F.struct(*(F.lit(v).alias(n) for n, v in names))
    pairs = F.zip_with(same, F.concat(F.array_repeat(F.lit(None).cast("boolean"), least), F.slice(same, F.lit(1), F.greatest(F.size(same) - least, F.lit(0)))), lambda x, y: F.struct(x.alias("now"), y.alias("then")))

    def step(s, p):
        score = lambda eq: F.when(eq, 1).otherwise(-PENALTY)
        gone = p["then"].isNotNull()
        back = s["back"] + F.when(gone, score(p["then"])).otherwise(0)
        back_all = s["back_all"] + F.when(gone & p["then"], 1).otherwise(0)
        lower = gone & (back <= s["low"])
        low, low_all, begun = (F.when(lower, x).otherwise(s[n]) for x, n in ((back, "low"), (back_all, "low_all"), (s["at"] + 1 - least, "from")))
        total, equal = s["sum"] + score(p["now"]), s["all"] + F.when(p["now"], 1).otherwise(0)
        better = (s["at"] + 1 >= least) & (total - low > s["top"])
        return F.struct(
            (s["at"] + 1).alias("at"), total.alias("sum"), equal.alias("all"), back.alias("back"), back_all.alias("back_all"),
            low.alias("low"), low_all.alias("low_all"), begun.alias("from"),
            F.when(better, total - low).otherwise(s["top"]).alias("top"), F.when(better, equal - low_all).otherwise(s["equal"]).alias("equal"),
            F.when(better, begun).otherwise(s["first"]).alias("first"), F.when(better, s["at"]).otherwise(s["last"]).alias("last"),
        )

    # zip_with pads the shorter array, so pairs are cut to the aligned words.
    return F.aggregate(F.slice(pairs, F.lit(1), F.size(same)), start, step, lambda s: F.struct(s["equal"], s["first"], s["last"]))


def row_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, doc_id, item_id, start, n_words, n_equal: the best overlap of each row (doc_id, text) and item that have one.

    ``row`` is a unique long, that of docs or else a new one.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(text_of()).alias("words"), F.monotonically_increasing_id().alias("item"))
    items = written(items, "items")
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    # A word and its gap have two characters at least; of lengths under SPAN there are a few.
    size = F.size("words")
    n, short = items.agg(F.sum(size), F.sort_array(F.collect_set(F.when((size > 0) & (size < SPAN), size)))).first()
    theirs = seeds(items, "item", short, whole=True).select("seed", "item", F.col("place").alias("item_place"), F.col("words").alias("item_words"))
    small = (n or 0) * len(MASKS) <= BROADCAST_SEEDS
    if "row" not in docs.columns:  # texts that are read once need no table
        docs = docs.withColumn("row", F.monotonically_increasing_id()) if small else numbered(docs, "row")
    docs = docs.select(F.struct("row", F.col("doc_id").cast("long").alias("doc_id")).alias("row"), words(text_of()).alias("words"))
    if small:
        hits = seeds(docs, "row", short).join(F.broadcast(theirs), "seed").select("row", "item", "item_words", shift, "words")
    else:  # words don't travel with seeds; they rejoin the distinct alignments
        hits = seeds(docs, "row", short).drop("words").join(theirs.drop("item_words"), "seed").select("row", "item", shift).distinct()
        hits = hits.join(docs, "row").join(items.select("item", F.col("words").alias("item_words")), "item")
    skip = F.greatest(F.lit(0), -F.col("shift"))
    part = F.array_join(F.slice("words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item_words") - skip), " ").alias("part")
    hits = hits.select("row", "item", "shift", part, F.array_join("item_words", " ").alias("of"))
    # An alignment's many seeds give one row. Its words are aggregates, not keys, so that Catalyst leaves the comparison above the join.
    aligned = hits.groupBy("row", "item", "shift").agg(F.first("part").alias("part"), F.split(F.first("of"), " ").alias("of"))
    both = aligned.select("row", "item", "shift", skip.alias("skip"), best_segment(F.slice("of", skip + 1, F.size("of")), F.split("part", " "), F.least(F.lit(MIN_WORDS), F.size("of"))).alias("x"))
    good = both.where("x.last >= 0").join(F.broadcast(items.select("item", "item_id")) if small else items.select("item", "item_id"), "item")
    first = (F.col("shift") + F.col("skip") + F.col("x.first")).cast("long")
    found = good.select("row", "item_id", F.struct(F.col("x.equal").cast("long").alias("n_equal"), (-first).alias("back"), (F.col("x.last") - F.col("x.first") + 1).cast("long").alias("n_words")).alias("o"))
    best = found.groupBy("row", "item_id").agg(F.max("o").alias("o"))
    return best.select("row.row", "row.doc_id", "item_id", (-F.col("o.back")).alias("start"), "o.n_words", "o.n_equal")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, n_equal: the best overlap of each document and benchmark item that have one.

    start is the overlap's first word in the document, n_words its length. Null or empty texts have none; a null doc_id or item_id is
    carried like any other value. Of equally good overlaps the first is given. Rows that repeat an id are searched each for itself and
    reported once. Empty tables give an empty result.
    """
    prepare(docs.sparkSession)
    many = row_overlaps(docs.select("doc_id", "text"), benchmark).select("doc_id", "item_id", F.struct("n_equal", (-F.col("start")).alias("back"), "n_words").alias("o"))
    best = many.groupBy("doc_id", "item_id").agg(F.max("o").alias("o"))
    return best.select("doc_id", "item_id", (-F.col("o.back")).alias("start"), "o.n_words", "o.n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap with any benchmark item, each judged by its own text."""
    prepare(docs.sparkSession)
    row = fresh("row", docs)
    rows = numbered(docs, row)
    leaks = row_overlaps(rows.select(F.col(row).alias("row"), "doc_id", "text"), benchmark).select(F.col("row").alias(row)).distinct()
    return without(rows, leaks, row)


def op4_benchmark_decontamination(spark, sf_dir):
    return overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
