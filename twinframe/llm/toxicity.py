"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of the labelled rows; every term of theirs is indexed. A term's weight is (1 + log tf) idf, times the
chi-squared of its document frequency between toxic and clean examples, so that terms which tell nothing hardly count; none is left
out, of the examples or of a query.
The index cuts the examples into blocks. The lists of rare terms are read whole. The lists of frequent terms, which have most of the
postings that a text meets, are kept by block with their largest weight there: what the rare terms gave and the sum of those weights
bound every cosine in a block. The blocks of highest bound are scored first, then all whose bound reaches the k-th best cosine found, so
the k nearest are exact. Several texts share the reading of a block, as a matrix product in single precision; what comes within its
rounding error of the k-th best is summed again in double precision.
The neighbours' votes, weighted by closeness, are calibrated by isotonic regression on leave-one-out votes of the examples, shrunk
towards the vote itself where toxic examples are few. A text without any of the terms takes the rate of the examples that have none.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from twinframe.llm.common import documents, fresh, prepare, table

#: Labelled rows that the index holds at most: those of smallest hash of doc_id.
MAX_EXAMPLES = 2_000
#: Neighbours, examples of a block, blocks that are scored first, and the score from which a text is predicted toxic.
NEAREST, BLOCK, FIRST, THRESHOLD = 15, 64, 4, 0.3
#: Added to each chi-squared, so that the terms of an uninformative sample still weigh.
FLOOR = 1e-3
#: A list is kept by block if so large a share of the examples have its term, for so many terms at most.
LONG, MAX_LONG = 0.05, 2_048
#: Texts that are scored at once, and postings of rare terms that are read at once (unless a single text has more).
TEXTS, POSTINGS = 64, 1_000_000
#: Toxic examples from which the calibrated vote outweighs the vote itself: with few, the fit follows chance.
PRIOR = 300
STEM = 5
WORD = r"[^\W_]+"


#: The characters of one byte in Latin-1, with a space in place of those that are in no word.
LATIN = bytes(c if re.match(WORD, chr(c)) else 32 for c in range(256))


def tokens(text: bytes | None) -> list[str]:
    """Words in lower case."""
    lower = (text or b"").decode().lower()
    try:
        return lower.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return re.findall(WORD, lower)


def words(text: bytes | None) -> list[str]:
    """Words, and the beginnings of longer ones with a mark, since inflected and compound words share their stem."""
    found = tokens(text)
    return found + [w[:STEM] + "~" for w in found if len(w) > STEM]


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after another, and the range that each is of."""
    size = stop - start
    of = np.repeat(np.arange(len(size), dtype="i4"), size)
    at = np.repeat((start - np.cumsum(size) + size).astype("i4"), size)
    at += np.arange(len(of), dtype="i4")
    return at, of


class Index:
    """Examples as unit vectors over all their terms: ids, labels and the postings of each term."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: list[str], example: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """``example``, ``term`` and ``tf`` are parallel: which example has which term how often. Examples are numbered as in ``ids``."""
        self.ids, self.labels = ids, labels.astype("f8")
        self.terms = terms
        n, toxic = len(ids), self.labels.sum()
        bare = np.ones(n, bool)
        bare[example] = False
        self.empty_rate = float((self.labels[bare].sum() + 0.1) / (bare.sum() + 1)) if n else 0.0
        df, a = np.bincount(term, minlength=len(terms)), np.bincount(term, self.labels[example], len(terms))
        spread = df * (n - df) * toxic * (n - toxic)
        chi2 = np.divide(n * (a * n - df * toxic) ** 2, spread, out=np.zeros(len(terms)), where=spread > 0)
        self.factor = (np.log((1 + n) / (1 + df)) + 1) * (chi2 + FLOOR)
        order = np.lexsort((term, example))
        example, term = example[order], term[order]
        own = self.unit(example, term, tf[order], n)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype("i4"), own[order].astype("f4")
        self.starts = np.r_[0, np.cumsum(df)]
        often = np.argsort(-df, kind="stable")[:MAX_LONG]
        #: Terms whose lists are kept by block.
        self.long = np.sort(often[df[often] >= max(LONG * n, 1)])
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if n > bare.sum():
            votes = self.votes(*self.nearest(example, term, own, n, skip=np.arange(n)), n)
            self.steps = isotonic(votes[~bare], self.labels[~bare])

    def __getstate__(self) -> dict:
        """Workers derive anew what follows from the postings, so that only those are broadcast."""
        return {k: v for k, v in self.__dict__.items() if k not in ("numbers", "stems", "places", "rows", "most")}

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.terms)}

    @cached_property
    def stems(self) -> np.ndarray:
        """The number of each word's beginning, or -1."""
        get = self.numbers.get
        return np.array([get(t[:STEM] + "~", -1) if len(t) > STEM and t[-1] != "~" else -1 for t in self.terms], int)

    @cached_property
    def places(self) -> np.ndarray:
        """The column of each term in ``rows``, or -1."""
        at = np.full(len(self.terms), -1)
        at[self.long] = np.arange(len(self.long))
        return at

    @cached_property
    def rows(self) -> np.ndarray:
        """Weights of the long lists, a row for each example; the last block is filled up with zeros."""
        at, of = ranges(self.starts[self.long], self.starts[self.long + 1])
        out = np.zeros((-(-len(self.ids) // BLOCK) * BLOCK, len(self.long)), "f4")
        out[self.example[at], of] = self.weight[at]
        return out

    @cached_property
    def most(self) -> np.ndarray:
        """Largest weight of each long list in each block."""
        return self.rows.reshape(len(self.rows) // BLOCK, BLOCK, len(self.long)).max(1)

    def unit(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Weights of the terms of ``n`` texts, each text's vector of length 1."""
        w = (1 + np.log(tf)) * self.factor[term]
        return w / np.sqrt(np.bincount(doc, w * w, n))[doc]

    def counted(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and frequency of the known terms, in that order, as ``words`` gives them."""
        get = self.numbers.get
        number: list[int] = []
        tf: list[int] = []
        sizes = []
        more: list[tuple[int, int, int]] = []  # beginnings of unknown words
        for k, text in enumerate(texts):
            found = Counter(tokens(text))
            here = list(map(get, found, repeat(-1)))
            number += here
            tf += found.values()
            sizes.append(len(here))
            more += [(k, get(w[:STEM] + "~", -1), c) for (w, c), i in zip(found.items(), here) if i < 0 and len(w) > STEM]
        term, doc, n = np.array(number, int), np.repeat(np.arange(len(texts)), sizes), np.array(tf, int)
        stem = np.where(term >= 0, self.stems[term], -1) if len(self.terms) else term
        doc2, stem2, n2 = np.array(more, int).reshape(-1, 3).T
        doc, term, n = np.r_[doc, doc, doc2], np.r_[term, stem, stem2], np.r_[n, n, n2]
        known = np.flatnonzero(term >= 0)
        key = doc[known] * len(self.terms) + term[known]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        doc, term = np.divmod(key[first], max(len(self.terms), 1))
        return doc, term, np.add.reduceat(n[known][order], first) if len(key) else n[:0]

    def nearest(
        self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, skip: np.ndarray | None = None, k: int = NEAREST
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, example and cosine of the k nearest of each text with a cosine over 0, nearest first; ties go to the smaller id.

        ``doc`` (of ``n``), ``term`` and ``weight`` are the texts' vectors in order of text; ``skip`` names an example for each that doesn't count.
        """
        reads = np.where(self.places[term] < 0, self.starts[term + 1] - self.starts[term], 0)
        cost = np.cumsum(np.bincount(doc, reads, n))
        parts = []
        start = 0
        while start < n and len(self.ids):
            before = cost[start - 1] if start else 0
            stop = min(start + TEXTS, max(start + 1, int(np.searchsorted(cost, before + POSTINGS, "right"))))
            a, b = np.searchsorted(doc, [start, stop])
            text, example, cosine = self._nearest(doc[a:b] - start, term[a:b], weight[a:b], stop - start, None if skip is None else skip[start:stop], k)
            parts.append((text + start, example, cosine))
            start = stop
        if not parts:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        text, example, cosine = map(np.concatenate, zip(*parts))
        return text, example, cosine

    def _nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, skip: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(self.rows)
        place = self.places[term]
        short, far = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        at, of = ranges(self.starts[term[short]], self.starts[term[short] + 1])
        key = self.example[at] + (doc[short] * width)[of]
        rare = np.bincount(key, weight[short][of] * self.weight[at], n * width).reshape(n, width).astype("f8")
        if skip is not None:
            rare[np.arange(n), skip] = -np.inf
        query = np.zeros((n, len(self.long)), "f4")
        query[doc[far], place[far]] = weight[far]
        cuts = np.searchsorted(doc[far], np.arange(n + 1))
        error = (np.diff(cuts) + 2) * 2.0**-23  # bounds the relative rounding error of a product in single precision, twice over
        bound = (rare.reshape(n, -1, BLOCK).max(2) + query @ self.most.T) * (1 + error)[:, None]
        score = rare.copy()
        done = np.zeros(bound.shape, bool)

        def add(todo: np.ndarray) -> None:
            np.logical_or(done, todo, out=done)
            for b in np.flatnonzero(todo.any(0)):
                texts, examples = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                score[texts, examples] += query[texts] @ self.rows[examples].T

        def least() -> np.ndarray:
            kth = np.partition(score, -k, 1)[:, -k] if width > k else np.zeros(n)
            return np.maximum(kth * (1 - error), 0)

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, 1)[:, :FIRST], True, 1)
        add(first)
        add((bound > 0) & (bound >= least()[:, None]) & ~done)
        text, example = np.nonzero((score > 0) & (score * (1 + error)[:, None] >= least()[:, None]))
        cosine = rare[text, example]
        ends = np.searchsorted(text, np.arange(n + 1))
        for t in np.flatnonzero((np.diff(ends) > 0) & (np.diff(cuts) > 0)).tolist():
            here, own = slice(ends[t], ends[t + 1]), far[cuts[t] : cuts[t + 1]]
            products = self.rows.take((example[here] * len(self.long))[:, None] + place[own]) * weight[own]
            cosine[here] += products.sum(1)
        order = np.lexsort((self.ids[example], -cosine, text))
        order = order[np.arange(len(order)) - ends[text] < k]
        return text[order], example[order], cosine[order]

    def votes(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Share of toxic ones among the neighbours of each of ``n`` texts, by closeness; the rate of bare examples without neighbours."""
        w = 1 / (1.05 - np.minimum(cosine, 1))
        total = np.bincount(text, w, n)
        out = np.full(n, self.empty_rate)
        np.divide(np.bincount(text, w * self.labels[example], n), total, out=out, where=total > 0)
        return np.minimum(out, 1)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The vote of the (cosine, example) of one text's neighbours."""
        return float(self.votes(np.zeros(len(near), int), np.array([i for _, i in near], int), np.array([s for s, _ in near]), 1)[0])

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The score of each text; text, example and cosine of the neighbours."""
        n = len(texts)
        doc, term, tf = self.counted(texts)
        text, example, cosine = self.nearest(doc, term, self.unit(doc, term, tf, n), n)
        vote, toxic = self.votes(text, example, cosine, n), self.labels.sum()
        score = np.minimum((toxic * np.interp(vote, *self.steps) + PRIOR * vote) / (toxic + PRIOR), 1)
        return np.where(np.bincount(text, minlength=n) > 0, score, self.empty_rate), text, example, cosine

    def score(self, text: bytes | None) -> tuple[float, list[tuple[float, int]]]:
        """The score of one text, and (cosine, example) of its neighbours."""
        score, _, example, cosine = self.scores([text])
        return float(score[0]), list(zip(cosine.tolist(), example.tolist()))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x, as points for linear interpolation."""
    pools: list[list[float]] = []  # mean, weight, sum of x
    for v in np.unique(x):
        same = y[x == v]
        pools.append([same.mean(), len(same), v * len(same)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            n = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index over the rows of ``labels`` (doc_id, toxic) that aren't held out. Rows with null doc_id or toxic are no examples.

    Of rows that repeat a doc_id one is the example, so the driver gets ``max_examples`` texts' terms at most.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # at most max_examples rows of 16 bytes are broadcast
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    known = known.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def count(batches):
        for batch in batches:
            tf = [Counter(words(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            terms, n = pa.array([list(c) for c in tf], pa.list_(pa.string())), pa.array([list(c.values()) for c in tf], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), terms, n], names=["doc_id", "toxic", "terms", "n"])

    got = known.mapInArrow(count, "doc_id long, toxic int, terms array<string>, n array<long>").toArrow().sort_by("doc_id").combine_chunks()
    lists = got.column("terms").combine_chunks()
    codes = lists.flatten().dictionary_encode() if len(got) else pa.array([], pa.string()).dictionary_encode()
    sizes = lists.value_lengths().to_numpy() if len(got) else np.empty(0, int)
    tf = got.column("n").combine_chunks().flatten().to_numpy() if len(got) else np.empty(0, int)
    return Index(got.column("doc_id").to_numpy(), got.column("toxic").to_numpy(), codes.dictionary.to_pylist(), np.repeat(np.arange(len(got)), sizes), codes.indices.to_numpy(), tf)


def scored(docs: DataFrame, index: Index, score: str = "score", evidence: str | None = "evidence") -> DataFrame:
    """Adds the score and, if named, the evidence (array of struct<doc_id, label, cosine> of the nearest examples) to docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            parts = [model.scores(texts[a : a + TEXTS].to_pylist()) for a in range(0, len(texts), TEXTS)]
            arrays = [*batch.columns, pa.array(np.concatenate([s for s, *_ in parts]) if parts else np.empty(0))]
            if evidence:
                sizes = [np.bincount(text, minlength=len(s)) for s, text, _, _ in parts]
                example = np.concatenate([np.empty(0, int), *(e for _, _, e, _ in parts)])
                why = [model.ids[example].astype("i8"), model.labels[example].astype("i4"), np.concatenate([np.empty(0), *(c for *_, c in parts)])]
                offsets = np.cumsum(np.concatenate([[0], *sizes])).astype("i4")
                arrays.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(w) for w in why], ["doc_id", "label", "cosine"])))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [*docs.columns, score, *([evidence] if evidence else [])]
    schema = StructType([*docs.schema]).add(score, "double")
    if evidence:
        schema = schema.add(evidence, DataType.fromDDL("array<struct<doc_id:bigint,label:int,cosine:double>>"))
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: one row for each row of docs.

    Null and empty texts score like any text without a term. A null doc_id is scored and counts as not held out. Without any
    labelled row all scores are 0. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    index = fit(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), index)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under THRESHOLD."""
    prepare(docs.sparkSession)
    score = fresh("toxicity", docs)
    return scored(docs, fit(docs, labels), score, None).where(F.col(score) < THRESHOLD).drop(score)


def op3_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
