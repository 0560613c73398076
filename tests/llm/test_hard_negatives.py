"""Hard negatives against all scores: ties, copies, odd rows, many small blocks and rounds, large numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, row long, list int, vec string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    ok = [(i, lab, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, lab, v in rows if None not in (i, lab) and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, lab, v) in enumerate(ok):
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for n, (j, other, w) in enumerate(ok) if n != k))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            hits = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def got(spark, rows, **kw):
    d = spark.createDataFrame([(*r, 1, 2, "v") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(d, F.col("vec_id") % 10 == 0, **kw).collect())


@pytest.mark.parametrize("block", [hn.BLOCK, 16])
def test_against_all_scores(spark, monkeypatch, block):
    """Half of all are one vector, many scores tie, and lists are visited in three rounds."""
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "ROUNDS", (2, 5))
    rng = random.Random(2)
    rows = [(k, rng.randrange(4), [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) if j % 3 else rng.gauss(0, 0.3) for j in range(8)]) for k in range(300)]
    rows += [(300 + k, k % 3, [0.5] * 8) for k in range(250)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (10, None, [1.0, 1.0]), (20, 2, None), (30, 2, [1.0, None]), (40, 2, [nan, 1.0]), (50, 2, [inf, 1.0]),
        (60, 2, []), (70, 2, [0.7]), (1, 1, [1.0, 0.4]), (2, 2, [0.6, 0.4]), (2, 2, [0.6, 0.4]), (None, 2, [0.6, 0.4]), (3, 2, [0.6, 0.4]), (80, 9, [1.0, 1.0]), (4, 1, [-1.0, -1.0]),
    ]
    assert got(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert got(spark, rows, positives=1, negatives=1, low=0, high=100) == brute(rows, lambda i: i % 10 == 0, 1, 1, 0, 100)
    assert got(spark, []) == [] and got(spark, [(3, 1, [1.0])]) == []
    big = [(k, k % 2, [1e5 * (k + 1), 3e7]) for k in range(20)]
    assert got(spark, big) == brute(big, lambda i: i % 10 == 0)


def test_lists_outside_a_window_are_not_visited(spark, monkeypatch):
    """Far apart clusters: a query meets few lists, and still gets the rows of all scores."""
    rng = random.Random(4)
    centres = [[3.0 if j == c else 0.0 for j in range(8)] for c in range(8)]
    rows = [(k, k // 8 % 2, [x + rng.gauss(0, 0.01) for x in centres[k % 8]]) for k in range(640)]
    seen = []
    real = hn.Index._visits

    def watched(self, done, batch):
        seen.append((self, done, batch))
        return real(self, done, batch)

    monkeypatch.setattr(hn.Index, "_visits", watched)
    assert got(spark, rows, low=90, high=99) == brute(rows, lambda i: i % 10 == 0, low=90, high=99)
    index = seen[0][0]
    asked = index.queries().withColumn("windows", F.array(F.struct(F.lit(0).alias("w"), F.lit(400_000).cast("long").alias("lo"), F.lit(10**9).alias("hi"))))
    near = asked.mapInArrow(real(index, 0, 1000), "list int, chunk binary, q_labels binary, q_vecs binary, windows binary")
    met = near.select(F.sum(F.length("chunk") / 8)).first()[0]
    assert 0 < met <= 0.5 * asked.count() * len(index.centroids)
