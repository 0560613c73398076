"""SimHash against all pairs: fingerprints by their definition, components of random, clustered and skewed points, odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinframe.llm import simhash

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WHITE.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """component of each (doc_id, fp): by all pairs."""
    fps = sorted({f for _, f in rows})
    u = np.array(fps, "u8")
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4).tolist():
            top[find(i)] = find(i + 1 + j)
    at, least = {f: find(k) for k, f in enumerate(fps)}, {}
    for d, f in rows:
        if d is not None:
            least[at[f]] = min(d, least.get(at[f], d))
    return sorted(((d, f, least.get(at[f])) for d, f in rows), key=repr)


def test_the_queries_rows_are_those_of_all_pairs(spark, sf_dir):
    for path in (sf_dir, sf_dir.replace("0.001", "0.01")):
        docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op12_simhash_near_dedup(spark, path).collect()]
        assert sorted(got, key=repr) == brute(docs)


def test_odd_texts(spark):
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(70_000))
    texts = [None, "", " \t\n", "a", "A", "one two three", "One  two\tthree", "a b c d", "x a b c d", "É   漢 b c", long, long + " end"]
    ids = [5, 3, None, 7, 8, 9, 9, 10, None, 11, 12, 12]
    docs = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, key int, component int")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == brute([(i, plain(t)) for i, t in zip(ids, texts)])
    assert simhash.near_groups(docs.where("doc_id < 0")).collect() == []


def clustered(rng, n):
    """Random points, chains and stars of few differing bits, and half of all in one value of the low 32 bits."""
    out = {rng.getrandbits(64) for _ in range(n)}
    seed = rng.getrandbits(64)
    for _ in range(n // 4):
        seed ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
        out.add(seed)
    low = rng.getrandbits(32)
    out |= {rng.getrandbits(32) << 32 | low for _ in range(n)}
    star = rng.getrandbits(64)
    out |= {star ^ sum(1 << b for b in rng.sample(range(64), rng.choice([2, 4]))) for _ in range(n)}
    return sorted(out)


@pytest.mark.parametrize("hot", [simhash.HOT, 20])
def test_components_of_points_are_those_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SLOT", 4 * hot)
    fps = clustered(random.Random(5), 700)
    rows = [(k, f) for k, f in enumerate(fps)]
    table = spark.createDataFrame([(k, f - 2**64 if f >= 2**63 else f) for k, f in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(table).collect()), key=repr)
    assert got == brute(rows)


def test_every_plan_finds_all_links(spark):
    """For each number of partitions: any two points within TAU bits share a value that one of them probes. Frequent values cost their probes."""
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 400, "i8")
    fps[:200] = fps[:200] >> 40 << 40 | 12345
    n = 10_000_000
    for ways in simhash.WAYS:
        plan = simhash.Plan(simhash.grouped(np.eye(64) * n / 2, n, ways), fps, n)
        allowed, _ = plan.allowances(fps)
        assert sorted(b for part in plan.parts for b in part) == list(range(64))
        assert ((allowed + 1).sum(axis=0) == simhash.TAU + 1).all() and allowed.max() <= simhash.REACH
        for k in range(400):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            other = np.array([(int(fps[k]) % 2**64) ^ flips], "u8").view("i8")
            apart = [int(np.bitwise_count(simhash.project(other, p) ^ simhash.project(fps[k : k + 1], p))[0]) for p in plan.parts]
            assert any(a <= t for a, t in zip(apart, allowed[:, k]))


def test_bits_that_vary_together_share_a_partition():
    both = np.full((64, 64), 250.0)
    for a, b in ((3, 60), (60, 33), (3, 33)):
        both[a, b] = both[b, a] = 490
    np.fill_diagonal(both, 500)
    assert sum({3, 60, 33} <= set(part) for part in simhash.grouped(both, 1000, 4)) == 1


def test_python_and_spark_hash_alike(spark):
    words = "One two three four"
    row = spark.range(1).select(F.xxhash64(F.lit(words.lower())).alias("h")).first()
    assert simhash.fingerprint(words.encode()) == row.h % 2**64
