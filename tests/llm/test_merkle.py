"""The Merkle manifest against a plain recomputation, at sizes about its pages' borders and on odd rows."""

import hashlib
import random
import zlib

import pytest

from twinframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, path string, root string, at long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p", "r", 7) for r in rows], SCHEMA)


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    cells = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(cells)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for at, (known, _, node, r) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            steps = [*path(trees[x], at), *path(top, g)]
            acc = node
            if known and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                acc = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in steps:
                acc = h([*left, acc, *right])
            proof = h([s for left, right in steps for s in left + right])
            out.append((r[0], node, trees[x][-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("page", [merkle.PAGE, 64])
def test_manifest_is_the_plain_tree(spark, monkeypatch, page):
    """With pages of 64 leaves, trees take three hops and end in runs of one node."""
    monkeypatch.setattr(merkle, "PAGE", page)
    monkeypatch.setattr(merkle, "SPAN", 4 if page == merkle.PAGE and page > 64 else 2)
    monkeypatch.setattr(merkle, "RUN_ROWS", 150)
    rng = random.Random(3)
    sizes = {"en": 64 * 64 + 1, "de": 65, "": 8, "fr": 9, None: 1, "é": 64, "z": 513}
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10**6), f"Text {rng.random()} Up", lang, rng.choice(["a", None]), rng.choice([None, 5])) for _ in range(n)]
    assert got(merkle.manifest(table(spark, rows))) == brute(rows)


def test_odd_rows_of_a_manifest(spark):
    rows = [
        (1, None, "en", "s", 1), (1, "", "en", "s", 1), (1, "Same", "en", "s", 1), (1, "Same", "en", "s", 1), (None, "No ID", "en", None, None),
        (None, "No ID", "en", None, None), (2, "X" * 200_000, None, None, None), (3, "é漢 \U0001f600", None, "", 0), (-4, "Minus", "", "s", -1),
    ]
    assert got(merkle.manifest(table(spark, rows))) == brute(rows)
    one = [(3, "ABC", None, None, None)]
    assert got(merkle.manifest(table(spark, one))) == brute(one)
    assert got(merkle.manifest(table(spark, []))) == []


def test_any_change_of_a_row_changes_the_root(spark, tmp_path):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(40)]
    root = merkle.manifest(table(spark, rows), str(tmp_path / "store")).first().root
    assert {p.name for p in (tmp_path / "store" / "rows").iterdir()} == {f"level={k}" for k in range(merkle.SPAN)}
    for k in (2, 4):
        changed = list(rows)
        changed[7] = tuple("9" if j == k and j in (1, 2, 3) else 99 if j == k else v for j, v in enumerate(rows[7]))
        assert merkle.manifest(table(spark, changed)).first().root != root
