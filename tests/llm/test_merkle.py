"""Merkle manifest against a plain tree over lists, and the merge of forests in any order."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from microbook.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes: list[str], arity: int) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree: list[list[str]], at: int, arity: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in tree[:-1]:
        first = at - at % arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


def brute(rows: list[tuple], arity: int = 8) -> list[tuple]:
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs = sorted({r[2] for r in rows}, key=order)
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (order(r[0]), leaf(r)))
        trees.append((own, levels([leaf(r) for r in own], arity)))
    top = levels([t[-1][0] for _, t in trees], arity)
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, row in enumerate(own):
            way = siblings(tree, i, arity) + siblings(top, k, arity)
            changed = row
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                changed = (row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            own_node = leaf(changed)
            for left, right in way:
                own_node = h(*left, own_node, *right)
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], h(*[d for left, right in way for d in left + right]), own_node, own_node == top[-1][0]))
    return out


def manifest(docs, **more):
    where = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle.proofs(docs, tampered=lambda c: merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c), where=where, **more)


def rows_of(df) -> list[tuple]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


def made(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Alpha", "ÄRGER", "x", "", "Zebra\n", "日本", "B" * 50]
    return [(i, " ".join(rng.choices(words, k=3)) if rng.random() > 0.05 else None, rng.choices(["en", "de", None, "zz", "Ä"], [20, 2, 2, 1, 1])[0], rng.choice(["a", None]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_manifest_against_lists(spark, n):
    rows = made(n, n)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    assert rows_of(manifest(docs)) == sorted(brute(rows), key=str)


def test_small_arity_many_levels_and_partitions(spark):
    """An arity of two makes a tall tree, so blocks, rounds of merges and hot runs near the root all occur."""
    rows = made(300, 5)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(40)
    assert rows_of(manifest(docs, arity=2)) == sorted(brute(rows, 2), key=str)


def test_ties_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "A", "en", "s", 1)] * 20 + [(1, "B", "en", "s", 1), (None, "C", "en", None, None), (None, None, None, None, None), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("leaf", "tree", "at", "key", "value", "__at", "block")})
    assert rows_of(manifest(docs)) == sorted(brute(rows), key=str)


def test_every_row_its_own_tree(spark):
    rows = [(i, f"T{i}", f"lang{i:03d}", None, i) for i in range(150)]
    assert rows_of(manifest(spark.createDataFrame(rows, COLUMNS).repartition(9))) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_listed_proof_hashes_to_its_digest(spark):
    rows = made(30, 3)
    for r in merkle.proofs(spark.createDataFrame(rows, COLUMNS)).collect():
        assert h(*r["proof"]) == r["proof_sha256"] and r["verified"] and r["folded_root"] == r["root"]


def test_merge_is_associative_and_commutative():
    """Any grouping and order of the leaves' fragments gives the same root and each inner run once."""
    leaves = [h(str(i)) for i in range(1000)]
    root = levels(leaves, 8)[-1][0]
    for seed in range(5):
        rng = random.Random(seed)
        dealt = [rng.randrange(13) for _ in leaves]
        parts = []
        for p in range(13):
            f = merkle.Forest(1, 8, 0)
            f.leaves[0] = len(leaves)
            for i in [i for i, d in enumerate(dealt) if d == p]:
                f.add(0, 0, i, leaves[i].encode())
            parts.append(f)
        while len(parts) > 1:
            a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
            parts.append(a.merge(b))
        (only,) = parts[0].nodes.values()
        assert only == {0: root.encode()}
        assert len(parts[0].runs) == len({r[:3] for r in parts[0].runs}) == 125 + 16 + 2 + 1


def test_contiguous_fragments_stay_small():
    f = merkle.Forest(1, 8, 3)
    f.leaves[0] = 8**6
    for i in range(1001, 60_000):
        f.add(0, 0, i, b"x" * 64)
    assert sum(len(v) for v in f.nodes.values()) <= 14 * 6
