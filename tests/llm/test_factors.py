"""Duplicate windows by greedy factors against all pairs of windows; and that it is the factors that decide."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from microbook.llm import substring_dedup, textkit


def made(rng, window):
    """Phrases of several blocks and documents that share passages: (block, doc, words)."""
    base = [[rng.randrange(4) for _ in range(rng.randrange(5, 40))] for _ in range(4)]
    out = []
    for b in range(rng.randrange(1, 4)):
        for _ in range(rng.randrange(1, 9)):
            w: list[int] = []
            while len(w) < rng.randrange(window, 40):
                x = rng.choice(base)
                i = rng.randrange(len(x))
                w += x[i : i + rng.randrange(1, 20)]
                if rng.random() < 0.3:
                    w.append(rng.randrange(99))
            out.append((b, rng.randrange(6), w))
    return out


def by_factors(rows, window):
    words, counts = np.array([x for *_, w in rows for x in w], np.uint64), np.array([len(w) for *_, w in rows])
    told = substring_dedup.factored(words, counts, np.array([b for b, _, _ in rows]), np.array([d for _, d, _ in rows]), window)
    return {(p, i) for p, f, n in zip(*(x.tolist() for x in told), strict=True) for i in range(f, f + n)}


def by_pairs(rows, window):
    held: dict = {}
    for b, d, w in rows:
        for i in range(len(w) - window + 1):
            key = (b, tuple(w[i : i + window]))
            held[key] = min(d, held.get(key, d))
    return {(k, i) for k, (b, d, w) in enumerate(rows) for i in range(len(w) - window + 1) if held[b, tuple(w[i : i + window])] < d}


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_factors_find_what_pairs_find(window):
    for seed in range(150):
        rows = made(random.Random(seed), window)
        assert by_factors(rows, window) == by_pairs(rows, window), seed


def test_without_factors_windows_are_missed(monkeypatch):
    """With every word its own factor, no window lies in two factors."""
    real = substring_dedup.greedy_factors
    monkeypatch.setattr(substring_dedup, "greedy_factors", lambda index, start, end: (np.arange(int(end.max())), np.arange(1, int(end.max()) + 1)))
    rows = made(random.Random(3), 5)
    assert by_pairs(rows, 5) and not by_factors(rows, 5)
    monkeypatch.setattr(substring_dedup, "greedy_factors", real)
    assert by_factors(rows, 5) == by_pairs(rows, 5)


def test_matches_are_looked_up_at_factors_and_boundaries_only(monkeypatch):
    """A copy of a long phrase is one look-up; text of its own is one for each word, and none for its windows."""
    asked: list[int] = []
    real = substring_dedup.Index.longest
    monkeypatch.setattr(substring_dedup.Index, "longest", lambda self, places: (asked.append(len(places)), real(self, places))[1])
    first, own = list(range(100)), list(range(1000, 1060))
    assert by_factors([(0, 1, first), (0, 2, first[10:90]), (0, 3, own)], 50) == {(1, i) for i in range(31)}
    assert sum(asked) == 100 + 1 + 60


def test_the_key_of_hashes_is_one_a_run_and_not_its_name(spark):
    key = textkit.run_key(spark)
    assert key == textkit.run_key(spark) and 0 <= key < 1 << 64
    held = dict(textkit._KEYS)
    textkit._KEYS.clear()
    try:
        assert textkit.run_key(spark) != key
    finally:
        textkit._KEYS.update(held)


def shared_passages(rng, n_docs):
    """Texts of their own that all hold a passage, or a part of it, or a repeated line: large blocks with many surroundings."""
    passage, line = [f"p{i}" for i in range(75)], [f"l{i % 7}" for i in range(56)]
    out = []
    for d in range(n_docs):
        own = [f"o{d}_{i}" for i in range(rng.randrange(0, 12))]
        a = rng.randrange(0, 20)
        core = rng.choice([passage, passage[a : a + 55], line + line, ["a"] * rng.randrange(50, 130)])
        out.append(" ".join([*own, *core, *own[::-1]]))
    return out


def removed_by_windows(texts, window=50):
    held, gone = {}, []
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - window + 1):
            held.setdefault(tuple(w[i : i + window]), d)
    for d, t in enumerate(texts):
        w = t.split()
        gone.append(len({j for i in range(len(w) - window + 1) if held[tuple(w[i : i + window])] < d for j in range(i, i + window)}))
    return gone


def test_large_blocks_are_split_by_content(spark, monkeypatch):
    """With few phrases to a block, passages in many documents go through several levels; every level parses, none loses a window."""
    levels, parsed = [], []
    real, parse = substring_dedup._level, substring_dedup._factored_rows
    monkeypatch.setattr(substring_dedup, "_level", lambda rows, window, anchor: (levels.append(anchor), real(rows, window, anchor))[1])
    monkeypatch.setattr(substring_dedup, "_factored_rows", lambda rows, window: (parsed.append(1), parse(rows, window))[1])
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 8)
    texts = shared_passages(random.Random(11), 160)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).select("doc_id", "n_removed").collect()}
    assert got == dict(enumerate(removed_by_windows(texts)))
    assert levels[:2] == [12, 31] and len(levels) > 2 and levels == sorted(levels) and len(parsed) > 1


@pytest.mark.parametrize("anchor", [3, 5, 8])
def test_pieces_are_windows_at_most_and_equal_windows_meet(anchor):
    """Cutting the phrases of a block anew puts each window into one piece; equal windows get one block, whatever surrounds them."""
    rng, window = np.random.default_rng(anchor), 8
    base = rng.integers(0, 5, 30)
    lists = [np.concatenate([rng.integers(0, 5, rng.integers(0, 6)), base[a : a + 15], rng.integers(0, 5, 4)]) for a in rng.integers(0, 15, 40)]
    counts = np.array([len(x) for x in lists])
    flat = textkit.mix(np.concatenate(lists).astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(40, 7)), pa.array(np.arange(40, dtype=np.int32) * 100), textkit.list_array(flat.view(np.int64), counts, pa.int64())], ["anchor", "first", "words"])
    ((_, _, of, first, n, block, _),) = substring_dedup._cut(batch, window, anchor, 0)
    assert n.max() <= window - anchor + 1
    met: dict = {}
    seen = []
    for o, f, k, b in zip(of.tolist(), first.tolist(), n.tolist(), block.tolist(), strict=True):
        for i in range(f - 100 * o, f - 100 * o + k):
            seen.append((o, i))
            met.setdefault(tuple(lists[o][i : i + window].tolist()), set()).add(b)
    assert sorted(seen) == [(o, i) for o in range(40) for i in range(counts[o] - window + 1)]
    assert all(len(b) == 1 for b in met.values())
