"""The operators of microbook.llm against brute force, on small tables with nulls, empty and repeated rows."""

import base64
import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from microbook.llm import common, decontaminate, exact_dedup, html_text, jaccard_join, mixing, substring_dedup, textkit, token_counts, toxicity, url_filter, warc
from microbook.llm.common import components, lookup_left

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, row string, size string"


def docs(spark, texts, ids=None, sources=None):
    """Documents with clashing extra columns."""
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], len(t or ""), "w", "s", "r", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, odd white space, nulls and empties."""
    rng = random.Random(seed)
    out = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(60)]
    base = words(rng, 220)
    for k in range(12):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
        out.append(" ".join(own))
    passage = words(rng, 70)
    out += [" ".join(words(rng, 30) + passage[a:b] + words(rng, 20)) for a, b in ((0, 70), (0, 70), (5, 70), (0, 55), (10, 60), (0, 40))]
    out += [out[3], out[3], out[5].replace(" ", "\n\t "), None, None, "", "  \n", "one", "one", "two words", "ä ö ü ß é " * 30, "same line\n" * 200]
    # a line on which the order of windows inside one text matters
    out += [" ".join(["loop"] * 120), " ".join(["loop"] * 90), " ".join(passage * 3)]
    return out


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


# word hashing


def test_hashes_follow_words_not_places():
    import pyarrow as pa

    texts = ["a bb ccc", None, "", "bb", " ccc\ta\u00a0b ", "A"] * 3
    by: dict = {}
    for ch in textkit.chunks(pa.array(texts).slice(1), True):
        for i in range(len(ch.first) - 1):
            t = (texts[1:][ch.rows.start + i] or "").lower()
            want = SPLIT.findall(t)
            own = ch.hashes[ch.first[i] : ch.first[i + 1]].tolist()
            assert len(own) == len(want)
            for w, h in zip(want, own, strict=True):
                assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_hashes_of_repetitive_words_and_sequences_differ():
    import pyarrow as pa

    for n in (1024, 2048, 8192):
        texts = [f"{thue_morse(n, 'a', 'b')} {thue_morse(n, 'b', 'a')}", thue_morse(n, "a ", "b "), thue_morse(n, "b ", "a ")]
        (ch,) = textkit.chunks(pa.array(texts), True, key=3)
        assert len(set(ch.hashes[:2].tolist())) == 2 and len(set(ch.grams(ch.first[1:-1], ch.first[2:]).tolist())) == 2
    (ch,) = textkit.chunks(pa.array(["a b c d e f g h", "x a b c d e f g h"]), True, key=3)
    for n in range(1, 9):
        assert ch.grams(np.array([0]), np.array([n])) == ch.grams(np.array([9]), np.array([9 + n]))


# 1


def test_collisions_that_were_planted_hit_nothing(spark):
    a, b = thue_morse(8192, "a", "b"), thue_morse(8192, "b", "a")
    bench = spark.createDataFrame([("item a", f"{a}")], "item_id string, text string")
    d = docs(spark, [a, b, f"x {a} y"])
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(d, bench).collect()} == {0: (1, ["item a"]), 1: (0, []), 2: (1, ["item a"])}
    # an automaton whose words collide still compares them
    own = decontaminate.Automaton([(1, [b"one"])])
    import pyarrow as pa

    (ch,) = textkit.chunks(pa.array(["two"]), True)
    assert own.checked(np.array([0]), ch, 0) == ([], set())
    assert {r.component_id for r in jaccard_join.jaccard_components(docs(spark, [a, b, f"{a} z", f"{b} z"]), 1, 85, 100).collect()} == {0, 1, 2, 3}
    one, two = f"{a} " * 61, f"{b} " * 61
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs(spark, [one, two])).collect()] == [0, 0]


def brute_windows(texts, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    tok = lambda t: pattern.findall((t or "").translate(lower))
    out = []
    for t in texts:
        ws, hit, names = tok(t), set(), set()
        for item, text in items:
            iw = tok(text)
            n = min(k, len(iw))
            for win in {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else ():
                for i in range(len(ws) - n + 1):
                    if tuple(ws[i : i + n]) == win:
                        hit |= set(range(i, i + n))
                        names.add(item)
        ids = sorted(str(x) for x in names if x is not None)
        out.append((len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_finds_every_window(spark):
    rng = random.Random(4)
    v = [f"k{i}" for i in range(6)]  # a small vocabulary, so windows overlap and repeat
    item_words = [[rng.choice(v) for _ in range(rng.choice((3, 9, 10, 11, 25)))] for _ in range(12)]
    items = [(i, " ".join(w)) for i, w in enumerate(item_words)] + [(3, "k0 k1"), (50, None), (51, "!!"), (None, "k5 k5 k5 k0"), (7, " ".join(item_words[8]))]
    texts = [" ".join(rng.choice(v) for _ in range(rng.randrange(200))) for _ in range(25)]
    texts += [", ".join(item_words[4]).upper(), "x " + " ".join(item_words[5]) + " y", None, "", "K0-K1", "no"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 40):
        found = decontaminate.decontaminate(docs(spark, texts), bench, block_words=block, clean=False).collect()
        got = [(r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.n_hit > 0) for r in sorted(found, key=lambda r: r.doc_id)]
        assert got == brute_windows(texts, items)


def test_decontamination_by_names_and_long_items(spark):
    rng = random.Random(14)
    long = " ".join(f"v{rng.randrange(50)}" for _ in range(300))
    items = [("b", long), ("a", "k1 k2 k3 k4"), ("a", "k9"), (None, "k7 k8")]
    texts = [" ".join(long.split()[i : i + 25]) for i in range(0, 280, 7)] + ["k1 k2 k3 k4", "k9 k7 k8", "k1 k2"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (10**6, 30):
        found = decontaminate.decontaminate(docs(spark, texts), bench, block_words=block, clean=False).collect()
        got = [(r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in sorted(found, key=lambda r: r.doc_id)]
        assert got == brute_windows(texts, items)


def test_cleaning_keeps_columns_that_are_named_like_results(spark):
    d = docs(spark, ["a b c", "bad words"]).withColumns({c: F.lit(f"own {c}") for c in ("n_hit", "items", "spans", "clean_text", "cut", "hit", "rest", "lost", "a.b")})
    bench = spark.createDataFrame([(1, "bad words")], "item_id long, text string")
    for limit in (0.0, 0.1):
        (row,) = decontaminate.clean_documents(d, bench, limit).collect()
        assert row.asDict() == {r.doc_id: r.asDict() for r in d.collect()}[0]


def test_decontamination_cuts_spans_and_keeps_the_rest(spark):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    d = docs(spark, ["Before, " + passage + " after.", "clean text é", None])
    got = rows_of(decontaminate.decontaminate(d, bench), "doc_id")
    assert got[0]["clean_text"] == "Before,  after." and got[1]["clean_text"] == "clean text é" and got[2]["clean_text"] is None
    assert {r.doc_id for r in decontaminate.clean_documents(d, bench).collect()} == {1, 2}
    kept = decontaminate.clean_documents(d, bench, coverage_limit=0.9)
    assert kept.columns == d.columns and rows_of(kept, "doc_id")[0]["text"] == "Before,  after."
    assert decontaminate.clean_documents(d, bench.limit(0)).count() == 3
    assert decontaminate.clean_documents(d.limit(0), bench).count() == 0


# 2


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        ws = SPLIT.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({("*", *ws)} if ws else set()))
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_components(spark, k, num, den):
    texts = corpus()
    rng = random.Random(9)
    # a chain whose ends do not link, and many texts around one common passage
    chain = words(rng, 100)
    for _ in range(8):
        texts.append(" ".join(chain))
        at = rng.randrange(95)
        chain = chain[:at] + words(rng, 1) + chain[at + 1 :]
    common = words(rng, 60)
    texts += [" ".join(common + words(rng, 12)) for _ in range(60)]
    got = jaccard_join.jaccard_components(docs(spark, texts).repartition(5), k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, k, num, den)


def test_jaccard_edge_rows(spark):
    texts = ["a b c d e f", "a b c d e f", "z", None, "a b c d e f"]
    got = jaccard_join.jaccard_components(docs(spark, texts, ids=[5, 5, 7, None, None]), 4, 85, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("5", 3, "5"), ("5", 3, "5"), ("7", 1, "7"), ("None", 0, "None"), ("None", 3, "None")]
    assert jaccard_join.jaccard_components(docs(spark, texts).limit(0)).count() == 0
    kept = jaccard_join.one_of_each(docs(spark, ["a b c d e f g", "a b c d e f g", None, None]))
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3} and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_a_doc_id_with_several_texts_keeps_its_links(spark):
    rng, texts, ids = random.Random(4), [], []
    for i in range(150):  # few of the linked pairs agree in fewer than two signatures and are left to the matrix
        long = [f"x{i}_{k}" for k in range(90)]
        texts += [" ".join(f"s{i}_{k}" for k in range(10)), " ".join(long), " ".join(long[:-10] + [f"y{i}_{rng.random()}" for _ in range(10)])]
        ids += [i, i, 1000 + i]
    got = jaccard_join.jaccard_components(docs(spark, texts, ids=ids), 1, 80, 100).collect()
    assert len(got) == 450 and {(r.doc_id, r.component_id) for r in got} == {(i, i % 1000) for i in ids}


@pytest.mark.parametrize("wide", [2, 10**9])
def test_the_order_of_tokens_decides_no_link(spark, monkeypatch, wide):
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    monkeypatch.setattr(jaccard_join, "STRETCH", 500)
    rng = random.Random(2)
    common = words(rng, 100)
    texts = [" ".join(common + words(rng, 22)) for _ in range(40)] + [" ".join(common + ["y"] * i) for i in range(6)]
    got = jaccard_join.jaccard_components(docs(spark, texts), 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 4, 85, 100)


def test_families_below_the_threshold_and_crowded_columns(spark, monkeypatch):
    """Many documents that share most of their words but link with few others, in small groups and crowded columns."""
    for name, value in (("BLOCK", 8), ("QUERIES", 8), ("HOT", 2), ("WIDE", 10**9)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng, texts = random.Random(21), []
    for f in range(3):
        base = [f"f{f}_{i}" for i in range(60)]
        for k in range(24):
            own = list(base)
            for at in rng.sample(range(60), rng.choice((1, 3, 6, 9))):
                own[at] = f"u{f}_{k}_{at}"
            texts.append(" ".join(own))
    for shingle, num in ((1, 85), (2, 80)):
        got = jaccard_join.jaccard_components(docs(spark, texts), shingle, num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, shingle, num, 100)


def test_groups_are_opened_by_their_bound():
    import pandas as pd

    side = lambda rows: pd.DataFrame(rows, columns=["doc_id", "comp", "tokens"])
    members = side([(1, 1, range(10)), (2, 2, range(5, 15)), (3, 3, range(100, 110)), (4, 1, range(10))])
    queries = side([(7, 7, range(10)), (8, 3, range(100, 110)), (9, 9, range(0, 20, 2)), (5, 5, range(9))])
    assert jaccard_join.open_groups(queries, members, 80, 100) == [(7, 1), (5, 1)]


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 400)]
    got = rows_of(components(spark.createDataFrame(path + hub + [(500, 500)], "u long, v long")), "node")
    assert {got[i]["comp"] for i in range(41)} == {0} and {got[i]["comp"] for i in range(100, 400)} == {100} and 500 not in got


@pytest.mark.parametrize("most", [0, 100_000])
def test_components_of_any_size_agree(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FEW_EDGES", most)
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)]
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for u, v in pairs:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    nodes = {x for u, v in pairs if u != v for x in (u, v)}
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(got) == len(nodes) and {r.node: r.comp for r in got} == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_rounds_over_few_edges_are_not_dealt_to_all_partitions(spark):
    """The driver keeps a record of each task: hundreds of partitions a round took it 1,500 MB."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)]
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("few_edges", "components")
    try:
        found = components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()
        told = spark.sparkContext.statusTracker()
        stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("few_edges") for s in told.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.comp for r in found} == {0, 100} and len(found) == 261
    assert stages and sum(s.numCompletedTasks for s in stages if s) <= 300


def test_lookups_of_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(i, i) for i in range(2, 50)] + [(None, 7)], "k long, x long")
    facts = spark.createDataFrame([(i, str(i)) for i in range(1, 30)], "k long, name string")
    got = lookup_left(rows, facts, ["k"]).collect()
    assert len(got) == 949 and all(r.name == (str(r.k) if r.k is not None and r.k < 30 else None) for r in got)


# 3


def brute_removed(texts, n=50):
    ws = [SPLIT.findall(t or "") for t in texts]
    first: dict = {}
    for d, w in enumerate(ws):
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, w in enumerate(ws):
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring_dedup(spark, monkeypatch):
    texts = corpus(3)
    rng = random.Random(5)
    a, b = words(rng, 150), words(rng, 150)
    # windows that run from one reference into another, and passages met in several places
    texts += [" ".join(a), " ".join(b), " ".join(a[60:130] + b[10:90]), " ".join(a[100:150] + b[:50]), " ".join(a[:75] + b[75:]), " ".join(b + a), " ".join(a[80:140] + a[20:75])]
    expected = brute_removed(texts)
    # all blocks parsed; all blocks split down to whole windows; some of each
    for rows in (substring_dedup.BLOCK_ROWS, 0, 2):
        monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", rows)
        got = substring_dedup.substring_dedup(docs(spark, texts).repartition(4)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == expected
    assert sum(r.n_removed > 0 for r in got) > 15


@pytest.mark.parametrize("seed", range(12))
def test_factors_against_brute_force(seed):
    """Longest earlier matches, and duplicate runs, of phrases over a small alphabet in several blocks."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 40, 30)
    block, doc = np.sort(rng.integers(0, 4, 30)), rng.integers(0, 12, 30)
    held = [rng.integers(0, 2 + seed % 3, n) for n in counts]
    held[3] = held[7][: counts[3]]
    counts = np.array([len(h) for h in held])
    sets = [{(block[j], doc[j], tuple(h[a:b])) for a in range(len(h)) for b in range(a + 1, len(h) + 1)} for j, h in enumerate(held)]

    def known(i, part):
        return any((block[i], doc[j], part) in sets[j] for j in range(30) if doc[j] < doc[i] and block[j] == block[i])

    longest = [max([k for k in range(1, len(h) - a + 1) if known(i, tuple(h[a : a + k]))], default=0) for i, h in enumerate(held) for a in range(len(h))]
    flat, phrase = np.concatenate(held).astype(np.uint64), np.repeat(np.arange(30), counts)
    left = np.concatenate([np.arange(n, 0, -1) for n in counts])
    assert substring_dedup.Index(flat, block[phrase], doc[phrase], left).longest(np.arange(len(flat))).tolist() == longest
    window = 5
    got = {(p, f + k) for p, f, n in zip(*substring_dedup.factored(flat, counts, block, doc, window)) for k in range(n)}
    assert got == {(i, a) for i, h in enumerate(held) for a in range(len(h) - window + 1) if known(i, tuple(h[a : a + window]))}


def test_substring_dedup_edge_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.substring_dedup(docs(spark, [t, t, t, t, None, ""], ids=[4, 4, 9, None, 3, 1])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == [("1", 0, 0), ("3", 0, 0), ("4", 60, 0), ("4", 60, 0), ("9", 60, 60), ("None", 60, 0)]
    assert substring_dedup.substring_dedup(docs(spark, [t]).limit(0)).count() == 0


# 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies</p></div>
<article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b> text,<br>next&nbsp;line &lt;b&gt; &#233;&#x20AC;.<p>Short.</p>
<div class="ad">Buy now</div><form><label>Mail</label><input></form><p>Last   one
here.</p></article><aside><p>Side</p></aside><section id="comments"><p>I disagree with all of this and say so at length here.</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold text, next line <b> \u00e9\u20ac.\n\nShort.\n\nLast one here."


def test_main_text_without_an_article_surges_and_dives():
    long = "A paragraph that is long enough to let the sum of the window surge above its threshold, with words to spare."
    page = f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div class='sidebar'><p>a</p><p>b</p><p>c</p></div><p><a>Imprint</a></p>"
    assert html_text.main_text(page) == f"{long}\n\nShort.\n\n{long}"


@pytest.mark.parametrize("advert", ['<div class="ad"><p>x</p></div>', "<aside><p>x</p><p>y</p></aside>", "<ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>"])
def test_main_text_goes_on_behind_an_advert(advert):
    a, b = ("A paragraph that is long enough to let the sum of the window surge above its threshold, with words to spare. " * k for k in (1, 2))
    page = f"<div><p>{a}</p>{advert}<p>{b}</p><p><a>A line that is a link</a></p><p>Short.</p></div>{advert}<p><a>Imprint</a></p>"
    assert html_text.main_text(page) == f"{a.strip()}\n\n{b.strip()}\n\nA line that is a link\n\nShort."
    assert html_text.main_text(f"<p>a</p>{advert}<p>b</p>") == "a\n\nb"


def test_main_text_is_the_article_that_surges():
    long = "A paragraph that is long enough to let the sum of the window surge above its threshold, with words to spare."
    teasers = "".join(f"<p><a href=t{i}>{long} {i}</a></p>" for i in range(5))
    page = f"<body><article>{teasers}</article><article><p>Short.</p><p>{long}</p><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><p>End.</p></article></body>"
    assert html_text.main_text(page) == f"Short.\n\n{long}\n\nx\n\ny\n\nz\n\nEnd."
    assert html_text.main_text("<article><p>a</p></article><article><p>bc</p></article>") == "a\n\nbc"
    assert html_text.main_text(f"<article><p>{long}</p></article><p>{long}</p><main><p>{long} b</p></main>") == f"{long}\n\n{long} b"


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a < b</p>", "a < b"), ("<script>x", ""), ("<p>a<!-- b", "a"), ("<p", ""), ("</p></div>x<p>y", "x\n\ny"), ("<nav>x</nav>", "")])
def test_main_text_of_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_what_a_page_says_of_its_parts_is_a_prior():
    long = "A paragraph that is long enough to let the sum of the window surge, with words to spare. " * 4
    text = long.strip()
    for outer in ("<article>{}</article>", "{}"):
        page = f"<div class='related-work'><h2 id='search-methods'>Search</h2><p class=form>{long}</p></div><div class='share price'><p>{long}</p></div><form><p>{long}</p></form>"
        short = "<div class='share'>tell a friend</div><form>Name <input> Mail <input></form><div class='ad'>buy</div><aside>more</aside>"
        assert html_text.main_text(outer.format(short + page + short)) == f"Search\n\n{text}\n\n{text}\n\n{text}"
    assert html_text.main_text(f"<p>{long}</p><div class='sidebar-left'><p>{long}</p></div><div id=comments><p>{long}</p></div>") == text


def test_attributes_follow_the_rules_of_html():
    assert html_text.main_text("<article><p data-x=it's>one</p></article>") == "one"
    assert html_text.main_text("<article><p title=\"5\" wide\">one</p><p a='x>y' b=\">\">two</p><p =c>three</p></article>") == "one\n\ntwo\n\nthree"
    assert html_text.main_text("a<!-->b<!-- > -->c") == "abc"


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</x>" * 40_000 + "a", "<a x='" * 40_000, "<p " + "a=" * 200_000, "<!--" * 40_000, "<p>a" * 40_000, "<b class=x>" * 40_000])
def test_long_and_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_window_sums_against_loops():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.choice((0, 0, 5, 40, 200)) for _ in range(rng.randrange(30))]
        sums = [sum(sizes[i : i + 3]) for i in range(len(sizes))]
        assert html_text.window_sums(sizes) == sums
        # a dive is a window without text; between dives every line with text is in one stretch
        held = [k for _, a, b in html_text.stretches(sizes) for k in range(a, b) if sizes[k]]
        assert held == [k for k, n in enumerate(sizes) if n]
        for surged, a, b in html_text.stretches(sizes):
            assert sizes[a] and sizes[b - 1] and all(sums[a:b]) and surged == any(n > html_text.SURGE for n in sums[max(0, a - 2) : b])


def test_pages_keep_their_rows(spark):
    p = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(p).collect()
    assert len(got) == 3 and got[2].text == "" and got[0].text.startswith("Title") and html_text.extract_text(p.limit(0)).count() == 0


# 5


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    free, out, left = {n: weights[i % 3] for i, (n, _) in enumerate(ordered)}, {}, share * sum(s for _, s in ordered)
    size = dict(ordered)
    while over := [n for n, w in free.items() if left * w / sum(free.values()) > limit * size[n]]:
        for n in over:
            out[n] = limit * size[n]
        left -= sum(out[n] for n in over)
        free = {n: w for n, w in free.items() if n not in over}
    return out | {n: left * w / sum(free.values()) for n, w in free.items()}


def targets(spark, sizes):
    rows = spark.createDataFrame([(n, s, 1) for n, s in sizes], "source string, size long, n long").repartition(3)
    return {r.source: r.target for r in mixing.targets(rows).collect()}


def test_targets_reshare_what_is_over(spark):
    assert targets(spark, [("b", 1000), ("a", 10), (None, 30)]) == {"a": 20.0, "b": 1480.0, None: 60.0}
    assert targets(spark, []) == {} and targets(spark, [("a", 0)]) == {"a": 0.0}
    rng = random.Random(5)
    many = [("é", 5), ("Z", 7), ("", 3), ("\U0001f600", 9), ("\uffff", 2), (None, 50)] + [(f"s{i}", int(10 ** rng.uniform(0, 6))) for i in range(200)]
    got = targets(spark, many)
    assert got == pytest.approx(brute_targets(many)) and sum(got.values()) == pytest.approx(1.5 * sum(n for _, n in many))


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 5000, 999), rng.uniform(0, 1, 999)
    q = mixing.flight(size, p, rng.integers(-(2**63), 2**63, 999))
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    same = mixing.flight(np.full(50, 7), np.full(50, 0.3), np.arange(50))
    assert same.sum() == pytest.approx(15)


def test_flight_keeps_every_probability_on_average():
    """Short, middling and long documents alike; a rule that always goes to the nearer end takes the middling ones less often."""
    rng = np.random.default_rng(8)
    n, runs, chance = 60, 1500, 0.3
    size = np.sort(rng.integers(1, 5000, n))
    total = np.zeros(n)
    for _ in range(runs):
        by = rng.permutation(n)
        total[by] += mixing.landing(size[by], mixing.flight(size[by], np.full(n, chance), rng.integers(-(2**63), 2**63, n)))
    mean, sigma = total / runs, (chance * (1 - chance) / runs) ** 0.5
    assert abs(mean - chance).max() < 5 * sigma
    for third in (mean[:20], mean[20:40], mean[40:]):
        assert abs(third.mean() - chance) < 0.02


def test_landing_against_every_rounding():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size, p = rng.integers(0, 60, 6), rng.choice([0.0, 1.0], 6)
        at = rng.choice(6, 2, replace=False)
        p[at] = rng.uniform(0.05, 0.95, 2)
        q = mixing.landing(size, p)
        assert set(q) <= {0.0, 1.0} and (np.delete(q, at) == np.delete(p, at)).all()
        best = min(abs(i * size[at[0]] + j * size[at[1]] - (p[at] * size[at]).sum()) for i in (0, 1) for j in (0, 1))
        assert abs((q * size).sum() - (p * size).sum()) == pytest.approx(best)


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    texts = [" ".join(["w"] * rng.randrange(1, 300)) for _ in range(900)] + [None, "", " "]
    sources = [None if i % 11 == 0 else "src0" if i % 3 == 0 else f"s{i % 5}" for i in range(len(texts))]
    d = docs(spark, texts, sources=sources)
    for block in (2048, 64):
        got = mixing.mix_sources(d, block=block).collect()
        assert len(got) == len(texts)
        by: dict = {}
        for r in got:
            assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
            by.setdefault(r.source, [0, r.target, r.source_size, 0])
            by[r.source][0] += r.taken
            by[r.source][3] += r.size
        assert {s: t for s, (_, t, *_) in by.items()} == pytest.approx(brute_targets([(s, x[2]) for s, x in by.items()]))
        for taken, target, size, own in by.values():
            assert own == size and abs(taken - target) <= 300
        again = mixing.mix_sources(d.repartition(7).orderBy(F.rand(3)), block=block).collect()
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_ids_beyond_the_doubles_stay_themselves(spark):
    big = 2**53
    texts, ids = ["a b", "c d e", "f", "f", "g h", None], [big + 1, big + 3, big + 5, big + 7, None, big + 9]
    mixed = mixing.mix_sources(docs(spark, texts, ids=ids, sources=["s"] * 6)).collect()
    assert sorted(map(str, (r.doc_id for r in mixed))) == sorted(map(str, ids))
    got = exact_dedup.exact_dedup(docs(spark, texts * 2, ids=ids + [big + 21, None, big + 25, None, None, None])).collect()
    want = {"a b": big + 1, "c d e": big + 3, "f": big + 5, "g h": None, "": big + 9}
    digest = {hashlib.sha256(t.encode()).hexdigest(): i for t, i in want.items()}
    assert len(got) == 12 and all(r.keep_id == digest[r.text_sha256] and r.kept == (r.doc_id == r.keep_id) for r in got)
    components = jaccard_join.jaccard_components(docs(spark, texts, ids=ids), 1, 85, 100).collect()
    assert {(r.doc_id, r.component_id) for r in components} == {(i, big + 5 if i == big + 7 else i) for i in ids}
    cut = substring_dedup.substring_dedup(docs(spark, [" ".join(map(str, range(60)))] * 3, ids=[big + 1, None, big + 3])).collect()
    assert {(r.doc_id, r.n_removed) for r in cut} == {(big + 1, 0), (None, 0), (big + 3, 60)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs(spark, texts, ids=ids), spark.createDataFrame([(1, "f")], "item_id long, text string")).collect()} == set(ids)
    counts = token_counts.count_tokens(docs(spark, texts, ids=ids)).collect()
    assert {None if r.doc_id is None else int(r.doc_id) for r in counts} == set(ids)


# 6


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


URLS = ["http://a.COM/en/7x?u=1", "https://example.com/en/7", "https://www.example.com/en/8#x", "ftp://xcom/en/", "http://com/en/", "http://b.example.net/de/8/1", "http://example.net/de/9", "x", None, "", "://", "http://", "http://org?/es/", "http://a.org/es/#", "http://x.org:80/es/", "a://b://c.com/en/", "http://ÄÖ.org/es/é"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i % 20, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string")
    rules = url_filter.RULES + [url_filter.RULES[0], (None, "/", "block"), ("", "/", "block")]
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = [(i % 20, *brute_rule(u, url_filter.RULES)) for i, u in enumerate(URLS * 2)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    none = url_filter.url_filter(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(want)


def test_hosts_of_very_many_labels(spark):
    urls = ["http://" + "a." * 16_000 + "com/en/", "http://" + "b" * 30_000 + "/", "http://" + "." * 9_000 + "/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow"} and time.time() - began < 20


def test_url_rules_survive_a_full_filter(spark):
    """A filter that is far too small passes nearly all keys; the join still decides."""
    rng = random.Random(8)
    hosts = [f"h{rng.randrange(300)}.net" for _ in range(400)]
    rules = [(h, f"/{i % 7}/", "block") for i, h in enumerate(hosts[:200])]
    pages = spark.createDataFrame([(i, f"http://sub.{h}/{i % 9}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    got = url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_bytes=64).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {i: brute_rule(f"http://sub.{h}/{i % 9}/x", rules)[2:] for i, h in enumerate(hosts)}


def test_bloom_has_no_false_negatives_and_few_positives():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(0, 2**63, 20_000).astype(np.uint64)
    b = url_filter.BlockedBloom(len(keys))
    b.add(keys)
    assert b.maybe(keys).all() and b.maybe(others).mean() < 0.02


def test_bloom_slices_are_those_of_one_filter(spark):
    rows = spark.range(40_000).select(F.xxhash64("id").alias("k"))
    keys = rows.toPandas()["k"].to_numpy().view(np.uint64)
    built, own = url_filter.build_bloom(rows, 40_000), url_filter.BlockedBloom(40_000)
    own.add(keys)
    assert own.slices > 1 and (built.words == own.words).all()


# 7


def test_toxicity_generalises_to_held_out_texts(spark):
    rng = random.Random(7)
    bad = ["idiot", "moron", "trash"]
    texts = []
    for i in range(400):
        own = words(rng, rng.randrange(5, 60), 300)
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(bad)
        texts.append(" ".join(own))
    texts += [None, "", "é"]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(None, 1, 1), (401, None, 0), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    d = docs(spark, texts)
    model = toxicity.train(d, labels)
    got = toxicity.scored(d.select("doc_id", "text"), model).withColumn("held_out", toxicity.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in tested]) > 0.95
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns and kept.filter("doc_id % 4 <> 0").count() >= 0.95 * 300


def test_the_stage_keeps_a_column_named_score(spark):
    d = docs(spark, ["a clean text", "another one"])
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert sorted(map(str, toxicity.without_toxic(d, labels).collect())) == sorted(map(str, d.collect()))


def test_the_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 1000, i % 2) for i in range(300)], "doc_id long, text string, toxic int")
    assert len(toxicity.training_rows(rows, rows, max_bytes=5_500)) == 5


def test_toxicity_without_labels_scores_zero(spark):
    d = docs(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.score < 1e-9 for r in toxicity.scored(d, toxicity.train(d, none)).collect()] == [True, True]
    assert toxicity.scored(d.limit(0), toxicity.train(d, none)).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    d = docs(spark, [f"text {i}" for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, toxic int, quality int")
    assert len(toxicity.training_rows(d, labels)) == 0


def test_the_fit_reads_its_whole_sample(spark):
    labels = spark.range(4_300).selectExpr("id as doc_id", "cast(id < 1900 as int) as toxic").unionByName(spark.range(10_000, 11_500).selectExpr("id as doc_id", "0 as toxic"))
    rows = toxicity.training_rows(labels.selectExpr("doc_id", "'a' as text"), labels)
    assert rows["toxic"].value_counts().to_dict() == {1: 1_500, 0: 2_500}


def brute_slots(text):
    s = " " + re.sub(r"\s+", " ", text.lower()).strip() + " "
    out = set()
    for n in toxicity.GRAMS:
        for i in range(len(s) - n + 1):
            h = ord(s[i])
            for c in s[i + 1 : i + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) % 2**32
            out.add((h ^ (h >> 15)) * 0x85EBCA6B % 2**32 >> (32 - toxicity.BITS))
    return out if s.strip() else set()


@pytest.mark.parametrize("piece", [5, 64, 1 << 18])
def test_slots_are_those_of_all_grams(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    for text in ("", "a", "ab", "abc", "Some  Words,\n\tand é ü 字 again " * 3, "x" * 200, " \n "):
        assert set(toxicity.slots(text).tolist()) == brute_slots(text)


def test_the_fit_holds_little_beside_the_features():
    rng = random.Random(12)
    texts = [" ".join(words(rng, 12, 40)) + (" vile" if i % 3 == 0 else "") for i in range(60)]
    tracemalloc.start()
    try:
        toxicity.fit(texts, np.array([float(i % 3 == 0) for i in range(60)]), rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * 8 * (1 << toxicity.BITS)


def test_the_fit_against_dense_matrices():
    rng = random.Random(11)
    texts = [" ".join(words(rng, 12, 40)) + (" vile" if i % 3 == 0 else "") for i in range(60)]
    y = np.array([float(i % 3 == 0) for i in range(60)])
    weights, bias = toxicity.fit(texts, y, rounds=25)
    own = [brute_slots(t) for t in texts]
    names = sorted(set().union(*own))
    x = np.array([[float(s in o) for s in names] for o in own])
    width = 1 << toxicity.BITS
    p, q = 1 + y @ x, 1 + (1 - y) @ x
    ratio = np.log(p / (width + (y @ x).sum())) - np.log(q / (width + ((1 - y) @ x).sum()))
    ratio[(x.sum(0) < 3) | (np.abs(ratio) < toxicity.LEAST_RATIO)] = 0
    v = x * ratio / x.sum(1, keepdims=True) ** toxicity.LENGTH_POWER
    costs = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    theta = np.zeros(len(names) + 1)
    m1 = m2 = np.zeros(len(names) + 1)
    for t in range(1, 26):
        miss = (1 / (1 + np.exp(-(v @ theta[:-1] + theta[-1]))) - y) * costs
        g = np.append(v.T @ miss + 1e-4 * theta[:-1], miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    assert np.count_nonzero(ratio) > 5 and bias == pytest.approx(theta[-1], abs=1e-3)
    assert weights[names] == pytest.approx(theta[:-1] * ratio, abs=1e-2)
    scores = toxicity.score_texts(texts, weights, bias, toxicity._Distinct())
    assert scores == pytest.approx(1 / (1 + np.exp(-(v @ theta[:-1] + theta[-1]))), abs=1e-3)


# 8


MAGIC = "WARC/1.1\r\n"
EVIL = f"before{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:66>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n{MAGIC}after"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_archives_round_trip(spark, tmp_path, split):
    htmls = [EVIL, "plain", "", None, "plain", f"{MAGIC}", "é" * 500, EVIL, "Content-Length: 3\r\n\r\n", "x" * 3000, f"a{MAGIC}{MAGIC}b", "plain", f"{MAGIC}Content-Length: 99999999\r\n\r\n"]
    urls = ["http://a/", None, "http://b/\r\nX-Evil: 1\r\n\r\n", *[f"http://c/{i}" for i in range(10)]]
    pages = spark.createDataFrame([(i, urls[i], h, "x") for i, h in enumerate(htmls)], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_warc(pages.repartition(3), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = rows_of(warc.describe_warc(spark, path), "page_id")
        bodies = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last = {}
    for i, h in enumerate(htmls):
        last[h or ""] = i
    for i, h in enumerate(htmls):
        first = last[h or ""] == i
        want = {"page_id": i, "payload_bytes": len((h or "").encode()), "payload_digest": sha1(h), "record_type": "response" if first else "revisit", "refers_to": None if first else last[h or ""]}
        assert got[i] == want
    assert len(got) == len(bodies) == len(htmls)
    payloads = {bytes(b.body).decode().split("\r\n\r\n", 1)[1] for b in bodies if "WARC-Type: response" in b.header}
    assert payloads == {h or "" for h in htmls}


def test_archives_of_both_versions(spark, tmp_path):
    def record(version, body):
        return f"WARC/1.{version}\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    bodies = ["x WARC/1.0 y", "WARC/1.1", "WARC/1.7\r\nz", "WARC/1.0\r\nContent-Length: 1\r\n\r\na\r\n\r\n"]
    (tmp_path / "a.warc").write_bytes("".join(record(i % 2, b) for i, b in enumerate(bodies)).encode())
    got = warc.read_warc(spark, str(tmp_path)).orderBy("start").collect()
    assert [bytes(r.body).decode() for r in got] == bodies and all(r.header.startswith("WARC-Type: response") for r in got)


def test_archives_min_bytes_and_edge_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (None, "u", "ab"), (3, "u", "a"), (4, "u", "a"), (4, "v", "other")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), min_bytes=2)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.describe_warc(spark, str(tmp_path / "w")).collect())
    assert got == [("1", "revisit", "2", 2), ("2", "response", "None", 2), ("2", "response", "None", 2), ("3", "response", "None", 1), ("4", "response", "None", 1), ("4", "response", "None", 5), ("None", "revisit", "2", 2)]
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.describe_warc(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_archives_hash_each_payload_once(spark, tmp_path, monkeypatch, copies):
    def hashes(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("sha1(")

    pages = spark.createDataFrame([(i, "u", f"page {i % 9 if copies else i}") for i in range(20)], "page_id long, url string, html string").repartition(2)
    warc.write_warc(pages, str(tmp_path / "w"))
    plans = []
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "text", lambda self, path: plans.append(hashes(self._df)))
        warc.write_warc(pages, str(tmp_path / "unwritten"))
    # pages that may be revisits and all others are two branches; no row is in both
    assert plans == [2 if copies else 1]
    read, verified = [], warc.verified
    monkeypatch.setattr(warc, "verified", lambda found, *carried: read.append(hashes(found)) or verified(found, *carried))
    got = rows_of(warc.describe_warc(spark, str(tmp_path / "w")), "page_id")
    assert read == [1] and {i: r["payload_digest"] for i, r in got.items()} == {r.page_id: sha1(r.html) for r in pages.collect()}


def test_archives_digests(spark, tmp_path):
    htmls = [f"page {i}" for i in range(3000)]
    # each group of eight letters has leading zeros in some digest
    assert all(any(sha1(h)[i:].startswith("AA") for h in htmls) for i in (0, 8, 16, 24))
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    headers = {h.split("urn:page:")[1].split(">")[0]: h for h in (r.header for r in warc.read_warc(spark, str(tmp_path / "w")).select("header").collect())}
    assert all(f"WARC-Payload-Digest: sha1:{sha1(h)}\r\n" in headers[str(i)] for i, h in enumerate(htmls))
    got = rows_of(warc.describe_warc(spark, str(tmp_path / "w")), "page_id")
    assert [got[i]["payload_digest"] for i in range(len(htmls))] == [sha1(h) for h in htmls]


# 9


def test_exact_dedup(spark):
    texts = corpus(8) * 2
    ids = [7 * i % len(texts) for i in range(len(texts))]
    got = exact_dedup.exact_dedup(docs(spark, texts, ids=ids).repartition(3)).collect()
    normal = {i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[k] or "") for k, i in enumerate(ids)}
    groups: dict = {}
    for i, t in normal.items():
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts)
    for r in got:
        own = groups[normal[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(own), len(own), r.doc_id == min(own), hashlib.sha256(normal[r.doc_id].encode()).hexdigest())


def test_exact_dedup_edge_rows(spark):
    d = docs(spark, ["a", "a", "a", None, " ", ""], ids=[3, 3, None, 5, 6, 4])
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect())
    assert got == [("3", "3", 3, True), ("3", "3", 3, True), ("4", "4", 2, True), ("5", "4", 2, False), ("6", "6", 1, True), ("None", "3", 3, False)]
    kept = exact_dedup.deduplicated(d)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6] and kept.columns == d.columns
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


def test_minimal_perfect_hash():
    hexes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)]
    w = exact_dedup._words(hexes)
    sizes, bits, slot = exact_dedup.build_mph(w)
    assert sorted(slot) == list(range(5000)) and (exact_dedup.mph_slots(w, sizes, bits) == slot).all() and len(bits) < 5 * 5000
    with pytest.raises(ValueError):
        exact_dedup.build_mph(np.concatenate([w[:3], w[:1]]))


# 10


def test_token_counts_add_up(spark):
    texts = ["Hello world\nsecond line\n\n\n", "no end", "", None, "\n", "naïve café 漢字\n🙂🙂\nx", "a" * 300 + "\n" + "b"]
    enc = token_counts.Tokens(open(token_counts.VOCABULARY, "rb").read())
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(docs(spark, texts), rule=rule).collect()
        for i, t in enumerate(texts):
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            assert sum(r.n_tokens for r in own) == pytest.approx(len(enc.encoding.encode_ordinary(t or "")))
            assert "".join((t or "")[r.start : r.stop] for r in own) == (t or "")
            assert enc.encoding.decode(enc.encoding.encode_ordinary(t or "")) == (t or "")


@pytest.mark.parametrize("space", [" ", "\n", "\t \n", "\u3000", "\xa0"])
def test_long_white_space_is_encoded_as_by_the_encoder(space):
    enc = token_counts.Tokens(open(token_counts.VOCABULARY, "rb").read())
    for before, behind in itertools.product(("", "x", "!", "ab c "), ("", "y", "1", "!", "'s", "é")):
        text = before + space * 2500 + behind + " tail" + space * 2001
        assert enc.encode(text) == enc.encoding.encode_ordinary(text)


def test_very_long_texts_are_counted_line_by_line(spark):
    texts = [" " * 1_000_000, "a\n" * 20_000, "é" * 300_000 + "\n" + " " * 100_000 + "b"]
    got = token_counts.count_tokens(docs(spark, texts)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("lines")).collect()
    enc = token_counts.Tokens(open(token_counts.VOCABULARY, "rb").read())
    assert {r.doc_id: (r.n, r.lines) for r in got} == {i: (len(enc.encode(t)), n) for i, (t, n) in enumerate(zip(texts, (1, 20_000, 2)))}


def test_counts_of_lines_against_loops(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(("word ", "é", "漢字", "\n", "  ", "🙂", "don't")) for _ in range(rng.randrange(60))) for _ in range(40)] + [None]
    enc = token_counts.Tokens(open(token_counts.VOCABULARY, "rb").read())
    got = {(r.doc_id, r.section): (r.start, r.stop, r.n_tokens) for r in token_counts.count_tokens(docs(spark, texts)).collect()}
    want = {}
    for i, t in enumerate(texts):
        t, at = t or "", 0
        rows = t.splitlines(keepends=True) or [""]
        ends = np.cumsum([len(enc.encoding.decode_single_token_bytes(x)) for x in enc.encoding.encode_ordinary(t)]).tolist()
        starts = [0, *ends[:-1]] if ends else []
        for k, line in enumerate(rows):
            low = len(t[:at].encode())
            high = low + len(line.encode())
            want[i, k] = (at, at + len(line), sum(low <= x < high for x in starts))
            at += len(line)
    assert got == want


def brute_attribute(ends, sections, rule):
    out = [0.0] * len(sections)
    a = 0
    for b in ends:
        share = [max(0, min(b, y) - max(a, x)) for x, y in sections]
        if rule == "split":
            out = [o + s / (b - a) for o, s in zip(out, share)]
        else:
            point = a if rule == "start" else b - 1
            for k, (x, y) in enumerate(sections):
                if (rule == "majority" and sum(share) and k == share.index(max(share))) or (rule != "majority" and x <= point < y):
                    out[k] += 1
        a = b
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_loops(rule):
    rng = random.Random(3)
    for _ in range(60):
        ends = np.cumsum([rng.randrange(1, 7) for _ in range(rng.randrange(30))])
        cuts = sorted(rng.sample(range(120), 8))
        sections = list(zip(cuts[::2], cuts[1::2]))
        got = token_counts.attribute(ends.astype(np.int64), *np.array(sections).T, rule)
        assert got == pytest.approx(brute_attribute(ends.tolist(), sections, rule))


def test_fields_are_encoded_as_one_text(spark):
    rows = spark.createDataFrame([(1, "a title", "the body of it"), (2, None, "é"), (3, "", "")], "id long, title string, body string")
    got = {(r.id, r.field): r.n_tokens for r in token_counts.count_field_tokens(rows, "id", ["title", "body"]).collect()}
    enc = token_counts.Tokens(open(token_counts.VOCABULARY, "rb").read())
    assert got[1, "title"] + got[1, "body"] == len(enc.encoding.encode_ordinary("a title\nthe body of it")) and len(got) == 6
    assert token_counts.count_tokens(rows.select("id", F.col("body").alias("text")).limit(0), key="id").count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([1]), np.array([0]), np.array([1]), "none")
