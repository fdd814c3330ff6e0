"""Alignment of two tokenizers against loops over tokens, with the libraries the files are meant for."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from microbook.llm import alignment

SCHEMA = "doc_id long, text string, a int, b string, row string, n_a string"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


def bytes_a(token: str) -> bytes:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return bytes(back[c] for c in token)


def bytes_b(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def spans(ids, spell):
    out, at = [], 0
    for i in ids:
        n = len(spell(i))
        out.append((at, at + n, i))
        at += n
    return out


def brute(rows, tools):
    """rows: (doc_id, text) -> the contract's columns, by loops."""
    a_tool, b_tool = tools
    spell_a, spell_b = lambda i: bytes_a(a_tool.id_to_token(i)), lambda i: bytes_b(b_tool.id_to_piece(i))
    linked, out, docs_with = [], [], Counter()
    for _, text in rows:
        a = b = []
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            want = (" " + text).encode()
            if b"".join(map(spell_a, a)) != want or b"".join(map(spell_b, b)) != want:
                a = b = []
        sa, sb = spans(a, spell_a), spans(b, spell_b)
        links, j = [], 0
        for s, e, i in sa:
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(sb) and sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for s, e, i in sa if low <= s and e <= c) + "|" + ",".join(str(i) for s, e, i in sb if low <= s and e <= c))
            low = c
        linked.append(links)
        docs_with.update(set(links))
        out.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
    most: dict[int, int] = {}
    for (i, _), n in docs_with.items():
        most[i] = max(n, most.get(i, 0))
    return sorted(
        (str(doc_id), n_a, n_b, n_groups, n_links, sum(docs_with[p] == most[p[0]] for p in links), sum(docs_with[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for (doc_id, _), (n_a, n_b, n_groups, n_links, text), links in zip(rows, out, linked, strict=True)
    )


def told(df):
    return sorted((str(r["doc_id"]), *[r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]) for r in df.collect())


def corpus():
    rng = random.Random(4)
    words = "the of Überraschung naïve 123456 don't we'll <|endoftext|> <s> </s> <unk> <0x41> été 日本語 🙂👩‍👩‍👧 straße foo_bar(x)=y; http://a.b/c?d=e A. B.".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", "\t\t a", "a▁b", "▁", "x" * 3000, " leading", "trailing  ", "a b c", "\x00\x01", "é", "﻿bom", "ﬁ ½ Ⅷ", texts[0], texts[0], "\r\n" * 50, "ab " * 500, "\U0010ffff"]
    return list(enumerate(texts)) + [(3, "again"), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", "r", "n") for i, t in rows], SCHEMA)


def test_align_against_loops(spark, tools):
    rows = corpus()
    assert told(alignment.align(frame(spark, rows).repartition(5))) == brute(rows, tools)


def test_many_shards_change_nothing(spark, tools):
    """Documents that share a slice, and counts looked up in several passes."""
    rows = corpus()
    want = brute(rows, tools)
    assert told(alignment.align(frame(spark, rows).coalesce(1), most=40)) == want
    coded = alignment.encoded(frame(spark, rows))
    sizes = alignment.token_sizes(spark)
    assert len(alignment.shards(alignment.link_counts(coded, sizes), 40)) > 3


def test_pieces_cover_rows():
    import numpy as np

    for weights in ([5], [1, 1, 1], [9, 1, 9, 1], [3] * 10):
        got = list(alignment._pieces(np.array(weights), 4))
        assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(weights)))
        assert all(hi - lo == 1 or sum(weights[lo:hi]) <= 4 for lo, hi in got)


def test_fast_encoder_gives_the_ids_of_the_library(tools):
    with open(alignment.A_FILE, "rb") as f:
        own = alignment.ByteLevel(f.read())
    assert own.fast
    rng = random.Random(1)
    pools = ["abcdefgh ", "aA1 .,'\n\t", "éüßñ ÀÊ", "日本語テ ", "🙂👍🏽‍ ", " \t\n\r\x0b\x0c\x85\xa0 ", "'s't're've'm'll'd ", "́ำ각", "٠١٢½Ⅷ ", "<|endoftext|> "]
    pools.append("".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000))
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60)))
        assert own.encode(text).tolist() == tools[0].encode(text, add_special_tokens=False).ids, repr(text)


def test_very_long_texts(spark, tools):
    texts = [" " * 100_000 + "x", "a" * 200_000, "word " * 100_000, "x" + "\n" * 5000 + "y"]
    got = {r["doc_id"]: r for r in alignment.align(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_a"] == len(tools[0].encode(" " + t, add_special_tokens=False).ids)
        assert got[i]["n_b"] == len(tools[1].encode(t)) and got[i]["n_groups"] > 0


def test_groups_spell_the_text(spark, tools):
    rows = [(i, t) for i, t in corpus() if i is not None and i != 3]
    coded = alignment.encoded(frame(spark, rows))
    out: dict = {}
    for r in sorted(alignment.groups(coded, alignment.token_sizes(spark)).collect(), key=lambda r: (r["doc_id"], r["group"])):
        own = out.setdefault(r["doc_id"], b"")
        spelled_a = b"".join(bytes_a(tools[0].id_to_token(i)) for i in r["a"])
        assert spelled_a == b"".join(bytes_b(tools[1].id_to_piece(i)) for i in r["b"]) and (r["start"], r["stop"]) == (len(own), len(own) + len(spelled_a))
        out[r["doc_id"]] = own + spelled_a
    kept = {r["doc_id"] for r in coded.filter("n_a > 0").select("doc_id").collect()}
    assert out == {i: (" " + t).encode() for i, t in rows if i in kept}


def test_empty_tables(spark):
    assert told(alignment.align(frame(spark, []))) == []
    assert [r[1:] for r in told(alignment.align(frame(spark, [(1, None), (2, "")])))] == [(0, 0, 0, 0, 0, 0, "")] * 2
