"""Substring deduplication by relative Lempel-Ziv parsing against reference blocks that are split by content.

Reference. Every text is cut into phrases by its content: of the 12-word sequences of a 50-word window
the one with the smallest hash is the window's anchor, and a phrase is a run of windows with the same
anchor (41 at most). Equal windows have equal anchors wherever they stand, so the anchors split the
whole corpus into reference blocks: the block of an anchor holds the distinct phrases around it, each
with the smallest doc_id it occurs in. No document is left out of the reference, and a factor of a whole
window can only come from the blocks of the document's own anchors.

Parsing. A phrase that its anchor's block holds from an earlier document is one factor as a whole. Where a
block holds several phrases from several documents, they are indexed by a suffix array and the first copy
of each phrase is factored greedily, left to right, by the longest match with a phrase of an earlier
document. Factors of a window or more become duplicate spans; at a boundary, windows that lie in the two
factors around it are checked by the longest match at their own start, and no others can be duplicates. Only
one copy of each distinct phrase is parsed; its other copies are duplicate as a whole. The covered words are
removed.

Large blocks. A block of over BLOCK_ROWS phrases would be too large for one task, and dealing it to several would hold
each part against each other. It is split by content once more: its phrases are cut anew by longer sequences (31
words, then 41, 46, 48, 49, 50), so that equal windows still meet in one block, and a window lies in one piece only.
Copies of a piece are one factor, blocks of several pieces are parsed, and those that are still large are split again.
Sequences of the whole window leave one piece in each block, so this ends, and pieces are never more than windows.

Rows: a null text has no words. A null doc_id is no reference and loses nothing. Rows that share a
doc_id are no reference for each other. Order or repetition of rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_left, stored, table
from .textkit import Chunk, chunks, list_array, mix, run_key, tidy
from .url_filter import build_bloom, split_by

WINDOW = 50
ANCHOR = 12
#: Windows of one phrase at most.
PHRASE = 41
#: Phrases of one reference block that are indexed together; larger blocks are split by longer sequences.
BLOCK_ROWS = 512
#: Phrases that are indexed at once, in whole blocks.
INDEX_ROWS = 2048


def phrases(ch, window: int, anchor: int, most: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's texts: (text, first window from the text's start, number of windows, anchor, digest) of every phrase
    of at most ``most`` windows, ordered by text and place."""
    starts = ch.starts_of(window)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    grams = np.full(len(ch.hashes), np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(len(ch.hashes) - anchor + 1)
    grams[: len(at)] = ch.grams(at, at + anchor)
    # minimum of the window's sequences, by doubling; windows never reach beyond their text
    width, low, n = 1, grams, window - anchor + 1
    while 2 * width <= n:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    least = np.minimum(low[starts], low[starts + n - width])
    text = np.searchsorted(ch.first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
    head = np.flatnonzero(place % most == 0)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    digest = ch.grams(first, first + count + window - 1)
    return text[head], first - ch.first[text[head]], count, least[head], digest


def _cut(batch: pa.RecordBatch, window: int, anchor: int, key: int) -> Iterator[tuple]:
    """Of a batch of texts, or of phrases of large blocks (``words``), chunk by chunk: the chunk and, for each phrase that is
    cut, its first word in the chunk, its row in the batch, its first window in its text, windows, anchor and digest."""
    if "text" in batch.schema.names:
        for ch in chunks(batch.column("text"), False, key=key):
            of, first, n, a, d = phrases(ch, window, anchor)
            yield ch, first + ch.first[of], of + ch.rows.start, first, n, a, d
        return
    lists = batch.column("words")
    offsets, none = lists.offsets.to_numpy().astype(np.int64), np.zeros(0, np.int64)
    ch = Chunk(slice(0, len(lists)), lists.flatten().to_numpy().view(np.uint64), offsets - offsets[0], none, none, none)
    of, first, n, a, d = phrases(ch, window, anchor, window - anchor + 1)
    block = batch.column("anchor").to_numpy().view(np.uint64)
    yield ch, first + ch.first[of], of, first + batch.column("first").to_numpy()[of], n, mix(a ^ mix(block[of])), d


def _phrase_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, digest, doc_id, row, first, n) of all phrases; row: digest of the text, for rows that share a doc_id."""
    names, key = ["anchor", "digest", "doc_id", "row", "first", "n"], run_key(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, of, first, n, a, d in _cut(batch, window, anchor, key):
                ids, own = (batch.column(c).take(pa.array(of)) for c in ("doc_id", "row"))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d.view(np.int64)), ids, own, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    return rows.mapInArrow(tidy(run), "anchor bigint, digest bigint, doc_id bigint, row bigint, first int, n int")


def _word_rows(rows: DataFrame, window: int, anchor: int, wanted) -> DataFrame:
    """(anchor, digest, doc_id, row, first, words) of the phrases whose (anchor, digest, doc_id) may be ``wanted``; words: their hashes."""
    names, key = ["anchor", "digest", "doc_id", "row", "first", "words"], run_key(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for ch, begin, of, first, n, a, d in _cut(batch, window, anchor, key):
                hit = wanted.value.maybe(_filter_key(a, d, own_ids[of]))
                begin, of, first, a, d, n = begin[hit], of[hit], first[hit], a[hit], d[hit], n[hit] + window - 1
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                ids, own = (batch.column(c).take(pa.array(of)) for c in ("doc_id", "row"))
                words = list_array(ch.hashes[at].view(np.int64), n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d.view(np.int64)), ids, own, pa.array(first.astype(np.int32)), words], names)

    return rows.mapInArrow(tidy(run), "anchor bigint, digest bigint, doc_id bigint, row bigint, first int, words array<bigint>")


class Index:
    """The places of phrases, sorted as suffixes of their phrases by doubling.

    ``longest(places)``: for each place the length of the longest match, within its phrase, with a phrase of the same
    block and a smaller ``doc``; it is with the nearest suffix, on either side, of an earlier document. ``left``: words
    from each place to its phrase's end.
    """

    def __init__(self, words: np.ndarray, block: np.ndarray, doc: np.ndarray, left: np.ndarray):
        n, at = len(words), np.arange(len(words))
        self.left, self.last = left, n - 1
        levels = [np.unique(words, return_inverse=True)[1]]
        levels[0] = np.unique(block * np.int64(n) + levels[0], return_inverse=True)[1]
        width = 1
        while width < int(left.max()):
            rank = levels[-1]
            beyond = np.where(left > width, rank[np.minimum(at + width, n - 1)] + 1, 0)
            levels.append(np.unique(rank * np.int64(n + 1) + beyond, return_inverse=True)[1])
            width *= 2
        self.levels = levels
        order = np.argsort(levels[-1], kind="stable")
        b, d = block[order], doc[order]
        self.partners = []  # the nearest earlier suffix on either side, -1 where there is none
        for step in (-1, 1):
            near = at + step
            live = at
            while True:
                inside = (near[live] >= 0) & (near[live] < n)
                live = live[inside]
                live = live[(b[near[live]] == b[live]) & (d[near[live]] >= d[live])]
                if not len(live):
                    break
                near[live] = near[near[live]]  # what lies between is no earlier than the place passed over
            known = (near >= 0) & (near < n)
            known[known] = b[near[known]] == b[known]
            partner = np.full(n, -1)
            partner[order[known]] = order[near[known]]
            self.partners.append(partner)

    def longest(self, places: np.ndarray) -> np.ndarray:
        best = np.zeros(len(places), np.int64)
        for partner in self.partners:
            of = np.flatnonzero(partner[places] >= 0)
            i, j = places[of], partner[places[of]]
            most, length = np.minimum(self.left[i], self.left[j]), np.zeros(len(i), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                same = (length < most) & (self.levels[k][np.minimum(i + length, self.last)] == self.levels[k][np.minimum(j + length, self.last)])
                length += same.astype(np.int64) << k
            best[of] = np.maximum(best[of], np.minimum(length, most))
        return best


def greedy_factors(index: Index, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the factors of all phrases, in order: the longest match, or one word; all phrases advance together."""
    place, live, found = start.copy(), np.flatnonzero(end > start), []
    while len(live):
        p = place[live]
        place[live] = p + np.maximum(index.longest(p), 1)
        found.append((p, place[live]))
        live = live[place[live] < end[live]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts)
    return starts[order], ends[order]


def factored(words: np.ndarray, counts: np.ndarray, block: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse phrases (``counts`` words each) against the earlier ones of their block: (phrase, first window, windows) of their duplicate runs.

    A window inside a factor is a duplicate. One that an earlier phrase holds and that begins in a factor without
    ending in it lies in that factor and the next: from the boundary on its words are a match as well, and the next
    factor is the longest. So matches are looked up where factors begin, and for windows over a single boundary.
    """
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    phrase = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    index = Index(words, block[phrase], doc[phrase], start[phrase] + counts[phrase] - at)
    begins, ends = greedy_factors(index, start, start + counts)
    of = np.searchsorted(begins, at, "right") - 1
    following = np.minimum(of + 1, len(begins) - 1)
    over_next = np.where(phrase[begins[following]] == phrase, ends[following], ends[of])
    held = ends[of] >= at + window
    across = np.flatnonzero(~held & (over_next >= at + window))
    held[across] = index.longest(across) >= window
    # runs of held windows
    new = held.copy()
    new[1:] &= ~(held[:-1] & (phrase[1:] == phrase[:-1]))
    first = np.flatnonzero(new)
    run = np.cumsum(new)[held] - 1
    return phrase[first], first - start[phrase[first]], np.bincount(run, minlength=len(first))


def _factored_rows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, first, count): duplicate runs of windows of ``rows``, whose blocks are small."""
    names = ["doc_id", "row", "first", "count"]

    def parse(batch: pa.Table) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        anchor, doc = (batch.column(c).to_numpy() for c in ("anchor", "doc_id"))
        lists = batch.column("words").combine_chunks()
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        block = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        at, first, n = factored(lists.flatten().to_numpy().view(np.uint64), counts, block, doc, window)
        own = batch.select(["doc_id", "row"]).take(pa.array(at)).combine_chunks()
        begin = batch.column("first").to_numpy()[at] + first
        return pa.RecordBatch.from_arrays([own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                piece = pa.Table.from_batches([batch.slice(at, INDEX_ROWS)])
                waiting = pa.concat_tables([waiting, piece]) if waiting else piece
                anchor = waiting.column("anchor").to_numpy()
                last = int(np.flatnonzero(anchor == anchor[-1])[0])  # the last block may go on
                if last:
                    yield parse(waiting.slice(0, last))
                    waiting = waiting.slice(last).combine_chunks()
        if waiting:
            yield parse(waiting)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), "doc_id bigint, row bigint, first int, count int")


def _filter_key(anchor: np.ndarray, digest: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return anchor ^ digest ^ doc_id


def _filter_key_column():
    """The same on the JVM."""
    return F.col("anchor").bitwiseXOR(F.col("digest")).bitwiseXOR(F.col("doc_id"))


def _level(rows: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame | None]:
    """(runs of duplicate windows (doc_id, row, first, count), the phrases of large blocks, if any) of texts, or of the
    phrases of large blocks that are cut by longer sequences."""
    found = stored(_phrase_rows(rows, window, anchor), "phrases")
    known = found.filter(F.col("doc_id").isNotNull())
    # the reference: each distinct phrase with its first document; combined before the shuffle
    held = known.groupBy("anchor", "digest").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows"))
    held = stored(held, "reference")
    blocks = held.groupBy("anchor").agg(F.min("origin").alias("low"), F.max("last").alias("high"), F.count("*").alias("held"))
    blocks = blocks.filter("low < high")
    shared = stored(lookup_left(held, blocks, ["anchor"], held.groupBy("anchor").agg(F.count("*").alias("n_rows"))).filter(F.col("held").isNotNull()), "shared")
    # 1. whole phrases of an earlier document
    repeated = shared.filter("last > origin").select("anchor", "digest", "origin", "n_rows")
    whole = lookup_left(found, repeated.drop("n_rows"), ["anchor", "digest"], held.select("anchor", "digest", "n_rows"))
    whole = whole.filter("origin < doc_id").select("doc_id", "row", "first", F.col("n").alias("count"))
    # 2. the first copy of each phrase whose block holds other phrases, parsed
    edges = shared.filter("held > 1").select("anchor", "digest", F.col("origin").alias("doc_id"))
    n_edges = edges.count()
    if not n_edges:
        return whole, None
    keys = edges.select(_filter_key_column().alias("key"))
    wanted = rows.sparkSession.sparkContext.broadcast(build_bloom(keys, n_edges))
    words = stored(_word_rows(rows, window, anchor, wanted).join(edges, ["anchor", "digest", "doc_id"], "left_semi"), "edges")
    counts = stored(words.groupBy("anchor").agg(F.count("*").alias("n_rows")), "counts")
    large = stored(counts.filter(F.col("n_rows") > BLOCK_ROWS).select("anchor", F.lit(True).alias("large")), "large")
    if not large.take(1):
        return whole.unionByName(_factored_rows(words, window)), None
    words = lookup_left(words, large, ["anchor"], counts)  # the rows of a large block must not meet in one task
    small, rest = words.filter("large is null").drop("large"), words.filter("large").drop("large")
    return whole.unionByName(_factored_rows(small, window)), rest


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, row, firsts, counts) of the documents with duplicates: runs of windows that an earlier document holds."""
    whole, rest = _level(docs.select("doc_id", "text", F.xxhash64("text").alias("row")), window, anchor)
    while rest is not None:
        anchor += -(-(window - anchor) // 2)
        more, rest = _level(rest, window, anchor)
        whole = whole.unionByName(more)
    spans = whole.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("first", "count"))).alias("s"))
    return spans.select("doc_id", "row", F.col("s.first").alias("firsts"), F.col("s.count").alias("counts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row; kept_text: the kept words joined by one space.

    Only rows that may lose words (a Bloom filter of fixed size tells) are shuffled to meet their spans.
    """
    spans = stored(duplicate_spans(docs, window, anchor), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    stay, asks = split_by(rows, [F.col("doc_id"), F.col("row")], spans.select("doc_id", "row"))
    none = F.lit(None).cast("array<int>")
    rows = stay.select("doc_id", "text", none.alias("firsts"), none.alias("counts")).unionByName(asks.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "firsts", "counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts, firsts, counts = (batch.column(c) for c in ("text", "firsts", "counts"))
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode("utf-8", "replace").split()
                n_words.append(len(words))
                if not firsts[i].is_valid:
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                a = firsts[i].values.to_numpy()
                steps = np.zeros(len(words) + 1, np.int32)
                np.add.at(steps, a, 1)
                np.add.at(steps, np.minimum(a + counts[i].values.to_numpy() + window - 1, len(words)), -1)
                gone = np.cumsum(steps)[:-1] > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op3_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = {
    "op3_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
f as (select h, min(doc_id) as origin from g group by h having min(doc_id) < max(doc_id)),
r as (select doc_id, list(distinct p) as ps from (select g.doc_id, unnest(range(i, i + 50)) as p from g join f on g.h = f.h where origin < g.doc_id) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(case when ps is null then array_to_string(ws, ' ') else array_to_string([w for w, j in ws if not list_contains(ps, j)], ' ') end) as kept_sha256
from d left join r on d.doc_id = r.doc_id"""
}
