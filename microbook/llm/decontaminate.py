"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are the strings of one suffix automaton per block of items (a block holds at most
``block_words`` words, which bounds what is broadcast and what a worker holds; an item that is longer is
cut into pieces that overlap by all but one word of a window). A document's words are streamed through the
automaton, which tracks the length of the longest item passage that ends at each word. Where that length
reaches the window (10 words, or a whole shorter item), the window's words are hit, and the state that
stands for the window names the items it occurs in. Words meet by hash; the words of a hit are compared
byte by byte, so no text is hit by a collision.

A benchmark of several blocks takes one pass over all documents, in which a Bloom filter of all items'
windows finds the documents that may be hit, and then one pass a block over these alone.

Rows: a null or wordless text has no words and no hits. Repeated documents each get their row.
Items without words occur nowhere; an item with a null id marks words but is not counted or listed;
rows that repeat an item id count as one item. Ids may be of any type. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table
from .textkit import IS_WORD_ALNUM, LOWER, chunks, hash_words, run_key, tidy
from .url_filter import build_bloom

WINDOW = 10
#: Words of the items of one automaton.
BLOCK_WORDS = 150_000
#: In the pipeline a document with a larger share of hit words goes, the others lose these words; 0: any hit.
COVERAGE_LIMIT = 0.1

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").translate(LOWER))


def word_hash(words: list[bytes], key: int) -> np.ndarray:
    """The hashes that ``textkit.chunks`` gives to the same words in a text."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    return hash_words(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends, key)


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``next``: per state, word id -> state; ``link``, ``length``: as usual. ``items_of[v]`` are the items
    that contain the window of state v (the state that stands for sequences of exactly the window's
    length); ``whole[v]`` lists (length, item) of shorter items that state v stands for.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW, key: int = 0):
        self.window, self.key = window, key
        vocabulary: dict[bytes, int] = {}
        coded = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for i, words in items if words]
        self.words = list(vocabulary)
        hashes = word_hash(self.words, key) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.known, self.ids = hashes[order], order.astype(np.int64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        self._name(coded)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:  # the sequence is a substring of an earlier item
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _name(self, coded) -> None:
        """Walk every item once more and note its windows' states."""
        k, link, length = self.window, self.link, self.length
        self.items_of: dict[int, set] = {}
        self.whole: dict[int, set] = {}
        for item, words in coded:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= k:
                    v = state
                    while length[link[v]] >= k:
                        v = link[v]
                    self.items_of.setdefault(v, set()).add(item)
            if len(words) < k:
                v = state
                while length[link[v]] >= len(words):
                    v = link[v]
                self.whole.setdefault(v, set()).add((len(words), item))
        # for each state, the window state and the shorter whole items among its suffixes
        self.window_state = [0] * len(length)
        self.suffix_items: list[tuple] = [()] * len(length)
        for v in sorted(range(1, len(length)), key=length.__getitem__):
            up = link[v]
            self.window_state[v] = self.window_state[up] if length[up] >= k else (v if length[v] >= k else 0)
            own = self.whole.get(v)
            self.suffix_items[v] = self.suffix_items[up] + tuple(sorted(own, key=str)) if own else self.suffix_items[up]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of hashed words; -1 for words of no item."""
        if not len(self.known):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.ids[at], -1)

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end) and the items whose windows occur, for a run of known words."""
        nxt, link, length, k = self.next, self.link, self.length, self.window
        spans, items = [], set()
        state = matched = 0
        for i, w in enumerate(codes, 1):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= k:
                spans.append((i - k, i))
                v = self.window_state[state]
                items.update(self.items_of.get(v, ()))
            if self.suffix_items[state]:
                for n, item in self.suffix_items[state]:
                    if n <= matched:
                        spans.append((i - n, i))
                        items.add(item)
        return spans, items


    def checked(self, codes: np.ndarray, ch, at: int) -> tuple[list[tuple[int, int]], set]:
        """``stream`` over the chunk's words from ``at`` on, with the words of all hits compared byte by byte."""
        while True:
            spans, items = self.stream(codes.tolist())
            places = {i for a, b in spans for i in range(a, b)}
            wrong = [i for i in places if ch.data[ch.starts[at + i] : ch.ends[at + i]].tobytes() != self.words[codes[i]]]
            if not wrong:
                return spans, items
            codes[wrong] = -1


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list]:
    """The items with their words, in blocks of bounded size; the driver holds one block and one item at a time."""
    block, size = [], 0
    step = max(block_words, 2 * window)
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        # a long item is cut into pieces that share all but one word of a window
        for at in range(0, max(1, len(words) - window + 1), step - window + 1):
            piece = words[at : at + step]
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((row["item_id"], piece))
            size += len(piece)
    if block:
        yield block


def _window_keys(items: DataFrame, window: int, key: int) -> DataFrame:
    """(k, n): hashes and lengths of all windows of all items, whole items where these are shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ch in chunks(batch.column("text"), True, IS_WORD_ALNUM, key):
                at = ch.starts_of(window)
                sizes = np.diff(ch.first)
                short = (sizes > 0) & (sizes < window)
                keys = np.concatenate([ch.grams(at, at + window), ch.grams(ch.first[:-1][short], ch.first[1:][short])])
                lengths = np.concatenate([np.full(len(at), window), sizes[short]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(lengths.astype(np.int32))], ["k", "n"])

    return items.select("text").mapInArrow(tidy(run), "k bigint, n int")


def _suspects(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``docs`` with ``__maybe``: whether the text may hold a window of any item."""
    key = run_key(docs.sparkSession)
    windows = _window_keys(benchmark, window, key)
    told = windows.groupBy("n").count().collect()  # a row for each length up to the window
    lengths, n = sorted(r["n"] for r in told), sum(r["count"] for r in told)
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(windows.select("k"), n))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]).add("__maybe", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ch in chunks(batch.column("text"), True, IS_WORD_ALNUM, key):
                maybe = np.zeros(len(ch.first) - 1, bool)
                for k in lengths:
                    at = ch.starts_of(k)
                    hit = bloom.value.maybe(ch.grams(at, at + k))
                    maybe[np.searchsorted(ch.first, at[hit], "right") - 1] = True
                own = batch.slice(ch.rows.start, len(maybe))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(maybe)], [*own.schema.names, "__maybe"])

    return docs.mapInArrow(tidy(run), schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(known: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` words of the items' vocabulary: only there can a window be."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _cut(text: str, spans: list[tuple[int, int]], words: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each span; ``words``: their byte starts and ends."""
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    for a, b in spans:
        out.append(raw[at : words[0][a]])
        at = words[1][b - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = True, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids of the items found), spans (hit words, from..to) and clean_text.

    ``clean_text`` is the text without the hit words; ``clean=False`` returns neither it nor (but
    with ``keep_text``) the text.
    No shuffle. Columns of ``docs`` that are named like a result give way to it.
    """
    out = docs.select(*[f"`{c}`" for c in docs.columns if c not in (*RESULTS, "clean_text")])
    kind = benchmark.schema["item_id"].dataType
    key, spark = run_key(docs.sparkSession), docs.sparkSession
    blocks = item_blocks(benchmark, block_words, window)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return _pass(out, Automaton(block, window, key), kind, True, with_text=clean or keep_text, with_clean=clean)
    marked = stored(_suspects(out, benchmark, window), "suspects")
    plain, todo = marked.filter("not __maybe").drop("__maybe"), marked.filter("__maybe").drop("__maybe")
    first = True
    while following is not None:
        todo = stored(_pass(todo, Automaton(block, window, key), kind, first, with_text=True, with_clean=False), "passes")
        block, following, first = following, next(blocks, None), False
    todo = _pass(todo, Automaton(block, window, key), kind, False, with_text=clean or keep_text, with_clean=clean)
    plain = _pass(plain, Automaton([], window, key), kind, True, with_text=clean or keep_text, with_clean=clean)
    return plain.unionByName(todo)


RESULTS = ("n_words", "n_hit", "items", "spans")


def _pass(docs: DataFrame, automaton: Automaton, kind, first: bool, with_text: bool, with_clean: bool) -> DataFrame:
    """Stream one automaton over all documents and add to what earlier passes found."""
    held = docs.sparkSession.sparkContext.broadcast(automaton)
    passed = [f for f in docs.schema.fields if f.name not in RESULTS and (with_text or f.name != "text")]
    names = [f.name for f in passed] + list(RESULTS) + ["clean_text"] * with_clean
    span = T.StructType().add("start", "long").add("stop", "long")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in passed])
    schema = schema.add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(kind)).add("spans", T.ArrayType(span))
    if with_clean:
        schema = schema.add("clean_text", "string")
    ids = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            col = batch.column("text")
            earlier = None if first else (batch.column("items"), batch.column("spans"))
            for ch in chunks(col, True, IS_WORD_ALNUM, own.key):
                n_words, n_hit, items, spans, cut = [], [], [], [], {}
                at = ch.first.tolist()
                found: dict[int, tuple[list, set]] = {}
                codes = own.codes(ch.hashes)
                for lo, hi in _runs(codes >= 0, own.shortest):
                    doc = int(np.searchsorted(ch.first, lo, "right")) - 1
                    while lo < hi:  # a run ends where its text ends
                        to = min(hi, at[doc + 1])
                        if to - lo >= own.shortest:
                            s, it = own.checked(codes[lo:to], ch, lo)
                            if s:
                                have = found.setdefault(doc, ([], set()))
                                have[0].extend((x + lo - at[doc], y + lo - at[doc]) for x, y in s)
                                have[1].update(it)
                        lo, doc = to, doc + 1
                byte_first = None
                for doc in range(len(at) - 1):
                    row = ch.rows.start + doc
                    new_spans, new_items = found.get(doc, ((), ()))
                    if earlier:
                        new_items = {*new_items, *earlier[0][row].as_py()}
                        new_spans = [*new_spans, *((x["start"], x["stop"]) for x in earlier[1][row].as_py())]
                    own_spans = _merged(new_spans) if new_spans else []
                    n_words.append(at[doc + 1] - at[doc])
                    n_hit.append(sum(y - x for x, y in own_spans))
                    items.append(sorted((x for x in new_items if x is not None), key=str) if new_items else [])
                    spans.append([{"start": x, "stop": y} for x, y in own_spans])
                    if with_clean and own_spans:
                        byte_first = byte_first or _text_starts(col, ch.rows)
                        places = np.stack([ch.starts[at[doc] : at[doc + 1]], ch.ends[at[doc] : at[doc + 1]]]) - byte_first[doc]
                        cut[doc] = _cut(col[row].as_py(), own_spans, places)
                # results leave chunk by chunk, so little is held beside the batch that came in
                own_rows = batch.slice(ch.rows.start, len(n_words))
                columns = [own_rows.column(f.name) for f in passed] + [
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, ids),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ]
                if with_clean:
                    texts = own_rows.column("text")
                    columns.append(pa.array([cut.get(i, x) for i, x in enumerate(texts.to_pylist())], pa.string()) if cut else texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(tidy(run), schema)


def _text_starts(col: pa.Array, rows: slice) -> list[int]:
    """Byte offsets of the texts of a chunk from the chunk's start."""
    part = col.slice(rows.start, rows.stop - rows.start)
    lengths = [0 if x is None else x for x in pc.binary_length(part).to_pylist()]
    return np.concatenate([[0], np.cumsum(lengths)]).tolist()


def op1_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=False)
    as_text = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(as_text, ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage_limit: float = COVERAGE_LIMIT) -> DataFrame:
    """Documents up to the coverage limit, without their hit spans; the others go.

    What is left around a cut may make up a new passage, so documents that were cut are searched again until
    none is hit. The limit holds for all words that a document loses. ``n_chars`` of a cut document is that of its text.
    """
    cols = docs.columns
    # all other columns travel in one, so none of them can clash with a result
    rest = F.struct(*[F.col(f"`{c}`") for c in cols if c != "text"])
    if coverage_limit <= 0:  # what stays has no span to cut
        found = decontaminate(docs.select("text", rest.alias("rest")), benchmark, clean=False, keep_text=True).filter("n_hit = 0")
        return found.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in cols])
    none = F.struct(F.lit(0).cast("long").alias("lost"), F.lit(None).cast("long").alias("words"))
    taken = F.struct((F.col("cut.lost") + F.col("n_hit")).alias("lost"), F.coalesce("cut.words", "n_words").alias("words"))
    todo, clean = docs.select("text", rest.alias("rest"), none.alias("cut")), []
    while True:
        found = decontaminate(todo, benchmark).select(F.col("clean_text").alias("text"), "rest", taken.alias("cut"), (F.col("n_hit") > 0).alias("hit"))
        found = stored(found.filter(F.col("cut.lost") <= F.col("cut.words") * F.lit(coverage_limit)), "cut")
        clean.append(found.filter("not hit"))
        todo = found.filter("hit").drop("hit")
        if not todo.take(1):
            break
    out = clean[0]
    for more in clean[1:]:
        out = out.unionByName(more)
    length = {"n_chars": F.when(F.col("cut.lost") > 0, F.char_length("text")).otherwise(F.col("rest.n_chars")).cast("long")} if "n_chars" in cols else {}
    return out.select(*[F.col("text") if c == "text" else length.get(c, F.col(f"rest.`{c}`")).alias(c) for c in cols])


_WINDOWS_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (select distinct item_id, least(len(ws), 10) as k, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') as g
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
ks as (select distinct k from iw),
dw as (select doc_id, i, k, array_to_string(ws[i:i+k-1], ' ') as g
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, ks where len(ws) >= k)),
hit as (select distinct doc_id, i, dw.k, item_id from dw join iw on dw.g = iw.g and dw.k = iw.k),
pos as (select distinct doc_id, unnest(range(i, i + k)) as p from hit),
n as (select doc_id, count(*) as n_hit from pos group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id)
"""

ORACLE = {
    "op1_decontaminate": _WINDOWS_SQL
    + """select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join n on w.doc_id = n.doc_id left join it on w.doc_id = it.doc_id"""
}
