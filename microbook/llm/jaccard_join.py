"""Exact n-gram Jaccard join over a token-group matrix.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form one
class, which its smallest doc_id stands for. Two classes link when ``den * |A n B| >= num * |A u B|``.
The join returns the connected components of all links; links inside a component need not be listed.

1. Groups of similar documents. Similar documents share the smallest hash of their set with a probability
   that is their similarity. For four hash orders, each class finds the smallest class with the same
   minimum, and belongs to the family of the one that most orders name (two at least), linked or not. A
   family's members are compared with a few pivots, so a large family of near copies becomes one component
   by a number of comparisons that is linear in its size. Its members are then dealt into groups of bounded
   size, those of its largest component apart from the others; a class without a family is its own group.
2. Matrix. For each group the matrix holds the probe tokens of its members (of a set of n those rarest
   n - ceil(t n) + 1) and marks the index tokens among them (the rarest n - ceil(2t/(1+t) n) + 1). Of two
   linked sets the smaller one's index tokens and the larger one's probe tokens meet, so no link between
   groups is lost. A column that a single group fills is dropped. The small groups of a column that over
   HOT groups fill are merged into groups of that column, so a column has few rows however many documents
   share its token. Rarity is counted over all documents; frequent tokens come last. For groups of one
   document prefix places bound the overlap.
3. Bound and open. For groups that meet in the matrix (and within groups of several components) the members
   of the smaller one are queries. A query's overlap with the whole token union of the other group bounds
   its overlap with each member; only where the bound qualifies is the group opened and the query compared
   with its members. Members that are known to be in the query's component are passed over.

Rows: null or wordless texts have an empty set, link with nothing and are their own component. Repeated
rows share their class. Rows that share a doc_id count as one node of the graph; a row with a null doc_id
takes no part and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lookup_left, parts, stored, table
from .textkit import chunks, give_back, list_array, mix, run_key, tidy
from .url_filter import build_bloom, split_by

SIGNATURES = 4
#: Signatures that a document shares with the one whose family it joins.
AGREE = 2
#: A token of more documents than this is frequent and ordered last. Exact for tokens with hashes in the lowest
#: quarter, where prefixes lie; a token with any hash counts as far as LOCAL documents of one stretch (of about
#: STRETCH tokens) share it.
WIDE, LOCAL, STRETCH = 16, 2, 3_000_000
QUARTER = np.uint64(1 << 62)
#: Frequent tokens whose order is broadcast: those with the most documents. Others keep their place in the hash order;
#: where that makes a column of many groups, these are merged.
MAX_FREQUENT = 1_000_000
#: Members of a group; queries that one task compares with it; tokens that either may hold (one document may hold more).
BLOCK, QUERIES, TOKENS = 256, 512, 2_000_000
#: Groups of a column of the matrix beyond which its small groups are merged.
HOT = 64
#: Documents of a family that its others are compared with in step 1.
PIVOTS = 8


def doc_sets(ch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts of the chunk, sorted within each text; number per text)."""
    words = np.diff(ch.first)
    at = ch.starts_of(shingle)
    counts = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    ends = np.cumsum(counts)
    values = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    short = (words > 0) & (words < shingle)
    place = ends[short] - 1
    values[place] = ch.grams(ch.first[:-1][short], ch.first[1:][short])
    rest = np.ones(len(values), bool)
    rest[place] = False
    values[rest] = ch.grams(at, at + shingle)
    sort_within(values, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.bincount(owner[keep], minlength=len(counts))


def sort_within(values: np.ndarray, sizes: np.ndarray) -> None:
    """Sort each run of the given sizes in place."""
    at = 0
    for n in sizes.tolist():
        if n > 1:
            values[at : at + n].sort()
        at += n


def _digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(s)))]) for s in (0x51, 0xA7)]
    end = np.cumsum(sizes)
    return tuple(mix(x[end] - x[end - sizes] + sizes.astype(np.uint64)) for x in sums)


def _at_least(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(x * num / den)."""
    return -((-x * num) // den)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, d1, d2, sigs) of every document."""
    key = run_key(docs.sparkSession)
    names = ["doc_id", "n", "d1", "d2", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ch in chunks(batch.column("text"), True, key=key):
                values, sizes = doc_sets(ch, shingle)
                d1, d2 = _digests(values, sizes)
                full, k = np.flatnonzero(sizes), len(sizes)
                begin = np.cumsum(sizes) - sizes
                sigs = np.zeros((SIGNATURES, k), np.uint64)
                for j in range(SIGNATURES if len(full) else 0):
                    sigs[j, full] = np.minimum.reduceat(mix(values ^ np.uint64(0x1F123BB5 * (j + 1))), begin[full])
                own = [batch.column("doc_id").slice(ch.rows.start, k), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*own, list_array(sigs.T.reshape(-1).view(np.int64), np.full(k, SIGNATURES), pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n bigint, d1 bigint, d2 bigint, sigs array<bigint>")


def frequent_tokens(docs: DataFrame, shingle: int) -> DataFrame:
    """(token, freq) of the frequent tokens, over all documents; counts are combined by stretches before they move."""
    key = run_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            told = (counts >= LOCAL) | (mix(tokens) < QUARTER)
            return pa.RecordBatch.from_arrays([pa.array(tokens[told].view(np.int64)), pa.array(counts[told])], ["token", "freq"])

        for batch in batches:
            for ch in chunks(batch.column("text"), True, key=key):
                values, _ = doc_sets(ch, shingle)
                held.append(values)
                n += len(values)
                if n >= STRETCH:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(tidy(run), "token bigint, freq bigint")
    return found.groupBy("token").agg(F.sum("freq").alias("freq")).filter(F.col("freq") > WIDE)


class Order:
    """A key for each token, in whose order sets are read: infrequent ones first, by hash; then frequent ones, the rarer first.

    The key stands for the token in the matrix. Two tokens with one key (62 bits) would make a group a
    candidate that is none; they cannot lose one.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], np.minimum(counts[by], (1 << 22) - 1).astype(np.uint64)

    def keys(self, values: np.ndarray) -> np.ndarray:
        h = mix(values)
        out = h >> np.uint64(2)
        if len(self.tokens) and len(values):
            at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
            often = np.flatnonzero(self.tokens[at] == values)
            out[often] = np.uint64(1 << 62) | (self.counts[at[often]] << np.uint64(40)) | (h[often] >> np.uint64(24))
        return out


def prefixes(docs: DataFrame, order, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id, d1, n, probe, n_index) of every row; ``probe``: the keys of the rarest tokens in order, of which the first n_index are index tokens."""
    names, key = ["doc_id", "d1", "n", "probe", "n_index"], run_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ch in chunks(batch.column("text"), True, key=key):
                values, sizes = doc_sets(ch, shingle)
                d1 = _digests(values, sizes)[0]
                keys = order.value.keys(values)
                sort_within(keys, sizes)
                n_probe = np.where(sizes > 0, sizes - _at_least(sizes, num, den) + 1, 0)
                n_index = np.where(sizes > 0, sizes - _at_least(sizes, 2 * num, num + den) + 1, 0)
                first = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(n_probe, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(ch.rows.start, len(sizes)), pa.array(d1.view(np.int64)), pa.array(sizes), list_array(keys[first].view(np.int64), n_probe, pa.int64()), pa.array(n_index.astype(np.int32))], names
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, d1 bigint, n bigint, probe array<bigint>, n_index int")


def _cells(members: DataFrame) -> DataFrame:
    """(key, row, pos, n, is_index) of ``members(row, single, n, probe, n_index)``; pos and n are the place in the prefix and the
    size of a group's only member, else -1 and null.

    The rows of one batch that repeat a group's key are joined before anything moves, so a key of a large
    group makes few rows.
    """
    names = ["key", "row", "pos", "n", "is_index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe = batch.column("probe")
            sizes = np.diff(probe.offsets.to_numpy())
            key = probe.flatten().to_numpy()
            pos = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            row, single, n, n_index = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("row", "single", "n", "n_index"))
            is_index = pos < n_index
            pos[~single] = -1
            many = np.flatnonzero(~single)
            if len(many):
                by = many[np.lexsort((~is_index[many], row[many], key[many]))]
                first = np.ones(len(by), bool)
                first[1:] = (key[by[1:]] != key[by[:-1]]) | (row[by[1:]] != row[by[:-1]])
                at = np.concatenate([np.flatnonzero(single), by[first]])
                key, row, pos, n, is_index = key[at], row[at], pos[at], n[at], is_index[at]
            size = pa.array(n.astype(np.int32), mask=pos < 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(pos), size, pa.array(is_index)], names)

    return members.select("row", "single", "n", "probe", "n_index").mapInArrow(tidy(run), "key bigint, row bigint, pos int, n int, is_index boolean")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, d1, tokens) of all rows that may be among the wanted (doc_id, d1): a Bloom filter drops nearly all others before anything moves."""
    n, key = wanted.count(), run_key(docs.sparkSession)
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(wanted.select(F.col("doc_id").bitwiseXOR(F.col("d1")).alias("k")), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for ch in chunks(batch.column("text"), True, key=key):
                values, sizes = doc_sets(ch, shingle)
                d1 = _digests(values, sizes)[0]
                hit = bloom.value.maybe(own[ch.rows] ^ d1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(ch.rows.start, len(sizes)).filter(pa.array(hit)), pa.array(d1[hit].view(np.int64)), list_array(values[np.repeat(hit, sizes)].view(np.int64), sizes[hit], pa.int64())],
                    ["doc_id", "d1", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, d1 bigint, tokens array<bigint>")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class _Components:
    """Components as far as one task knows them."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (d := self.up.get(c, c)) != c:
            self.up[c] = c = self.up.get(d, d)
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def open_groups(queries: pd.DataFrame, members: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links (query, member) of one group that join components; both sides have doc_id, comp and tokens."""
    sets = [np.asarray(t, np.int64) for t in members["tokens"]]
    ids, comps, sizes = members["doc_id"].tolist(), members["comp"].tolist(), np.array([len(t) for t in sets])
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[by]
    union, begin, count = np.unique(flat[by], return_index=True, return_counts=True)
    known, kinds, out = _Components(), set(comps), []
    for q, comp, tokens in zip(queries["doc_id"].tolist(), queries["comp"].tolist(), queries["tokens"], strict=True):
        if all(known.root(c) == known.root(comp) for c in kinds):
            continue
        own = np.asarray(tokens, np.int64)
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        at = at[union[at] == own]
        # |q n m| >= t |q u m| >= t |q|: the overlap with the union bounds that with each member
        if den * len(at) < num * len(own):
            continue
        n = count[at]
        both = np.bincount(owner[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
        for m in np.flatnonzero(den * both >= num * (len(own) + sizes - both)).tolist():
            if known.join(comp, comps[m]):
                out.append((q, ids[m]))
    return out


def gather(block: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """Links among the documents of one block, found by comparing them with a few pivots.

    The pivots are the block's leader, the two documents whose tokens are the most common in the block (the
    text that others are copies of), and then the most central of those that are not linked yet.
    """
    sets = [np.asarray(t, np.int64) for t in block["tokens"]]
    ids, sizes = block["doc_id"].tolist(), np.array([len(t) for t in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    central = np.add.reduceat(counts[place].astype(float), np.cumsum(sizes) - sizes) / sizes
    order = np.lexsort((ids, -central)).tolist()
    linked, out, used = np.zeros(len(sets), bool), [], set()
    leader = int(np.flatnonzero(~block["q"].to_numpy(bool))[0])
    for k in range(PIVOTS):
        pivot = leader if k == 0 else next((i for i in order if i not in used and (k < 3 or not linked[i])), None)
        if pivot is None:
            break
        used.add(pivot)
        for i in range(len(sets)):
            low, high = sorted((sizes[i], sizes[pivot]))
            if i not in used and (k < 3 or not linked[i]) and ids[i] != ids[pivot] and den * low >= num * high and _linked(sets[i], sets[pivot], num, den):
                linked[i] = linked[pivot] = True
                out.append((ids[i], ids[pivot]))
    return out


def _blocks(n, tokens, most: int):
    """Groups into which n documents with that many tokens are dealt."""
    return F.greatest(F.ceil(n / most), F.ceil(tokens / TOKENS), F.lit(1)).cast("long")


def verify(docs: DataFrame, queries: DataFrame, members: DataFrame, known: DataFrame, shingle: int, num: int, den: int, among: bool = False) -> DataFrame:
    """Links (g, u, v) for ``queries(g, doc_id, n)`` against ``members(g, doc_id, n)``.

    With ``among``, queries of a group may link with each other as well, by way of pivots. ``known(doc_id, d1,
    comp)`` tells the texts of the documents. A group with many queries is copied for each QUERIES of them, so
    no task takes an unbounded number; a document's groups travel with its row, so a full set moves once to
    meet its groups and once to each of them. Tasks are dealt by the number of tokens.
    """
    spark = docs.sparkSession
    sizes = queries.groupBy("g").agg(_blocks(F.count("*"), F.sum("n"), QUERIES).alias("salts"), F.count("*").alias("n_rows"))
    sizes = stored(sizes, "asked")
    q = lookup_left(queries, sizes.select("g", "salts"), ["g"], sizes.select("g", "n_rows"))
    q = q.select("doc_id", "n", F.struct("g", F.pmod(F.xxhash64("doc_id", F.lit(3)), "salts").alias("salt"), F.lit(True).alias("q")).alias("a"))
    m = members.join(sizes.select("g", "salts"), "g")
    m = m.select("doc_id", "n", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda k: F.struct(F.col("g"), k.alias("salt"), F.lit(False).alias("q")))).alias("a"))
    places = stored(q.unionByName(m).join(known.select("doc_id", "d1", "comp"), "doc_id"), "places")
    tokens = places.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * parts(spark), -(-2 * tokens // TOKENS))
    sets = full_sets(docs, places.select("doc_id", "d1").distinct(), shingle)
    rows = sets.join(places, ["doc_id", "d1"]).select("doc_id", "comp", "tokens", "a.*")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("g", "salt"), F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (g, _), block in pdf.groupby(["g", "salt"], sort=False):
            asks = block["q"].to_numpy(bool)
            if asks.any() and not asks.all():
                found = gather(block, num, den) if among else open_groups(block[asks], block[~asks], num, den)
                out += [(g, u, v) for u, v in found]
        return pd.DataFrame(out, columns=["g", "u", "v"], dtype="int64")

    return rows.groupBy("bucket").applyInPandas(run, "g bigint, u bigint, v bigint")


def families(classes: DataFrame) -> DataFrame:
    """(g, g_n, doc_id, n) of the classes that share AGREE signatures with the leader g of a family, each in one family only."""
    signs = classes.select("node", "n", F.posexplode("sigs").alias("k", "sig"))
    lead = stored(signs.groupBy("k", "sig").agg(F.min(F.struct("node", "n")).alias("g"), F.count("*").alias("n_rows")).filter("n_rows > 1"), "leaders")
    asks = lookup_left(signs, lead.select("k", "sig", "g"), ["k", "sig"], lead.select("k", "sig", "n_rows"))
    alike = (F.least("n", "g.n") * 2 >= F.greatest("n", "g.n")) & (F.col("g.node") < F.col("node"))
    agree = asks.filter(alike).groupBy(F.col("g.node").alias("g"), F.col("node").alias("doc_id")).agg(F.count("*").alias("agree"), F.max("g.n").alias("g_n"), F.max("n").alias("n"))
    best = agree.filter(F.col("agree") >= AGREE).groupBy("doc_id").agg(F.max_by(F.struct("g", "g_n", "n"), F.struct("agree", -F.col("g"))).alias("b"))
    return best.select("b.g", "b.g_n", "doc_id", "b.n")


def gathered(docs: DataFrame, asks: DataFrame, leaders: DataFrame, known: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links (u, v) within families: by pivots of the parts of a family, then among the pivots of all its parts."""
    out, level, size = None, asks, None
    while True:
        found = stored(verify(docs, level, leaders, known, shingle, num, den, among=True), "links")
        out = found if out is None else out.unionByName(found)
        crowded = level.groupBy("g").agg(_blocks(F.count("*"), F.sum("n"), QUERIES).alias("salts")).filter("salts > 1").select("g")
        pivots = found.join(crowded, "g").filter("g <> v").select("g", F.col("v").alias("doc_id")).distinct()
        pivots = stored(pivots.join(known.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "pivots")
        before, size = size, pivots.count()
        if not size or (before is not None and 2 * size > before):
            return out.select("u", "v")
        level = pivots


def dealt(classes: DataFrame, asks: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, d1, n, comp, single, row): the group (row of the matrix) of every class."""
    leaders = asks.select(F.col("g").alias("node"), F.col("g").alias("own")).distinct()
    rows = classes.select("node", "d1", "n").join(asks.select(F.col("doc_id").alias("node"), "g"), "node", "left").join(leaders, "node", "left").join(comps, "node", "left")
    rows = stored(rows.select(F.col("node").alias("doc_id"), "d1", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("g", "own").alias("g")), "family_members")
    alone = rows.filter("g is null").select("doc_id", "d1", "n", "comp", F.lit(True).alias("single"), F.xxhash64(F.lit("one"), "doc_id").alias("row"))
    own = rows.filter("g is not null")
    held = stored(own.groupBy("g", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")), "family_parts")
    largest = held.groupBy("g").agg(F.max_by("comp", F.struct("docs", -F.col("comp"))).alias("largest"), F.count("*").alias("n_rows"))
    held = lookup_left(held, largest.drop("n_rows"), ["g"], largest.select("g", "n_rows")).withColumn("most", F.col("comp") == F.col("largest"))
    blocks = [_blocks(F.sum(F.when(is_, F.col("docs")).otherwise(0)), F.sum(F.when(is_, F.col("tokens")).otherwise(0)), BLOCK).alias(c) for c, is_ in (("inner", F.col("most")), ("outer", ~F.col("most")))]
    stats = stored(held.groupBy("g").agg(F.max("largest").alias("largest"), *blocks, F.sum("docs").alias("n_rows")), "families")
    own = lookup_left(own, stats.drop("n_rows"), ["g"], stats.select("g", "n_rows"))
    most = F.col("comp") == F.col("largest")
    block = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.when(most, F.col("inner")).otherwise(F.col("outer")))
    own = own.select("doc_id", "d1", "n", "comp", F.lit(False).alias("single"), F.xxhash64(F.lit("family"), "g", most, block).alias("row"))
    return alone.unionByName(own)


def _sizes(facts: DataFrame) -> DataFrame:
    return facts.groupBy("row").agg(
        F.count("*").alias("size"), F.sum("n").alias("tokens"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c_low"), F.max("comp").alias("c_high"), F.bool_and("single").alias("single")
    )


def merged(shared: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix and the groups after the small groups of crowded columns became groups of these columns."""
    column = Window.partitionBy("key")
    crowded = shared.withColumn("rows", F.count("*").over(column)).filter(F.col("rows") > HOT)
    crowded = crowded.groupBy("row").agg(F.max(F.struct("rows", "key"))["key"].alias("into"))
    crowded = stored(crowded.join(_sizes(facts).filter(F.col("size") * 2 <= BLOCK).select("row", "size", "tokens"), "row"), "crowded")
    if not crowded.take(1):
        return shared, facts
    per = crowded.groupBy("into").agg(_blocks(F.sum("size"), F.sum("tokens"), BLOCK).alias("blocks"), F.count("*").alias("n_rows"))
    moved = lookup_left(crowded, per.drop("n_rows"), ["into"], per.select("into", "n_rows"))
    moved = stored(moved.select("row", F.xxhash64(F.lit("column"), "into", F.pmod(F.xxhash64("row", F.lit(9)), "blocks")).alias("new")), "moved")
    stays = F.col("new").isNull()
    facts = facts.join(moved, "row", "left").withColumns({"row": F.coalesce("new", "row"), "single": F.col("single") & stays}).drop("new")
    shared = shared.join(moved, "row", "left").select(
        "key", F.coalesce("new", "row").alias("row"), F.when(stays, F.col("pos")).otherwise(-1).alias("pos"), F.when(stays, F.col("n")).alias("n"), "is_index"
    )
    shared = shared.groupBy("key", "row").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("is_index").alias("is_index"))
    return stored(shared, "matrix"), stored(facts, "facts")


def matrix_pairs(docs: DataFrame, facts: DataFrame, often: pa.Table, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, a_size, b_size), facts): pairs of groups that meet in the matrix and that no bound rules out, and the groups.

    A group whose members are in several components is a pair with itself. The key order is total, so keys of
    one prefix that lie before a shared key and are not shared are missing in the other set; for two groups
    of one document this bounds their overlap.
    """
    order = docs.sparkSession.sparkContext.broadcast(Order(often["token"].to_numpy().astype(np.int64).view(np.uint64), often["freq"].to_numpy()))
    members = stored(prefixes(docs, order, shingle, num, den).join(facts.drop("n", "comp"), ["doc_id", "d1"]).select("row", "single", "n", "probe", "n_index"), "members")
    cells = _cells(members).repartition(parts(docs.sparkSession), "key")
    column = Window.partitionBy("key")
    cells = cells.withColumns({"least": F.min("row").over(column), "most": F.max("row").over(column)}).filter("least < most")
    cells = cells.groupBy("key", "row").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("is_index").alias("is_index"))
    shared, facts = merged(stored(cells, "matrix"), facts)
    left, right = (shared.select("key", F.col("row").alias(c), F.col("pos").alias(f"{c}_pos"), F.col("n").alias(f"{c}_n"), F.col("is_index").alias(f"{c}_index")) for c in "ab")
    # two single documents need this overlap, and so a shared key among the first n - need + 1 of either; all shared
    # keys before the last such key are such keys as well, so counting those loses nothing
    need = F.ceil(num * (F.col("a_n") + F.col("b_n")) / (num + den))
    early = (F.col("a_pos") <= F.col("a_n") - need) & (F.col("b_pos") <= F.col("b_n") - need)
    near = (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num) & early
    met = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & F.coalesce(near, F.lit(True))).groupBy("a", "b").agg(
        F.count("*").alias("both"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"), F.max(F.col("a_index") | F.col("b_index")).alias("indexed")
    )
    met = met.filter("indexed")
    sizes = stored(_sizes(facts), "group_sizes")
    for c in "ab":
        met = met.join(sizes.select(F.col("row").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("single", "low", "high", "size", "c_low", "c_high")]), c)
    apart = ~((F.col("a_c_low") == F.col("a_c_high")) & (F.col("b_c_low") == F.col("b_c_high")) & (F.col("a_c_low") == F.col("b_c_low")))
    fits = (F.col("a_high") * den >= F.col("b_low") * num) & (F.col("b_high") * den >= F.col("a_low") * num) & apart
    need = F.col("a_low") + F.col("b_low")  # of two single documents: overlap * (num + den) >= num * (n_a + n_b)
    most = F.least(*[F.col(f"{c}_low") - (F.col(f"{c}_pos") + 1 - F.col("both")) for c in "ab"])
    both_single = F.col("a_single") & F.col("b_single") & (F.col("a_size") == 1) & (F.col("b_size") == 1)
    met = stored(met.filter(fits & (~both_single | (most * (num + den) >= need * num))).withColumn("ones", both_single), "met")
    within = sizes.filter("size > 1 and c_low < c_high").select(F.col("row").alias("a"), F.col("row").alias("b"), F.col("size").alias("a_size"), F.col("size").alias("b_size"))
    names = within.columns
    return met.filter("not ones").select(names).unionByName(_by_prefixes(met.filter("ones"), members, num, den).select(names)).unionByName(within), facts


def _by_prefixes(met: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of single documents those whose whole prefixes leave room for the overlap they need.

    Up to the smaller one of their last keys both prefixes are complete, so keys that are not shared there are
    missing; beyond, at most the rest of the smaller set can be shared.
    """
    heads = members.filter("single").select("row", "n", "probe")
    for c in "ab":
        met = met.join(heads.select(F.col("row").alias(c), F.col("n").alias(f"{c}_all"), F.col("probe").alias(f"{c}_probe")), c)
    last = F.least(F.element_at("a_probe", -1), F.element_at("b_probe", -1))
    rest = [F.col(f"{c}_all") - F.size(F.filter(f"{c}_probe", lambda k: k <= last)) for c in "ab"]
    most = F.size(F.array_intersect("a_probe", "b_probe")) + F.least(*rest)
    return met.filter(most * (num + den) >= (F.col("a_all") + F.col("b_all")) * num).drop("a_all", "b_all", "a_probe", "b_probe")


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    often = frequent_tokens(docs, shingle).orderBy(F.desc("freq"), "token").limit(MAX_FREQUENT).toArrow()
    rows = stored(described(docs, shingle), "described")
    # classes of equal sets; the smallest doc_id stands for each
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows"), F.any_value("sigs").alias("sigs"))
    classes = stored(classes, "classes")
    known = classes.select(F.col("node").alias("doc_id"), "d1", "n", F.col("node").alias("comp"))
    # 1. groups
    asks = stored(families(classes), "asks")
    leaders = asks.groupBy("g").agg(F.max("g_n").alias("n")).select("g", F.col("g").alias("doc_id"), "n")
    links = gathered(docs, asks.select("g", "doc_id", "n"), leaders, known, shingle, num, den)
    comps = stored(components(links), "groups")
    # 2. matrix
    facts = stored(dealt(classes, asks, comps), "facts")
    pairs, facts = matrix_pairs(docs, facts, often, shingle, num, den)
    del often
    give_back()
    # 3. bound and open: the members of the smaller group are the queries
    swap = F.col("a_size") > F.col("b_size")
    pairs = stored(pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("g")), "pairs")
    if pairs.take(1):
        members = facts.select("row", "doc_id", "n")
        targets = members.withColumnRenamed("row", "g").join(pairs.select("g").distinct(), "g")
        queries = members.withColumnRenamed("row", "small").join(pairs, "small").select("g", "doc_id", "n")
        more = stored(verify(docs, stored(queries, "queries"), stored(targets, "targets"), facts, shingle, num, den).select("u", "v"), "links")
        if more.take(1):
            comps = stored(components(links.unionByName(more)), "groups")
    final = classes.select("d1", "d2", "n", "node", "n_rows").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    final = stored(final, "final")
    out = lookup_left(rows.select("doc_id", "n", "d1", "d2"), final.select("d1", "d2", "n", "comp"), ["d1", "d2", "n"], final.select("d1", "d2", "n", "n_rows"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The document with the smallest doc_id of each component; a row with a null doc_id stays. Only rows that may have to go are shuffled."""
    gone = jaccard_components(docs, shingle, num, den).filter("component_id < doc_id").select("doc_id").distinct()
    gone = stored(gone, "gone")
    stay, asks = split_by(docs, [F.col("doc_id")], gone)
    return stay.unionByName(asks.join(gone, "doc_id", "left_anti").select(*docs.columns))


ORACLE = {
    "op2_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') || ' *' else array_to_string(ws[i:i+3], ' ') end as s
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select u, v from p join n x on u = x.doc_id join n y on v = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select u, v from e union all select v, u from e),
reach(a, b) as (select u, v from both_ways union select a, v from reach join both_ways on b = u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) as component_id
from d left join n on d.doc_id = n.doc_id left join reach on d.doc_id = a group by d.doc_id, n.n"""
}
