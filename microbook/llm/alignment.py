"""Alignment of two tokenizers over the same texts.

A text is encoded as a space and itself: by a byte-level BPE vocabulary (A) and by a piece model that adds the space
of its own (B). Both cut the same bytes. Where a token of A and one of B end at the same byte, the text is cut;
between two cuts lies a group of A tokens that stands for a group of B tokens. Two tokens whose bytes overlap are
linked, and the number of documents in the corpus that hold a pair of ids linked says how well they correspond.

Method: the texts of an Arrow batch (in slices of about SLICE bytes, a longer text being its own) stand one behind
the other in one range of bytes. The ends of all A tokens and of all B tokens in it are counted once
(``bincount``); cuts are where both counts are positive, and the running sums of the counts give each token's group,
each overlap's two tokens and, by differences at the documents' offsets, each document's results. No loop runs over
tokens.

Stages: texts are encoded once, and their ids stored; a second pass counts, for each pair of ids, the documents
that link it, summing within a task before the shuffle; a third looks the counts up. The counted pairs are looked
up by broadcast in shards of at most PAIRS_HELD pairs (whole A ids; an A id has no more pairs than B has ids), one
pass over the ids for each shard, so a task's memory has a bound whatever the corpus. The pairs are bounded by the
two vocabularies, not by the documents.

A's ids are those of the ``tokenizers`` library. Where the vocabulary file numbers its tokens in the order of its
merges and has no normaliser (as the given one), ``tiktoken`` gives the same ids several times faster and is used,
except for texts with very long runs of white space, on which its pattern matcher overflows.

Rows: a text that is null or empty, or whose tokens' bytes are not those of a space and the text (as B's mark for a
space standing in the text, or a character that B does not know), has no tokens: zeros and an empty digest. Names
of special tokens in a text are ordinary text. Repeated rows each get theirs and each count as a document. Null keys
stay. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .textkit import column_view, list_array, tidy

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# fixed value: the pre-tokenisation pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{2000}")
#: Bytes of text, and tokens of A, that are aligned at once.
SLICE, TOKENS = 1 << 20, 1 << 18
#: Counted pairs that a worker holds, and distinct pairs that a task sums before it sends them.
PAIRS_HELD = 2_000_000


class ByteLevel:
    """A: ids of texts, and the bytes of each id."""

    def __init__(self, blob: bytes):
        spec, self.blob, self.slow = json.loads(blob), blob, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        before = spec.get("pre_tokenizer") or {}
        in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges)
        usual = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        self.fast = None
        if in_order and usual:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not LONG_SPACE.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if not self.slow:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.blob.decode())
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """B: ids of texts (it adds the space in front), and the bytes of each id."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.bytes_of = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def loaded(kind: type, blob: bytes):
    """A worker's tokenizer, kept for its later tasks."""
    return kind(blob)


def sizes_of(bytes_of: list[bytes]) -> np.ndarray:
    return np.array([len(b) for b in bytes_of], np.int64)


def spelled(ids: np.ndarray, bytes_of: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The tokens' bytes, joined."""
    flat, first = np.frombuffer(b"".join(bytes_of), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    own = sizes[ids]
    ends = np.cumsum(own)
    return flat[np.repeat(first[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]


class Aligned:
    """Groups and overlaps of the tokens of several documents, which stand one behind the other.

    ``n_groups``, ``n_links``: of each document; ``link_a``, ``link_b``, ``link_doc``: ids and document of each overlap;
    ``group_a``, ``group_b``: each token's group, numbered over all documents; ``last_a``, ``last_b``: whether it ends one.
    """

    def __init__(self, a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.a_count, self.b_count = a, b, a_count, b_count
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        total = int(ends_a[-1]) if len(a) else 0
        self.doc_ends = np.concatenate([[0], ends_a])[np.cumsum(a_count)]
        at_a, at_b = (np.bincount(e, minlength=total + 1).astype(np.int32) for e in (ends_a, ends_b))
        cut, edge = np.minimum(at_a, at_b), np.flatnonzero(np.maximum(at_a, at_b))
        cuts = np.cumsum(cut, dtype=np.int32)
        upto_a, upto_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
        self.last_a, self.last_b = cut[ends_a].astype(bool), cut[ends_b].astype(bool)
        self.group_a, self.group_b = cuts[ends_a] - self.last_a, cuts[ends_b] - self.last_b
        self.cut_ends = np.flatnonzero(cut)
        # a token reaches over every edge up to its own end
        self.link_a, self.link_b = a[upto_a[edge] - at_a[edge]], b[upto_b[edge] - at_b[edge]]
        self.link_doc = np.searchsorted(self.doc_ends, edge, "left")
        self.n_groups = self.by_doc(cuts)
        self.n_links = np.diff(np.searchsorted(edge, np.concatenate([[0], self.doc_ends]), "right"))

    def by_doc(self, running: np.ndarray) -> np.ndarray:
        """Each document's share of a running sum over bytes."""
        return np.diff(np.concatenate([[0], running[self.doc_ends]])) if len(self.doc_ends) else np.zeros(0, np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's overlaps."""
        running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        upto = np.cumsum(self.n_links)
        return running[upto] - running[upto - self.n_links]

    def digests(self) -> list[str]:
        """SHA-256 of each document's ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        n = int(self.n_groups.sum())
        in_a, in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        # in each group the A tokens come first
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        ids, sep = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sep[place_a], sep[place_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        digits = decimals(int(ids.max()) + 1 if len(ids) else 1)
        width = digits[1][ids]
        cells = np.zeros((len(ids), digits[0].shape[1] + 1), np.uint8)
        cells[:, :-1] = digits[0][ids]
        cells[np.arange(len(ids)), width] = sep
        text = memoryview(cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes())
        tokens = np.cumsum(self.a_count + self.b_count)
        ends = np.concatenate([[0], np.cumsum(width + 1)])[tokens]
        starts = np.concatenate([[0], ends[:-1]])
        # the last group of a document has no semicolon behind it
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    written = [str(i).encode() for i in range(most)]
    width = max(map(len, written))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in written), np.uint8).reshape(most, width), np.array([len(w) for w in written])


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below ``most``, and how many they are; for the next power of two, so that few tables are made."""
    return _decimals(1 << max(10, (most - 1).bit_length()))


def id_type(ids: int) -> np.dtype:
    """What the ids of a vocabulary are stored as."""
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def packed(ids: np.ndarray, counts: np.ndarray, kind: np.dtype) -> pa.Array:
    """Lists of ids as binary values: a few bytes an id, and no list for the JVM to take apart."""
    offsets = np.concatenate([[0], np.cumsum(counts * kind.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all values of a binary column, and how many each has."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind).astype(np.int32), np.diff(offsets) // kind.itemsize


def _pieces(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose weights add up to about ``most``; a heavier row stands alone."""
    upto, at = np.cumsum(weights), 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def encoded(docs: DataFrame, key: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, a, b) of every text; a and b hold its ids (``unpacked``). One pass."""
    sc = docs.sparkSession.sparkContext
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        held = sc.broadcast((f.read(), g.read()))
    kind = docs.schema[key].dataType.simpleString()
    counts = ["n_a", "n_b", "n_groups", "n_links"]

    def tell(batch: pa.RecordBatch, lo: int, hi: int, left: ByteLevel, right: Pieces, size_a: np.ndarray, size_b: np.ndarray) -> pa.RecordBatch:
        texts = batch.column("text").slice(lo, hi - lo)
        data, offsets = column_view(texts)
        written = [" " + (t or "") for t in texts.to_pylist()]
        a = [left.encode(t) for t in written]
        b = [np.array(t, np.int32) for t in right.encode([t[1:] for t in written])]
        size = np.diff(offsets) + 1
        fits = np.array([s > 1 and int(size_a[x].sum()) == s == int(size_b[y].sum()) for s, x, y in zip(size, a, b, strict=True)])
        raw = b"".join(b" " + bytes(data[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(fits))
        want, first = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(size[fits])])
        for ids, table_, sizes in ((a, left.bytes_of, size_a), (b, right.bytes_of, size_b)):
            own = [x for x, f in zip(ids, fits, strict=True) if f]
            bad = np.flatnonzero(spelled(np.concatenate(own), table_, sizes) != want) if own else np.zeros(0, int)
            if len(bad):
                ok = fits.copy()
                ok[np.flatnonzero(fits)[np.unique(np.searchsorted(first, bad, "right") - 1)]] = False
                want = want[np.repeat(ok[fits], size[fits])]
                first, fits = np.concatenate([[0], np.cumsum(size[ok])]), ok
        none = np.zeros(0, np.int32)
        a = [x if f else none for x, f in zip(a, fits, strict=True)]
        b = [x if f else none for x, f in zip(b, fits, strict=True)]
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.concatenate(a).astype(np.int32), np.concatenate(b).astype(np.int32)
        told = Aligned(ids_a, n_a, ids_b, n_b, size_a, size_b)
        columns = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, told.n_groups, told.n_links)]
        columns += [pa.array(told.digests(), pa.string()), packed(ids_a, n_a, id_type(len(size_a))), packed(ids_b, n_b, id_type(len(size_b)))]
        own = [batch.column(c).slice(lo, hi - lo) for c in ("row", key)]
        return pa.RecordBatch.from_arrays(own + columns, ["row", key, *counts, "groups_sha256", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = loaded(ByteLevel, held.value[0]), loaded(Pieces, held.value[1])
        size_a, size_b = sizes_of(left.bytes_of), sizes_of(right.bytes_of)
        for batch in batches:
            _, offsets = column_view(batch.column("text"))
            for lo, hi in _pieces(np.diff(offsets) + 1, SLICE):
                yield tell(batch, lo, hi, left, right, size_a, size_b)

    schema = f"row bigint, `{key}` {kind}, {', '.join(f'{c} bigint' for c in counts)}, groups_sha256 string, a binary, b binary"
    return docs.select(F.monotonically_increasing_id().alias("row"), key, "text").mapInArrow(tidy(run), schema)


def token_sizes(spark, a_file: str = A_FILE, b_file: str = B_FILE):
    """Bytes of each id of A and of B, as a broadcast."""
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        return spark.sparkContext.broadcast((sizes_of(ByteLevel(f.read()).bytes_of), sizes_of(Pieces(g.read()).bytes_of)))


def _aligned(batch: pa.RecordBatch, sizes) -> Iterator[tuple[int, int, Aligned]]:
    """Alignment of the stored ids, about TOKENS of A at a time."""
    flat, count = {}, {}
    for c, size in zip("ab", sizes, strict=True):
        flat[c], count[c] = unpacked(batch.column(c), id_type(len(size)))
    first = {c: np.concatenate([[0], np.cumsum(count[c])]) for c in "ab"}
    for lo, hi in _pieces(count["a"] + 1, TOKENS):
        own = {c: flat[c][first[c][lo] : first[c][hi]] for c in "ab"}
        yield lo, hi, Aligned(own["a"], count["a"][lo:hi], own["b"], count["b"][lo:hi], *sizes)


def groups(coded: DataFrame, sizes, key: str = "doc_id") -> DataFrame:
    """(key, group, start, stop, a, b): the groups of ``encoded`` texts, in order, with their bytes in the space and text."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, al in _aligned(batch, sizes.value):
                n = int(al.n_groups.sum())
                doc = np.repeat(np.arange(len(al.n_groups)), al.n_groups)
                number = np.arange(n) - (np.cumsum(al.n_groups) - al.n_groups)[doc]
                base = np.concatenate([[0], al.doc_ends[:-1]])[doc]
                start = np.where(number == 0, base, np.concatenate([[0], al.cut_ends[:-1]]) if n else al.cut_ends) - base
                lists = [list_array(ids, np.bincount(g, minlength=n), pa.int32()) for ids, g in ((al.a, al.group_a), (al.b, al.group_b))]
                keys = batch.column(key).take(pa.array(doc + lo))
                yield pa.RecordBatch.from_arrays([keys, pa.array(number.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array((al.cut_ends - base).astype(np.int64)), *lists], [key, "group", "start", "stop", "a", "b"])

    return coded.select(key, "a", "b").mapInArrow(tidy(run), f"`{key}` {kind}, `group` bigint, start bigint, stop bigint, a array<int>, b array<int>")


def link_counts(coded: DataFrame, sizes) -> DataFrame:
    """(a, b, n, best): in how many documents each pair of ids is linked, and whether that is the highest of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = len(sizes.value[1])
        every = len(sizes.value[0]) * n_b
        held, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def gathered():
            pairs = np.concatenate([held[0], *[p for p, _ in waiting]])
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], np.concatenate([held[1], *[n for _, n in waiting]])[order]
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, int)
            return pairs[first], np.add.reduceat(n, first) if len(first) else n

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((held[0] // n_b).astype(np.int32)), pa.array((held[0] % n_b).astype(np.int32)), pa.array(held[1])], ["a", "b", "n"])

        for batch in batches:
            for _, _, al in _aligned(batch, sizes.value):
                pair = al.link_a.astype(np.int64) * n_b + al.link_b
                once = np.unique(al.link_doc.astype(np.int64) * every + pair) % every
                waiting.append(np.unique(once, return_counts=True))
                if sum(len(p) for p, _ in waiting) > PAIRS_HELD:
                    held, waiting = gathered(), []
                    if len(held[0]) > PAIRS_HELD // 2:
                        yield told()
                        held = (held[0][:0], held[1][:0])
        held, waiting = gathered(), []
        if len(held[0]):
            yield told()

    each = coded.select("a", "b").mapInArrow(tidy(run), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    each = stored(each, "alignment_pairs")
    most = each.groupBy("a").agg(F.max("n").alias("__most"))
    return each.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("__most")).alias("best"))


def shards(pairs: DataFrame, most: int = PAIRS_HELD) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``most`` pairs each (or a single id); a row per A id reaches the driver."""
    out: list[tuple[int, int]] = []
    held = 0
    for a, n in sorted((r["a"], r["n"]) for r in pairs.groupBy("a").agg(F.count("*").alias("n")).collect()):
        if out and held + n <= most:
            out[-1], held = (out[-1][0], a), held + n
        else:
            out.append((a, a))
            held = n
    return out


def link_sums(coded: DataFrame, pairs: DataFrame, sizes, most: int = PAIRS_HELD) -> DataFrame:
    """``coded`` without its ids, with n_best (overlaps whose count is their A id's highest) and count_sum (over all overlaps)."""
    spark = coded.sparkSession
    fields = [f for f in coded.schema.fields if f.name not in ("a", "b")]

    def part(lo: int, hi: int, shown: list) -> DataFrame:
        own = pairs.filter(F.col("a").between(lo, hi)).toArrow()
        a, b, n, best = (own.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        n_b = len(sizes.value[1])
        pair = a.astype(np.int64) * n_b + b
        order = np.argsort(pair)
        held = spark.sparkContext.broadcast((pair[order], n[order], best[order].astype(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = held.value
            for batch in batches:
                for first, to, al in _aligned(batch, sizes.value):
                    here = (al.link_a >= lo) & (al.link_a <= hi)
                    at = np.searchsorted(known, al.link_a[here].astype(np.int64) * n_b + al.link_b[here])
                    count, top = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
                    count[here], top[here] = n[at], best[at]
                    columns = [batch.column(f.name).slice(first, to - first) for f in shown]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(al.sums(top)), pa.array(al.sums(count))], [*[f.name for f in shown], "n_best", "count_sum"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown)
        return coded.select(*[f.name for f in shown], "a", "b").mapInArrow(tidy(run), f"{kinds}, n_best bigint, count_sum bigint")

    ranges = shards(pairs, most) or [(0, 0)]
    if len(ranges) == 1:
        return part(*ranges[0], fields)
    row = [f for f in fields if f.name == "row"]
    sums = stored(part(*ranges[0], row), "alignment_sums")
    for lo, hi in ranges[1:]:
        sums = sums.unionByName(stored(part(lo, hi, row), "alignment_sums"))
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return coded.drop("a", "b").join(sums, "row")


def align(docs: DataFrame, key: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE, most: int = PAIRS_HELD) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    coded = stored(encoded(docs, key, a_file, b_file), "alignment_ids")
    sizes = token_sizes(docs.sparkSession, a_file, b_file)
    pairs = stored(link_counts(coded, sizes), "alignment_counts")
    return link_sums(coded, pairs, sizes, most).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_tokenizer_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))
