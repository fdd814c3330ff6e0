"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The byte lengths of its tokens give each token's span; an
interval join against the sorted spans of the document's sections (or fields) finds the sections that a
token touches. A token inside one section counts there. One that crosses a boundary is allocated by a
rule: ``start`` (the section of its first byte, the default), ``end`` (of its last byte), ``majority``
(the section with most of its bytes, the earlier one in a tie) or ``split`` (to each section its share
of the bytes). Bytes outside of all sections belong to no section.

The vocabulary is a file of token ranks (path as a parameter); its bytes, of fixed size, are broadcast.

Very long texts, such as a million spaces, are encoded whole as well.

Rows: a null or empty text is one empty section with 0 tokens. By default a section is a line with its
line end, so sections cover the text and their counts add up to those of the document. Repeated rows each
get theirs. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkit import tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed value: the characters that \s matches in it
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
#: Rows that leave a task at once.
ROWS = 100_000
RULES = ("start", "end", "majority", "split")


class Tokens:
    """A byte-level BPE encoder that knows the bytes of each token."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.cuts = pattern == PATTERN
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """The tokens of the text.

        The pattern matches white space with a look-ahead whose stack grows with the run. A long run is one
        piece of the pattern up to its last character (which may open the next piece) or the text's end, and
        nothing before a run reaches into it, so the run is cut out there and encoded as that piece.
        """
        out, at = [], 0
        if self.cuts:
            for m in LONG_SPACE.finditer(text):
                end = m.end() if m.end() == len(text) else m.end() - 1
                out += self.encoding.encode_ordinary(text[at : m.start()])
                out += self.encoding._encode_single_piece(text[m.start() : end])
                at = end
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset behind each token of the text."""
        return np.cumsum(self.bytes_of[np.asarray(self.encode(text), np.int64)])


def byte_offsets(text: str, chars: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets."""
    if text.isascii():
        return chars
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[chars]


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. ``ends``: bytes behind each token; sections are sorted, disjoint byte spans, none empty but a sole one."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    out = np.zeros(len(start))
    if not len(ends) or not len(start):
        return out
    begin = np.concatenate([[0], ends[:-1]])
    if rule in ("start", "end"):
        point = begin if rule == "start" else ends - 1
        at = np.searchsorted(start, point, "right") - 1
        inside = (at >= 0) & (point < stop[at])
        return np.bincount(at[inside], minlength=len(start)).astype(float)
    first = np.searchsorted(stop, begin, "right")
    last = np.searchsorted(start, ends, "left") - 1
    n = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(ends)), n)
    section = np.repeat(first, n) + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    share = np.minimum(stop[section], ends[token]) - np.maximum(start[section], begin[token])
    if rule == "split":
        return np.bincount(section, weights=share / (ends - begin)[token], minlength=len(start))
    order = np.lexsort((section, -share, token))
    chosen = order[np.unique(token[order], return_index=True)[1]]
    return np.bincount(section[chosen], minlength=len(start)).astype(float)


def lines_of(text: str) -> list[tuple[int, int]]:
    """Character spans of lines with their line ends."""
    parts = text.split("\n")
    sizes = [len(p) + 1 for p in parts[:-1]] + [len(p) for p in parts[-1:] if p]
    return list(itertools.pairwise(itertools.accumulate(sizes, initial=0))) or [(0, 0)]


def count_tokens(docs: DataFrame, key: str = "doc_id", rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN, sections: Callable[[str], list] = lines_of) -> DataFrame:
    """(key, section, start, stop, n_tokens) of every section of every text; start and stop count characters.

    ``sections`` gives a text's sorted, disjoint character spans. One pass, no shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "section", "start", "stop", "n_tokens"]
    # for counts that may be fractions
    number = "double" if rule == "split" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(held.value, pattern)

        def told(batch: pa.RecordBatch, owner: list, spans: list, counts: list) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in spans])
            edges, n = np.concatenate(spans), np.concatenate(counts)
            section = np.arange(len(edges)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # ids stay in Arrow, where a null among them changes none
            keys = batch.column(key).take(pa.array(np.repeat(owner, sizes)))
            return pa.RecordBatch.from_arrays([keys, pa.array(section.astype(np.int32)), pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(n if rule == "split" else n.astype(np.int64))], names)

        for batch in batches:
            owner, spans, counts, size = [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                own = np.asarray(sections(text), np.int64).reshape(-1, 2)
                edges = byte_offsets(text, own)
                owner.append(i)
                spans.append(own)
                counts.append(attribute(tokens.ends(text), edges[:, 0], edges[:, 1], rule))
                size += len(own)
                if size >= ROWS:
                    yield told(batch, owner, spans, counts)
                    owner, spans, counts, size = [], [], [], 0
            if owner:
                yield told(batch, owner, spans, counts)

    schema = f"`{key}` {kind}, section int, start bigint, stop bigint, n_tokens {number}"
    return docs.select(key, "text").mapInArrow(tidy(run), schema)


def count_field_tokens(rows: DataFrame, key: str, fields: list[str], joint: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, field, n_tokens): the fields are encoded as one text, joined by ``joint``, which belongs to the field before it."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    packed = rows.select(key, F.array(*[F.char_length(v) for v in values]).alias("sizes"), F.concat_ws(joint, *values).alias("text"))
    wide = len(joint)
    with open(vocabulary, "rb") as f:
        held = packed.sparkSession.sparkContext.broadcast(f.read())
    kind = packed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(held.value, pattern)
        for batch in batches:
            counts = []
            for sizes, text in zip(batch.column("sizes").to_pylist(), batch.column("text").to_pylist(), strict=True):
                stops = np.cumsum(np.asarray(sizes, np.int64) + wide)
                stops[-1] -= wide
                edges = byte_offsets(text, np.concatenate([[0], stops]))
                counts.append(attribute(tokens.ends(text), edges[:-1], edges[1:], rule))
            if counts:
                keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(counts)), len(fields))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(fields * len(counts)), pa.array(np.concatenate(counts))], [key, "field", "n_tokens"])

    return packed.mapInArrow(tidy(run), f"`{key}` {kind}, field string, n_tokens double")


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
