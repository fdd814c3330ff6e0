"""Merkle dataset manifest: a hash tree over all rows of a table, with a proof for each row.

A row's leaf is the hash of its fields. The leaves of one value of ``by`` (say, a language) form a tree, in
the order of ``order``; the roots of those trees, in the order of their values, form the tree above them.

Method: a sparse forest under an associative and commutative merge. A forest holds the nodes that are not
resolved yet, keyed by tree, level and index. As the sizes of all trees are known, so is the number of
siblings of each node, and whenever a run of siblings is complete it is replaced by its parent. A task reduces
the leaves it reads to the few nodes at its edges; those fragments are merged along a tree of tasks
(``tree_reduce``) until the root alone is left. Fragments grow with the height of the tree, not with the rows.
The merges also give out the runs that they complete, from the level of whole blocks up: a run is completed
once, so these are the inner nodes, and each block of leaves finds its path to the root among them.

A proof lists the siblings of a row's nodes from its leaf to the root, level by level, each level from left to
right. Whoever holds the row, its proof and the root can check that the row is unchanged (``folded``).

Rows: null fields hash as ``-``; a null of ``by`` is a tree of its own, the first; null orders come first; rows
of equal order follow their leaves, so repeated rows each get a leaf, whatever the partitioning; a null id is
never tampered with. An empty table has no rows and no root. Columns other than the fields change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_left, ranked, stored, table

ARITY = 8
#: Levels that are built within a block of ARITY ** LOW leaves.
LOW = 3
#: Fragments that one task merges in a round.
FAN = 32
#: Number of the tree over the roots of the others.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Completed runs that leave a task at once.
ROWS = 10_000

RUN = "tree long, level int, run long, digests array<string>"
FRAGMENT = f"part long, leaves long, whole boolean, at long, {RUN}"


def digest(*parts: bytes) -> bytes:
    """H: lowercase hex SHA-256 of the inputs, concatenated."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """A value as leaves hold it: its UTF-8 byte count, a colon and itself; ``-`` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


class Forest:
    """Unresolved nodes of trees whose sizes are known; ``add`` and ``merge`` resolve what becomes complete.

    ``nodes``: (tree, level, run) -> {index: digest} of the siblings present, with ``leaves``, the size of the
    tree; ``runs``: the completed runs of levels from ``low`` on, and all those of the TOP tree.
    """

    def __init__(self, trees: int, arity: int = ARITY, low: int = LOW):
        self.trees, self.arity, self.low = trees, arity, low
        self.nodes: dict[tuple[int, int, int], dict[int, bytes]] = {}
        self.leaves: dict[int, int] = {TOP: trees}
        self.runs: list[tuple[int, int, int, list[bytes]]] = []

    def width(self, tree: int, level: int) -> int:
        """Nodes of a level."""
        return -(-self.leaves[tree] // self.arity**level)

    def add(self, tree: int, level: int, at: int, own: bytes) -> None:
        while True:
            width = self.width(tree, level)
            if width == 1 and tree != TOP:
                tree, level, at = TOP, 0, tree
                continue
            run = at // self.arity
            held = self.nodes.setdefault((tree, level, run), {})
            held[at] = own
            if width == 1 or len(held) < min(self.arity, width - run * self.arity):
                return
            del self.nodes[tree, level, run]
            siblings = [held[i] for i in sorted(held)]
            if level >= self.low or tree == TOP:
                self.runs.append((tree, level, run, siblings))
            level, at, own = level + 1, run, digest(*siblings)

    def merge(self, other: Forest) -> Forest:
        self.leaves |= other.leaves
        for (tree, level, _), held in other.nodes.items():
            for at, own in held.items():
                self.add(tree, level, at, own)
        self.runs += other.runs
        return self

    def told_runs(self, part: int) -> list[tuple]:
        """The completed runs as rows, which the forest then gives up."""
        out = [(part, self.leaves[tree], True, None, tree, level, run, [d.decode() for d in held]) for tree, level, run, held in self.runs]
        self.runs = []
        return out

    def told_nodes(self, part: int) -> list[tuple]:
        return [(part, self.leaves[tree], False, at, tree, level, run, [own.decode()]) for (tree, level, run), held in self.nodes.items() for at, own in held.items()]


def _fragment(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    names = ["part", "leaves", "whole", "at", "tree", "level", "run", "digests"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def sow(trees: int, arity: int, low: int) -> Callable:
    """A task's leaves (tree, leaves, at, leaf) to its fragment and the runs that it completes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(trees, arity, low), TaskContext.get().partitionId()
        for batch in batches:
            tree, leaves, at, own = (batch.column(c).to_pylist() for c in ("tree", "leaves", "at", "leaf"))
            for t, n, i, d in zip(tree, leaves, at, own, strict=True):
                forest.leaves[t] = n
                forest.add(t, 0, i, d.encode())
            if len(forest.runs) >= ROWS:
                yield _fragment(forest.told_runs(part))
        if rows := forest.told_runs(part) + forest.told_nodes(part):
            yield _fragment(rows)

    return run


def tree_reduce(fragments: DataFrame, trees: int, arity: int = ARITY, low: int = LOW) -> tuple[DataFrame, list[DataFrame]]:
    """Merge fragments, FAN at a time, until one is left: (its nodes, the runs completed on the way by round).

    The tree of merges is that of ``RDD.treeReduce``; as rounds over stored tables it also keeps the completed
    runs, which would otherwise have to travel with the fragments to the driver.
    """

    def meet(rows: pa.Table) -> pa.Table:
        part = rows.column("to")[0].as_py()
        forests: dict[int, Forest] = {}
        for r in rows.to_pylist():
            own = forests.setdefault(r["part"], Forest(trees, arity, low))
            own.leaves[r["tree"]] = r["leaves"]
            own.add(r["tree"], r["level"], r["at"], r["digests"][0].encode())
        total = Forest(trees, arity, low)
        for p in sorted(forests):
            total.merge(forests[p])
        return pa.Table.from_batches([_fragment(total.told_runs(part) + total.told_nodes(part))])

    held, runs = stored(fragments, "merkle_fragments"), []
    while True:
        runs.append(held.filter("whole").select("tree", "level", "run", "digests"))
        nodes = held.filter("not whole")
        most = nodes.agg(F.max("part")).first()[0]
        if not most:  # one fragment, or no rows at all
            return nodes, runs
        held = stored(nodes.withColumn("to", F.floor(F.col("part") / FAN)).groupBy("to").applyInArrow(meet, FRAGMENT), "merkle_fragments")


def numbered_trees(placed: DataFrame, by: str) -> DataFrame:
    """(by, tree, leaves) of rows from ``ranked``: trees numbered in the order of ``by``.

    Values that first stand in one partition are numbered there, after those of the partitions before; only one row
    per partition meets in a single task.
    """
    first = placed.filter("__at = 0").select(by, F.col("__n").alias("leaves"), "__gid", F.shiftright("__gid", 33).alias("__part"))
    per = first.groupBy("__part").agg(F.count("*").alias("__c"))
    before = per.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = first.join(before, "__part").withColumn("tree", F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__gid")) - 1)
    return numbered.select(by, "tree", "leaves")


def paths(trees: DataFrame, runs: DataFrame, total: int, arity: int = ARITY, low: int = LOW) -> DataFrame:
    """(tree, block, up, level, run, digests): the runs on the way of each block of leaves to the root; ``up`` is true in the TOP tree."""
    size = arity**low
    block = trees.select("tree", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("leaves") - 1) / size))).alias("block"))
    heights = [h for h in range(63) if arity**h < 1 << 62]
    own = [F.when(F.col("leaves") > arity**h, F.struct(F.lit(False).alias("up"), F.col("tree").alias("at_tree"), F.lit(h).alias("level"), F.floor(F.col("block") / arity ** (h - low + 1)).alias("run"))) for h in heights if h >= low]
    top = [F.struct(F.lit(True).alias("up"), F.lit(TOP).cast("long").alias("at_tree"), F.lit(h).alias("level"), F.floor(F.col("tree") / arity ** (h + 1)).alias("run")) for h in heights if total > arity**h]
    steps = F.array_compact(F.array(*own, *top))
    need = block.select(F.col("tree").alias("of"), "block", F.explode(steps).alias("s")).select("of", "block", "s.up", F.col("s.at_tree").alias("tree"), "s.level", "s.run")
    # the runs near the root are on the way of all blocks: hot keys are looked up by broadcast
    return lookup_left(stored(need, "merkle_need"), runs, ["tree", "level", "run"]).withColumnRenamed("tree", "at_tree").withColumnRenamed("of", "tree")


def climb(own: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
    """The root above a node, from the siblings on the left and right of its way."""
    for left, right in way:
        own = digest(left, own, right)
    return own


def proofs(docs: DataFrame, by: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: Callable[[str], Column] | None = None, where: Column | None = None, arity: int = ARITY, listed: bool = True) -> DataFrame:
    """(key, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of each row.

    ``proof``: the siblings' digests (null unless ``listed``), ``proof_sha256``: H of them. With ``tampered`` (the
    value of a field after tampering) and ``where``, the rows there are folded from a tampered leaf and their
    original siblings.
    """
    values = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("string") if tampered is None else F.when(where, leaf([tampered(c) for c in fields]))
    rows = stored(docs.select(F.col(key).alias("key"), F.col(by).alias("value"), leaf(list(values.values())).alias("leaf"), other.alias("other")), "merkle_leaves")
    placed = ranked(rows, ["value"], ["key", "leaf"], "merkle")
    trees = stored(numbered_trees(placed, "value"), "merkle_trees")
    total = trees.count()
    low, size = LOW, arity**LOW
    same = placed["value"].eqNullSafe(trees["value"])
    leaves = stored(placed.join(trees, same).select("tree", "leaves", F.col("__at").alias("at"), "key", "leaf", "other"), "merkle_placed")
    fragments = leaves.select("tree", "leaves", "at", "leaf").mapInArrow(sow(total, arity, low), FRAGMENT)
    _, completed = tree_reduce(fragments, total, arity, low)
    runs = completed[0]
    for more in completed[1:]:
        runs = runs.unionByName(more)
    way = paths(trees, runs, total, arity, low)
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]

    def sides(siblings: list[bytes], i: int) -> tuple[bytes, bytes]:
        return b"".join(siblings[:i]), b"".join(siblings[i + 1 :])

    def show(block: pa.Table, steps: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        first, tree, n = block.column("at")[0].as_py(), block.column("tree")[0].as_py(), block.column("leaves")[0].as_py()
        level = [d.encode() for d in block.column("leaf").to_pylist()]
        own_leaves, height, below = level, 0, []
        while height < low and n > arity**height:
            below.append([sides(level[i - i % arity : i - i % arity + arity], i % arity) for i in range(len(level))])
            level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
            height += 1
        above, subroot = [], None
        for s in sorted(steps.to_pylist(), key=lambda s: (s["up"], s["level"])):
            if s["up"] and subroot is None:
                subroot = climb(level[0], above)
            at = tree // arity ** s["level"] if s["up"] else first // arity ** s["level"]
            above.append(sides([d.encode() for d in s["digests"]], at % arity))
        root = climb(level[0], above)
        subroot = (root if subroot is None else subroot).decode()
        upper = b"".join(left + right for left, right in above)
        out: dict[str, list] = {c: [] for c in ("proof", "proof_sha256", "folded_root")}
        for i, (own, changed) in enumerate(zip(own_leaves, block.column("other").to_pylist(), strict=True)):
            near = [held[i // arity**h] for h, held in enumerate(below)]
            proof = b"".join(left + right for left, right in near) + upper
            folded = climb(climb(own if changed is None else changed.encode(), near), above)
            out["proof"].append([proof[at : at + 64].decode() for at in range(0, len(proof), 64)] if listed else None)
            out["proof_sha256"].append(digest(proof).decode())
            out["folded_root"].append(folded.decode())
        roots = [root.decode()] * len(own_leaves)
        verified = [f == r for f, r in zip(out["folded_root"], roots, strict=True)]
        held = [block.column("key"), block.column("leaf"), pa.array([subroot] * len(roots)), pa.array(roots), pa.array(out["proof"], pa.list_(pa.string())), pa.array(out["proof_sha256"]), pa.array(out["folded_root"]), pa.array(verified)]
        return pa.table(held, names)

    blocks = leaves.withColumn("block", F.floor(F.col("at") / size)).groupBy("tree", "block")
    shown = blocks.cogroup(way.groupBy("tree", "block")).applyInArrow(show, f"key {kind}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean")
    return shown.withColumnRenamed("key", key)


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    where = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = proofs(docs, tampered=lambda c: lower_ascii(F.col(c)) if c == "text" else F.col(c), where=where, listed=False)
    return out.drop("proof")


def _crc32_sql(text: str) -> str:
    byte = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::bigint)"
    step = "list_reduce(range(8), lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end, xor(c, b))"
    return f"xor(list_reduce({byte}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SIBLINGS = """select *, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as r
from {0} window run as (partition by tree, level, ix // 8 order by ix)"""
_UP = "select tree, level + 1, ix // 8, (width + 7) // 8, sha256(string_agg(d, '' order by ix)) from {0} where width > 1 group by tree, level, ix // 8, width"
_FOLD = "select f.rid, f.tree, f.level + 1, f.ix // 8, (f.width + 7) // 8, f.proof || s.l || s.r, sha256(s.l || f.own || s.r) from {0} f join {1} s on f.tree = s.tree and f.level = s.level and f.ix = s.ix where f.width > 1"

ORACLE = {
    "op11_merkle_manifest": f"""
with recursive leaves as (
  select doc_id, lang, {_leaf_sql("text")} as leaf,
    case when {_crc32_sql("(doc_id::varchar)")} % 3 = 0 then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other
  from documents),
placed as (
  select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as ix,
    count(*) over (partition by lang) as n, row_number() over () as rid from leaves),
nodes(tree, level, ix, width, d) as (select tree, 0, ix, n, leaf from placed union all {_UP.format("nodes")}),
subroots as (select tree, d from nodes where width = 1),
top(tree, level, ix, width, d) as (select -1, 0, tree, (select count(*) from subroots), d from subroots union all {_UP.format("top")}),
beside as ({_SIBLINGS.format("nodes")}),
beside_top as ({_SIBLINGS.format("top")}),
fold(rid, tree, level, ix, width, proof, own) as (select rid, tree, 0, ix, n, '', coalesce(other, leaf) from placed union all {_FOLD.format("fold", "beside")}),
fold_top(rid, tree, level, ix, width, proof, own) as (select rid, -1, 0, tree, (select count(*) from subroots), proof, own from fold where width = 1 union all {_FOLD.format("fold_top", "beside_top")})
select p.doc_id, p.leaf, s.d as subroot, t.d as root, sha256(f.proof) as proof_sha256, f.own as folded_root, f.own = t.d as verified
from placed p join subroots s on p.tree = s.tree join fold_top f on p.rid = f.rid and f.width = 1 cross join (select d from top where width = 1) t
"""
}
