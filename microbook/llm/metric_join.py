"""Near-duplicate embeddings by an exact metric range join.

Vectors are linked when their cosine, in double precision, is at least a threshold; the angle between vectors is a
metric, so this is a join within a radius of t, the threshold's angle.

Method: a few vectors are pivots. A vector's home is the cell of the nearest one. It is also sent to the cell of
another pivot q where the triangle inequality leaves room for a partner at home there: the distance to q is at most
2 t more than that to its own pivot, and within t of the range of distances that q's own vectors have. Of two cells
the one of the lower pivot takes the pair, so each pair meets once. Cells join independently of each other.

Within a cell the vectors stand in tiles of TILE rows by their distance to the pivot, and the triangle inequality
decides most of what it can without looking at vectors, both ways: two tiles whose distances add up to at most t are
linked row by row (so a large group of copies around a pivot costs one look-up a tile, not a comparison a pair), and
tiles whose distances differ by more than t are not linked at all. The other pairs of tiles are compared, each pair
in a task of its own, by matrix products over strips; no pair leaves it, only the number of each row's links and at
most one edge a row, of a spanning forest. Connected components then join the edges.

Pivots are chosen on a sample of SAMPLE rows (by a hash of the row's number), the densest places first and none
within t of another, so large groups get their own. The sample decides what is compared where, not what is linked.
Vectors without near neighbours in many dimensions are about equally far from all pivots: no rule of this kind rules
them out, cells then receive most of the others, and the work grows with the square of the rows, in tiles of bounded
size. Clustered vectors stay in few cells.

Rows: a null or zero vector, or one with null or non-finite components, is linked with nothing and stays. Repeated
rows and ids are rows like others. A shorter vector counts as ending in zeros. Null ids are in no minimum; a component
of null ids only has a null id. An empty table gives no rows. Other columns, labels included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lookup_left, ranked, stored, table
from .textkit import tidy

THRESHOLD = 0.9
#: Rows of the sample that pivots are chosen from.
SAMPLE = 4096
#: Rows for each pivot, and the least and most pivots there are.
PER_PIVOT, LEAST, MOST = 8192, 8, 1024
TILE = 4096
#: Rows of a tile that are compared at once.
STRIP = 512
#: Angles are told apart down to this; what lies closer to a bound is compared.
ANGLE = 1e-6
#: Cosines closer to the threshold than this are computed again from the vectors as given.
CLOSE = 1e-9

HOME, GUEST = 0, 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls as a matrix of doubles, scaled by powers of two (which changes no angle); short ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least the threshold."""
    cosine = unit(x) @ unit(y).T
    out = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < CLOSE)
    for at in range(0, len(i), 1 << 16):
        a, b = x[i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]]
        exact = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        out[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = exact >= threshold
    return out


def choose_pivots(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Rows of the sample, densest first, none within ``radius`` of another."""
    if not len(sample):
        return sample
    own = unit(sample)
    near = np.concatenate([(angles(own[i : i + STRIP], own) <= radius / 2).sum(1) for i in range(0, len(own), STRIP)])
    chosen: list[int] = []
    free = np.ones(len(own), bool)
    for i in np.argsort(-near, kind="stable").tolist():
        if free[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            free &= angles(own[i : i + 1], own)[0] > radius
    return own[chosen]


def usable(vectors: DataFrame, column: str):
    """Whether a row's vector has a direction."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda v: v != 0), F.lit(False))


def deal(rows: DataFrame, pivots: np.ndarray, width: int, radius: float) -> DataFrame:
    """(cell, side, d, row, v): each vector at home, and as a guest in the cells of lower pivots where a partner may be."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        d = angles(unit(matrix(batch.column("v"), width)), held.value)
        return d, d.argmin(1)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(held.value), np.inf), np.full(len(held.value), -np.inf)
        for batch in batches:
            d, home = near(batch)
            own = d[np.arange(len(home)), home]
            np.minimum.at(low, home, own)
            np.maximum.at(high, home, own)
        seen = np.flatnonzero(high >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low[seen]), pa.array(high[seen])], ["cell", "low", "high"])

    reach = rows.select("v").mapInArrow(tidy(survey), "cell long, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in reach:  # a row for each pivot
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, home = near(batch)
            own = d[np.arange(len(home)), home]
            goes = (d - own[:, None] <= 2 * radius + ANGLE) & (d <= high + radius + ANGLE) & (d >= low - radius - ANGLE) & (np.arange(d.shape[1]) < home[:, None])
            goes[np.arange(len(home)), home] = True
            for cell in np.flatnonzero(goes.any(0)).tolist():
                who = np.flatnonzero(goes[:, cell])
                side = np.where(home[who] == cell, HOME, GUEST).astype(np.int32)
                taken = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), cell, np.int32)), pa.array(side), pa.array(d[who, cell]), taken.column("row"), taken.column("v")], ["cell", "side", "d", "row", "v"])

    return rows.select("row", "v").mapInArrow(tidy(send), f"cell int, side int, d double, row long, v {rows.schema['v'].dataType.simpleString()}")


#: Tile pairs of a cell to compare (i of its home tiles with tiles lo..hi of ``with``), and what its tiles are sure of.
PLAN = "cell int, side int, tile int, sure long, heads array<long>, other int, lo int, hi int"


def plan_cell(radius: float):
    """From a cell's tiles (side, tile, n, low, high, head), sorted by distance, what is certain and what must be compared."""

    def ranges(of: dict, to: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each tile of ``of``: how many tiles of ``to`` are linked for certain, and how many may be linked."""
        sure = np.searchsorted(to["high"], radius - ANGLE - of["high"], "right")
        return sure, np.searchsorted(to["low"], of["high"] + radius + ANGLE, "right")

    def plan(tiles: pa.Table) -> pa.Table:
        tiles = tiles.sort_by([("side", "ascending"), ("tile", "ascending")])
        cell, side = tiles.column("cell")[0].as_py(), tiles.column("side").to_numpy()
        by = [{c: tiles.column(c).to_numpy()[side == s] for c in ("n", "low", "high", "head")} for s in (HOME, GUEST)]
        out = []
        for s in (HOME, GUEST):
            sure, heads = np.zeros(len(by[s]["n"]), np.int64), [[] for _ in by[s]["n"]]
            for o in (HOME, GUEST):
                if (s, o) == (GUEST, GUEST) or not len(by[o]["n"]):
                    continue
                certain, possible = ranges(by[s], by[o])
                upto = np.concatenate([[0], np.cumsum(by[o]["n"])])
                for i, c in enumerate(certain.tolist()):
                    if c:
                        # rows do not count as their own partners
                        sure[i] += int(upto[c]) - (s == o and i < c)
                        heads[i].append(int(by[o]["head"][0]))
                    if s == HOME:
                        first = max(c, i) if o == HOME else c
                        # further down, tiles may still be too near the pivot
                        far = int(np.searchsorted(by[o]["high"], by[s]["low"][i] - radius - ANGLE, "left"))
                        first, last = max(first, far), int(possible[i]) - 1
                        if first <= last:
                            out.append((cell, s, i, 0, [], o, first, last))
            out += [(cell, s, i, int(n), h, None, None, None) for i, (n, h) in enumerate(zip(sure, heads, strict=True)) if h]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32()]
        names = ["cell", "side", "tile", "sure", "heads", "other", "lo", "hi"]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return plan


def compare_tiles(width: int, threshold: float):
    """The links between two tiles (or within one): (row, n, link), n of a row's links and an edge of their spanning forest."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("right", "ascending"), ("row", "ascending")])
        x, ids, right = matrix(rows.column("v"), width), rows.column("row").to_numpy(), rows.column("right").to_numpy(zero_copy_only=False).astype(bool)
        cut = int((~right).sum())
        within = cut == len(ids)
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        base = 0 if within else cut
        for at in range(0, cut, STRIP):
            to = min(cut, at + STRIP)
            hit = linked(x[at:to], x[base:], threshold)
            if within:
                hit[np.arange(to - at), np.arange(at, to)] = False
            else:
                n[base:] += hit.sum(0)
            n[at:to] += hit.sum(1)
            for i in np.flatnonzero(hit.any(1)).tolist():
                joined = np.append(label[base + np.flatnonzero(hit[i])], label[at + i])
                low = joined.min()
                if (joined != low).any():
                    label[np.isin(label, joined)] = low
        some = np.flatnonzero(n)
        return pa.table([pa.array(ids[some]), pa.array(n[some]), pa.array(ids[label[some]])], ["row", "n", "link"])

    return compare


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, per_pivot: int = PER_PIVOT, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: its number of links, the smallest key it reaches, whether that is its own.

    ``threshold`` must be positive.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    radius = float(np.arccos(threshold))
    v = F.col(vector)
    if "float" not in vectors.schema[vector].dataType.simpleString():
        v = v.cast("array<double>")
    rows = stored(vectors.select(F.col(key).alias("key"), v.alias("v")).withColumn("row", F.monotonically_increasing_id()), "metric_rows")
    valid = rows.filter(usable(rows, "v")).select("row", "v")
    total, width = valid.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    sample = valid.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow()
    pivots = choose_pivots(matrix(sample.column("v"), width), min(MOST, max(LEAST, -(-total // per_pivot))), radius)
    dealt = stored(deal(valid, pivots, width, radius), "metric_dealt")
    placed = stored(ranked(dealt, ["cell", "side"], ["d", "row"], "metric").select("cell", "side", F.floor(F.col("__at") / tile).cast("int").alias("tile"), "d", "row", "v"), "metric_tiles")
    tiles = placed.groupBy("cell", "side", "tile").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.min_by("row", F.struct("d", "row")).alias("head"))
    plan = stored(tiles.groupBy("cell").applyInArrow(plan_cell(radius), PLAN), "metric_plan")
    # each pair of tiles is a unit of work; a tile goes to each of its units
    units = plan.filter("lo is not null").select("cell", F.col("tile").alias("i"), "other", F.explode(F.sequence("lo", "hi")).alias("j"))
    left = units.select("cell", F.lit(HOME).alias("side"), F.col("i").alias("tile"), "i", "other", "j", F.lit(False).alias("right"))
    others = units.filter((F.col("other") == GUEST) | (F.col("i") != F.col("j"))).select("cell", F.col("other").alias("side"), F.col("j").alias("tile"), "i", "other", "j", F.lit(True).alias("right"))
    work = placed.join(left.unionByName(others), ["cell", "side", "tile"]).select("cell", "i", "other", "j", "right", "row", "v")
    compared = work.groupBy("cell", "i", "other", "j").applyInArrow(compare_tiles(width, threshold), "row long, n long, link long")
    certain = plan.filter("lo is null").select("cell", "side", "tile", "sure", "heads")
    sure = placed.select("cell", "side", "tile", "row").join(certain, ["cell", "side", "tile"])
    sure = sure.select("row", F.posexplode("heads").alias("at", "link"), "sure").select("row", F.when(F.col("at") == 0, F.col("sure")).otherwise(0).alias("n"), "link")
    found = stored(compared.unionByName(sure), "metric_links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    members = components(found.select(F.col("row").alias("u"), F.col("link").alias("v")))
    named = stored(members.join(rows.select(F.col("row").alias("node"), "key"), "node"), "metric_members")
    lowest = stored(named.groupBy("comp").agg(F.min("key").alias("component_id")), "metric_components")
    reached = lookup_left(named.select("node", "comp"), lowest, ["comp"]).select(F.col("node").alias("row"), "component_id", F.lit(True).alias("in_one"))
    out = rows.select("row", "key").join(counts, "row", "left").join(reached, "row", "left")
    component = F.when(F.col("in_one"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def op13_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op13_embedding_near_dedup": """
with recursive usable as (
  select row_number() over () as r, vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as u, b.vec_id as v from usable a join usable b on a.r <> b.r and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
lowest as (select u, min(v) as low from reach group by u),
counts as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) as component_id, least(e.vec_id, coalesce(l.low, e.vec_id)) = e.vec_id as kept
from embeddings e left join counts c on e.vec_id = c.u left join lowest l on e.vec_id = l.u
"""
}
