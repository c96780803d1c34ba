"""Iterations on tables: pointer jumping, components, closures, suppression and spatial joins.

Each loop halves what is left to do or stops when nothing changes.  A round's table is written and read
back (see ``sources.scratch``), so that neither lineage nor size estimates grow, and older rounds are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.scratch import Scratch
from ridgeline.sources.scratch import components as star_components

#: Width of a tile of pixels, and the step of pixel ids from one line to the next.
TILE, LINE = 512, 1 << 32


def pixel_id(x="x", y="y") -> Column:
    return F.col(y).cast("long") * LINE + F.col(x)


def settle(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The table, written to the session's shared folder and read back."""
    return (scratch or Scratch(df.sparkSession)).keep(df)


def roots(links: DataFrame, most: int = 64) -> DataFrame:
    """links: map_id, id, next (null at a root) -> map_id, id, root, by pointer jumping; a cycle's members keep null."""
    scratch = Scratch(links.sparkSession)
    now = scratch.keep(links.select("map_id", "id", F.coalesce("next", "id").alias("to"), F.col("next").isNull().alias("done")))
    left = now.filter("not done").count()
    for _ in range(most):
        if not left:
            break
        ahead = now.select("map_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"))
        after = scratch.keep(now.join(ahead, ["map_id", "to"]).select("map_id", "id", F.col("to2").alias("to"), (F.col("done") | F.col("done2")).alias("done")))
        scratch.drop(now)
        now, before = after, left
        left = now.filter("not done").count()
        if left == before:  # what is left leads into a cycle
            break
    return now.select("map_id", "id", F.when(F.col("done"), F.col("to")).alias("root"))


def accumulate(links: DataFrame, most: int = 40) -> DataFrame:
    """links (map_id, id, next), acyclic -> map_id, id, acc: nodes that flow through each, itself counted, by doubling."""
    scratch = Scratch(links.sparkSession)
    now = scratch.keep(links.select("map_id", "id", F.col("next").alias("to"), F.lit(1).cast("long").alias("acc")))
    for _ in range(most):
        live = now.filter("to is not null")
        if live.isEmpty():
            break
        gain = live.groupBy("map_id", F.col("to").alias("id")).agg(F.sum("acc").alias("gain"))
        ahead = now.select("map_id", F.col("id").alias("to"), F.col("to").alias("to2"))
        after = now.join(ahead, ["map_id", "to"], "left").join(gain, ["map_id", "id"], "left")
        after = scratch.keep(after.select("map_id", "id", F.col("to2").alias("to"), (F.col("acc") + F.coalesce("gain", F.lit(0))).alias("acc")))
        scratch.drop(now)
        now = after
    return now.select("map_id", "id", "acc")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n-1 with links a-b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return root


def components(mask: DataFrame, eight: bool = False, tile: int = TILE, rounds: list | None = None) -> DataFrame:
    """mask: map_id, y, x -> with label, the least (y, x) of the pixel's connected component as y * 2**32 + x.

    Tiles are labelled by themselves, an Arrow group each; only links between touching border
    pixels of two tiles go through the star steps, so the rounds work on a share of 1/tile.
    """
    scratch = Scratch(mask.sparkSession)

    def label(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy().astype(np.int64), table.column("x").to_numpy().astype(np.int64)
        order = np.lexsort((x, y))
        grid = np.full((tile + 2, tile + 2), -1, np.int64)  # a border of nothing
        i, j = y[order] % tile + 1, x[order] % tile + 1
        grid[i, j] = np.arange(len(order))
        a, b = [], []
        for di, dj in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if eight else 2]:
            other = grid[i + di, j + dj]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[a[-1]])
        head = order[forest(len(order), np.concatenate(a), np.concatenate(b))]
        out = np.empty(len(order), np.int64)
        out[order] = y[head] * LINE + x[head]
        return table.select(["map_id", "y", "x"]).append_column("part", pa.array(out))

    of = lambda c: F.floor(F.col(c) / tile)
    px = mask.select(F.col("map_id").cast("int"), F.col("y").cast("int"), F.col("x").cast("int"))
    px = scratch.keep(px.groupBy("map_id", of("y").alias("ty"), of("x").alias("tx")).applyInArrow(label, "map_id int, y int, x int, part long"))
    edge = lambda c, k: F.pmod(F.col(c), F.lit(tile)) == k
    first = px.filter(edge("y", 0) | edge("x", 0) | (edge("x", tile - 1) if eight else F.lit(False)))
    steps = [(-1, 0), (0, -1)] + ([(-1, -1), (-1, 1)] if eight else [])
    near = first.withColumn("s", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))))
    near = near.select("map_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("part").alias("a"))
    last = px.filter(edge("y", tile - 1) | edge("x", tile - 1) | (edge("x", 0) if eight else F.lit(False))).withColumnRenamed("part", "b")
    links = scratch.keep(near.join(last, ["map_id", "y", "x"]).filter("a <> b").select("map_id", "a", "b").distinct())
    if links.isEmpty():
        return px.withColumnRenamed("part", "label")
    names = star_components(links, scratch, ("map_id",), rounds).withColumnRenamed("node", "part")
    return px.join(names, ["map_id", "part"], "left").select("map_id", "y", "x", F.coalesce("component", "part").alias("label"))


def numbered(df: DataFrame, out: str, line: list[str], order: str) -> DataFrame:
    """Adds out, the place (from 0) of a row in its map by line, then by order: places within lines, and the rows of the lines before."""
    lines = df.groupBy("map_id", *line).agg(F.count("*").alias("_n"))
    up = Window.partitionBy("map_id").orderBy(*line)  # a row a line
    lines = lines.select("map_id", *line, (F.sum("_n").over(up) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("map_id", *line).orderBy(order)) - 1
    return df.withColumn("_own", own).join(lines, ["map_id", *line]).withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own")


def at_least(labelled: DataFrame, size: int) -> DataFrame:
    """Pixels of components of that size or more."""
    return labelled.join(labelled.groupBy("map_id", "label").count().filter(F.col("count") >= size).select("map_id", "label"), ["map_id", "label"], "left_semi")


def closure(edges: DataFrame, start: DataFrame, reverse: bool = False) -> DataFrame:
    """edges: src, dst; start: id -> all ids reachable, the start included; cycles are no harm."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    scratch = Scratch(edges.sparkSession)
    steps = scratch.keep(edges.select(F.col(src).alias("id"), F.col(dst).alias("to")).distinct())
    seen = front = scratch.keep(start.select("id").distinct())
    while not front.isEmpty():
        # A union of the rounds' tables: nothing that was reached is written again.
        front = scratch.keep(front.join(steps, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def radius_join(left: DataFrame, right: DataFrame, radius: float, extra: Column | None = None) -> DataFrame:
    """Pairs within radius (closed) of left (map_id, x, y, ...) and right (map_id, x2, y2, ...): an equi-join on grid cells.

    right is put in its cell, left in its 3 x 3 cells, so a pair meets once; adds dist.
    """
    cell = max(1.0, float(radius))
    put = lambda c: F.floor(F.col(c) / cell).cast("int")
    near = F.array(*(F.struct((put("x") + i).alias("gx"), (put("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = left.withColumn("_c", F.explode(near)).withColumn("_gx", F.col("_c.gx")).withColumn("_gy", F.col("_c.gy")).drop("_c")
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    out = spread.join(right.withColumn("_gx", put("x2")).withColumn("_gy", put("y2")), ["map_id", "_gx", "_gy"]).filter(d2 <= radius * radius).drop("_gx", "_gy")
    out = out.withColumn("dist", F.sqrt(d2.cast("double")))
    return out if extra is None else out.filter(extra)


def nearest(left: DataFrame, right: DataFrame, radius: float, key: list[str], tie: str) -> DataFrame:
    """For each key of left, the row of right that is nearest within radius; ties by the column ``tie``."""
    columns = [c for c in right.columns if c != "map_id"]
    pairs = radius_join(left, right, radius)
    best = F.min_by(F.struct(*columns, "dist"), F.struct("dist", tie)).alias("best")
    return pairs.groupBy(*key).agg(best).select(*key, "best.*")


def suppress(points: DataFrame, radius: float) -> DataFrame:
    """Greedy suppression: points (map_id, id, x, y, strength) in order of strength, then id, both falling; each kept one drops those within radius.

    A point that beats all undecided points near it is kept and its neighbours go, round by round:
    the same as one by one, as the order is total.
    """
    scratch = Scratch(points.sparkSession)
    left = scratch.keep(points.select("map_id", "id", "x", "y", "strength"))
    kept = None
    while not left.isEmpty():
        other = left.select("map_id", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("strength").alias("s2"))
        pairs = radius_join(left, other, radius).filter("id <> id2")
        beaten = pairs.filter("s2 > strength or (s2 = strength and id2 > id)").select("map_id", "id").distinct()
        best = scratch.keep(left.join(beaten, ["map_id", "id"], "left_anti"))
        kept = best if kept is None else kept.unionByName(best)
        gone = radius_join(left, best.select("map_id", F.col("x").alias("x2"), F.col("y").alias("y2")), radius).select("map_id", "id").distinct()
        rest = scratch.keep(left.join(gone, ["map_id", "id"], "left_anti"))
        scratch.drop(left)
        left = rest
    return points.select("map_id", "id") if kept is None else kept.select("map_id", "id")
