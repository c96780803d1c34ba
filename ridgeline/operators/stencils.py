"""Stencils over pixels, a tile with its halo at a time.

A pixel goes to its own tile and, where a tile's border is within the halo, to the neighbours' too.  That is
one shuffle for a whole chain of steps, whatever they are, and a task holds tiles and never a row
or a map.  Steps work on arrays: the part of the map that is in the tile and its halo.  Beyond the map's
edge they do as they say; what they make of the halo's own edge is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256
Fields = dict[str, np.ndarray]


@dataclass(frozen=True)
class Step:
    """reach: pixels that an output looks around; reads, makes: columns; work: adds the latter to the fields."""

    reach: int
    reads: tuple[str, ...]
    makes: tuple[str, ...]
    work: Callable[[Fields], None]
    kind: str = "double"


def kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * k * k / sigma**2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def shifted(a: np.ndarray, axis: int, k: int, pad: int, mode: str, value: float = 0.0) -> np.ndarray:
    """Neighbour k steps on along the axis, of an array padded by ``pad``."""
    n = a.shape[axis] - 2 * pad
    at = [slice(None)] * 2
    at[axis] = slice(pad + k, pad + k + n)
    return a[tuple(at)]


def padded(a: np.ndarray, axis: int, pad: int, mode: str, **kw) -> np.ndarray:
    return np.pad(a, [(pad, pad) if k == axis else (0, 0) for k in (0, 1)], mode=mode, **kw)


def along_line(a: np.ndarray, axis: int, pad: int, mode: str, **kw) -> Callable[[int], np.ndarray]:
    wide = padded(a, axis, pad, mode, **kw)
    return lambda k: shifted(wide, axis, k, pad, mode)


def blur(column: str, sigma: float, out: str | None = None) -> Step:
    """Separable Gaussian, y first, edges mirrored (the edge pixel twice)."""
    weights, out = kernel(sigma), out or column
    r = len(weights) // 2

    def work(f: Fields) -> None:
        a = f[column]
        for axis in (0, 1):
            near, total = along_line(a, axis, r, "symmetric"), None
            for k, w in zip(range(-r, r + 1), weights, strict=True):
                total = near(k) * w if total is None else total + near(k) * w
            a = total
        f[out] = a

    return Step(r, (column,), (out,), work)


def slope(a: np.ndarray, axis: int, cell: float) -> np.ndarray:
    """Central difference, one-sided at the ends; NaN on a line of one pixel."""
    if a.shape[axis] < 2:
        return np.full(a.shape, np.nan)
    near = along_line(a, axis, 1, "edge")
    out = (near(1) - near(-1)) / (2 * cell)
    ends = [(slice(None), [0, -1]), ([0, -1], slice(None))][axis == 0]
    out[ends] = ((near(1) - near(-1)) / cell)[ends]
    return out


def differences(column: str, dx: str, dy: str, cell: float) -> Step:
    def work(f: Fields) -> None:
        f[dx], f[dy] = slope(f[column], 1, cell), slope(f[column], 0, cell)

    return Step(1, (column,), (dx, dy), work)


def sobel(column: str, dx: str, dy: str, cell: float) -> Step:
    """3x3 Sobel operator; its dx points west."""

    def work(f: Fields) -> None:
        near = along_line(f[column], 1, 1, "edge")
        d, s = near(-1) - near(1), near(-1) + 2 * f[column] + near(1)
        d_line, s_line = along_line(d, 0, 1, "edge"), along_line(s, 0, 1, "edge")
        f[dx] = (d_line(-1) + 2 * d + d_line(1)) / (8 * cell)
        f[dy] = (s_line(1) - s_line(-1)) / (8 * cell)

    return Step(1, (column,), (dx, dy), work)


def box(column: str, low: int, high: int, how: str, out: str) -> Step:
    """min or max over the square from low to high pixels, cut at the map's edge; missing pixels are left out."""
    blank, pick = {"min": (np.inf, np.minimum), "max": (-np.inf, np.maximum)}[how]
    r = max(-low, high)

    def work(f: Fields) -> None:
        a = np.where(np.isnan(f[column]), blank, f[column])
        for axis in (0, 1):
            wide, have, step = padded(a, axis, r, "constant", constant_values=blank), 1, None
            width = high - low + 1
            cut = lambda x, a, b, axis=axis: x[a:b] if axis == 0 else x[:, a:b]
            step = wide  # least of ``have`` pixels from each on
            while 2 * have <= width:
                n = step.shape[axis]
                step = pick(cut(step, 0, n - have), cut(step, have, n))
                have *= 2
            n = a.shape[axis]
            a = pick(cut(step, r + low, r + low + n), cut(step, r + high + 1 - have, r + high + 1 - have + n))
        f[out] = a

    return Step(r, (column,), (out,), work)


def variance(column: str, out: str) -> Step:
    """Population variance of 3x3 pixels, edges mirrored, not below 0."""

    def work(f: Fields) -> None:
        near = along_line(f[column], 1, 1, "edge")
        a = near(-1) + f[column] + near(1)
        b = near(-1) * near(-1) + f[column] * f[column] + near(1) * near(1)
        a_line, b_line = along_line(a, 0, 1, "edge"), along_line(b, 0, 1, "edge")
        mean = (a_line(-1) + a + a_line(1)) / 9.0
        square = (b_line(-1) + b + b_line(1)) / 9.0
        f[out] = np.maximum(0.0, square - mean * mean)

    return Step(1, (column,), (out,), work)


def steepest(column: str, steps: tuple, out: str) -> Step:
    """Number (from 1) of the step (dx, dy) of the steepest drop, the first of equals; 0 without a drop."""

    def work(f: Fields) -> None:
        z = f[column]
        wide = np.pad(z, 1, constant_values=np.nan)
        h, w = z.shape
        falls = np.stack([(z - wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]) / (math.sqrt(2.0) if dx and dy else 1.0) for dx, dy in steps])
        falls = np.where(np.isnan(falls), -np.inf, falls)
        best = falls.max(axis=0)
        f[out] = np.where(best > 0, falls.argmax(axis=0) + 1, 0)

    return Step(1, (column,), (out,), work, "int")


def strict_top(column: str, out: str) -> Step:
    """1 where a pixel is above all its eight neighbours, else 0."""

    def work(f: Fields) -> None:
        a = f[column]
        wide = np.pad(np.where(np.isnan(a), -np.inf, a), 1, constant_values=-np.inf)
        h, w = a.shape
        ring = [wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
        f[out] = (a > np.max(ring, axis=0)).astype(np.int32)

    return Step(1, (column,), (out,), work, "int")


def apply(df: DataFrame, *steps: Step, tile: int = TILE) -> DataFrame:
    """df (map_id, y, x, ...) with the columns that the steps make, one after the other."""
    made: dict[str, str] = {}
    reads: list[str] = []
    for s in steps:
        reads += [c for c in s.reads if c not in made and c not in reads]
        made |= dict.fromkeys(s.makes, s.kind)
    halo = sum(s.reach for s in steps)
    if halo > tile:
        raise ValueError("the halo is wider than a tile")
    rest = [f for f in df.schema if f.name not in made]
    types = {"double": (T.DoubleType(), pa.float64(), np.float64), "int": (T.IntegerType(), pa.int32(), np.int32)}
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rest] + [T.StructField(c, types[k][0], True) for c, k in made.items()])

    def work(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy().astype(np.int64), table.column("x").to_numpy().astype(np.int64)
        own = (y // tile == table.column("_ty").to_numpy()) & (x // tile == table.column("_tx").to_numpy())
        i, j = y - y.min(), x - x.min()
        f: Fields = {}
        for c in reads:
            f[c] = np.full((int(i.max()) + 1, int(j.max()) + 1), np.nan)
            f[c][i, j] = table.column(c).to_numpy().astype(np.float64)
        with np.errstate(all="ignore"):
            for s in steps:
                s.work(f)
        i, j = i[own], j[own]
        out = table.select([c.name for c in rest]).filter(pa.array(own))
        for c, k in made.items():
            out = out.append_column(c, pa.array(f[c][i, j].astype(types[k][2]), types[k][1]))
        return out

    reach = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile).cast("int")), F.floor((F.col(c) + halo) / tile).cast("int"))
    dealt = df.withColumn("_ty", F.explode(reach("y"))).withColumn("_tx", F.explode(reach("x")))
    return dealt.groupBy("map_id", "_ty", "_tx").applyInArrow(work, schema)
