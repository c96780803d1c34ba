"""An immutable query builder over features: typed selection, filters, relations, order and paging."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.graphs import closure

TYPES = ("peak", "ridge", "valley", "saddle", "flat_zone")
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains")
NUMBER = (T.NumericType, T.BooleanType)


def matches(kind: T.DataType, value: Any) -> bool:
    """Whether a column of that type can equal the value: there are no implicit casts."""
    if isinstance(value, (bool, int, float)):
        return isinstance(kind, NUMBER)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def condition(df: DataFrame, field: str, op: str, value: Any) -> Column:
    """A filter on a field; an unknown field matches nothing, as does null."""
    if field not in df.columns:
        return F.lit(False)
    c, kind = F.col(field), df.schema[field].dataType
    if isinstance(kind, T.BooleanType) and isinstance(value, (int, float)):
        c, kind = c.cast("int"), T.IntegerType()
        value = int(value) if isinstance(value, bool) else value
    if op in ("eq", "neq"):
        same = (c == F.lit(value)) if matches(kind, value) else (F.lit(False) & c.isNotNull())
        return same if op == "eq" else c.isNotNull() & ~same
    if op in ("gt", "gte", "lt", "lte"):
        if not matches(kind, value):
            raise TypeError(f"{field} can't be compared with {value!r}")
        return {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]
    if op == "in":
        if isinstance(value, str):
            if not isinstance(kind, T.StringType):
                raise TypeError(f"{field} isn't text")
            return F.expr(f"instr({_quoted(value)}, `{field}`) > 0")
        usable = [v for v in value if matches(kind, v)]
        return c.isin(usable) if usable else F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array_contains(c, value) if matches(kind.elementType, value) else F.lit(False)
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return c.contains(value)
    raise TypeError(f"{field} can't contain {value!r}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Query:
    """terrain: an object with features, visibility, flow, connectivity and basins."""

    terrain: Any
    kind: str | None = None
    filters: tuple = ()
    relations: tuple = ()
    order: tuple | None = None
    most: int | None = None
    skip: int = 0

    def select(self, kind: str) -> Query:
        if kind not in TYPES:
            raise ValueError(f"unknown feature type: {kind}")
        return replace(self, kind=kind)

    def where(self, **conditions) -> Query:
        more = []
        for key, value in conditions.items():
            field, _, op = key.partition("__") if not key.startswith("_") else (key, "", "")
            op = op or "eq"
            if op not in OPERATORS:
                raise ValueError(f"unknown operator: {op}")
            more.append((field, op, value))
        return replace(self, filters=(*self.filters, *more))

    def in_watershed(self, basin: str) -> Query:
        return replace(self, relations=(*self.relations, ("basin", basin)))

    def visible_to(self, target: Query | list | str) -> Query:
        return replace(self, relations=(*self.relations, ("visible", target)))

    def connected_to(self, feature_id: str) -> Query:
        return replace(self, relations=(*self.relations, ("connected", feature_id)))

    def upstream_of(self, feature_id: str) -> Query:
        return replace(self, relations=(*self.relations, ("up", feature_id)))

    def downstream_of(self, feature_id: str) -> Query:
        return replace(self, relations=(*self.relations, ("down", feature_id)))

    def order_by(self, field: str, descending: bool = False) -> Query:
        return replace(self, order=(field, descending))

    def limit(self, n: int) -> Query:
        if n < 1:
            raise ValueError("limit must be 1 or more")
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must be 0 or more")
        return replace(self, skip=n)

    def to_df(self) -> DataFrame:
        """The result: lazy, but for the rounds of upstream_of and downstream_of, which run here."""
        if self.kind is None:
            raise ValueError("select() a feature type first")
        df = self.terrain.features.filter(F.col("feature_type") == self.kind)
        for f in self.filters:
            df = df.filter(condition(df, *f))
        for name, value in self.relations:
            df = df.join(self.related(name, value), "feature_id", "left_semi")
        keys = [F.col("map_id").asc(), F.col("seq").asc()]
        if self.order:
            field, descending = self.order
            c = F.col(field) if field in df.columns else F.lit(None)
            # Nulls come last, and first when the order is reversed.
            keys.insert(0, c.desc_nulls_first() if descending else c.asc_nulls_last())
        df = df.orderBy(*keys)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)

    execute = to_df

    def related(self, name: str, value) -> DataFrame:
        t = self.terrain
        spark = t.features.sparkSession
        if name == "basin":
            return t.basins.filter(F.col("basin_key") == value).select("feature_id")
        if name == "visible":
            ids = value.to_df().select("feature_id") if isinstance(value, Query) else spark.createDataFrame([(v,) for v in ([value] if isinstance(value, str) else value)], "feature_id string")
            return t.visibility.join(ids.select(F.col("feature_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("feature_id"))
        if name == "connected":
            return t.connectivity.filter(F.col("src") == value).select(F.col("dst").alias("feature_id"))
        start = spark.createDataFrame([(value,)], "id string")
        return closure(t.flow, start, reverse=name == "up").select(F.col("id").alias("feature_id"))


def by_id(features: DataFrame, feature_id: str):
    """The feature's row; KeyError if there is none."""
    row = features.filter(F.col("feature_id") == feature_id).first()
    if row is None:
        raise KeyError(feature_id)
    return row


def by_prefix(features: DataFrame, prefix: str) -> str:
    """The one id that starts so; KeyError if none or several do."""
    found = features.filter(F.col("feature_id").startswith(prefix)).select("feature_id").limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{'ambiguous' if found else 'no'} feature id: {prefix}")
    return found[0].feature_id


def ping(features: DataFrame, x: float, y: float, radius_m: float, scale: float, kind: str | None = None) -> DataFrame:
    """Features within radius_m of a pixel, closest first, with distance_m."""
    df = features if kind is None else features.filter(F.col("feature_type") == kind)
    d = F.sqrt(((F.col("cx") - x) * (F.col("cx") - x) + (F.col("cy") - y) * (F.col("cy") - y)).cast("double")) * scale
    return df.withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m).orderBy("distance_m", "seq")


def ping_from(features: DataFrame, feature_id: str, radius_m: float, scale: float, kind: str | None = None) -> DataFrame:
    """The same around a feature of the same map, without itself."""
    row = by_id(features, feature_id)
    return ping(features.filter(F.col("map_id") == row.map_id), row.cx, row.cy, radius_m, scale, kind).filter(F.col("feature_id") != feature_id)
