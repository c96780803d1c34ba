"""Working tables in the shared folder of the session, and connected components on them.

A table is written as Parquet and read back: that cuts the lineage, survives lost executors, and gives
Catalyst the true size of the rows (a checkpoint keeps an estimate that every join of a loop multiplies).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder of a single machine.

    On a cluster there is no folder that all executors see unless one is named, so that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ridgeline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


class Scratch:
    """Tables that outlive one job.

    ``drop`` removes one that no later step reads.  An operator's last tables stay while its lazy
    result may be read, and go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark).rstrip('/')}/ridgeline-{uuid.uuid4().hex}"
        self.n = 0

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """The table, written and read back; shuffle files of the job that made it are removed at its end."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        if self.n == 1:
            files, p = self._files(self.root)
            files.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ridgeline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_ridgeline_path", None)
            if path:
                files, p = self._files(path)
                files.delete(p, True)


#: A head with more members than this at once is split into salted parts.
SALTS = 8


def salted_join(rows: DataFrame, small: DataFrame, key: str | list[str], spread: str) -> DataFrame:
    """rows joined to small (a row a key) by key, in SALTS parts by the column spread: a hot key is no task of its own."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return rows.withColumn("_salt", salt).join(copies, [*([key] if isinstance(key, str) else key), "_salt"]).drop("_salt")


def components(links: DataFrame, scratch: Scratch, within: tuple[str, ...] = (), rounds: list | None = None) -> DataFrame:
    """Connected components of links (a long, b long): node, component (the smallest node reachable).

    within: columns that links and components never cross, passed on.  Alternates large-star and
    small-star steps (Kiveris et al. 2014) until nothing changes: a logarithmic number of rounds,
    each of which writes as many links at most as the one before.  The least neighbour of a node is
    found by partial aggregation and joined back by (node, salt), so that a head with many members
    is no task of its own.  rounds, a list, gets a row count for each round.
    """
    by = list(within)
    col = F.col

    def least(df: DataFrame) -> DataFrame:
        """Adds m, the least b of each a, to its rows."""
        salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
        low = df.groupBy(*by, "a").agg(F.min("b").alias("m"))
        low = low.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
        return df.withColumn("salt", salt).join(low, [*by, "a", "salt"]).drop("salt")

    now = scratch.keep(links.filter("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        around = now.unionByName(now.select(*by, col("b").alias("a"), col("a").alias("b")))
        # Large star: larger neighbours go to the least of the neighbourhood, the node included.
        large = least(around).filter("b > a").select(*by, col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the least of them.
        small = least(large)
        small = small.select(*by, col("b").alias("a"), col("m").alias("b")).unionByName(small.select(*by, "a", col("m").alias("b")))
        after = scratch.keep(small.filter("a <> b").distinct())
        scratch.drop(now)
        now = after
        got = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(col("b").cast("decimal(38,0)"))).first())
        if rounds is not None:
            rounds.append(got[0])
        if mark == got:
            break
        mark = got
    heads = now.select(*by, col("b").alias("node"), col("b").alias("component")).distinct()
    return now.select(*by, col("a").alias("node"), col("b").alias("component")).unionByName(heads)
