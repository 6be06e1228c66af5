"""Tables written to the shared folder, and connected components over edge tables of any size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables that written() made and nobody has deleted yet.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary folder that is then set for the session, which only a local one
    may use: on a cluster each machine would write a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path: its lineage is cut, and no executor's loss touches it.

    Results may read such a table when they are asked for. Run operators in a scratch() block to have their tables deleted.
    """
    path = f"{shared_folder(df.sparkSession)}/tallyloom-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str] | None = None) -> Iterator[None]:
    """Tables that are written in the block are deleted at its end, but for paths in `keep`. Take results out before."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before and p not in (keep or ())]:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for every node of edges (a, b); edge tables without rows give none.

    Alternating stars: every node's larger neighbours are linked to its smallest one, then its smaller neighbours and itself
    are. Paths shorten by a constant factor each round and hubs never gather their neighbours: a minimum is summed before the
    shuffle and joined back, and such joins may split a hub's rows.
    """
    spark = edges.sparkSession
    edges, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # each edge of large goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges, new = written(small.where("a <> b").distinct())
        delete(spark, path)
        path = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components of {now[0]} edges are not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
