"""Connected components, written intermediate tables, and tables whose columns may have any names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write, and go on from what was written: lineage ends here, in the folder that all executors share."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node each node is connected with, for the edges (a, b).

    Large-star and small-star steps in turn until the edges stay as they are; each is a minimum per node (combined before its shuffle) and a join.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_table(edges, f"{folder}-0")
    before, step = _state(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are written first: a join of two plain shuffles is one that Spark can split where a node has very many edges.
        low = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), f"{folder}-low-{step}")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = write_table(large, f"{folder}-large-{step}")
        low = write_table(large.groupBy("a").agg(F.min("b").alias("low")), f"{folder}-least-{step}")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        step += 1
        edges = write_table(small, f"{folder}-{step}")
        now = _state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def set_aside(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, rest): the two columns an operator works on, and all others in one struct, where no name of theirs can clash with one of the operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"), F.struct(*others, *([] if others else [F.lit(0).alias("none")])).alias("rest"))


def put_back(rows: DataFrame, columns: Sequence[str], doc_id: str = "doc_id", text: str = "text", new: Mapping[str, Column] | None = None) -> DataFrame:
    """The columns of the table before set_aside(), in their order; `new` replaces some that are there."""
    own = {doc_id: F.col("id"), text: F.col("body")} | dict(new or {})
    return rows.select(*[(own[c] if c in own else F.col("rest").getField(c)).alias(c) for c in columns])
