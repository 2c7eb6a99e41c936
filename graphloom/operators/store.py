"""Writes: upserts, replacement of files' rows, and snapshots that change as a whole.

A snapshot is a folder of Parquet tables; writers make a new folder and then move one small pointer file, so readers see
the old state or the new one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EDGES, NODES, TABLES, ensure_columns

KEPT_ON_UPSERT = ("id", "community_id", "signature")
EDGE_KEY = ("kind", "source_qualified", "target_qualified", "file_path", "line")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``; equal places are settled by the whole row, so runs agree."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.xxhash64(*df.columns))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def next_ids(df: DataFrame, start, order: list[str]) -> DataFrame:
    """Give rows consecutive ids after ``start``: ranks within range partitions plus the counts of those before."""
    dealt = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    ranked = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__p").withColumn("id", (F.lit(start) + F.col("__b") + F.col("__i")).cast("long")).drop("__p", "__b", "__i")


def upsert_nodes(old: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert or overwrite by qualified_name. Of several incoming rows the last by ``seq`` wins; an existing row keeps
    its id, community and signature; new ones get ids after the largest."""
    fresh = ensure_columns(last_by(incoming, ["qualified_name"], seq).drop(seq), NODES)
    old = ensure_columns(old, NODES)
    kept = old.join(fresh.select("qualified_name"), "qualified_name", "left_anti")
    had = old.select("qualified_name", *(F.col(c).alias(f"old_{c}") for c in KEPT_ON_UPSERT))
    merged = fresh.join(had, "qualified_name", "left")
    changed = merged.filter("old_id IS NOT NULL").withColumns({c: F.col(f"old_{c}") for c in KEPT_ON_UPSERT}).select(*NODES.fieldNames())
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = next_ids(merged.filter("old_id IS NULL").select(*(c for c in NODES.fieldNames() if c != "id")), top, ["qualified_name"]).select(*NODES.fieldNames())
    return kept.select(*NODES.fieldNames()).unionByName(changed).unionByName(added)


def upsert_edges(old: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert or overwrite by (kind, source, target, file, line); confidence and its tier come from ``extra``."""
    fresh = ensure_columns(last_by(incoming, list(EDGE_KEY), seq).drop(seq), EDGES)
    fresh = fresh.withColumns({"confidence": F.coalesce(F.get_json_object("extra", "$.confidence").cast("double"), F.lit(1.0)), "confidence_tier": F.coalesce(F.get_json_object("extra", "$.confidence_tier"), F.lit("EXTRACTED"))})
    old = ensure_columns(old, EDGES)
    kept = old.join(fresh.select(*EDGE_KEY), list(EDGE_KEY), "left_anti").select(*EDGES.fieldNames())
    merged = fresh.join(old.select(*EDGE_KEY, F.col("id").alias("old_id")), list(EDGE_KEY), "left")
    changed = merged.filter("old_id IS NOT NULL").withColumn("id", F.col("old_id")).select(*EDGES.fieldNames())
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = next_ids(merged.filter("old_id IS NULL").select(*(c for c in EDGES.fieldNames() if c != "id")), top, list(EDGE_KEY)).select(*EDGES.fieldNames())
    return kept.unionByName(changed).unionByName(added)


def remove_file_data(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of ``files`` (file_path)."""
    f = files.select("file_path").distinct()
    return nodes.join(f, "file_path", "left_anti").select(*nodes.columns), edges.join(f, "file_path", "left_anti").select(*edges.columns)


def delete_nodes_for_file(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") != file_path)


def replace_file_batch(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace all rows of ``files`` by the new ones; running it again changes nothing but ids."""
    n, e = remove_file_data(nodes, edges, files)
    return upsert_nodes(n, new_nodes), upsert_edges(e, new_edges)


replace_file = replace_file_batch


def update_node_signature(nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    s = signatures.select(F.col("id"), F.col("signature").alias("new_signature"))
    return nodes.join(s, "id", "left").withColumn("signature", F.coalesce("new_signature", "signature")).select(*nodes.columns)


def set_node_community(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    a = assigned.select("qualified_name", F.col("community_id").alias("new_id"))
    return nodes.join(a, "qualified_name", "left").withColumn("community_id", F.coalesce("new_id", "community_id")).select(*nodes.columns)


class Snapshots:
    """Versioned tables below a path that driver and executors share; a pointer file names the current version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        fs, p = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0].strip()

    def read(self, name: str) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        fs, p = self._fs(f"{self.path}/{version}/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], TABLES[name])
        return ensure_columns(self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{version}/{name}"), TABLES[name])

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write a new version with these tables (others are carried over) and make it the current one."""
        version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for name in TABLES:
            df = tables.get(name, None)
            if df is None and self.version() is not None:
                df = self.read(name)
            if df is not None:
                df.write.parquet(f"{self.path}/{version}/{name}")
        fs, tmp = self._fs(f"{self.path}/CURRENT.{version}")
        out = fs.create(tmp, True)
        out.write(bytearray(version.encode()))
        out.close()
        _, current = self._fs(f"{self.path}/CURRENT")
        fs.delete(current, False)
        if not fs.rename(tmp, current):
            raise OSError(f"could not move the pointer of {self.path}")
        return version

    def set_metadata(self, key: str, value: str) -> str:
        rest = self.read("metadata").filter(F.col("key") != key)
        return self.write({"metadata": rest.unionByName(self.spark.createDataFrame([(key, value)], TABLES["metadata"]))})

    def get_metadata(self, key: str) -> str | None:
        row = self.read("metadata").filter(F.col("key") == key).first()
        return row.value if row else None
