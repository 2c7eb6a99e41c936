"""Keeping a graph up to date: full builds, incremental batches by content hash, and a file stream.

Every batch replaces whole files, so running one again gives the same graph; the stream uses that for exactly-once
results. A file stream does not see deletions: run incremental_update now and then to find them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.communities import communities_table, detect_communities, store_communities
from ..operators.flows import detect_flows
from ..operators.store import Snapshots, replace_file_batch
from ..operators.traverse import cut, resolve_calls
from ..schema import EDGES, NODES
from ..sources.files import changed_files, scan_files, select_sources
from ..sources.parser import parse_files

STREAM_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _apply(store: Snapshots, files: DataFrame, touched: DataFrame) -> str:
    new_nodes, new_edges = parse_files(files)
    nodes, edges = replace_file_batch(store.read("nodes"), store.read("edges"), touched, cut(new_nodes), cut(new_edges))
    nodes = cut(nodes.select(*NODES.fieldNames()))
    edges = cut(resolve_calls(nodes, edges).select(*EDGES.fieldNames()))
    meta = store.read("metadata").filter("key != 'last_updated'").unionByName(store.spark.createDataFrame([("last_updated", str(time.time()))], "key string, value string"))
    return store.write({"nodes": nodes, "edges": edges, "metadata": meta})


def full_build(spark: SparkSession, root: str, store: Snapshots) -> str:
    """Parse every source file below ``root`` in one distributed pass; files that are gone lose their rows."""
    files = scan_files(spark, root)
    had = store.read("nodes").select("file_path").distinct()
    touched = files.select(F.col("path").alias("file_path")).unionByName(had)
    return _apply(store, files, touched)


def incremental_update(spark: SparkSession, root: str, store: Snapshots) -> tuple[str | None, DataFrame]:
    """Parse only files whose hash is new; returns the new version (None if nothing changed) and the changes."""
    scanned = scan_files(spark, root)
    changes = cut(changed_files(scanned, store.read("nodes")))
    if changes.isEmpty():
        return None, changes
    fresh = scanned.join(changes.filter("change != 'deleted'").select("path"), "path", "left_semi")
    return _apply(store, fresh, changes.select(F.col("path").alias("file_path"))), changes


def postprocess(store: Snapshots) -> str:
    """Flows and communities of the current graph."""
    nodes, edges = store.read("nodes"), store.read("edges")
    flows, memberships = detect_flows(nodes, edges)
    now = F.current_timestamp()
    communities, assigned = communities_table(nodes, edges, detect_communities(nodes, edges))
    marked, summaries = store_communities(nodes, communities, assigned)
    return store.write({"nodes": cut(marked), "flows": cut(flows.withColumns({"created_at": now, "updated_at": now})), "flow_memberships": cut(memberships), "communities": cut(communities.withColumn("created_at", now)), "community_summaries": cut(summaries)})


def watch(spark: SparkSession, root: str, store: Snapshots, checkpoint: str, available_now: bool = True):
    """A streaming query that puts new and changed files below ``root`` into the graph."""
    stream = spark.readStream.format("binaryFile").schema(STREAM_SCHEMA).option("recursiveFileLookup", True).load(root)
    files = select_sources(spark, stream, root)

    def one(batch: DataFrame, _id: int) -> None:
        if not batch.isEmpty():
            _apply(store, batch, batch.select(F.col("path").alias("file_path")))

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest_state(spark: SparkSession, events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: the state that a stream of upserts comes to."""
    return events.groupBy(key).agg(*(F.max_by(c, F.struct(order, F.xxhash64(*events.columns))).alias(c) for c in events.columns if c != key))
