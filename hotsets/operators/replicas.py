"""Replica bytes, block bytes and replication factor per dataset, in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hotsets.functions.numeric import ratio_floor

# fixed values: node-name suffixes of nodes that are not user-readable disk
NON_DISK_NODE_PATTERNS = ("%MSS", "%Buffer", "%Export")


def on_disk(node: Column) -> Column:
    """Whether a replica's node is user-readable disk (NULL node: no)."""
    tape = reduce(lambda a, b: a | b, [node.like(p) for p in NON_DISK_NODE_PATTERNS])
    return F.coalesce(~tape, F.lit(False))


def _keys(per_snapshot: bool) -> list[str]:
    return ["dataset_name", "now"] if per_snapshot else ["dataset_name"]


def dataset_bytes(snapshots: DataFrame, per_snapshot: bool = False) -> DataFrame:
    """Per dataset: ``disk_bytes`` (of its replicas on disk), ``unique_bytes``
    (each distinct block and size once) and ``has_disk``.

    One scan and no join: rows are first reduced to one per block and size,
    carrying the bytes that disk nodes hold of it, then to one per dataset.
    Both steps combine on the map side.
    """
    keys = _keys(per_snapshot)
    disk = on_disk(F.col("node_name"))
    blocks = snapshots.groupBy(*keys, "block_id", "block_bytes").agg(
        F.sum(F.when(disk, F.col("br_node_bytes"))).alias("held"), F.bool_or(disk).alias("any_disk"))
    return blocks.groupBy(*keys).agg(
        F.sum("held").alias("disk_bytes"), F.sum("block_bytes").alias("unique_bytes"), F.bool_or("any_disk").alias("has_disk"))


def replica_bytes(snapshots: DataFrame, per_snapshot: bool = False) -> DataFrame:
    """Bytes of all replicas on disk, for the datasets that have one there."""
    return dataset_bytes(snapshots, per_snapshot).where("has_disk").select(*_keys(per_snapshot), "disk_bytes")


def block_bytes(snapshots: DataFrame, per_snapshot: bool = False) -> DataFrame:
    """Bytes of the distinct (bytes, block) of every dataset."""
    return dataset_bytes(snapshots, per_snapshot).select(*_keys(per_snapshot), "unique_bytes")


def replication_factor(snapshots: DataFrame, per_snapshot: bool = False, above: int = 1) -> DataFrame:
    """FLOOR(replica bytes / block bytes) of the datasets with a replica on
    disk, kept when > ``above``."""
    totals = dataset_bytes(snapshots, per_snapshot).where("has_disk")
    return (totals.select(ratio_floor("disk_bytes", "unique_bytes").alias("replicas"), *_keys(per_snapshot))
            .filter(F.col("replicas") > above))
