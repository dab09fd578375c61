from hotsets.operators import replicas
from tests.conftest import rows

SNAP = "now string, dataset_name string, block_id long, block_bytes double, node_name string, br_node_bytes double"


def test_replication_factor_rules(spark):
    data = [
        # dataset d1: block 1 (10 bytes) seen in 2 snapshots; disk replicas 10+10+15 -> 35/10 = 3
        ("t1", "d1", 1, 10.0, "T1_DISK", 10.0),
        ("t2", "d1", 1, 10.0, "T1_DISK", 10.0),
        ("t2", "d1", 1, 10.0, "T2_DISK", 15.0),
        ("t1", "d1", 1, 10.0, "T1_MSS", 1000.0),      # tape: excluded
        ("t1", "d1", 1, 10.0, "T1_Buffer", 1000.0),   # excluded
        ("t1", "d1", 1, 10.0, "T1_Export", 1000.0),   # excluded
        ("t1", "d1", 1, 10.0, None, 1000.0),          # NULL node: dropped
        # d2: block size changed between snapshots -> counted twice (5 + 6)
        ("t1", "d2", 2, 5.0, "X", 22.0),
        ("t2", "d2", 2, 6.0, "X", 11.0),              # 33 / 11 = 3
        # d3: ratio exactly 1 -> not kept; d4: 1.99 -> floor 1 -> not kept; d5: 2 -> kept
        ("t1", "d3", 3, 10.0, "X", 10.0),
        ("t1", "d4", 4, 100.0, "X", 199.0),
        ("t1", "d5", 5, 100.0, "X", 200.0),
        # d6: block bytes 0 -> ratio NULL -> not kept, no error
        ("t1", "d6", 6, 0.0, "X", 10.0),
    ]
    snap = spark.createDataFrame(data, SNAP)
    rf = replicas.replication_factor(snap)
    assert rows(rf, "dataset_name", "replicas") == [("d1", 3), ("d2", 3), ("d5", 2)]
    rb = dict(rows(replicas.replica_bytes(snap), "dataset_name", "disk_bytes"))
    assert rb["d1"] == 35.0
    bb = dict(rows(replicas.block_bytes(snap), "dataset_name", "unique_bytes"))
    assert bb["d1"] == 10.0 and bb["d2"] == 11.0
    per = rows(replicas.replication_factor(snap, per_snapshot=True), "dataset_name", "now", "replicas")
    assert ("d1", "t2", 2) in per and ("d5", "t1", 2) in per
