"""Parameters of the registered test-table queries, shared by the Spark
queries and their SQL equivalents.

The original label is ``numaccesses > 50``, but no test group has more than
two accesses; ``readbytes > 50000`` splits the groups about in half.
Training uses the weeks up to 40.  The two queries that show how unseen
values are encoded leave one site out of their vocabulary.
"""

LABEL_METRIC, LABEL_THRESHOLD = "readbytes", 50000.0
TRAIN_LAST_WEEK, HELD_OUT_SITE = 40, "NATION_3"

# buckets of the file key: both tables of the weekly join have as many
BUCKETS = 16

# labels of the sweep: (metric, threshold); the last one has no positive row to hold out in small tables
SWEEP = [("readbytes", 30000.0), ("readbytes", 50000.0), ("dataset_size", 1500.0), ("numaccesses", 50.0)]
