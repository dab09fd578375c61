"""hotsets: dataset-popularity analytics as Spark jobs.

Reads file-access logs, job records, file catalogs and replica snapshots,
builds weekly popularity tables, replication factors and log-scale
histograms, encodes features, samples deterministically, trains Spark ML
models and evaluates their predictions.  Everything is DataFrame / SQL
code; there are no Python UDFs on the data path.
"""

__version__ = "0.1.0"
