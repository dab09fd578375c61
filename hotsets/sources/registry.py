"""Named sources: name -> (format, schema, path pattern).

Path patterns are Hadoop globs (``{a,b}``, ``*``) and may point into
partition folders such as ``year=2015`` or ``time=2015-08-01``; with
``base_path`` set, the folder names become partition columns, so a filter
on them prunes whole folders at planning time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from hotsets import schemas
from hotsets.sources import readers


@dataclass(frozen=True)
class Source:
    fmt: str
    schema: StructType
    path: str
    base_path: str | None = None
    options: dict = field(default_factory=dict)


class Registry:
    def __init__(self, root: str = ""):
        self.root = root.rstrip("/")
        self._sources: dict[str, Source] = {}

    def add(self, name: str, fmt: str, schema: StructType, path: str, base_path: str | None = None,
            **options) -> "Registry":
        self._sources[name] = Source(fmt, schema, path, base_path, options)
        return self

    def path(self, name: str) -> str:
        p = self._sources[name].path
        return p if (p.startswith("/") or "://" in p or not self.root) else f"{self.root}/{p}"

    def names(self) -> list[str]:
        return sorted(self._sources)

    def has_files(self, spark: SparkSession, name: str) -> bool:
        """Whether the source's path pattern matches any file (a listing on
        the driver, nothing is read)."""
        from pyspark.errors import AnalysisException
        try:
            spark.read.format("binaryFile").load(self.path(name))
            return True
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return False
            raise

    def format(self, name: str) -> str:
        return self._sources[name].fmt

    def read(self, spark: SparkSession, name: str, observation: Observation | None = None) -> DataFrame:
        """The source as a DataFrame.  ``observation``: counts of a JSON source, taken by the job that reads it."""
        s = self._sources[name]
        opts = dict(s.options)
        if s.base_path:
            opts["base_path"] = s.base_path if (s.base_path.startswith("/") or "://" in s.base_path) \
                else f"{self.root}/{s.base_path}"
        if s.fmt == "json":
            return readers.read_json_lines(spark, self.path(name), s.schema, opts.get("base_path"), observation)
        return readers.read(spark, s.fmt, self.path(name), s.schema, **opts)


def default_registry(root: str) -> Registry:
    """Layout of the production folders, relative to ``root``.  There are two access logs
    (``access_log`` and ``access_log_eos``) and the dataset list in two formats."""
    return (Registry(root)
            .add("access_log", "json", schemas.ACCESS_RAW, "xrootd/*/*/*")
            .add("access_log_eos", "json", schemas.ACCESS_RAW, "eos/*/*/*")
            .add("dataset_catalog_avro", "avro", schemas.DATASET_CATALOG, "datasets-avro/*")
            .add("jobs", "avro", schemas.JOBS, "jobs/year=*", base_path="jobs")
            .add("dataset_catalog", "csv", schemas.DATASET_CATALOG, "datasets/*")
            .add("file_catalog", "csv", schemas.FILE_CATALOG, "catalog/*")
            .add("replica_snapshots", "csv", schemas.REPLICA_SNAPSHOTS, "replicas/time=*",
                 base_path="replicas")
            .add("analyses", "json", readers._with_corrupt(schemas.ANALYSES), "analyses/*"))
