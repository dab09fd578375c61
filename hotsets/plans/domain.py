"""Lazy construction of the domain tables for one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from hotsets.operators.accesslog import clean_accesses
from hotsets.operators.weekly import access_popularity, jobs_popularity
from hotsets.sources import adapters


class Domain:
    """Domain DataFrames over the test tables in ``sf_dir`` (all lazy plans)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def file_catalog(self) -> DataFrame:
        return adapters.file_catalog(self.spark, self.sf_dir)

    @cached_property
    def dataset_catalog(self) -> DataFrame:
        return adapters.dataset_catalog(self.spark, self.sf_dir)

    @cached_property
    def access_raw(self) -> DataFrame:
        return adapters.access_raw(self.spark, self.sf_dir)

    @cached_property
    def access_clean(self) -> DataFrame:
        return clean_accesses(self.access_raw)

    @cached_property
    def replica_snapshots(self) -> DataFrame:
        return adapters.replica_snapshots(self.spark, self.sf_dir)

    @cached_property
    def jobs(self) -> DataFrame:
        return adapters.jobs(self.spark, self.sf_dir)

    @cached_property
    def analyses(self) -> DataFrame:
        return adapters.analyses(self.spark, self.sf_dir)

    @cached_property
    def access_json_lines(self) -> DataFrame:
        return adapters.access_json_lines(self.spark, self.sf_dir)

    @cached_property
    def popularity(self) -> DataFrame:
        return access_popularity(self.access_clean, self.file_catalog)

    @cached_property
    def jobs_popularity(self) -> DataFrame:
        return jobs_popularity(self.jobs)
