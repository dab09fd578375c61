"""Tables handed from one step of a job to the next, and who owns them.

A hand-off lives as long as its owner.  An owner is a handle of the session: every DataFrame that is
read through the handle, or derived from one that is, refers to it, so the tables written on the
way belong to it too.  They are dropped when the owner's work ends (``owning``, also after an
error), or once neither the handle nor any DataFrame made through it is left (``sweep``, which each new
owner starts with), and in any case when the driver's JVM ends.  ``left`` names what is there.
"""

from __future__ import annotations

import copy
import gc
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hotsets.session import ensure_checkpoint_dir, fresh_session

FOLDER = "handoffs"
_ATTRIBUTE = "_hotsets_owner"


class Owner:
    """The hand-offs of one piece of work."""

    def __init__(self, spark: SparkSession, name: str):
        self.name, self.paths, self.tables = name, [], []
        sc = spark.sparkContext
        self.folder = f"{ensure_checkpoint_dir(spark)}/{FOLDER}"
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())

    def new_path(self) -> str:
        """A path of its own, known before anything is written there (a failed write is dropped too)."""
        path = f"{self.folder}/{self.name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        self._files.deleteOnExit(self._path(path))
        return path

    def drop(self, spark: SparkSession) -> None:
        while self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {self.tables[-1]}")
            self.tables.pop()
        while self.paths:
            path = self._path(self.paths[-1])
            self._files.delete(path, True)
            self._files.cancelDeleteOnExit(path)
            self.paths.pop()

    def present(self) -> list[str]:
        folder = self._path(self.folder)
        return sorted(f.getPath().getName() for f in self._files.listStatus(folder)) if self._files.exists(folder) else []


_owners: list[tuple[weakref.ref, Owner]] = []


def own(spark: SparkSession, name: str) -> SparkSession:
    """A handle of ``spark`` (the same session: settings, views and catalog are shared) that owns the
    hand-offs of all that is read through it."""
    sweep(spark)
    handle = copy.copy(spark)
    setattr(handle, _ATTRIBUTE, Owner(spark, name))
    _owners.append((weakref.ref(handle), owner_of(handle)))
    return handle


@contextmanager
def owning(spark: SparkSession, name: str) -> Iterator[SparkSession]:
    """``own`` for work that ends here: its hand-offs are dropped at the end, also after an error."""
    handle = own(spark, name)
    try:
        yield handle
    finally:
        owner_of(handle).drop(spark)


def owner_of(spark: SparkSession) -> Owner:
    """The handle's owner; a session without one owns what is left until the JVM ends."""
    owner = getattr(spark, _ATTRIBUTE, None)
    if owner is None or owner.folder != f"{ensure_checkpoint_dir(spark)}/{FOLDER}":
        owner = Owner(spark, "session")
        setattr(spark, _ATTRIBUTE, owner)
    return owner


def beside(spark: SparkSession) -> SparkSession:
    """A fresh session whose hand-offs have the same owner.

    For jobs that observe counts: a session in which anything has been observed can no longer send
    its fitted models to tasks (they refer to the session by their training summary), so
    counts are observed in a session of their own.
    """
    fresh = fresh_session(spark)
    setattr(fresh, _ATTRIBUTE, owner_of(spark))
    return fresh


def sweep(spark: SparkSession, collect: bool = False) -> None:
    """Drop the hand-offs of owners to which nothing refers any more.  ``collect``: first look for
    reference cycles that keep some alive."""
    if collect:
        gc.collect()
    for entry in [e for e in _owners if e[0]() is None]:
        entry[1].drop(spark)
        _owners.remove(entry)


def left(spark: SparkSession) -> list[str]:
    """Names (owner first) of the hand-offs that are there now."""
    return owner_of(spark).present()


def hand_off(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The lineage ends at the files, as with ``checkpoint()``, but later scans
    read only the columns (and, with ``partition_by``, the folders) they need
    and the planner knows the true size.  The owner of ``df``'s session drops it.
    """
    spark = df.sparkSession
    path = owner_of(spark).new_path()
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*[f"`{c}`" for c in df.columns]) if partition_by else back
