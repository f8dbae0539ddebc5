"""Guarded, two-phase publishing of tables.

A table is a folder of parts and numbered manifests; readers see the parts that the last
manifest names, and nothing else. A run writes its rows as a new part, while Spark observes
the guards' measures in the same pass; if a guard fails the part goes, and no manifest is
written. A run that dies before its manifest leaves a part that nobody reads. So a target
changes as a whole, at the last step, or not at all, and the next run writes what is missing.

Beside the data stand ``_SUCCESS``, when all expected keys are there, or ``_MISSING``, which
names a folder of CSV files of those that are not.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators.relational import GuardError, missing_keys


@dataclass(frozen=True)
class Guard:
    """A measure of the rows that are written, and when it is well; one that is not
    ``fatal`` warns and lets the rows pass."""

    name: str
    measure: Column
    holds: Callable[[object], bool]
    fatal: bool = True


def rows_at_least(n: int) -> Guard:
    return Guard("rows", F.count(F.lit(1)), lambda x: x >= n)


def none_where(name: str, bad: Column) -> Guard:
    """No row may be ``bad``; a null is not."""
    return Guard(name, F.count_if(bad), lambda x: x == 0)


def share_at_least(name: str, good: Column, least: float) -> Guard:
    """The share of ``good`` rows; no rows have no share, and pass."""
    return Guard(name, F.avg(F.coalesce(good, F.lit(False)).cast("double")), lambda x: x is None or x >= least)


def few_empty(name: str, lists: list[Column], most: float = 0.0, fatal: bool = False) -> Guard:
    """The share of rows of which any of the lists is null or empty, as lineups at ingest
    are; more than ``most`` is worth a warning."""
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.size(x), F.lit(0)) <= 0 for x in lists])
    return Guard(name, F.avg(empty.cast("double")), lambda x: x is None or x <= most, fatal)


def spread(name: str, value: Column) -> Guard:
    """A predictor must not be one value only."""
    return Guard(name, F.stddev_pop(value), lambda x: x is None or x > 0)


def observed(df: DataFrame, guards: list[Guard], act: Callable[[DataFrame], None]) -> dict[str, object]:
    """Runs ``act`` on ``df`` and gives the guards' measures of the rows that it read, in
    that same pass; raises if one of them does not hold."""
    if not guards:
        act(df)
        return {}
    watch = Observation()
    act(df.observe(watch, *[g.measure.alias(g.name) for g in guards]))
    found = watch.get
    failed = [g for g in guards if not g.holds(found[g.name])]
    if fatal := {g.name: found[g.name] for g in failed if g.fatal}:
        raise GuardError(f"guards do not hold: {fatal}")
    for g in failed:
        warnings.warn(f"guard {g.name}: {found[g.name]}", stacklevel=2)
    return found


class Folder:
    """Small files in a folder of any store that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.at(name))] if self.files.exists(self.at(name)) else []

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> None:
        """Writes a file whole or not at all; another run that made it first is an error."""
        draft = f"_draft-{uuid.uuid4().hex}"
        self.write(draft, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(self.at(draft)), context.makeQualified(self.at(name)), none)
        except Exception as e:
            self.delete(draft)
            raise GuardError(f"{name} was published by another run") from e


def _manifests(folder: Folder) -> list[str]:
    return sorted(n for n in folder.names() if n.startswith("manifest-"))


def manifest(spark: SparkSession, path: str) -> dict:
    """What the last published manifest says; nothing yet has no parts."""
    folder = Folder(spark, path)
    found = _manifests(folder)
    return json.loads(folder.read(found[-1])) if found else {"parts": [], "complete": None, "missing": None}


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the published parts; None before the first."""
    parts = [spark.read.parquet(f"{path.rstrip('/')}/parts/{p}") for p in manifest(spark, path)["parts"]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def publish(df: DataFrame, path: str, guards: list[Guard] | None = None, replace: bool = True) -> dict:
    """Publishes ``df`` beside what is there, or in its place; gives the guards' measures."""
    return _publish(df, path, guards or [], replace, None, [])


def publish_missing(df: DataFrame, path: str, keys: list[str], expected: DataFrame, guards: list[Guard] | None = None) -> dict:
    """Publishes the rows of ``df`` whose keys are expected and not there yet, and says
    whether all expected keys are there now. Gives the guards' measures."""
    present = read_published(df.sparkSession, path)
    wanted = expected.select(*keys).distinct()
    new = df.join(wanted, keys, "left_semi")
    if present is not None:
        new = new.join(present.select(*keys).distinct(), keys, "left_anti")
    return _publish(new, path, guards or [], False, wanted, keys)


def _publish(df: DataFrame, path: str, guards: list[Guard], replace: bool, expected: DataFrame | None, keys: list[str]) -> dict:
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    before, number = manifest(spark, path), len(_manifests(folder))
    part = uuid.uuid4().hex
    try:
        found = observed(df, guards, lambda rows: rows.write.parquet(f"{folder.path}/parts/{part}"))
        after = {"parts": ([] if replace else before["parts"]) + [part], "complete": None, "missing": None}
        if expected is not None:
            rows = [spark.read.parquet(f"{folder.path}/parts/{p}").select(*keys) for p in after["parts"]]
            gone = missing_keys(expected, reduce(DataFrame.unionByName, rows), keys)
            gone.write.option("header", True).csv(f"{folder.path}/missing/{part}")
            after["missing"] = spark.read.option("header", True).csv(f"{folder.path}/missing/{part}").count()
            after["complete"] = after["missing"] == 0
        folder.create_once(f"manifest-{number:09d}", json.dumps(after))
    except Exception:
        folder.delete(f"parts/{part}")
        folder.delete(f"missing/{part}")
        raise
    if expected is not None:  # marks for readers that know no manifests
        folder.delete("_MISSING" if after["complete"] else "_SUCCESS")
        folder.write("_SUCCESS" if after["complete"] else "_MISSING", "" if after["complete"] else f"missing/{part}\n")
    return found


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes parts that the last manifest does not name: of dead runs, and replaced ones.
    For a time when nobody writes or reads. Gives their number."""
    folder, known = Folder(spark, path), set(manifest(spark, path)["parts"])
    old = [p for p in folder.names("parts") if p not in known]
    for p in old:
        folder.delete(f"parts/{p}")
    return len(old)
