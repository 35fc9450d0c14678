"""Which folders make up a store: a log of versions, each one file that names the run every published day comes from.

Runs write below ``v=RUN`` folders that nobody looks at until a version names them, so whatever a job leaves behind when it dies,
readers see the days of the last version, all streams and manifests alike, or all days of the next one. A version is written aside
and renamed to its number, which fails if another writer took the number: that writer's days are then read and, unless they are
the same days, kept in the next number. Days that no version names are those in plain folders.

The rename must be atomic and refuse to replace, as on HDFS and local disks.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.session import qualified, small_frame

_NUMBER = 20


class SnapshotConflict(RuntimeError):
    """Another writer published one of the days meanwhile."""


@dataclass(frozen=True)
class Snapshot:
    """The run of every published day, as of a version; version 0 is a store without a log."""

    version: int
    runs: dict[dt.date, str]

    def plus(self, days: list[dt.date], run: str) -> Snapshot:
        return Snapshot(self.version, self.runs | dict.fromkeys(days, run))


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(log_folder(spark, root))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def log_folder(spark: SparkSession, root: str) -> str:
    """Where the versions of a store are, a JSON file each, named by its number."""
    return f"{qualified(spark, root).rstrip('/')}/_versions"


def versions(spark: SparkSession, root: str) -> list[int]:
    """All versions there are, ascending."""
    files, folder = _folder(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """A version of the store, the last one by default."""
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return Snapshot(0, {})
    if version not in known:
        raise ValueError(f"no version {version} of {root}")
    return Snapshot(version, {dt.date.fromisoformat(d): run for d, run in _content(spark, root, version)["runs"].items()})


def _content(spark: SparkSession, root: str, version: int) -> dict:
    files, folder = _folder(spark, root)
    stream = files.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{version:0{_NUMBER}d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def contents(spark: SparkSession, root: str) -> list[dict]:
    """What every version of a log says, in order."""
    return [_content(spark, root, v) for v in versions(spark, root)]


def commit(spark: SparkSession, root: str, days: list[dt.date], run: str, base: Snapshot) -> Snapshot:
    """Publish the days of a run that began at ``base``: one rename. Days others published meanwhile stay, or raise if the same."""
    while True:
        now = snapshot(spark, root)
        taken = sorted(str(d) for d in days if now.runs.get(d) != base.runs.get(d))
        if taken:
            raise SnapshotConflict(f"published by another writer meanwhile: {', '.join(taken)}")
        runs = now.plus(days, run).runs
        if claim(spark, root, now.version + 1, {"runs": {str(d): runs[d] for d in sorted(runs)}}):
            return Snapshot(now.version + 1, runs)


def claim(spark: SparkSession, root: str, version: int, content: dict) -> bool:
    """Whether the version could be written: not if its number is taken."""
    jvm = spark.sparkContext._jvm
    files, folder = _folder(spark, root)
    files.mkdirs(folder)
    aside = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.tmp")
    stream = files.create(aside, False)
    stream.write(json.dumps(content, indent=1).encode())
    stream.close()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(folder, f"{version:0{_NUMBER}d}.json"), none)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        files.delete(aside, False)
        return False
    return True


def visible(files: DataFrame, at: Snapshot) -> DataFrame:
    """The rows (day, rel, ...) of files that belong to a snapshot: those of a day's run, or of no run where the day has none."""
    run = F.regexp_extract("rel", r"(?:^|/)v=([^/]+)/", 1)
    if not at.runs:
        return files.filter(run == "")
    named = small_frame(files.sparkSession, list(at.runs.items()), "__day date, __run string")
    rows = files.join(named, F.col("day") == F.col("__day"), "left")
    return rows.filter(run == F.coalesce("__run", F.lit(""))).drop("__day", "__run")


def vacuum(spark: SparkSession, root: str, parts: tuple[str, ...], keep: int = 1, older_than: dt.timedelta = dt.timedelta(days=1)) -> list[str]:
    """Remove runs that the last ``keep`` versions do not name and that have not changed for a while, and older versions.

    Readers of removed versions fail from then on; jobs that take longer than ``older_than`` must not be running.
    """
    known = versions(spark, root)
    kept = {run for v in known[-keep:] for run in snapshot(spark, root, v).runs.values()}
    files, folder = _folder(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    before = (dt.datetime.now() - older_than).timestamp() * 1000
    gone = []
    for part in parts:
        top = path(folder.getParent(), part)
        for status in files.listStatus(top) if files.exists(top) else ():
            name = status.getPath().getName()
            if name.startswith("v=") and name.removeprefix("v=") not in kept and status.getModificationTime() < before:
                files.delete(status.getPath(), True)
                gone.append(f"{part}/{name}")
    for v in known[:-keep]:
        files.delete(path(folder, f"{v:0{_NUMBER}d}.json"), False)
    return sorted(gone)
