"""Stage tables: Parquet folders with a manifest, and lineage cuts between stages.

Annotation builds join a table with what was derived from it many times over; each stage is therefore written and read
back, so that the next one plans from a scan.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the checkpoints that this process has made and not deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; on one machine, where it names none, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="isoframe-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lineage ends there, and a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    where = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        out._checkpoint = where.get()
        _made.append(out._checkpoint)
    return out


def discard(df: DataFrame) -> None:
    """Delete what settle() wrote for df, which nothing reads any more."""
    path = getattr(df, "_checkpoint", None)
    if path in _made:
        _made.remove(path)
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside are deleted at the end: for steps whose results are written or collected by then."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            delete(spark, path)
        del _made[start:]


class Store:
    """Named tables under one folder; a manifest row names each finished one, with paths relative to the folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, *names: str) -> bool:
        """Whether all the tables named are finished."""
        found = [self._fs(f"{name}/_SUCCESS") for name in names]
        return all(bool(fs.exists(p)) for fs, p in found)

    def names(self) -> list[str]:
        fs, p = self._fs("")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if self.has(x.getPath().getName())) if fs.exists(p) else []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, overwrite: bool = False, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
        """The table, written unless it is there already and not to be overwritten.

        order sorts within files, so that row-group statistics prune region reads.
        """
        if overwrite or not self.has(name):
            rows = df.sortWithinPartitions(*order) if order else df
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}")
        return self.read(name)

    def describe(self) -> str:
        """Each table's columns, as JSON."""
        return json.dumps({n: self.read(n).dtypes for n in self.names()})

    # A manifest names the version, and for each table its place (relative to the folder, or absolute where it lies elsewhere), its
    # columns and its number of files, so that a folder can be moved as a whole and is checked when it is opened.

    def _path(self, place: str) -> str:
        return place if "://" in place or place.startswith("/") else f"{self.path}/{place}"

    def _files(self, place: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(place))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return 0
        found, n = fs.listFiles(p, True), 0
        while found.hasNext():
            n += found.next().getPath().getName().startswith("part-")
        return n

    def write_manifest(self, version: int, places: dict[str, str] | None = None) -> dict:
        """The manifest of all finished tables, and of those in `places`, which lie elsewhere."""
        at = {n: n for n in self.names()} | (places or {})
        found = {n: {"path": p, "columns": [list(c) for c in self.spark.read.parquet(self._path(p)).dtypes], "files": self._files(p)} for n, p in sorted(at.items())}
        manifest = {"version": version, "tables": found}
        fs, p = self._fs("manifest.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        return manifest

    def manifest(self) -> dict | None:
        """The manifest, if there is one."""
        fs, p = self._fs("manifest.json")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])

    def check(self, version: int, migrations: dict[int, Callable[[Store], None]] | None = None) -> dict[str, DataFrame]:
        """The tables of the manifest, brought to a version and checked.

        migrations: version to a step that brings it to the next one; the manifest is written anew after each. Raised are a missing
        manifest, a version without a step, one that is newer, and all tables at once that are gone, lack files or have other columns.
        """
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"{self.path} has no manifest")
        while now["version"] < version:
            step = (migrations or {}).get(now["version"])
            if step is None:
                raise ValueError(f"no step from version {now['version']} of {self.path}")
            step(self)
            elsewhere = {n: t["path"] for n, t in now["tables"].items() if t["path"] != n}
            now = self.write_manifest(now["version"] + 1, elsewhere)
        if now["version"] > version:
            raise ValueError(f"{self.path} is of version {now['version']}, newer than {version}")
        wrong, out = [], {}
        for n, t in now["tables"].items():
            files = self._files(t["path"])
            if files < t["files"]:
                wrong.append(f"{n}: {files} of {t['files']} files")
                continue
            out[n] = self.spark.read.parquet(self._path(t["path"]))
            if [list(c) for c in out[n].dtypes] != t["columns"]:
                wrong.append(f"{n}: other columns")
        if wrong:
            raise ValueError(f"{self.path}: " + "; ".join(wrong))
        return out
