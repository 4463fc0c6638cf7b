"""Tables in versions: each publish writes a version of its own and a manifest, and one atomic rename moves a pointer to it.

A reader that asks for the current version reads the pointer once and keeps to that version, so it never sees half a
publish; a failure before the rename leaves the old version in place. Rolling back moves the pointer, nothing is rewritten.
Folders: root/versions/<id>/data, manifest and about (the parent's id), and the file root/CURRENT with an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.publishing import ScopeError, replace_scope
from loomstone.sources import sinks
from loomstone.sources.tables import filesystem

POINTER = "CURRENT"


class BrokenVersion(RuntimeError):
    """A version's rows are not what its manifest says."""


def _read_text(spark: SparkSession, name: str) -> str | None:
    path, fs = filesystem(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def _write_text(spark: SparkSession, name: str, text: str) -> None:
    path, fs = filesystem(spark, name)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Move the pointer: a new file renamed over the old one, which file systems do at once."""
    aside = f"{root}/.{uuid.uuid4().hex}"
    _write_text(spark, aside, version)
    jvm, fs_package = spark._jvm, spark._jvm.org.apache.hadoop.fs
    source, target = fs_package.Path(aside), fs_package.Path(f"{root}/{POINTER}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where = source.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(source)
    fs_package.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(where, target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target), options)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names, or None."""
    return _read_text(spark, f"{root}/{POINTER}")


def parent(spark: SparkSession, root: str, version: str) -> str | None:
    return _read_text(spark, f"{root}/versions/{version}/about") or None


def read(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A version's rows, the current one's if none is named. The frame keeps to it, whatever is published later."""
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/versions/{version}/data")


def publish(df: DataFrame, root: str, by: Sequence[str] = ()) -> str:
    """Write df as a new version with its manifest (rows and checksum by the columns by), then move the pointer. The version's id."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/versions/{version}"
    df.write.parquet(f"{path}/data")
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    sinks.manifest(written, df.columns, by).write.parquet(f"{path}/manifest")
    _write_text(spark, f"{path}/about", current(spark, root) or "")
    _point(spark, root, version)
    return version


def verify(spark: SparkSession, root: str, version: str, by: Sequence[str] = ()) -> None:
    """Raise BrokenVersion unless a version's rows and checksums are as its manifest says."""
    rows = read(spark, root, version)
    said = spark.read.parquet(f"{root}/versions/{version}/manifest")
    there = sinks.manifest(rows, rows.columns, by).select(said.columns)
    if not said.exceptAll(there).unionByName(there.exceptAll(said)).isEmpty():
        raise BrokenVersion(version)


def publish_scope(root: str, new: DataFrame, scope: Column, by: Sequence[str] = ()) -> str:
    """A new version with new in place of the current rows of the scope. Rows and contents outside it are verified before the pointer moves."""
    spark = new.sparkSession
    inside = F.coalesce(scope, F.lit(False))
    if not new.where(~inside).isEmpty():
        raise ScopeError("new rows lie outside the scope")
    before = read(spark, root)
    out = replace_scope(before, new.select(*before.columns), scope)
    a, b = (sinks.manifest(d.where(~inside), before.columns).first() for d in (before, out))
    if a != b:
        raise ScopeError(f"outside the scope {a['n']} rows before, {b['n']} after, or other contents")
    return publish(out, root, by)


def rollback(spark: SparkSession, root: str, version: str | None = None, by: Sequence[str] = ()) -> str:
    """Point to a version again, the parent of the current one if none is named, once its manifest holds. Its id."""
    version = version or parent(spark, root, current(spark, root) or "")
    if not version:
        raise FileNotFoundError("there is no version before this one")
    verify(spark, root, version, by)
    _point(spark, root, version)
    return version


def sync(df: DataFrame, root: str, by: Sequence[str] = ()) -> str:
    """'unchanged' if the current version has the same rows (as often, in any order) by its manifest, else 'replaced', and df is published."""
    spark, now = df.sparkSession, current(df.sparkSession, root)
    if now:
        said = spark.read.parquet(f"{root}/versions/{now}/manifest")
        there = sinks.manifest(df, df.columns, by).select(said.columns)
        same_columns = sorted(read(spark, root, now).dtypes) == sorted(df.dtypes)
        if same_columns and said.exceptAll(there).unionByName(there.exceptAll(said)).isEmpty():
            return "unchanged"
    publish(df, root, by)
    return "replaced"


def remove_before(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove all versions but the current one and its keep forebears; the ids that went. Versions that no pointer ever named go, too."""
    stay, v = [], current(spark, root)
    while v and len(stay) <= keep:
        stay.append(v)
        v = parent(spark, root, v)
    path, fs = filesystem(spark, f"{root}/versions")
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in stay]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
