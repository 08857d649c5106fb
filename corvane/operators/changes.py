"""Manifest differences and replacement of changed files: joins of tables, for any storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_detection(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """current (file_path, mod_time, size) with status: new, modified or same. A file is the same only if its time and its size both are."""
    old = manifest.select("file_path", F.col("mod_time").alias("old_time"), F.col("size").alias("old_size"), F.lit(True).alias("known"))
    same = F.col("mod_time").eqNullSafe(F.col("old_time")) & F.col("size").eqNullSafe(F.col("old_size"))
    status = F.when(F.col("known").isNull(), "new").when(same, "same").otherwise("modified")
    return current.join(old, "file_path", "left").select("file_path", "mod_time", "size", status.alias("status"))


def deleted_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path) of the manifest's files that are gone."""
    return manifest.select("file_path").join(current.select("file_path"), "file_path", "left_anti")


def next_manifest(current: DataFrame, manifest: DataFrame, failed: DataFrame) -> DataFrame:
    """The manifest after a run: what is there now, but a failed file (file_path) keeps its old entry, or has none."""
    kept = manifest.join(failed.select("file_path"), "file_path", "left_semi").join(current.select("file_path"), "file_path", "left_semi")
    fresh = current.select("file_path", "mod_time", "size").join(failed.select("file_path"), "file_path", "left_anti")
    return fresh.unionByName(kept.select("file_path", "mod_time", "size"))


def delete_by_key(index: DataFrame, keys: DataFrame, key: str = "file_path") -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti").select(*index.columns)


def replace_by_file(index: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """index without the rows of touched files (file_path), and with the fresh rows."""
    return delete_by_key(index, touched).unionByName(fresh.select(*index.columns))
