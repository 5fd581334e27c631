"""Layers of a project as Parquet tables, and the listing of an image bank."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LAYERS

IMAGE_EXTENSIONS = ("tif", "jp2")


def read_layers(spark: SparkSession, root: str, epsg: int, names: tuple[str, ...] = tuple(LAYERS)) -> dict[str, DataFrame]:
    """The named layers below ``root``, with their fixed schemas.  Raises if a layer holds another CRS."""
    layers = {name: spark.read.schema(LAYERS[name]).parquet(current(spark, root, name)) for name in names}
    for name, df in layers.items():
        other = df.filter(F.col("epsg").isNull() | (F.col("epsg") != epsg)).select("epsg").limit(1).collect()
        if other:
            raise ValueError(f"layer {name} has epsg {other[0][0]}, the project {epsg}")
    return layers


def zone_names(pzones: DataFrame) -> DataFrame:
    return pzones.select("pz_name").distinct()


def list_bank(files: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, path_col: str = "filepath") -> DataFrame:
    """Rows of a listing whose extension is one of ``extensions``, in lower or upper case (mixed case isn't taken)."""
    either = "|".join(x for e in extensions for x in (e.lower(), e.upper()))
    return files.filter(F.col(path_col).rlike(rf"\.({either})$"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(filepath) of all files below ``root``; the contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("filepath"))


def _files(spark: SparkSession, root: str):
    """The file system of a folder, and how it names paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def manifests(spark: SparkSession, root: str, layer: str) -> list[tuple[int, str, int]]:
    """(number, version, time in ms) of all versions of a layer that were completed, oldest first."""
    fs, path = _files(spark, root)
    folder = path(f"{root}/{layer}/_manifest")
    if not fs.exists(folder):
        return []
    found = [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(folder)]
    return sorted((int(name.split("_")[0]), name.split("_")[1], at) for name, at in found)


def current(spark: SparkSession, root: str, layer: str) -> str:
    """The folder of a layer's current version; it stays readable for a time after it is replaced."""
    known = manifests(spark, root, layer)
    if not known:
        raise FileNotFoundError(f"{root} has no layer {layer}")
    return f"{root}/{layer}/{known[-1][1]}"


def read_layer(spark: SparkSession, root: str, layer: str) -> DataFrame:
    """A layer as it is now: later writes don't change what this reads."""
    return spark.read.parquet(current(spark, root, layer))


def write_layer(df: DataFrame, root: str, layer: str, cluster: tuple[str, ...] = (), folders: tuple[str, ...] = (), keep_seconds: float = 86_400) -> str:
    """Writes a new version of a layer and makes it the current one; returns its folder.

    A version is complete before it is named.  It is named by creating one
    empty file, whose name holds a number and the version: readers see the old
    version or the new one and never a part of either, whatever fails.  Of two
    writers at once the one with the higher name is current.  Versions that
    were replaced over ``keep_seconds`` ago are removed.

    Rows are sorted by ``folders`` and ``cluster`` and cut into files by
    their bytes, so files are few and each holds a narrow range; ``folders``
    are folders too.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    order = [*folders, *cluster]
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    (laid.write.partitionBy(*folders) if folders else laid.write).parquet(f"{root}/{layer}/{version}")
    fs, path = _files(spark, root)
    known = manifests(spark, root, layer)
    fs.create(path(f"{root}/{layer}/_manifest/{(known[-1][0] if known else 0) + 1:012d}_{version}"), False).close()
    clean_layer(spark, root, layer, keep_seconds)
    return f"{root}/{layer}/{version}"


def clean_layer(spark: SparkSession, root: str, layer: str, keep_seconds: float) -> int:
    """Removes the versions that were replaced over ``keep_seconds`` ago; returns how many."""
    fs, path = _files(spark, root)
    known, removed = manifests(spark, root, layer), 0
    for (number, version, _), (_, _, replaced) in zip(known, known[1:]):
        if time.time() * 1000 - replaced > keep_seconds * 1000:
            # the data last: a version without data is never named
            fs.delete(path(f"{root}/{layer}/_manifest/{number:012d}_{version}"), False)
            fs.delete(path(f"{root}/{layer}/{version}"), True)
            removed += 1
    return removed


def layer_exists(spark: SparkSession, root: str, layer: str) -> bool:
    return bool(manifests(spark, root, layer))


def bank_map_name(data_type: str, suffix: str) -> str:
    return f"extents-map_{data_type}_{suffix}"


def write_bank_map(features: DataFrame, root: str, data_type: str = "optical", suffix: str = "") -> str:
    return write_layer(features, root, bank_map_name(data_type, suffix))


def read_bank_map(spark: SparkSession, root: str, data_type: str = "optical", suffix: str = "") -> DataFrame | None:
    """The stored extents map, or None where there is none."""
    name = bank_map_name(data_type, suffix)
    return read_layer(spark, root, name) if layer_exists(spark, root, name) else None


def write_thumbs(thumbs: DataFrame, root: str) -> str:
    return write_layer(thumbs, root, "thumbs", ("th_pz_name", "th_path"))


def write_pairs(pairs: DataFrame, root: str) -> str:
    return write_layer(pairs, root, "pairs", ("pa_pz_name", "pa_key"))


def write_vectors(vectors: DataFrame, root: str, pixel_size: float) -> str:
    """Vector fields (pa_pz_name, pa_key, row, col, attributes): a folder for each zone, files sorted by pair; the layer's name is a column.

    A pair's rows lie in one file or a few that follow each other, and their
    row groups are found by the statistics of ``pa_key``.
    """
    named = vectors.withColumn("layer", F.concat(F.lit(f"{pixel_size:g}_"), "pa_key", F.lit("shift")))
    return write_layer(named, root, "vectors", ("pa_key", "row", "col"), ("pa_pz_name",))


def write_areas(areas: DataFrame, root: str, n_clusters: int, min_surface: float | None = None) -> str:
    """Polygonised areas; number of clusters and least surface are in the layer's name, kept as a column."""
    name = f"areas_N{n_clusters}" + (f"_min{min_surface:g}" if min_surface is not None else "")
    return write_layer(areas.withColumn("layer", F.lit(name)), root, name)
