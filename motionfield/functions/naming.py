"""Names of thumbs and pairs, sensors and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted thumb names and the sensors looked for.
THUMB_NAME = r"^([a-z]|[A-Z]|-|[0-9])+_[0-9]{4}(-[0-9]{2}){2}_.*.(tif|TIF)$"
SENSORS = "spot6|SPOT6|spot7|SPOT7|aerial|AERIAL"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column, up: int = 1) -> Column:
    """The path without its last ``up`` parts."""
    return F.regexp_replace(path, rf"(/[^/]*){{{up}}}$", "")


def thumb_parts(path: Column) -> Column:
    """struct<key, pz_name, date, sensor, year> of a thumb's path, null where its name isn't one."""
    name = file_name(path)
    key = F.split(name, "[.]")[0]
    parts = F.split(key, "_")
    good = name.rlike(THUMB_NAME) & (F.size(parts) == 3)
    year = F.split(F.get(parts, 1), "-")[0]
    return F.when(good, F.struct(key.alias("key"), F.get(parts, 0).alias("pz_name"), F.get(parts, 1).alias("date"), F.get(parts, 2).alias("sensor"), year.try_cast("int").alias("year")))


def pair_key(pz: Column, ldate: Column, lsensor: Column, rdate: Column, rsensor: Column) -> Column:
    return F.concat(pz, F.lit("_"), ldate, F.lit("-"), lsensor, F.lit("_"), rdate, F.lit("-"), rsensor)


def pair_paths(thumb_path: Column, key: Column) -> Column:
    """struct of the folder and files of a pair, beside its left thumb's folder."""
    base = F.concat(folder(thumb_path, 2), F.lit("/displacements/"), key)
    at = lambda tail: F.concat(base, F.lit("/"), tail)
    return F.struct(
        base.alias("path"), at(F.concat(F.lit("asp_outputs/"), key, F.lit("_run-F.tif"))).alias("dispf"), at(F.concat(F.lit("asp_outputs/"), key, F.lit("_corr-eval-ncc.tif"))).alias("snr"),
        at(F.concat(key, F.lit("_magn.tif"))).alias("magn"), at(F.concat(key, F.lit("_vect.gpkg"))).alias("vect"),
    )


def parse_pair(path: Column) -> Column:
    """The inverse: struct of zone, dates, sensors and thumb keys; null unless the parent folder is ``displacements``."""
    parts = F.split(path, "/")
    key = F.element_at(parts, -1)
    inside = (F.size(parts) >= 2) & (F.lower(F.get(parts, F.size(parts) - 2)) == "displacements")
    three = F.split(key, "_")
    left, right = F.split(F.get(three, 1), "-"), F.split(F.get(three, 2), "-")
    good = inside & (F.size(three) == 3) & (F.size(left) == 4) & (F.size(right) == 4)
    date = lambda side: F.concat_ws("-", F.slice(side, 1, 3))
    pz = F.get(three, 0)
    thumb = lambda side: F.concat(pz, F.lit("_"), date(side), F.lit("_"), F.get(side, 3))
    return F.when(good, F.struct(
        pz.alias("pz_name"), date(left).alias("left_date"), F.get(left, 3).alias("left_sensor"), date(right).alias("right_date"),
        F.get(right, 3).alias("right_sensor"), thumb(left).alias("left_key"), thumb(right).alias("right_key"),
    ))


def extract_sensor(path: Column, data_type: str = "optical") -> Column:
    """The first sensor named anywhere in the path, else 'unknown'; 'dem' for elevation banks."""
    if data_type == "dem":
        return F.lit("dem")
    found = F.regexp_extract(path, f"({SENSORS})", 1)
    return F.when(found == "", "unknown").otherwise(found)


def acquisition(path: Column, xml: Column, data_type: str = "optical") -> Column:
    """struct<sensor, acq_date, listed>; later rules overwrite earlier ones.

    ``listed`` is false for satellite images without metadata, which are left
    out.  No rule: no date.
    """
    name, sensor = file_name(path), extract_sensor(path, data_type)
    if data_type == "dem":
        return F.struct(sensor.alias("sensor"), F.get(F.split(name, "_"), 1).alias("acq_date"), F.lit(True).alias("listed"))
    second = F.get(F.split(name, "-"), 1)
    aerial = F.concat(F.substring(second, 1, 4), F.lit("-"), F.substring(second, 5, 2), F.lit("-"), F.substr(second, F.lit(7)))
    is_aerial, is_spot = F.lower(sensor) == "aerial", F.lower(sensor).isin("spot6", "spot7")
    told = F.regexp_extract(xml, r"<IMAGING_DATE>([^<]*)</IMAGING_DATE>", 1)
    date = F.when(is_aerial, aerial).when(is_spot, F.when(told != "", told))
    swiss = F.contains(name, F.lit("swissimage"))
    date = F.when(swiss, F.concat(F.get(F.split(name, "_"), 1), F.lit("-01-01"))).otherwise(date)
    return F.struct(F.when(swiss, "aerial").otherwise(sensor).alias("sensor"), date.alias("acq_date"), (~is_spot | xml.isNotNull()).alias("listed"))
