"""Readers and writers: incident CSV, weather and station JSON, keyed objects,
versioned tables, feature collections."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.clean import RAW_SCHEMA
from ..session import work_tables

US_TIMESTAMP = "MM/dd/yyyy hh:mm:ss a"


def file_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a CSV folder by their header: names -> paths, in the order of the paths.

    One job reads the first line of every file; names and paths of files come to the driver, no data.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # a file's first block is read by one task from its start, so its first row is the header
    first = lines.filter("block = 0").groupBy("file").agg(F.first("value").alias("header"))
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '^\ufeff|^"|"$', "")))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first.select("file", names.alias("names")).orderBy("file").collect():
        out.setdefault(tuple(r["names"]), []).append(unquote(r["file"]))
    return out


def _scan(spark: SparkSession, header: tuple[str, ...], paths: list[str], **options: str) -> DataFrame:
    """Text columns of files that share a header; an extra last column holds rows that do not fit it, if asked for."""
    fields = [StructField(c, StringType()) for c in header]
    if corrupt := options.get("columnNameOfCorruptRecord"):
        fields.append(StructField(corrupt, StringType()))
    # enforceSchema off: Spark compares the header of every file with the schema
    return spark.read.schema(StructType(fields)).options(header=True, enforceSchema=False, columnPruning=False, **options).csv(paths)


def read_incident_csv(spark: SparkSession, path: str, timestamp_format: str | None = None) -> DataFrame:
    """Header CSV with all columns as text, found by their names: files may hold more of them, in any order.

    Files of one folder may have different headers: each header is one scan, and the scans are united by name. Missing
    columns raise an error, malformed rows are dropped (:func:`malformed_rows` counts them), and timestamps that are
    neither ISO nor in US form (nor in ``timestamp_format``, if given) become NULL and fall to the quality filter.
    """
    wanted = StructType.fromDDL(RAW_SCHEMA).names if isinstance(RAW_SCHEMA, str) else RAW_SCHEMA.names
    headers = file_headers(spark, path)
    for header, paths in headers.items():
        if missing := [c for c in wanted if c not in header]:
            raise ValueError(f"columns missing in {paths[0]}: {', '.join(missing)}")
    if not headers:
        raise ValueError(f"no file with a header in {path}")
    scans = [_scan(spark, header, paths, mode="DROPMALFORMED").select(*wanted) for header, paths in headers.items()]
    df = reduce(DataFrame.unionByName, scans)
    forms = [F.lit(timestamp_format)] if timestamp_format else [None, F.lit(US_TIMESTAMP)]
    parsed = F.coalesce(*[F.try_to_timestamp(F.col("INCIDENT_DATETIME"), *([f] if f is not None else [])) for f in forms])
    return df.withColumn("INCIDENT_DATETIME", parsed.cast("timestamp_ntz"))


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, malformed, filled) of every CSV file: rows below the header, those that do not fit it, fields with a value."""
    marked = [
        _scan(spark, header, paths, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed").select(
            F.col("_metadata.file_path").alias("file"), F.size(F.array_compact(F.array(*[F.col(f"`{c}`") for c in header]))).alias("filled"), "_malformed"
        )
        for header, paths in file_headers(spark, path).items()
    ]
    return reduce(DataFrame.unionByName, marked).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_malformed").alias("malformed"), F.sum("filled").alias("filled")
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class VersionedTable:
    """A table that is replaced as a whole while readers keep a consistent view.

    Every version is a new folder; an append-only log names the current one, so
    the data being read is never the data being written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = f"{self.path}/log"

    def _entries(self) -> DataFrame:
        return self.spark.read.schema("seq long, version string").json(self.log)

    def current(self) -> str:
        row = self._entries().agg(F.max(F.struct("seq", "version")).alias("m")).first()
        return f"{self.path}/{row['m']['version']}"

    def read(self, columns: list[str] | None = None) -> DataFrame:
        return read_table(self.spark, self.current(), columns)

    def _claim(self) -> int:
        """A version number of one's own: the file that stands for it can be created once only."""
        last = (self._entries().agg(F.max("seq")).first()[0] or 0) if _exists(self.spark, self.log) else 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        while not fs.createNewFile(path(f"{self.path}/claims/{last + 1}")):
            last += 1
        return last + 1

    def replace(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        write_table(df, f"{self.path}/{version}", partition_by)
        entry = self.spark.range(1).select(F.lit(self._claim()).cast("long").alias("seq"), F.lit(version).alias("version"))
        entry.coalesce(1).write.mode("append").json(self.log)
        return self.read()


WEATHER_COLUMNS = ["time", "temperature_2m", "precipitation", "windspeed_10m", "weathercode"]
WEATHER_PAYLOAD = (
    "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>, "
    "windspeed_10m: array<double>, weathercode: array<int>>"
)


def read_weather_payload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Column-oriented hourly JSON documents to one row per hour.

    ``multi_line`` for one document per file, otherwise one document per line.
    """
    return hourly_rows(spark.read.schema(WEATHER_PAYLOAD).option("multiLine", multi_line).json(path))


def hourly_rows(payload: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in WEATHER_COLUMNS])
    rows = payload.select(F.explode(zipped).alias("r")).select("r.*")
    hour = F.try_to_timestamp(F.col("time")).cast("timestamp_ntz")
    return rows.withColumn("time", hour).withColumnRenamed("time", "date_hour")


STATION_SCHEMA = (
    "station_id string, name string, borough string, address string, lat double, lon double, dispatch_zone string"
)


def read_stations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of stations, or with ``multi_line=False`` one station per line."""
    return spark.read.schema(STATION_SCHEMA).option("multiLine", multi_line).json(path)


def read_keyed_object(spark: SparkSession, path: str, value_type: str, key: str = "zone") -> DataFrame:
    """One JSON object per file, keyed by zone, to one row per key."""
    text = spark.read.text(path, wholetext=True)
    return keyed_rows(text.select("value"), "value", value_type, key)


def keyed_rows(df: DataFrame, column: str, value_type: str, key: str = "zone") -> DataFrame:
    entries = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(F.explode(entries).alias(key, "v")).select(key, "v.*")


# ---- headers ----------------------------------------------------------------

def normalised(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalised(c) for c in df.columns])


def discover(df: DataFrame, *alternatives: tuple[str, ...]) -> str | None:
    """First column whose name contains every word of one alternative."""
    return next((c for c in df.columns if any(all(w in c for w in words) for words in alternatives)), None)


def event_columns(df: DataFrame) -> dict[str, str | None]:
    return {
        "start": discover(df, ("start", "date")),
        "end": discover(df, ("end", "date")),
        "kind": discover(df, ("type",)),
        "borough": discover(df, ("borough",)),
    }


def transit_columns(df: DataFrame) -> dict[str, str | None]:
    return {
        "month": discover(df, ("month",), ("period",)),
        "count": discover(df, ("count",), ("incident",), ("total",)),
    }


# ---- feature collections ----------------------------------------------------

def feature(geometry: Column, *properties) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")
    )


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def ring_geometry(ring: Column) -> Column:
    coords = F.array(F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))))
    return F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))


def feature_collection(df: DataFrame, keys: list[str], order: Column, item: Column, *head: Column) -> DataFrame:
    """One document per key. Keys name scenarios, whose features are bounded by
    zones or units, so no group grows with the facts."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("f")))), lambda x: x["f"])
    grouped = df.groupBy(*keys).agg(items.alias("features"))
    doc = F.struct(F.lit("FeatureCollection").alias("type"), *head, F.col("features"))
    return grouped.select(*keys, F.to_json(doc).alias("document"))


def write_documents(df: DataFrame, path: str) -> None:
    df.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert or update by key; the newer row wins as a whole."""
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(*current.columns))


def upsert_partitions(spark: SparkSession, path: str, changes: DataFrame, key: str, partition: str) -> None:
    """:func:`upsert` into a Parquet table partitioned by ``partition``, rewriting only partitions that change.

    Touched are the partitions of the changes and those that still hold a changed key under another partition value; only
    they are read, and Spark's dynamic overwrite replaces only them. The new rows are written apart first, since a
    table cannot be overwritten by what is read from it. The last of several changes to one key is not defined: pass one.
    A partition that loses all its rows keeps none. A table that does not exist yet is written as it comes.
    """
    if not _exists(spark, path):
        changes.write.partitionBy(partition).parquet(path)
        return
    current = spark.read.parquet(path)
    with work_tables(spark) as write:
        changes = write(changes.select(*current.columns))
        old = current.join(changes.select(key), key, "left_semi").select(partition)
        touched = write(changes.select(partition).union(old).distinct())
        rows = current.join(F.broadcast(touched), partition, "left_semi").select(*current.columns)
        merged = write(upsert(rows, changes, key))
        merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        # dynamic overwrite leaves alone what gets no rows
        emptied = touched.join(merged.select(partition).distinct(), partition, "left_anti")
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        left = spark.read.parquet(path).select(partition, folder.alias("folder")).join(F.broadcast(emptied), partition, "left_semi")
        for r in left.select("folder").distinct().collect():
            gone = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"]))
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
