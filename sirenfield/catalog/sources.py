"""Scans, sources and sinks (S1-S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.geo import degree_buffer_ring, ring_wkt
from ..operators import enrich, scenarios
from ..session import shared_dir
from ..sources import files
from . import query


@query(
    "s01_csv_scan",
    """SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA, BOROUGH, INCIDENT_RESPONSE_SECONDS_QY AS response,
       strftime(INCIDENT_DATETIME, '%Y-%m-%d %H:%M:%S.%f') AS incident_dt FROM x_raw""",
)
def csv_scan(t):
    path = shared_dir(t.spark)
    text = [F.col(c).cast("string").alias(c) for c in t.raw.columns]
    t.raw.select(*text).write.option("header", True).csv(path)
    df = files.read_incident_csv(t.spark, path)
    return df.select(
        "CAD_INCIDENT_ID", "INCIDENT_DISPATCH_AREA", "BOROUGH",
        F.col("INCIDENT_RESPONSE_SECONDS_QY").alias("response"),
        F.date_format("INCIDENT_DATETIME", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("incident_dt"),
    )


@query("s02_parquet_scan", "SELECT event_id, event_type, value FROM events")
def parquet_scan(t):
    return files.read_table(t.spark, f"{t.sf_dir}/events.parquet", ["event_id", "event_type", "value"])


@query(
    "s03_parquet_sink",
    """SELECT split, INCIDENT_DISPATCH_AREA AS zone, count(*) AS n, round(sum(INCIDENT_RESPONSE_SECONDS_QY), 2) AS seconds
       FROM x_clean GROUP BY ALL""",
)
def parquet_sink(t):
    path = shared_dir(t.spark)
    files.write_table(t.cleaned, path, ("split",))
    return (
        files.read_table(t.spark, path)
        .groupBy("split", F.col("INCIDENT_DISPATCH_AREA").alias("zone"))
        .agg(F.count("*").alias("n"), F.round(F.sum("INCIDENT_RESPONSE_SECONDS_QY"), 2).alias("seconds"))
    )


@query(
    "s04_replace_table",
    "SELECT INCIDENT_DISPATCH_AREA AS zone, count(*) AS n, round(avg(svi_score), 4) AS svi FROM x_clean_svi GROUP BY ALL",
)
def replace_table(t):
    table = files.VersionedTable(t.spark, shared_dir(t.spark))
    first = table.replace(t.cleaned)
    current = table.replace(enrich.join_vulnerability(first))
    return current.groupBy(F.col("INCIDENT_DISPATCH_AREA").alias("zone")).agg(
        F.count("*").alias("n"), F.round(F.avg("svi_score"), 4).alias("svi")
    )


@query(
    "s05_weather_payload",
    """SELECT strftime(date_hour, '%Y-%m-%d %H:%M:%S') AS date_hour, round(temperature_2m, 4) AS temperature_2m,
       precipitation, windspeed_10m, weathercode FROM x_weather_raw""",
)
def weather_payload(t):
    """Hours to column-oriented documents (one per day, 24 hours each) and back."""
    hour = F.struct(
        F.date_format("date_hour", "yyyy-MM-dd'T'HH:mm").alias("time"), "temperature_2m", "precipitation",
        "windspeed_10m", "weathercode",
    )
    days = t.weather_raw.groupBy(F.to_date("date_hour").alias("day")).agg(F.array_sort(F.collect_list(hour)).alias("h"))
    columns = F.struct(*[F.col(f"h.{c}").alias(c) for c in files.WEATHER_COLUMNS])
    path = shared_dir(t.spark)
    days.select(columns.alias("hourly")).write.json(path)
    rows = files.read_weather_payload(t.spark, path, multi_line=False)
    return rows.withColumns({
        "date_hour": F.date_format("date_hour", "yyyy-MM-dd HH:mm:ss"), "temperature_2m": F.round("temperature_2m", 4),
    })


@query(
    "s06_station_records",
    """SELECT station_id, name, borough, address, round(lat, 6) AS lat, round(lon, 6) AS lon, dispatch_zone FROM x_stations""",
)
def station_records(t):
    path = shared_dir(t.spark)
    t.stations.write.json(path)
    df = files.read_stations(t.spark, path, multi_line=False)
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(
    "s07_keyed_object",
    "SELECT INCIDENT_DISPATCH_AREA AS zone, round(svi_score, 4) AS svi_score, BOROUGH AS borough, total_incidents FROM x_stats",
)
def keyed_object(t):
    value = F.struct(F.round("svi_score", 4).alias("svi_score"), F.col("BOROUGH").alias("borough"), "total_incidents")
    entries = F.collect_list(F.struct(F.col("INCIDENT_DISPATCH_AREA"), value.alias("v")))
    doc = t.stats.agg(F.to_json(F.map_from_entries(entries)).alias("doc"))
    return files.keyed_rows(doc, "doc", "struct<svi_score: double, borough: string, total_incidents: long>")


@query("s08_header_normalise", "SELECT * FROM x_permits")
def header_normalise(t):
    return files.normalise_headers(t.permits)


@query(
    "s09_column_discovery",
    """SELECT start_date_time AS start_text, end_date_time AS end_text, event_type AS kind, event_borough AS borough FROM x_permits""",
)
def column_discovery(t):
    feed = files.normalise_headers(t.permits)
    found = files.event_columns(feed)
    return feed.select(
        F.col(found["start"]).alias("start_text"), F.col(found["end"]).alias("end_text"),
        F.col(found["kind"]).alias("kind"), F.col(found["borough"]).alias("borough"),
    )


@query(
    "s10_literal_dimension",
    """SELECT z.zone, z.zone_name, z.borough, z.svi_label, count(*) AS n FROM x_clean c JOIN x_zones z ON z.zone = c.INCIDENT_DISPATCH_AREA
       GROUP BY ALL""",
)
def literal_dimension(t):
    z = dim.zones(t.spark).select("zone", "zone_name", "borough", "svi_label")
    facts = t.cleaned.select(F.col("INCIDENT_DISPATCH_AREA").alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))
    return facts.join(F.broadcast(z), "zone")


@query(
    "s11_zone_documents",
    """WITH h AS (SELECT *, (predicted - min(predicted) OVER w) / (max(predicted) OVER w - min(predicted) OVER w + 0.001::DOUBLE) AS i
                  FROM x_bin_forecast WINDOW w AS (PARTITION BY scenario_id))
       SELECT scenario_id, to_json({'type': 'FeatureCollection', 'query_params': {'hour': hour, 'dow': dow, 'month': month}, 'features': list({'type': 'Feature',
         'properties': {'zone': zone, 'borough': h.borough, 'zone_name': zone_name, 'predicted_count': round(predicted, 2),
           'normalized_intensity': round(i, 4), 'svi_score': svi_score,
           'historical_avg_response_sec': round(coalesce(avg_response_seconds, response_default), 2), 'high_acuity_ratio': round(high_acuity_ratio, 6)},
         'geometry': {'type': 'MultiPolygon', 'coordinates': [[list_transform(range(129), lambda v: [
            round(lon + radius_deg * cos(-(v / 128.0::DOUBLE) * 2 * pi()), 6) + 0.0, round(lat + radius_deg * sin(-(v / 128.0::DOUBLE) * 2 * pi()), 6) + 0.0])]]}}
         ORDER BY zone_ord)}) AS document
       FROM h JOIN (SELECT borough, radius_deg::DOUBLE AS radius_deg FROM x_boroughs) b ON b.borough = h.borough GROUP BY scenario_id, hour, dow, month""",
)
def zone_documents(t):
    """Scored zones with their boundary, and the parameters they were asked for."""
    keys = ["scenario_id", "hour", "dow", "month"]
    names = dim.zones(t.spark).select("zone", "zone_name", "response_default")
    radius = dim.boroughs(t.spark).select("borough", "radius_deg")
    avg = t.stats.select(F.col("INCIDENT_DISPATCH_AREA").alias("zone"), "avg_response_seconds")
    df = scenarios.with_intensity(t.bin_forecast, ["scenario_id"])
    df = df.join(F.broadcast(names), "zone").join(F.broadcast(avg), "zone", "left").join(F.broadcast(radius), "borough")
    ring = F.transform(degree_buffer_ring(F.col("lon"), F.col("lat"), F.col("radius_deg")), lambda p: F.struct(
        (F.round(p["lon"], 6) + 0.0).alias("lon"), (F.round(p["lat"], 6) + 0.0).alias("lat")
    ))
    item = files.feature(
        files.ring_geometry(ring),
        "zone", "borough", "zone_name", F.round("predicted", 2).alias("predicted_count"),
        F.round("normalized_intensity", 4).alias("normalized_intensity"), "svi_score",
        F.round(F.coalesce("avg_response_seconds", "response_default"), 2).alias("historical_avg_response_sec"),
        F.round("high_acuity_ratio", 6).alias("high_acuity_ratio"),
    )
    asked = F.struct("hour", "dow", "month").alias("query_params")
    docs = files.feature_collection(df, keys, F.col("zone_ord"), item, asked)
    return docs.select("scenario_id", "document")


@query(
    "s11_staging_documents",
    """SELECT scenario_id, to_json({'type': 'FeatureCollection', 'ambulance_count': 5, 'features': list({'type': 'Feature',
         'properties': {'staging_index': staging_index, 'coverage_radius_m': 3500, 'predicted_demand_coverage': predicted_demand_coverage,
           'cluster_zones': cluster_zones, 'zone_count': zone_count},
         'geometry': {'type': 'Point', 'coordinates': [round(lon, 6), round(lat, 6)]}} ORDER BY staging_index)}) AS document
       FROM x_centred GROUP BY scenario_id""",
)
def staging_documents(t):
    item = files.feature(
        files.point_geometry(F.round("lon", 6), F.round("lat", 6)),
        "staging_index", "coverage_radius_m", "predicted_demand_coverage", "cluster_zones", "zone_count",
    )
    return files.feature_collection(
        t.centred, ["scenario_id"], F.col("staging_index"), item, F.lit(5).alias("ambulance_count")
    )


@query(
    "s11_station_features",
    """SELECT station_id, to_json({'type': 'Feature', 'properties': {'station_id': station_id, 'name': name, 'borough': borough,
         'address': address, 'dispatch_zone': dispatch_zone}, 'geometry': {'type': 'Point', 'coordinates': [round(lon, 6), round(lat, 6)]}}) AS feature
       FROM x_stations""",
)
def station_features(t):
    """Stations grow with the data, so they stay one feature per row (line-delimited)."""
    item = files.feature(
        files.point_geometry(F.round("lon", 6), F.round("lat", 6)),
        "station_id", "name", "borough", "address", "dispatch_zone",
    )
    return t.stations.select("station_id", F.to_json(item).alias("feature"))


@query(
    "s12_keyed_upsert",
    """SELECT coalesce(s.zone, z.zone) AS zone, CASE WHEN s.n IS NULL THEN z.borough ELSE s.b END AS borough, coalesce(s.svi, z.svi_score) AS svi_score,
              coalesce(s.n, 0) AS incidents
       FROM x_zones z
       FULL JOIN (SELECT INCIDENT_DISPATCH_AREA AS zone, BOROUGH AS b, round(svi_score, 4) AS svi, total_incidents AS n FROM x_stats) s ON s.zone = z.zone""",
)
def keyed_upsert(t):
    """Boundary dimension, partitioned by borough, updated by the statistics of the zones."""
    current = dim.zones(t.spark).select(
        "zone", "borough", "svi_score", F.lit(0).cast("long").alias("incidents")
    )
    path = shared_dir(t.spark)
    files.upsert_partitions(t.spark, path, current, "zone", "borough")
    changes = t.stats.select(
        F.col("INCIDENT_DISPATCH_AREA").alias("zone"), F.col("BOROUGH").alias("borough"),
        F.round("svi_score", 4).alias("svi_score"), F.col("total_incidents").alias("incidents"),
    )
    files.upsert_partitions(t.spark, path, changes, "zone", "borough")
    return t.spark.read.parquet(path)


@query(
    "s13_zone_geometry",
    """SELECT zone, count(*) AS incidents, 129 AS vertices, round(any_value(lon) + any_value(radius_deg)::DOUBLE, 6) AS east_lon,
       round(any_value(lat), 6) AS east_lat, true AS is_closed
       FROM x_clean c JOIN x_zones z ON z.zone = c.INCIDENT_DISPATCH_AREA JOIN x_boroughs b ON b.borough = z.borough GROUP BY zone""",
)
def zone_geometry(t):
    b = dim.boroughs(t.spark).select("borough", "radius_deg")
    shapes = dim.zones(t.spark).join(F.broadcast(b), "borough").select(
        "zone", degree_buffer_ring(F.col("lon"), F.col("lat"), F.col("radius_deg")).alias("ring")
    ).withColumn("wkt", ring_wkt(F.col("ring")))
    facts = t.cleaned.groupBy(F.col("INCIDENT_DISPATCH_AREA").alias("zone")).agg(F.count("*").alias("incidents"))
    first, last = F.col("ring")[0], F.element_at("ring", -1)
    return facts.join(F.broadcast(shapes), "zone").select(
        "zone", "incidents", F.size("ring").alias("vertices"), F.round(first["lon"], 6).alias("east_lon"),
        F.round(first["lat"], 6).alias("east_lat"),
        (F.abs(first["lat"] - last["lat"]) < 1e-9).alias("is_closed"),
    )
