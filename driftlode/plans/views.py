"""Derived tables on which the queries run: the same expressions for Spark and for the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIX = "select user_id as ship_id, event_id as seq, {epoch} as t, 27.6e0 + ((event_id * 7919) % 1600) / 1e3 as lat, -89.9e0 + ((event_id * 104729) % 1500) / 1e3 as lon from {events}"
GRID = "select lat, lon, sum(w) / sum(sum(w)) over () as p, min(hour) as hour from (select 28.0e0 + (s_suppkey % 7) * 0.05e0 as lat, -89.3e0 + ((s_suppkey * 3) % 11) * 0.05e0 as lon, 1e0 + s_suppkey % 5 as w, 1e0 + 2 * (s_suppkey % 6) as hour from {supplier}) s group by lat, lon"
SCENE = "select s_suppkey as scene_id, s_suppkey % 25 as k, s_name as name from {supplier}"
MEMBER = "select o_custkey as detection, o_orderkey as seq, 1e0 + 2 * (o_orderkey % 24) as hour, 0.03e0 as alpha, 28.0e0 + ((o_orderkey * 37) % 400) / 1e3 as lat, -89.4e0 + ((o_orderkey * 53) % 500) / 1e3 as lon, ((o_orderkey * 13) % 160) / 1e1 as offset_km, 5e0 + ((o_orderkey * 7) % 60) as sim_area, 1e0 + ((o_orderkey * 11) % 40) / 1e1 as sim_elong, 20e0 + (o_custkey % 20) as obs_area, 1e0 + (o_custkey % 9) / 2e0 as obs_elong from {orders}"
BLOB = "select p_partkey as blob_id, 0 as scene_id, p_partkey as label, 28.0e0 + ((p_partkey * 37) % 400) / 1e3 as lat, -89.4e0 + ((p_partkey * 53) % 500) / 1e3 as lon, 1e0 + (p_size % 20) / 4.1e0 as elongation_ratio, -8e0 - (p_partkey % 9) * 1.0137e0 as vh_vv_ratio_db, 10 + p_size * 7 as pixel_count, case when p_partkey % 7 = 0 then null else p_size % 12 + 0e0 end as wind, 2e0 + (p_partkey % 31) / 7e0 as area_km2, -18e0 - (p_partkey % 13) / 3e0 as mean_backscatter_db, 1e0 + (p_partkey % 5) / 8e0 as texture_std_db, (p_partkey % 17) / 9e0 as texture_local_variance from {part}"
WIND = "select s_suppkey as seq, 28.0e0 + ((s_suppkey * 91) % 420) / 1e3 as lat, -89.4e0 + ((s_suppkey * 67) % 520) / 1e3 as lon, case when s_suppkey % 11 = 0 then null else abs(s_acctbal) / 1e3 end as wind, case when s_suppkey % 3 = 0 then 'scene' else 'other' end as ts from {supplier}"
RASTER = {
    "spark": "select 0L as scene_id, cast(floor(vec_id / 25e0) * 8 + floor(pos / 8e0) as int) as row, cast((vec_id % 25) * 8 + pos % 8 as int) as col, cast(v as double) as v, 0.02e0 * exp(cast(v as double)) as vv, 0.01e0 * exp(cast(w as double)) as vh from (select vec_id, pos, v, element_at(embedding, 64 - pos) as w from {embeddings} lateral view posexplode(embedding) as pos, v)",
    "duckdb": "select 0 as scene_id, cast(floor(vec_id / 25e0) * 8 + floor(pos / 8e0) as int) as row, cast((vec_id % 25) * 8 + pos % 8 as int) as col, cast(embedding[pos + 1] as double) as v, 0.02e0 * exp(cast(embedding[pos + 1] as double)) as vv, 0.01e0 * exp(cast(embedding[64 - pos] as double)) as vh from embeddings cross join (select unnest(range(64)) as pos) p",
}
FIELD = {
    "spark": "select i, j, h, 1704067200e0 + h * 3600e0 as t, case when (i * 7 + j * 5 + h) % 23 = 0 then null else 0.5e0 + ((i * 3 + j * 7 + h * 11) % 40) / 1e1 end as speed_kmh, ((i * 29 + j * 31 + h * 13) % 360) + 0e0 as direction_deg from (select p_partkey % 4 as i, cast(floor(p_partkey / 4e0) as bigint) as j from {part}) n lateral view explode(sequence(0L, 71L)) as h",
    "duckdb": "select i, j, h, 1704067200e0 + h * 3600e0 as t, case when (i * 7 + j * 5 + h) % 23 = 0 then null else 0.5e0 + ((i * 3 + j * 7 + h * 11) % 40) / 1e1 end as speed_kmh, ((i * 29 + j * 31 + h * 13) % 360) + 0e0 as direction_deg from (select p_partkey % 4 as i, cast(floor(p_partkey / 4e0) as bigint) as j from part) n cross join (select unnest(range(72)) as h) hh",
}
EPOCH = {"spark": "unix_micros(cast(ts as timestamp)) / 1e6", "duckdb": "epoch_us(ts) / 1e6"}
PLAIN = {"fix": (FIX, "events"), "grid": (GRID, "supplier"), "member": (MEMBER, "orders"), "blob": (BLOB, "part"), "scene": (SCENE, "supplier"), "wind_rec": (WIND, "supplier")}
OTHER = {"raster": (RASTER, "embeddings"), "field_obs": (FIELD, "part")}
TILES = 25


def view(spark: SparkSession, sf_dir: str, name: str, dealt_by: str | None = None) -> DataFrame:
    """``dealt_by``: a key of the table by whose ranges its rows are dealt first, as a small file of rows that explode into many is one task."""
    text, table = PLAIN[name] if name in PLAIN else (OTHER[name][0]["spark"], OTHER[name][1])
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if dealt_by:
        source = source.select(dealt_by).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_by)
    return spark.sql(text.replace("{epoch}", EPOCH["spark"]), **{table: source})


def sql(name: str) -> str:
    """``name as (...)`` for a WITH clause of the checking SQL."""
    text = PLAIN[name][0].replace("{epoch}", EPOCH["duckdb"]).format(**{PLAIN[name][1]: PLAIN[name][1]}) if name in PLAIN else OTHER[name][0]["duckdb"]
    return f"{name} as ({text})"


def raster_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Height and width of the mosaic."""
    top = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    return 8 * (int(top or 0) // TILES + 1), 8 * TILES
