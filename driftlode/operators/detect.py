"""Detection records from blobs: look-alike score, wind, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlode.operators.correlate import top_first


def lookalike_score(wind: Column, ratio_db: Column, elong: Column, pixels: Column) -> Column:
    """Rule-based confidence in [0, 1]. Unknown wind costs a little, an infinite elongation counts as 10."""
    by_wind = F.when(wind.isNull(), -0.05).otherwise(0.20 * (1 / (1 + F.exp(-(F.coalesce(wind, F.lit(3.0)) - 3.0))) - 0.5) * 2)
    by_ratio = F.when(ratio_db.isNull(), 0.0).otherwise(0.10 * F.least(F.greatest((-10.0 - ratio_db) / 10.0, F.lit(-1.0)), F.lit(1.0)))
    by_shape = 0.15 * (F.least(F.coalesce(elong, F.lit(10.0)) / 4.0, F.lit(1.0)) - 0.5) * 2
    return F.least(F.greatest(0.55 + by_wind + by_ratio + by_shape - F.when(pixels < 50, 0.15).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def low_wind(wind: Column) -> Column:
    return F.coalesce(wind < 3.0, F.lit(False))


def gate_features(blobs: DataFrame) -> DataFrame:
    """The seven inputs of a look-alike model: infinite elongation 10, unknown wind -1."""
    return blobs.select("blob_id", "area_km2", F.coalesce("elongation_ratio", F.lit(10.0)).alias("elongation_ratio"), "mean_backscatter_db", "texture_std_db", "texture_local_variance", "vh_vv_ratio_db", F.coalesce("wind", F.lit(-1.0)).alias("wind"))


def nearest_wind(points: DataFrame, records: DataFrame, scene_time: Column, cutoff: float = 1.0, parts: int = 24) -> DataFrame:
    """For each point (id, lat, lon) the wind of the nearest record within ``cutoff`` degrees.

    Records of the scene's own time come before all others; of equals the first (by seq) wins; null if
    it has no value. First cells of a ``parts``-th of the cut-off are compared: one that holds points needs the records of
    those cells only that may be nearer than the farthest place of the best cell. Then points meet these
    records in an equi-join on the cell. Points of one place are one point there, and of the records of one
    place, which a cache repeats for every time, only the first can win.
    """
    size = cutoff / parts
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    ours = F.when(F.col("r_ts").eqNullSafe(scene_time), 1000.0).otherwise(0.0)
    known = records.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("ts").alias("r_ts"), cell("lat").alias("ri"), cell("lon").alias("rj"), F.struct("seq", "wind").alias("r")).withColumn("ours", ours)
    known = known.groupBy("r_lat", "r_lon", "ri", "rj", "ours").agg(F.min("r").alias("r"))
    at = points.select("lat", "lon").distinct().withColumns({"pi": cell("lat"), "pj": cell("lon")})
    # how near and how far a place of one cell may be from one of another
    reach = F.sequence(F.lit(-parts - 1), F.lit(parts + 1))
    near = at.select("pi", "pj").distinct().withColumn("di", F.explode(reach)).withColumn("dj", F.explode(reach)).withColumns({"ri": F.col("pi") + F.col("di"), "rj": F.col("pj") + F.col("dj")})
    gap = lambda k: F.greatest(F.abs(F.col(k)) - 1, F.lit(0)) * size
    far = lambda k: (F.abs(F.col(k)) + 1) * size
    cells = near.join(known.select("ri", "rj", "ours").distinct(), ["ri", "rj"])
    cells = cells.withColumns({"least": F.hypot(gap("di"), gap("dj")), "most": F.hypot(far("di"), far("dj"))}).where(F.col("least") <= cutoff)
    bound = cells.where(F.col("most") <= cutoff).groupBy("pi", "pj").agg(F.min(F.col("most") - F.col("ours")).alias("bound"))
    kept = cells.join(bound, ["pi", "pj"], "left").where(F.col("bound").isNull() | (F.col("least") - F.col("ours") <= F.col("bound") + 1e-9))
    there = kept.select("pi", "pj", "ri", "rj", "ours").join(known, ["ri", "rj", "ours"])
    d = F.sqrt(F.pow(F.col("lat") - F.col("r_lat"), 2) + F.pow(F.col("lon") - F.col("r_lon"), 2))
    both = at.join(there, ["pi", "pj"]).withColumn("d", d).where(F.col("d") <= cutoff)
    there = both.groupBy("lat", "lon").agg(F.min(F.struct((F.col("d") - F.col("ours")).alias("rank"), F.col("r.seq").alias("seq"), F.col("r.wind").alias("wind"))).alias("b"))
    best = points.join(there, ["lat", "lon"]).groupBy("id").agg(F.min("b").alias("b")).select("id", F.col("b.wind").alias("wind"), F.col("b.seq").alias("record"))
    return points.select("id").join(best, "id", "left")


def records(blobs: DataFrame) -> DataFrame:
    """Rounded detection records; ids are hashes of scene and label, so runs agree."""
    wind, elong = F.col("wind"), F.col("elongation_ratio")
    return blobs.select(
        F.sha2(F.concat_ws(":", "scene_id", "label"), 256).alias("detection_id"), F.round("area_km2", 6).alias("area_km2"), F.round(elong, 3).alias("elongation_ratio"),
        F.round("mean_backscatter_db", 3).alias("mean_backscatter_db"), F.round(wind, 2).alias("wind_speed_at_acquisition_ms"), low_wind(wind).alias("low_wind_flag"),
        F.round(lookalike_score(wind, F.col("vh_vv_ratio_db"), elong, F.col("pixel_count")), 4).alias("confidence_score"), "pixel_count",
    )


__all__ = ["gate_features", "lookalike_score", "low_wind", "nearest_wind", "records", "top_first"]
