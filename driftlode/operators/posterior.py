"""Posterior algebra over ensemble members (detection, hour, alpha, lat, lon and what was simulated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlode.functions.geo import haversine_km
from driftlode.functions.geodesic import distance_km
from driftlode.functions.times import iso_text

SIGMA_KM, SIGMA_AREA, SIGMA_ELONG, MASS, BIN = 8.0, 0.6, 0.5, 0.80, 0.05


def abc_weight(offset: Column, sim_area: Column, obs_area: Column, sim_elong: Column, obs_elong: Column) -> Column:
    """exp(-d^2 / 2) of the distance in units of the tolerances; areas floor at 1e-6, elongations at 1e-3."""
    area = F.ln(F.greatest(sim_area, F.lit(1e-6)) / F.greatest(obs_area, F.lit(1e-6))) / SIGMA_AREA
    elong = F.ln(F.greatest(sim_elong, F.lit(1e-3)) / F.greatest(obs_elong, F.lit(1e-3))) / SIGMA_ELONG
    d2 = F.pow(offset / SIGMA_KM, 2) + area * area + elong * elong
    return F.exp(-d2 / 2)


def normalised(members: DataFrame, weight: str = "weight") -> DataFrame:
    """With ``p``: the weight's share in its detection, or an even share if the sum is no positive number.

    Members of a null detection are a detection of their own; one shuffle.
    """
    own = Window.partitionBy("detection")
    both = members.withColumns({"_w": F.sum(weight).over(own), "_n": F.count("*").over(own)})
    ok = (F.col("_w") > 0) & ~F.isnan("_w") & (F.col("_w") < float("inf"))
    return both.withColumn("p", F.when(ok, F.col(weight) / F.when(ok, F.col("_w"))).otherwise(1 / F.col("_n"))).drop("_w", "_n")


def means(members: DataFrame) -> DataFrame:
    """Weighted mean position and hour, and the effective sample size."""
    mean = lambda c: F.sum(F.col(c) * F.col("p")) / F.sum("p")
    return members.groupBy("detection").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), mean("hour").alias("hour"), F.coalesce(1 / F.nullif(F.sum(F.col("p") * F.col("p")), F.lit(0.0)), F.lit(0.0)).alias("ess"), F.count("*").alias("n"))


def weighted_quantiles(members: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """For each name the first hour (in order of hour, then alpha) at which the cumulative share is that of ``wanted`` or more; one window for all."""
    order = Window.partitionBy("detection").orderBy("hour", "alpha", "seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("detection")
    cum = members.withColumn("_c", F.sum("p").over(order) / F.sum("p").over(whole))
    return cum.groupBy("detection").agg(*[F.coalesce(F.min(F.when(F.col("_c") >= q, F.col("hour"))), F.max("hour")).alias(name) for name, q in wanted.items()])


def weighted_quantile(members: DataFrame, q: float, out: str) -> DataFrame:
    return weighted_quantiles(members, {out: q})


def release_window(members: DataFrame, mass: float = MASS) -> DataFrame:
    """Credible hours before the detection; the larger hour is the earlier time."""
    return weighted_quantiles(members, {"min_hour": (1 - mass) / 2, "max_hour": 1 - (1 - mass) / 2})


def result(members: DataFrame, detections: DataFrame, size: float | None = BIN, mass: float = MASS) -> DataFrame:
    """One document for each detection (detection, t): origin grid, likeliest origin, release window, radius, counts.

    ``members`` have p. Times are ISO texts; cells come in order of their share; a ``size`` of none gives the members themselves.
    """
    iso = lambda hour: iso_text(F.col("t") - hour * 3600)
    grid = origin_grid(members, size) if size else raw_grid(members)
    cell = F.struct((-F.col("p")).alias("order"), "lat", "lon", iso(F.col("hour")).alias("time_estimate"), F.col("p").alias("probability"))
    cells = grid.join(detections.select("detection", "t"), "detection").groupBy("detection").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    top = map_estimate(members).select("detection", F.struct("lat", "lon", "hour", "p").alias("top"))
    both = cells.join(means(members).select("detection", "ess", "n"), "detection").join(uncertainty_radius(members), "detection").join(release_window(members, mass), "detection").join(top, "detection").join(detections.select("detection", "t"), "detection")
    return both.select(
        "detection", F.transform("cells", lambda c: c.dropFields("order")).alias("origin_probability_grid"),
        F.struct(F.round("top.lat", 5).alias("lat"), F.round("top.lon", 5).alias("lon"), iso(F.col("top.hour")).alias("time_estimate"), F.round("top.p", 6).alias("probability")).alias("most_likely_origin"),
        F.array(iso(F.col("max_hour")), iso(F.col("min_hour"))).alias("release_time_window"), F.round("radius_km", 3).alias("uncertainty_radius_km"),
        F.col("n").alias("n_ensemble_members"), F.round("ess", 2).alias("effective_sample_size"),
    )


def uncertainty_radius(members: DataFrame, geodesic: bool = False) -> DataFrame:
    """Weighted RMS distance of the members from their mean, by haversine or on the WGS84 ellipsoid."""
    own = Window.partitionBy("detection")
    mean = lambda c: F.sum(F.col(c) * F.col("p")).over(own) / F.sum("p").over(own)
    far = (distance_km if geodesic else haversine_km)(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon"))
    each = members.withColumns({"m_lat": mean("lat"), "m_lon": mean("lon")}).withColumn("_d", far)
    return each.groupBy("detection").agg(F.sqrt(F.sum(F.col("p") * F.col("_d") * F.col("_d")) / F.sum("p")).alias("radius_km"))


def origin_grid(members: DataFrame, size: float = BIN) -> DataFrame:
    """Cells of ``size`` degrees, half-even: their summed share, and the time of their likeliest member."""
    key = lambda c: F.rint(F.col(c) / size)
    cells = members.groupBy("detection", key("lat").alias("i"), key("lon").alias("j")).agg(F.sum("p").alias("p"), F.max(F.struct("p", (-F.col("seq")).alias("m"), "hour")).alias("top"))
    return cells.select("detection", F.round(F.col("i") * size, 5).alias("lat"), F.round(F.col("j") * size, 5).alias("lon"), "p", F.col("top.hour").alias("hour"))


def raw_grid(members: DataFrame) -> DataFrame:
    """The members themselves as cells, for a bin size of none."""
    return members.select("detection", "seq", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("p", 6).alias("p"), "hour")


def map_estimate(members: DataFrame) -> DataFrame:
    """The likeliest member of each detection, the first on a tie."""
    top = members.groupBy("detection").agg(F.max(F.struct("p", (-F.col("seq")).alias("m"), "lat", "lon", "hour")).alias("t"))
    return top.select("detection", "t.lat", "t.lon", "t.hour", "t.p")


def badge(synthetic: Column, degenerate: Column, ratio: Column, speed_range: Column, coverage: Column) -> Column:
    """Six states in order of precedence."""
    return (
        F.when(synthetic, "Not physically meaningful").when(degenerate, "Ensemble collapsed").when(ratio < 0.15, "Origin uncertain")
        .when(speed_range < 0.02, "Weak current gradient").when(coverage > 0.55, "Location narrowed, timing open").otherwise("Origin well constrained")
    )


def by_time(grid: DataFrame) -> DataFrame:
    """Cells grouped by time, with the count and share of each time."""
    return grid.groupBy("hour").agg(F.count("*").alias("cells"), F.sum("p").alias("p"))


def viewport(grid: DataFrame) -> DataFrame:
    """Centre and zoom that show all cells: zoom log2(360 / span) - 0.6 within 6.5 and 10.5, spans at least 0.05."""
    a = grid.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    span = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(0.05))
    return a.select(((F.col("s") + F.col("n")) / 2).alias("lat"), ((F.col("w") + F.col("e")) / 2).alias("lon"), F.greatest(F.lit(6.5), F.least(F.lit(10.5), F.log2(360 / span) - 0.6)).alias("zoom"))
