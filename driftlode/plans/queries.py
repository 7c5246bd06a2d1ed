"""Registered queries of the library's operators, each with its SQL for another engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlode.functions import geo, style
from driftlode.functions.times import iso_epoch
from driftlode.operators import correlate, detect, drift, field, posterior, raster
from driftlode.plans.views import raster_size, sql, view
from driftlode.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = 1704844800.0, 1705017600.0
LATE_START, LATE_END = 1709251200.0, 1709254800.0
HAVERSINE = "2 * 6371.0088e0 * asin(sqrt(power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2)))"
MEMBERS = sql("member") + ", w as (select *, exp(-0.5e0 * (power(offset_km / 8e0, 2) + power(ln(sim_area / obs_area) / 0.6e0, 2) + power(ln(sim_elong / obs_elong) / 0.5e0, 2))) as weight from member), mp as (select *, weight / sum(weight) over (partition by detection) as p from w)"


def r(x: Column | str, n: int = 6) -> Column:
    return F.round(x, n) + F.lit(0.0)


def hav(*a: str) -> str:
    return HAVERSINE.format(*a)


def query(text: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if text:
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def rank_sql(start: float, end: float, tail: str = "") -> str:
    """The ranking written as joins and windows."""
    c, h = (start + end) / 2, max((end - start) / 2, 1.0)
    return f"""with {sql("fix")}, {sql("grid")},
o as (select sum(lat * p) / sum(p) as olat, sum(lon * p) / sum(p) as olon from grid),
ref as (select greatest(sum(p * exp(-({hav("olat", "olon", "lat", "lon")}) / 8e0)), 1e-9) as r from grid, o),
marked as (select *, t between {start!r}e0 and {end!r}e0 as hit, least(abs(t - {start!r}e0), abs(t - {end!r}e0)) as away from fix),
counted as (select *, sum(case when hit then 1 else 0 end) over (partition by ship_id) as n_in, row_number() over (partition by ship_id order by away, seq) as nr from marked),
cand as (select * from counted where hit or (n_in = 0 and nr = 1)),
prox as (select f.ship_id, f.seq, f.t, f.lat, f.lon, f.n_in, sum(g.p * exp(-({hav("f.lat", "f.lon", "g.lat", "g.lon")}) / 8e0)) as prox from cand f cross join grid g group by all),
best as (select *, row_number() over (partition by ship_id order by prox desc, seq) as br, min({hav("olat", "olon", "lat", "lon")}) over (partition by ship_id) as km from prox, o),
scored as (select *, least(prox / r, 1e0) as norm, case when n_in > 0 then greatest(0e0, 1e0 - abs(t - {c!r}e0) / {h!r}e0) else 0e0 end as central from best, ref where br = 1),
ranked as (select ship_id, round(100e0 * (0.7e0 * norm + (1e0 - 0.7e0) * central), 1) as suspicion_score, round(km, 2) as closest_distance_km, round(lat, 5) as closest_lat, round(lon, 5) as closest_lon, t as closest_t, n_in > 0 as in_release_window, cast(n_in as bigint) as positions_in_window, round(prox, 6) as grid_weighted_proximity, round(norm, 4) as normalised_proximity, round(central, 4) as time_centrality from scored)
{tail or "select * from ranked"}"""


def _rank(start: float, end: float, top: int = 0):
    return lambda s, d: correlate.rank_vessels(view(s, d, "fix"), view(s, d, "grid"), start, end, top)


@query(rank_sql(START, END))
def vessel_rank(s, d):
    return _rank(START, END)(s, d)


@query(rank_sql(START, END, "select * from ranked order by suspicion_score desc, ship_id limit 10"))
def vessel_rank_topk(s, d):
    return _rank(START, END, 10)(s, d)


@query(rank_sql(LATE_START, LATE_END))
def vessel_rank_fallback(s, d):
    return _rank(LATE_END, LATE_START)(s, d)  # swapped bounds are put in order


@query(rank_sql(START, START + 1800, "select 24 - 0 * count(*) as x from ranked").replace("select 24 - 0 * count(*) as x from ranked", "select cast(count(*) filter (where in_release_window) as bigint) as vessels_in_window, (select count(distinct ship_id) from fix) as vessels_considered, (select count(*) from grid) as grid_cells_scored, (select round(r, 6) from ref) as reference_proximity, 8e0 as sigma_dist_km from ranked"))
def correlate_counts(s, d):
    return correlate.correlate_debug(view(s, d, "fix"), view(s, d, "grid"), START, START + 1800).drop("disclaimer")


@query(rank_sql(START, END, "select ship_id, suspicion_score from (select * from ranked where suspicion_score >= 50 order by suspicion_score desc, ship_id limit 4) x"))
def lead_labels(s, d):
    ranked = _rank(START, END)(s, d).where("suspicion_score >= 50")
    return ranked.orderBy(F.desc("suspicion_score"), "ship_id").limit(4).select("ship_id", "suspicion_score")


@query(f"with {sql('fix')} select ship_id, round(min({hav('28.2e0', '-89.15e0', 'lat', 'lon')}), 6) as km, count(*) as n from fix group by 1")
def haversine_closest(s, d):
    km = geo.haversine_km(F.lit(28.2), F.lit(-89.15), F.col("lat"), F.col("lon"))
    return view(s, d, "fix").groupBy("ship_id").agg(r(F.min(km)).alias("km"), F.count("*").alias("n"))


@query(
    f"""with {sql('fix')},
p as (select ship_id, seq, round(lon, 3) as lon, round(lat, 3) as lat, row_number() over (partition by ship_id order by seq) as i, count(*) over (partition by ship_id) as n from fix)
select ship_id, i as vertex, lon, lat from p where n >= 2"""
)
def track_geometry(s, d):
    lines = correlate.track_geometry(view(s, d, "fix")).select("ship_id", F.posexplode("line").alias("i", "p"))
    return lines.select("ship_id", (F.col("i") + 1).cast("long").alias("vertex"), F.round("p.lon", 3).alias("lon"), F.round("p.lat", 3).alias("lat"))


@query(f"with {sql('fix')} select ship_id, count(*) as n from fix group by 1 having count(*) > 1")
def ship_id_dups(s, d):
    return correlate.duplicate_keys(view(s, d, "fix"), "ship_id")


def members(s, d) -> DataFrame:
    m = view(s, d, "member")
    m = m.withColumn("weight", posterior.abc_weight(F.col("offset_km"), F.col("sim_area"), F.col("obs_area"), F.col("sim_elong"), F.col("obs_elong")))
    return posterior.normalised(m)


@query(f"with {MEMBERS} select detection, seq, round(weight, 9) as weight from w")
def abc_weights(s, d):
    return members(s, d).select("detection", "seq", r("weight", 9).alias("weight"))


@query(f"with {MEMBERS} select detection, seq, round(p, 9) as p from mp")
def posterior_normalise(s, d):
    return members(s, d).select("detection", "seq", r("p", 9).alias("p"))


@query(
    f"""with {sql('member')},
z as (select *, case when detection % 3 = 0 then 0e0 else offset_km end as weight from member),
t as (select *, sum(weight) over (partition by detection) as sw, count(*) over (partition by detection) as n from z)
select detection, seq, round(case when sw > 0 then weight / sw else 1e0 / n end, 9) as p from t"""
)
def posterior_uniform_fallback(s, d):
    m = view(s, d, "member").withColumn("weight", F.when(F.col("detection") % 3 == 0, 0.0).otherwise(F.col("offset_km")))
    return posterior.normalised(m).select("detection", "seq", r("p", 9).alias("p"))


@query(
    f"""with {MEMBERS} select detection, round(sum(lat * p) / sum(p), 6) as lat, round(sum(lon * p) / sum(p), 6) as lon, round(sum(hour * p) / sum(p), 6) as hour, round(1e0 / sum(p * p),
    6) as ess, count(*) as n from mp group by 1"""
)
def posterior_mean_ess(s, d):
    return posterior.means(members(s, d)).select("detection", r("lat").alias("lat"), r("lon").alias("lon"), r("hour").alias("hour"), r("ess").alias("ess"), "n")


@query(
    f"""with {MEMBERS},
c as (select *, sum(p) over (partition by detection order by hour, alpha, seq rows unbounded preceding) / sum(p) over (partition by detection) as cum from mp)
select detection, coalesce(min(hour) filter (where cum >= (1 - 0.8e0) / 2), max(hour)) as min_hour, coalesce(min(hour) filter (where cum >= 1 - (1 - 0.8e0) / 2), max(hour)) as max_hour
    from c group by 1"""
)
def release_window(s, d):
    return posterior.release_window(members(s, d))


@query(
    f"""with {MEMBERS},
c as (select *, sum(p) over (partition by detection order by hour, alpha, seq rows unbounded preceding) / sum(p) over (partition by detection) as cum from mp)
select detection, coalesce(min(hour) filter (where cum >= 0.5e0), max(hour)) as median_hour from c group by 1"""
)
def weighted_median_hour(s, d):
    return posterior.weighted_quantile(members(s, d), 0.5, "median_hour")


@query(
    f"""with {MEMBERS},
m as (select detection, sum(lat * p) / sum(p) as a, sum(lon * p) / sum(p) as b from mp group by 1)
select detection, round(sqrt(sum(p * power({hav('a', 'b', 'lat', 'lon')}, 2)) / sum(p)), 6) as radius_km from mp join m using (detection) group by 1"""
)
def uncertainty_radius(s, d):
    return posterior.uncertainty_radius(members(s, d)).select("detection", r("radius_km").alias("radius_km"))


BINNED = f"""with {MEMBERS},
k as (select *, round_even(lat / 0.05e0, 0) as i, round_even(lon / 0.05e0, 0) as j from mp),
n as (select *, row_number() over (partition by detection, i, j order by p desc, seq) as rn, sum(p) over (partition by detection, i, j) as cp from k),
og as (select detection, round(i * 0.05e0, 5) as lat, round(j * 0.05e0, 5) as lon, cp as p, hour from n where rn = 1)"""


@query(f"{BINNED} select detection, lat, lon, round(p, 6) as p, hour from og")
def origin_grid(s, d):
    return posterior.origin_grid(members(s, d)).withColumn("p", r("p"))


@query(f"with {MEMBERS} select detection, seq, round(lat, 5) as lat, round(lon, 5) as lon, round(p, 6) as p, hour from mp")
def origin_raw(s, d):
    return posterior.raw_grid(members(s, d))


@query(f"with {MEMBERS}, n as (select *, row_number() over (partition by detection order by p desc, seq) as rn from mp) select detection, lat, lon, hour, round(p, 6) as p from n where rn = 1")
def map_estimate(s, d):
    return posterior.map_estimate(members(s, d)).withColumn("p", r("p"))


@query(f"{BINNED} select hour, count(*) as cells, round(sum(p), 6) as p from og group by 1")
def posterior_by_time(s, d):
    return posterior.by_time(posterior.origin_grid(members(s, d))).withColumn("p", r("p"))


@query(f"{BINNED} select detection, round(coalesce(nullif(max(p), 0e0), 1e0), 6) as top from og group by 1")
def posterior_max(s, d):
    return posterior.origin_grid(members(s, d)).groupBy("detection").agg(r(F.coalesce(F.nullif(F.max("p"), F.lit(0.0)), F.lit(1.0))).alias("top"))


@query(
    f"""{BINNED} select round((min(lat) + max(lat)) / 2, 6) as lat, round((min(lon) + max(lon)) / 2, 6) as lon, round(greatest(6.5e0, least(10.5e0, log2(360e0 / greatest(max(lat) - min(lat),
    max(lon) - min(lon), 0.05e0)) - 0.6e0)), 6) as zoom from og"""
)
def viewport(s, d):
    return posterior.viewport(posterior.origin_grid(members(s, d))).select(r("lat").alias("lat"), r("lon").alias("lon"), r("zoom").alias("zoom"))


@query(
    f"""with {MEMBERS},
a as (select detection, 1e0 / sum(p * p) / count(*) as ratio, max(hour) - min(hour) as span from mp group by 1)
select detection, case when detection % 17 = 0 then 'Not physically meaningful' when detection % 13 = 0 then 'Ensemble collapsed' when ratio < 0.15e0 then 'Origin uncertain'
    when (detection % 10) / 1e2 < 0.02e0 then 'Weak current gradient' when span / 46e0 > 0.55e0 then 'Location narrowed, timing open' else 'Origin well constrained' end as badge from a"""
)
def confidence_badge(s, d):
    a = members(s, d).groupBy("detection").agg((1 / F.sum(F.col("p") * F.col("p")) / F.count("*")).alias("ratio"), (F.max("hour") - F.min("hour")).alias("span"))
    k = F.col("detection")
    return a.select(k, posterior.badge(k % 17 == 0, k % 13 == 0, F.col("ratio"), (k % 10) / 100.0, F.col("span") / 46.0).alias("badge"))


PIXELS = f"with {sql('raster')}"


@query(f"{PIXELS} select row, col, round(case when col % 11 = 0 then 0e0 else vv * vv / power(1e0 + col % 5, 2) end, 9) as sigma0 from raster")
def calibrate(s, d):
    gain = F.when(F.col("col") % 11 == 0, 0.0).otherwise(1.0 + F.col("col") % 5)
    return view(s, d, "raster").select("row", "col", r(raster.calibrate(F.col("vv"), gain), 9).alias("sigma0"))


@query(f"{PIXELS} select row, col, round(10 * log10(greatest(vv, 1e-6)), 6) as vv_db, round(10 * log10(greatest(vh, 1e-6)), 6) as vh_db from raster")
def to_db(s, d):
    return view(s, d, "raster").select("row", "col", r(raster.to_db(F.col("vv"))).alias("vv_db"), r(raster.to_db(F.col("vh"))).alias("vh_db"))


@query(f"{PIXELS} select row, col, cast(round_even(255 * (least(greatest(10 * log10(greatest(vv, 1e-6)), -30e0), 0e0) + 30e0) / 30e0, 0) as smallint) as vv_byte from raster")
def to_uint8(s, d):
    return view(s, d, "raster").select("row", "col", raster.to_byte(raster.to_db(F.col("vv"))).alias("vv_byte"))


def window_sql(value: str, size: int, name: str) -> str:
    """Mean of ``value`` over a square window with reflected edges, by one join for each offset."""
    h = size // 2
    at = lambda c, n: f"case when {c} < 0 then -{c} - 1 when {c} >= {n} then 2 * {n} - 1 - {c} else {c} end"
    return f"off as (select a, b from (select unnest(range(-{h}, {h + 1})) as a) x, (select unnest(range(-{h}, {h + 1})) as b) y), dim as (select max(row) + 1 as hh, max(col) + 1 as ww from raster), want as (select row, col, {at('(row + a)', 'hh')} as rr, {at('(col + b)', 'ww')} as cc from raster, off, dim), {name} as (select w.row, w.col, sum({value}) / {size * size} as m, sum(({value}) * ({value})) / {size * size} as m2 from want w join raster s on s.row = w.rr and s.col = w.cc group by 1, 2)"


@query(f"{PIXELS}, {window_sql('s.vv', 7, 'b')} select row, col, round(m, 9) as mean_7 from b")
def box_mean_7(s, d):
    return raster.box_sums(view(s, d, "raster"), "vv", 7, "m", *raster_size(s, d)).select("row", "col", r("m", 9).alias("mean_7"))


@query(
    f"""{PIXELS}, {window_sql('s.vv', 7, 'b')},
v as (select row, col, m, greatest(m2 - m * m, 0e0) as var, vv from b join raster using (row, col))
select row, col, round(m + case when var > 0 then least(greatest((var - 0.25e0 * m * m) / var, 0e0), 1e0) else 0e0 end * (vv - m), 9) as lee from v"""
)
def lee_filter(s, d):
    return raster.lee_filter(view(s, d, "raster"), "vv", "lee", *raster_size(s, d)).select("row", "col", r("lee", 9).alias("lee"))


@query(f"{PIXELS}, {window_sql('10 * log10(greatest(s.vv, 1e-6))', 5, 'b')} select row, col, round(greatest(m2 - m * m, 0e0), 6) as var_5 from b")
def local_variance(s, d):
    px = view(s, d, "raster").withColumn("db", raster.to_db(F.col("vv")))
    return raster.local_variance(px, "db", "x", *raster_size(s, d)).select("row", "col", r("x").alias("var_5"))


@query(
    f"""with {sql('scene')} select distinct scene_id, unnest(list_concat(range(0, cast(greatest(300 + k * 97 - 256, 0) as bigint) + 1, 224), [cast(greatest(300 + k * 97 - 256,
    0) as bigint)])) as start from scene"""
)
def tile_starts(s, d):
    return view(s, d, "scene").select("scene_id", F.explode(raster.tile_starts((300 + F.col("k") * 97).cast("int"))).alias("start")).withColumn("start", F.col("start").cast("long"))


TILED = sql("scene") + """,
sc as (select scene_id, 60 + k * 7 as height, 50 + k * 11 as width from scene),
ro as (select distinct scene_id, height, width, unnest(list_concat(range(0, greatest(height - 64, 0) + 1, 56), [greatest(height - 64, 0)])) as row_off from sc),
ti as (select distinct scene_id, height, width, row_off, unnest(list_concat(range(0, greatest(width - 64, 0) + 1, 56), [greatest(width - 64, 0)])) as col_off from ro)"""


@query(f"with {TILED} select scene_id, row_off, col_off, least(64, height - row_off) as valid_h, least(64, width - col_off) as valid_w from ti")
def tile_scene(s, d):
    sc = view(s, d, "scene").select("scene_id", (60 + F.col("k") * 7).alias("height"), (50 + F.col("k") * 11).alias("width"))
    return raster.tiles(sc, 64, 56).select("scene_id", *[F.col(c).cast("long").alias(c) for c in ("row_off", "col_off", "valid_h", "valid_w")])


@query(
    f"""{PIXELS},
st as (select unnest([0, 7, 14]) as k),
t as (select vec.k as ro, (row + vec.k) as row, col, abs(v) * (1 + vec.k) / 3e1 as prob from raster cross join st vec)
select row, col, round(sum(prob) / count(*), 6) as prob from t group by 1, 2"""
)
def stitch(s, d):
    px = view(s, d, "raster").withColumn("row_off", F.explode(F.array(F.lit(0), F.lit(7), F.lit(14))))
    probs = px.select("scene_id", "row_off", F.lit(0).alias("col_off"), F.col("row").alias("r"), F.col("col").alias("c"), (F.abs("v") * (1 + F.col("row_off")) / 30.0).alias("prob"))
    return raster.stitch(probs).select("row", "col", r("prob").alias("prob"))


RING = [(40.5, 10.5), (150.5, 30.5), (120.5, 120.5), (30.5, 90.5)]


def ray_sql(x: str, y: str) -> str:
    sides = zip(RING, RING[1:] + RING[:1], strict=True)
    return " + ".join(f"case when ({a[1]}e0 > {y}) <> ({b[1]}e0 > {y}) and {x} < ({b[0]}e0 - {a[0]}e0) * ({y} - {a[1]}e0) / ({b[1]}e0 - {a[1]}e0) + {a[0]}e0 then 1 else 0 end" for a, b in sides)


@query(f"{PIXELS} select row, col, ({ray_sql('col', 'row')}) % 2 = 1 as water from raster")
def point_in_polygon(s, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return view(s, d, "raster").select("row", "col", geo.in_ring(F.col("col"), F.col("row"), ring).alias("water"))


@query(
    f"""{PIXELS} select row, col, round(case when ({ray_sql('col', 'row')}) % 2 = 1 then abs(v) * 2 else 0e0 end, 6) as prob, (case when ({ray_sql('col', 'row')}) % 2 = 1 then abs(v) * 2
    else 0e0 end) >= 0.25e0 as hit, (case when ({ray_sql('col', 'row')}) % 2 = 1 then abs(v) * 2 else 0e0 end) > 0.25e0 as above from raster"""
)
def land_mask_binarize(s, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    p = raster.land_masked(F.abs("v") * 2, geo.in_ring(F.col("col"), F.col("row"), ring))
    return view(s, d, "raster").withColumn("p", p).select("row", "col", r("p").alias("prob"), raster.binarize(F.col("p"), 0.25).alias("hit"), raster.binarize(F.col("p"), 0.25, False).alias("above"))


def morph_sql(steps: str) -> str:
    """Min (e) and max (d) over 3x3, one after the other."""
    out, last = [f"{PIXELS}, m0 as (select row, col, case when v > -0.05e0 then 1 else 0 end as m from raster), o9 as (select a, b from (select unnest([-1, 0, 1]) as a) x, (select unnest([-1, 0, 1]) as b) y)"], "m0"
    for k, step in enumerate(steps, 1):
        out.append(f"m{k} as (select x.row, x.col, {'min' if step == 'e' else 'max'}(y.m) as m from {last} x cross join o9 join {last} y on y.row = x.row + a and y.col = x.col + b group by 1, 2)")
        last = f"m{k}"
    return ", ".join(out) + f" select row, col, m = 1 as mask from {last}"


@query(morph_sql("edde"))
def morph_open_close(s, d):
    px = view(s, d, "raster").select("scene_id", "row", "col", (F.col("v") > -0.05).alias("mask"))
    return raster.open_close(px, "mask").select("row", "col", "mask")


LABELLED = f"""with recursive {sql('raster')},
m as (select row, col, cast(row as bigint) * 100000 + col as id from raster where v > 0.15e0),
o9 as (select a, b from (select unnest([-1, 0, 1]) as a) x, (select unnest([-1, 0, 1]) as b) y),
reach as (select id, row, col, id as root from m union select m.id, m.row, m.col, reach.root from reach cross join o9 join m on m.row = reach.row + a and m.col = reach.col + b),
roots as (select id, row, col, min(root) as root from reach group by 1, 2, 3),
big as (select root, row_number() over (order by root) as label from (select root, count(*) as n from roots group by 1) z where n >= 4),
lab as (select row, col, big.label from roots join big using (root))"""


def labelled(s, d) -> DataFrame:
    return raster.components(view(s, d, "raster").withColumn("mask", F.col("v") > 0.15), "mask", 4)


@query(f"{LABELLED} select cast(row as bigint) as row, cast(col as bigint) as col, label from lab")
def components(s, d):
    return labelled(s, d).select("row", "col", "label")


FEATURES = """count(*) as pixel_count, cast(min(row) as bigint) as min_row, cast(max(row) as bigint) as max_row, cast(min(col) as bigint) as min_col, cast(max(col) as bigint) as max_col,
    round(avg(row), 6) as mean_row, round(avg(col), 6) as mean_col, round(avg(10 * log10(vv)), 6) as mean_backscatter_db, round(stddev_pop(10 * log10(vv)), 6) as texture_std_db,
    round(avg(10 * log10(vh) - 10 * log10(vv)), 6) as vh_vv_ratio_db, round(avg(abs(v)), 6) as confidence"""


@query(
    f"""{LABELLED}, {window_sql("10 * log10(greatest(s.vv, 1e-6))", 5, "b")}
select label, {FEATURES}, round(avg(greatest(m2 - m * m, 0e0)), 5) as texture_local_variance
from lab join raster using (row, col) join b using (row, col) group by 1"""
)
def blob_features(s, d):
    px = view(s, d, "raster").select("scene_id", "row", "col", raster.to_db(F.col("vv")).alias("vv_db"), raster.to_db(F.col("vh")).alias("vh_db"), F.abs("v").alias("prob"))
    px = raster.local_variance(px, "vv_db", "local_var", *raster_size(s, d))
    f = raster.blob_features(labelled(s, d).join(px, ["scene_id", "row", "col"]))
    whole = [F.col(c).cast("long").alias(c) for c in ("pixel_count", "min_row", "max_row", "min_col", "max_col")]
    means = [r(c).alias(c) for c in ("mean_row", "mean_col", "mean_backscatter_db", "texture_std_db", "vh_vv_ratio_db", "confidence")]
    return f.select("label", *whole, *means, r("texture_local_variance", 5).alias("texture_local_variance"))


def outlined(blobs: DataFrame) -> DataFrame:
    """Blobs of the mosaic as detections in degrees."""
    return raster.detections_from_blobs(blobs, 28.5, -89.3, 0.00213179, 0.00257173)


def slicks(s, d) -> DataFrame:
    return outlined(labelled(s, d))


@query(
    f"""{LABELLED} select label, count(*) as pixel_count, round(28.5e0 - 0.00213179e0 * (avg(row) + 0.5e0), 6) as lat, round(-89.3e0 + 0.00257173e0 * (avg(col) + 0.5e0), 6) as lon
from lab group by 1"""
)
def slick_centroids(s, d):
    sizes = labelled(s, d).groupBy("label").agg(F.count("*").alias("pixel_count"))
    return slicks(s, d).join(sizes, "label").select("label", "pixel_count", r("lat").alias("lat"), r("lon").alias("lon"))


@query()
def slick_origin(s, d):
    """From the raster to the origin: the mosaic's largest blob, its polygon, the backward ensemble and its result."""
    blobs = labelled(s, d)
    top = raster.primary_component(blobs, 6).select("scene_id", "label")
    found = outlined(blobs.join(top, ["scene_id", "label"], "left_semi")).select(F.col("label").alias("detection"), "polygon", "lat", "lon", F.lit(START).alias("t"), "area_km2")
    return posterior.result(posterior.normalised(drift.backtrack(found, GYRE)), found)


@query(
    f"""{LABELLED},
q as (select label, var_pop(row) as a, var_pop(col) as b, covar_pop(row, col) as c from lab group by 1),
e as (select label, 4 * sqrt(greatest((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c), 0e0)) as big, 4 * sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c),
    0e0)) as small from q)
select label, round(case when small < 1e-6 then case when big > 1e-6 then null else 1e0 end else big / small end, 5) as elongation from e"""
)
def blob_elongation(s, d):
    q = labelled(s, d).groupBy("label").agg(F.var_pop("row").alias("a"), F.var_pop("col").alias("b"), F.covar_pop("row", "col").alias("c"))
    return q.select("label", r(raster.ellipse_elongation(F.col("a"), F.col("b"), F.col("c")), 5).alias("elongation"))


@query(
    f"""{LABELLED},
z as (select label, count(*) as n, avg(row) as mr, avg(col) as mc from lab group by 1)
select label, n, round(mr, 6) as mean_row, round(mc, 6) as mean_col from (select *, row_number() over (order by n desc, label) as k from z) y where k = 1 and n >= 6"""
)
def primary_component(s, d):
    return raster.primary_component(labelled(s, d), 6).select("label", "n", r("mean_row").alias("mean_row"), r("mean_col").alias("mean_col"))


@query(f"{PIXELS}, c as (select v > 0.1e0 as mask, count(*) as n from raster group by 1) select mask, n, round(100e0 * n / sum(n) over (), 6) as pct from c")
def class_balance(s, d):
    return raster.class_balance(view(s, d, "raster").withColumn("mask", F.col("v") > 0.1), "mask").withColumn("pct", r("pct"))


@query(
    f"""{PIXELS},
x as (select floor(row / 8e0) as sample, case when v > 0.1e0 then 1e0 else 0e0 end as y, least(abs(v) * 3, 1e0) as p from raster),
h as (select *, case when p > 0.5e0 then 1e0 else 0e0 end as hit, least(greatest(p, 1e-7), 1 - 1e-7) as q from x)
select cast(sample as bigint) as sample, round((2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 6) as dice, round((sum(hit * y) + 1e-7) / (sum(hit) + sum(y) - sum(hit * y) + 1e-7),
    6) as iou, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as bce from h group by 1"""
)
def dice_iou(s, d):
    px = view(s, d, "raster").select(F.floor(F.col("row") / 8.0).alias("sample"), (F.col("v") > 0.1).alias("y"), F.least(F.abs("v") * 3, F.lit(1.0)).alias("p"))
    return raster.mask_scores(px, "y", "p", "sample").select("sample", r("dice").alias("dice"), r("iou").alias("iou"), r("bce").alias("bce"))


@query(
    f"""{PIXELS},
n as (select max(row) + 1 as h, max(col) + 1 as w from raster)
select 'rot90' as variant, w - 1 - col as row, row as col, round(v, 6) as v from raster, n union all select 'fliplr', row, w - 1 - col, round(v, 6) from raster, n
    union all select 'rot180', h - 1 - row, w - 1 - col, round(v, 6) from raster, n"""
)
def raster_variants(s, d):
    return raster.variants(view(s, d, "raster").select("row", "col", r("v").alias("v")), *raster_size(s, d)).select("variant", "row", "col", "v")


LOOK = """least(greatest(0.55e0 + case when wind is null then -0.05e0 else 0.4e0 * (1 / (1 + exp(-(wind - 3e0))) - 0.5e0) end + 0.1e0 * least(greatest((-10e0 - vh_vv_ratio_db) / 10e0, -1e0),
    1e0) + 0.3e0 * (least(elongation_ratio / 4e0, 1e0) - 0.5e0) - case when pixel_count < 50 then 0.15e0 else 0e0 end, 0e0), 1e0)"""


@query(f"with {sql('blob')} select blob_id, round({LOOK}, 6) as score from blob")
def lookalike_score(s, d):
    return view(s, d, "blob").select("blob_id", r(detect.lookalike_score(F.col("wind"), F.col("vh_vv_ratio_db"), F.col("elongation_ratio"), F.col("pixel_count"))).alias("score"))


@query(
    f"""with {sql('blob')} select sha256(concat(scene_id, ':', label)) as detection_id, round(area_km2, 6) as area_km2, round(elongation_ratio, 3) as elongation_ratio,
    round(mean_backscatter_db, 3) as mean_backscatter_db, round(wind, 2) as wind_speed_at_acquisition_ms, coalesce(wind < 3e0, false) as low_wind_flag, round({LOOK},
    4) as confidence_score, pixel_count from blob order by confidence_score desc"""
)
def detection_records(s, d):
    return detect.records(view(s, d, "blob")).orderBy(F.desc("confidence_score"))


@query(
    f"""with {sql('blob')} select blob_id, round(area_km2, 6) as area_km2, elongation_ratio, round(mean_backscatter_db, 6) as mean_backscatter_db, texture_std_db, round(texture_local_variance,
    6) as texture_local_variance, vh_vv_ratio_db, coalesce(wind, -1e0) as wind from blob"""
)
def gate_features(s, d):
    return detect.gate_features(view(s, d, "blob")).withColumns({c: r(c) for c in ("area_km2", "mean_backscatter_db", "texture_local_variance")})


@query(
    f"""with {sql('blob')}, {sql('wind_rec')},
n as (select b.blob_id as id, w.seq as record, w.wind, row_number() over (partition by b.blob_id order by sqrt(power(b.lat - w.lat, 2) + power(b.lon - w.lon, 2)) - case
    when w.ts = 'scene' then 1e3 else 0e0 end, w.seq) as k from blob b join wind_rec w on sqrt(power(b.lat - w.lat, 2) + power(b.lon - w.lon, 2)) <= 1e0)
select blob_id as id, n.record, round(n.wind, 6) as wind from blob left join n on n.id = blob_id and k = 1"""
)
def wind_nearest(s, d):
    points = view(s, d, "blob").select(F.col("blob_id").alias("id"), "lat", "lon")
    return detect.nearest_wind(points, view(s, d, "wind_rec"), F.lit("scene")).select("id", "record", r("wind").alias("wind"))


RECT = "(28e0 + (scene_id % 5) * 0.1e0)"


@query(
    f"""with {sql('scene')} select scene_id, 5 as vertices, round(-89.4e0 - 0.5e0, 6) as min_lon, round({RECT} - 0.5e0, 6) as min_lat, round(-89.1e0 + 0.5e0, 6) as max_lon,
    round({RECT} + 0.2e0 + 0.5e0, 6) as max_lat, round({RECT} + 0.1e0, 6) as c_lat, round(-89.25e0, 6) as c_lon from scene"""
)
def polygon_box_ring(s, d):
    n = view(s, d, "scene").withColumn("b", 28.0 + (F.col("scene_id") % 5) * 0.1)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), (F.col("b") + y).alias("y"))
    n = n.withColumn("ring", F.array(corner(-89.4, 0.0), corner(-89.1, 0.0), corner(-89.1, 0.2), corner(-89.4, 0.2)))
    n = n.withColumns({"box": geo.bbox(F.col("ring"), 0.5), "c": geo.ring_centroid(F.col("ring"))})
    return n.select("scene_id", F.size(geo.close_ring(F.col("ring"))).alias("vertices"), *[r(f"box.{c}").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], r("c.y").alias("c_lat"), r("c.x").alias("c_lon"))


@query(f"{PIXELS} select row, col, round(28.5e0 - row / 159e0 * (28.5e0 - 28.2e0), 6) as lat, round(-89.3e0 + col / 199e0 * (-89.0e0 + 89.3e0), 6) as lon from raster")
def pixel_to_latlon(s, d):
    lat, lon = geo.pixel_to_latlon(F.col("col"), F.col("row"), F.lit(200), F.lit(160), 28.5, -89.3, 28.2, -89.0)
    return view(s, d, "raster").select("row", "col", r(lat).alias("lat"), r(lon).alias("lon"))


@query(f"with {sql('blob')}, u as (select blob_id, (blob_id % 97) / 97.3e0 as x, (blob_id % 89) / 89.7e0 as y, lat, lon from blob) select blob_id, round(lat + y * 0.135e0, 6) as top, round(lon - x * 0.153e0, 6) as left, round(lat + y * 0.135e0 - 0.135e0, 6) as bottom, round(lon - x * 0.153e0 + 0.153e0, 6) as right from u".replace(" as left,", ' as "left",').replace(" as right", ' as "right"'))
def solve_bbox(s, d):
    k = F.col("blob_id")
    b = view(s, d, "blob").select(k, geo.solve_bbox((k % 97) / 97.3, (k % 89) / 89.7, F.col("lat"), F.col("lon"), 0.135, 0.153).alias("b"))
    return b.select("blob_id", "b.*")


UV = """uv as (select *, case when speed_kmh is null then 0e0 else speed_kmh / 3.6e0 * sin(radians(direction_deg)) end as u, case when speed_kmh is null then 0e0
    else speed_kmh / 3.6e0 * cos(radians(direction_deg)) end as v from field_obs)"""


def observed(s, d, dealt_by: str | None = None) -> DataFrame:
    u, v = field.uv(F.col("speed_kmh"), F.col("direction_deg"))
    return view(s, d, "field_obs", dealt_by).withColumns({"u": u, "v": v})


@query(f"with {sql('field_obs')}, {UV} select i, j, h, round(u, 6) + 0e0 as u, round(v, 6) + 0e0 as v from uv")
def current_uv(s, d):
    return observed(s, d).select("i", "j", "h", r("u").alias("u"), r("v").alias("v"))


@query(
    f"""with {sql('field_obs')}, {UV},
q as (select i, j, avg(sqrt(u * u + v * v)) as sp, count(speed_kmh) as n from uv group by 1, 2)
select round(max(sp) - min(sp), 6) as speed_range, round(avg(sp), 6) as speed_mean, count(*) filter (where n = 0) as empty_points from q"""
)
def field_diagnostics(s, d):
    return field.diagnostics(observed(s, d)).select(r("speed_range").alias("speed_range"), r("speed_mean").alias("speed_mean"), "empty_points")


@query(
    f"""with {sql('field_obs')}, {UV},
ask as (select distinct i, j, 1704067200e0 + h * 4321e0 - 5000e0 as t from uv),
x as (select i, j, t, (least(greatest(t, 1704067200e0), 1704067200e0 + 71 * 3600e0) - 1704067200e0) / 3600e0 as x from ask),
k as (select *, cast(floor(x) as bigint) as k, x - floor(x) as w from x)
select k.i, k.j, k.t, round(a.u + w * (coalesce(b.u, a.u) - a.u), 6) + 0e0 as u, round(a.v + w * (coalesce(b.v, a.v) - a.v), 6) + 0e0 as v,
    k.t > 1704067200e0 + 71 * 3600e0 as extrapolated from k join uv a on a.i = k.i and a.j = k.j and a.h = k.k left join uv b on b.i = k.i and b.j = k.j and b.h = k.k + 1"""
)
def time_interp(s, d):
    obs = observed(s, d)
    asked = obs.select("i", "j", (1704067200.0 + F.col("h") * 4321.0 - 5000.0).alias("t"))
    return field.at_times(obs, asked).select("i", "j", "t", r("u").alias("u"), r("v").alias("v"), "extrapolated")


@query(
    f"""with {sql('field_obs')}, {UV}, {sql('blob')},
y as (select blob_id as id, least(greatest((lat - 28.05e0) / 0.1e0, 0e0), 3e0) as y, least(greatest((lon + 89.35e0) / 0.1e0, 0e0), 3e0) as x from blob),
f as (select *, least(floor(y), 2) as i0, least(floor(x), 2) as j0 from y),
c as (select id, i0 + a as i, j0 + b as j, case when a = 1 then y - i0 else 1 - (y - i0) end * case when b = 1 then x - j0 else 1 - (x - j0) end as w from f cross
    join (select unnest([0, 1]) as a) p cross join (select unnest([0, 1]) as b) q)
select id, round(sum(w * u), 6) + 0e0 as u, round(sum(w * v), 6) + 0e0 as v from c join uv on uv.i = c.i and uv.j = c.j and uv.h = 5 group by 1"""
)
def bilinear(s, d):
    points = view(s, d, "blob").select(F.col("blob_id").alias("id"), "lat", "lon")
    return field.bilinear(points, observed(s, d).where("h = 5"), 28.05, -89.35, 0.1, 4).select("id", r("u").alias("u"), r("v").alias("v"))


GYRE = field.Gyre(28.2, -89.15)


def gyre_sql(lat: str, lon: str, t: str) -> tuple[str, str]:
    dy, dx = f"(({lat} - 28.2e0) * 111.32e0)", f"(({lon} + 89.15e0) * 111.32e0 * cos(radians(28.2e0)))"
    rr = f"greatest(sqrt({dx} * {dx} + {dy} * {dy}), 1e-6)"
    sp = f"(0.35e0 * exp(-({dx} * {dx} + {dy} * {dy}) / (2 * 70e0 * 70e0)) * (0.6e0 + 0.4e0 * sin(2 * pi() * {t} / (96 * 3600e0))))"
    return f"({sp} * (-{dy} / {rr}) - 0.08e0 + 1e-5 * {dx} * 1000)", f"({sp} * ({dx} / {rr}) - 0.04e0 - 1e-5 * {dy} * 1000)"


@query(f"with {sql('fix')} select seq, round({gyre_sql('lat', 'lon', 't')[0]}, 6) + 0e0 as u, round({gyre_sql('lat', 'lon', 't')[1]}, 6) + 0e0 as v from fix")
def gyre_field(s, d):
    u, v = GYRE.to_column(F.col("lat"), F.col("lon"), F.col("t"))
    return view(s, d, "fix").select("seq", r(u).alias("u"), r(v).alias("v"))


@query(
    f"""with {sql('scene')} select scene_id, unnest(list_transform(range(0, 24), lambda i: 1e0 + 2e0 * i)) as hour, round(greatest(least(sqrt((1e0 + k * 40) / pi()), 25e0), 0.3e0),
    6) as release_radius_km from scene"""
)
def hypothesis_grid(s, d):
    hours = F.transform(F.sequence(F.lit(0), F.lit(len(drift.hour_grid(1, 48, 2)) - 1)), lambda k: 1.0 + 2.0 * k)
    return view(s, d, "scene").select("scene_id", F.explode(hours).alias("hour"), r(drift.release_radius_km(1.0 + F.col("k") * 40)).alias("release_radius_km"))


@query(
    f"""with recursive p as (select s_suppkey as id, 28e0 + (s_suppkey % 40) / 1e2 as lat, -89.4e0 + (s_suppkey % 30) / 1e2 as lon, 1704067200e0 as t, 0 as k from supplier),
e as (select * from p union all select id, lat + 300e0 * {gyre_sql('lat', 'lon', '(t + k * 300e0)')[1]} / 111320e0,
    lon + 300e0 * {gyre_sql('lat', 'lon', '(t + k * 300e0)')[0]} / (111320e0 * cos(radians(lat))), t, k + 1 from e where k < 48)
select id, round(lat, 6) as lat, round(lon, 6) as lon from e where k = 48"""
)
def euler_track(s, d):
    p = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (28.0 + (F.col("s_suppkey") % 40) / 100.0).alias("lat"), (-89.4 + (F.col("s_suppkey") % 30) / 100.0).alias("lon"), F.lit(1704067200.0).alias("t"))
    return drift.euler_track(p, GYRE, 48, 300.0).select("id", r("lat").alias("lat"), r("lon").alias("lon"))


@query(
    f"""with {MEMBERS},
c as (select *, avg(lat) over (partition by detection) as ml, avg(lon) over (partition by detection) as mo from mp),
q as (select detection, count(*) as n, var_samp((lon - mo) * 111320e0 * cos(radians(ml))) as a, var_samp((lat - ml) * 111320e0) as b,
    covar_samp((lon - mo) * 111320e0 * cos(radians(ml)), (lat - ml) * 111320e0) as c from c group by 1)
select detection, round(case when n < 3 then 1e0 else sqrt(greatest((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c), 1e-9) / greatest((a + b) / 2 - sqrt(power((a - b) / 2,
    2) + c * c), 1e-9)) end, 4) as elongation from q"""
)
def pca_elongation(s, d):
    m = members(s, d)
    mean = m.groupBy("detection").agg(F.avg("lat").alias("ml"), F.avg("lon").alias("mo"))
    x, y = (F.col("lon") - F.col("mo")) * geo.metres_per_degree_lon(F.col("ml")), (F.col("lat") - F.col("ml")) * geo.METRES_PER_DEGREE
    q = m.join(mean, "detection").groupBy("detection").agg(F.count("*").alias("n"), F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"))
    return q.select("detection", r(F.when(F.col("n") < 3, 1.0).otherwise(geo.elongation(F.col("a"), F.col("b"), F.col("c"))), 4).alias("elongation"))


def detections(s, d) -> DataFrame:
    """A small slick outline for each supplier; the work grows with the table."""
    n = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("detection"))
    lat, lon = 28.0 + (F.col("detection") % 7) * 0.05, -89.3 + (F.col("detection") % 11) * 0.05
    corner = lambda a, b: F.struct((lon + a).alias("x"), (lat + b).alias("y"))
    ring = F.array(corner(-0.05, -0.01), corner(0.05, -0.02), corner(0.06, 0.01), corner(-0.04, 0.02))
    return n.select("detection", ring.alias("ring"), (1704067200.0 + F.col("detection") * 3600.0).alias("t"), F.when(F.col("detection") % 3 > 0, 20.0 + F.col("detection") % 9).alias("area_km2"))


@query()
def backtrack_ensemble(s, d):
    return posterior.normalised(drift.backtrack(detections(s, d), GYRE))


@query()
def forecast_track(s, d):
    at = detections(s, d).select(F.col("detection").alias("origin"), geo.ring_centroid(F.col("ring")).alias("c"), "t", "area_km2")
    at = at.select("origin", F.col("c.y").alias("lat"), F.col("c.x").alias("lon"), "t", drift.release_radius_km(F.coalesce("area_km2", F.lit(0.3))).alias("radius_km"))
    return drift.forecast_totals(drift.forward(at, GYRE))


@query("select s_suppkey as detection, 24 as members, 1e0 as mass, 1e0 as first_hour, 47e0 as last_hour, 0 as wrong from supplier")
def ensemble_summary(s, d):
    m = backtrack_ensemble(s, d)
    wrong = F.count_if((F.col("weight") < 0) | (F.col("weight") > 1) | (F.col("p") < 0) | F.col("offset_km").isNull() | (F.col("sim_area_km2") <= 0) | (F.col("sim_elongation") < 1))
    return m.groupBy("detection").agg(F.count("*").alias("members"), r(F.sum("p")).alias("mass"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), wrong.alias("wrong"))


@query("select s_suppkey as origin, 13 as snapshots, true as ok from supplier")
def forecast_summary(s, d):
    ok = (F.col("total_drift_km") > 0) & (F.abs(F.col("mean_speed_kmh") * 12 - F.col("total_drift_km")) < 1e-6) & (F.col("final_hull_area_km2") > 0)
    return forecast_track(s, d).select("origin", "snapshots", ok.alias("ok"))


GRIDS = """cells as (select cast(s_suppkey % 10 as bigint) as detection, 28.0e0 + (s_suppkey % 7) * 0.05e0 as lat, -89.3e0 + ((s_suppkey * 3) % 11) * 0.05e0 as lon, 1e0 + s_suppkey % 5 as w
    from {supplier}),
grids as (select detection, lat, lon, w / sum(w) over (partition by detection) as p from cells)"""
SPAN = f"{START!r}e0 + detection * 90000e0"


@query(
    f"""with {sql("fix")}, {GRIDS.format(supplier="supplier")},
o as (select detection, sum(lat * p) / sum(p) as olat, sum(lon * p) / sum(p) as olon, {SPAN} as low, {SPAN} + 43200e0 as high from grids group by 1),
ref as (select detection, greatest(sum(p * exp(-({hav("olat", "olon", "lat", "lon")}) / 8e0)), 1e-9) as r from grids join o using (detection) group by 1),
near as (select o.detection, f.ship_id, f.seq, f.t, low, high, {hav("olat", "olon", "f.lat", "f.lon")} as km, sum(g.p * exp(-({hav("f.lat", "f.lon", "g.lat", "g.lon")}) / 8e0)) as prox
    from fix f join o on f.t between low and high join grids g on g.detection = o.detection group by all),
best as (select *, row_number() over (partition by detection, ship_id order by prox desc, seq) as k, count(*) over (partition by detection, ship_id) as n, min(km) over (partition by detection, ship_id) as km_least from near)
select detection, ship_id, round(100e0 * (0.7e0 * least(prox / r, 1e0) + (1e0 - 0.7e0) * greatest(0e0, 1e0 - abs(t - (high + low) / 2) / ((high - low) / 2))), 1) as suspicion_score,
    round(km_least, 2) as closest_distance_km, n as positions_in_window, round(prox, 6) as grid_weighted_proximity
from best join ref using (detection) where k = 1"""
)
def vessel_rank_detections(s, d):
    grids = s.sql(f"with {GRIDS} select * from grids", supplier=s.read.parquet(f"{d}/supplier.parquet"))
    windows = grids.select("detection").distinct().select("detection", (START + F.col("detection") * 90000.0).alias("start"), (START + F.col("detection") * 90000.0 + 43200.0).alias("end"))
    return correlate.score_detections(view(s, d, "fix"), grids, windows)


@query(
    f"""with {sql("fix")}, f as (select ship_id, seq, case when seq % 5 = 0 then 'not a time' else strftime(to_timestamp(floor(t)) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') end as iso, floor(t) as t from fix)
select ship_id, seq, t + case when seq % 3 = 0 then -7200e0 else 0e0 end as t from f where iso <> 'not a time'"""
)
def iso_parse(s, d):
    at = F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("seq") % 3 == 0, "+02:00").when(F.col("seq") % 3 == 1, "Z").otherwise("")
    text = F.when(F.col("seq") % 5 == 0, "not a time").otherwise(F.concat(at, zone))
    return view(s, d, "fix").select("ship_id", "seq", iso_epoch(text).alias("t")).where("t is not null")


@query(
    f"""with {sql('member')},
x as (select detection, seq, (offset_km % 4) / 4e0 as share, cast(floor(hour) as bigint) as age from member)
select detection, seq, round(900e0 + 5200e0 * sqrt(share), 6) as radius_m, greatest(70, 190 - age * 12) as opacity, cast(floor(6 + 10 * share) as bigint) as size from x"""
)
def cell_style(s, d):
    x = view(s, d, "member").select("detection", "seq", (F.col("offset_km") % 4 / 4.0).alias("share"), F.floor("hour").alias("age"))
    return x.select("detection", "seq", r(style.cell_radius_m(F.col("share"))).alias("radius_m"), style.cell_opacity(F.col("age"), F.lit(False)).alias("opacity"), F.floor(6 + 10 * F.col("share")).alias("size"))


@query(
    """select o_orderkey as id, case when o_orderkey % 3 = 0 then 'merged' else o_orderstatus end as status, o_totalprice as price, case
    when o_orderkey % 3 = 0 then o_orderkey % 10 end as rank from orders union all select -o_orderkey, 'merged', null, o_orderkey % 10 from orders where o_orderkey % 7 = 0 and o_orderkey > 0"""
)
def event_merge(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("merged").alias("status"), (F.col("o_orderkey") % 10).alias("rank"))
    more = o.where("o_orderkey % 7 = 0 and o_orderkey > 0").select((-F.col("o_orderkey")).alias("id"), F.lit("merged").alias("status"), (F.col("o_orderkey") % 10).alias("rank"))
    return catalog.upsert(old, new.union(more), "id")


@query(
    f"""with {sql('scene')} select scene_id, case when scene_id % 4 = 0 then cast(scene_id as varchar) else name end as title, case when scene_id % 3 = 0 then '' else name end as subtitle,
    concat('/api/scenes/', scene_id, '/image') as image_url from scene"""
)
def scene_catalog(s, d):
    k = F.col("scene_id")
    return catalog.scene_list(view(s, d, "scene").select(k, F.when(k % 4 > 0, F.col("name")).alias("title"), F.when(k % 3 > 0, F.col("name")).alias("subtitle")))


@query(
    f"""with {sql("scene")}
select scene_id, case when scene_id % 2 = 1 then name when scene_id % 3 = 0 then 'side' else 'tag' end as "timestamp",
    case when scene_id % 3 = 0 then 'pass' else name end as pass_id,
    case when scene_id % 5 = 0 then 0e0 when scene_id % 3 = 0 then null else 35e0 end as incidence_angle
from scene"""
)
def scene_metadata(s, d):
    k, name = F.col("scene_id"), F.col("name")
    n = view(s, d, "scene").select(
        k, F.when(k % 2 == 1, name).otherwise("").alias("o_timestamp"), F.when(k % 3 == 0, "side").alias("s_timestamp"), F.lit("tag").alias("t_timestamp"),
        F.lit("").alias("o_pass_id"), F.when(k % 3 == 0, "pass").alias("s_pass_id"), name.alias("t_pass_id"),
        F.when(k % 5 == 0, 0.0).alias("o_incidence"), F.when(k % 3 != 0, 35.0).alias("s_incidence"), F.lit(None).cast("double").alias("t_incidence"),
    )
    return catalog.resolve_metadata(n)


BUCKET = "cast(concat('0x', substr(md5(cast(c_custkey as varchar)), 1, 8)) as bigint) % 100"


@query(
    f"""select cast(c_custkey as varchar) as sample_id,
    case when c_custkey % 3 = 0 then 'test' when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 'val' when {BUCKET} < 10 then 'val' else 'train' end as split
from customer"""
)
def split_assign(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("sample_id"))
    word = F.when(F.col("k") % 3 == 0, "test").when((F.col("k") % 3 == 1) & (F.col("k") % 2 == 0), "validation").when(F.col("k") % 3 == 1, "unheard of")
    return catalog.assign_splits(c.select("sample_id"), c.select("sample_id", word.alias("split")).where("split is not null"))


@query(f"with {sql('fix')} select ship_id, seq, strftime(to_timestamp(floor(t)) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso, t from fix")
def iso_times(s, d):
    return view(s, d, "fix").select("ship_id", "seq", F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), "t")


@query("select count(*) as n, bool_and(s_acctbal > -1e4) as ok, count(*) filter (where not s_acctbal > -1e4) as down from supplier")
def service_health(s, d):
    t = s.read.parquet(f"{d}/supplier.parquet").withColumn("up", F.col("s_acctbal") > -1e4)
    return catalog.health(t).crossJoin(t.agg(F.count("*").alias("n")))


from driftlode.plans import geometry, tracks  # noqa: E402, F401  they register their queries
