"""Radar rasters as long pixel tables (scene_id, row, col, and bands)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlode.functions.geo import polygon_area_km2, simplify
from driftlode.functions.geodesic import lonlat_of_utm, utm_zone
from driftlode.functions.polygon import KIND as POLYGON
from driftlode.functions.polygon import rings
from driftlode.operators.linking import kept, smallest_reachable

TILE = 256


def calibrate(dn: Column, gain: Column) -> Column:
    """DN^2 / A^2; 0 where that isn't finite."""
    x = F.when((gain == 0) | gain.isNull() | dn.isNull(), 0.0).otherwise(dn * dn / F.when(gain == 0, 1.0).otherwise(gain * gain))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def to_db(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-6)))


def to_byte(db: Column, low: float = -30.0, high: float = 0.0) -> Column:
    """dB clipped to [low, high] and scaled to 0..255, rounded half to even."""
    return F.rint(255 * (F.least(F.greatest(db, F.lit(low)), F.lit(high)) - low) / (high - low)).cast("smallint")


STRIP = 256


def box_means(pixels: DataFrame, values: dict[str, Column], size: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """``pixels`` with, under each name of ``values``, the mean of that expression in a size x size window; edges are reflected.

    One pass along columns and one along rows, each a shuffle and a window frame. Lines are cut into strips of STRIP
    pixels, to which the pixels within half a window are sent too; so no task needs a whole line. Sizes come
    from the columns scene_height and scene_width of a pixel's scene, or are the same for all scenes. Places without a pixel add nothing; the
    first pass gives those beside a pixel a row too, for the windows that reach the pixel from another line.
    """
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    half = size // 2
    sides = {"row": F.lit(height) if height is not None else F.col("scene_height"), "col": F.lit(width) if width is not None else F.col("scene_width")}

    def filled(places: DataFrame, axis: str, group: list[str]) -> DataFrame:
        """``places`` and, as rows without values, the empty places of a strip that lie within half a window of one."""
        line = Window.partitionBy(*group).orderBy("_p")
        p, before, after = F.col("_p"), F.lag("_p").over(line), F.lead("_p").over(line)
        run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        # least and greatest leave nulls out; a place between two is the first one's if it reaches it
        beside = F.concat(run(F.greatest(p - half, before + half + 1), p - 1), run(p + 1, F.least(p + half, after - 1)))
        inner = F.filter(beside, lambda g: (g >= 0) & (g < sides[axis].cast("int")) & (F.floor(g / STRIP) == F.col("_s")))
        # null stands for the place itself
        rows = places.withColumn("_g", inner).withColumn("_g", F.explode(F.concat(F.array(F.lit(None).cast("int")), "_g")))
        own = F.col("_g").isNull()
        return rows.withColumns({c: F.when(own, F.col(c)) for c in values} | {"_px": own, "_p": F.coalesce("_g", "_p"), axis: F.coalesce("_g", axis).cast(places.schema[axis].dataType)}).drop("_g")

    def along(df: DataFrame, axis: str, other: str, last: bool) -> DataFrame:
        at, n = F.col(axis).cast("int"), sides[axis].cast("int")
        # the places at which a pixel stands: its own, and those of its images beyond the edges
        images = F.array(at, F.when(at < half, -at - 1), F.when(at >= n - half, 2 * n - 1 - at))
        places = df.withColumn("_p", F.explode(F.filter(images, lambda x: x.isNotNull())))
        strips = F.array_distinct(F.array(F.floor((F.col("_p") - half) / STRIP), F.floor((F.col("_p") + half) / STRIP)))
        places, group = places.withColumn("_s", F.explode(strips)), ["scene_id", other, "_s"]
        near = Window.partitionBy(*group).orderBy("_p").rangeBetween(-half, half)
        sums = (places if last else filled(places, axis, group)).withColumns({c: F.sum(c).over(near) / size for c in values})
        return sums.where((F.col("_p") == at) & (F.floor(F.col("_p") / STRIP) == F.col("_s"))).drop("_p", "_s")

    return along(along(pixels.withColumns(values), "col", "row", False), "row", "col", True).where("_px").drop("_px")


def box_sums(pixels: DataFrame, value: str, size: int, out: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """box_means() of one column."""
    return box_means(pixels, {out: F.col(value)}, size, height, width)


def _moments(value: str) -> dict[str, Column]:
    return {"_m": F.col(value), "_m2": F.col(value) * F.col(value)}


def lee_filter(pixels: DataFrame, value: str, out: str, height: int | None = None, width: int | None = None, size: int = 7, noise: float = 0.25) -> DataFrame:
    """Speckle filter in linear power: mean + w * (x - mean), w in [0, 1] from the local variance."""
    both = box_means(pixels, _moments(value), size, height, width)
    var = F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))
    floor = noise * F.col("_m") * F.col("_m")
    w = F.when(var > 0, F.least(F.greatest((var - floor) / F.when(var > 0, var).otherwise(1.0), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return both.withColumn(out, F.col("_m") + w * (F.col(value) - F.col("_m"))).drop("_m", "_m2")


def local_variance(pixels: DataFrame, value: str, out: str, height: int | None = None, width: int | None = None, size: int = 5) -> DataFrame:
    both = box_means(pixels, _moments(value), size, height, width)
    return both.withColumn(out, F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))).drop("_m", "_m2")


def land_spans(polygons: DataFrame, height: int | None = None) -> DataFrame:
    """(scene_id, row, first, last): the runs of pixels of a row whose centres lie in a polygon of land.

    ``polygons``: scene_id and polygon (parts with holes, see functions.polygon) or ring, in columns and rows. Every side is cut with
    the rows that it crosses; along a row of a polygon the cuts, in order, open and close its runs.
    """
    shape = F.col("polygon") if "polygon" in polygons.columns else F.array(F.array("ring"))
    # a polygon that comes twice counts once, so that its own corners tell it from others
    each = polygons.select("scene_id", shape.alias("_p")).distinct().withColumn("_k", F.md5(F.to_json("_p"))).select("scene_id", "_k", F.explode(rings(F.col("_p"))).alias("r"))
    sides = each.select("scene_id", "_k", F.posexplode("r").alias("i", "p"), "r").select("scene_id", "_k", "p", F.get("r", (F.col("i") + 1) % F.size("r")).alias("q"))
    low, high = F.ceil(F.least("p.y", "q.y")), F.ceil(F.greatest("p.y", "q.y")) - 1
    if height is not None:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(height - 1))
    rows = sides.withColumns({"_low": low, "_high": high}).where("_low <= _high").select("scene_id", "_k", "p", "q", F.explode(F.sequence("_low", "_high")).alias("row"))
    x = (F.col("q.x") - F.col("p.x")) * (F.col("row") - F.col("p.y")) / (F.col("q.y") - F.col("p.y")) + F.col("p.x")
    along = Window.partitionBy("scene_id", "_k", "row").orderBy("x")
    runs = rows.select("scene_id", "_k", "row", x.alias("x")).select("scene_id", "row", "x", F.row_number().over(along).alias("n"), F.lead("x").over(along).alias("to"))
    # a centre is inside from the one cut, included, to the next
    return runs.where("n % 2 = 1").select("scene_id", "row", F.ceil("x").alias("first"), (F.ceil("to") - 1).alias("last")).where("first <= last")


def water_mask(pixels: DataFrame, polygons: DataFrame | None, out: str = "water", cell: int = STRIP, height: int | None = None) -> DataFrame:
    """``pixels`` with ``out``: whether no polygon of land (see land_spans) holds their centre.

    By scanlines: polygons become runs of rows, runs two events each, and a running count of those along a row, in strips of ``cell``
    pixels, tells how many cover a pixel; no polygon is carried to a pixel, no task needs a whole line. Without polygons all is water, with a warning, as land may then
    be taken for a slick.
    """
    if polygons is None:
        warnings.warn("no polygons of land: nothing is masked, and shadows of land may be taken for slicks", stacklevel=2)
        return pixels.withColumn(out, F.lit(True))
    spans = land_spans(polygons, height).withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))))
    event = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    ends = F.array(event(F.greatest("first", F.col("_b") * cell), 1), event(F.col("last") + 1, -1))
    turns = spans.select(F.col("scene_id").alias("_s"), F.col("row").alias("_r"), "_b", F.explode(ends).alias("e"))
    turns = turns.groupBy("_s", "_r", "_b", F.col("e.at").alias("_c")).agg(F.sum("e.by").alias("_by"))
    marked = pixels.withColumns({"_s": F.col("scene_id"), "_r": F.col("row").cast("long"), "_c": F.col("col").cast("long"), "_b": F.floor(F.col("col") / cell), "_by": F.lit(0).cast("long"), "_px": F.lit(True)})
    along = Window.partitionBy("_s", "_r", "_b").orderBy("_c").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    covered = marked.unionByName(turns, allowMissingColumns=True).withColumn("_on", F.sum("_by").over(along))
    return covered.where("_px").withColumn(out, F.col("_on") <= 0).drop("_s", "_r", "_b", "_c", "_by", "_px", "_on")


def land_masked(prob: Column, water: Column) -> Column:
    return F.when(water, prob).otherwise(0.0)


def binarize(prob: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    return prob >= threshold if inclusive else prob > threshold


def extreme_3x3(pixels: DataFrame, mask: str, grow: bool) -> DataFrame:
    """Dilate (grow) or erode a boolean mask by 3x3; places outside the image don't count."""
    near = pixels.select("scene_id", mask, F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col").select("scene_id", mask, "row", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)).alias("col"))
    best = near.groupBy("scene_id", "row", "col").agg((F.bool_or if grow else F.bool_and)(mask).alias("_m"))
    return pixels.join(best, ["scene_id", "row", "col"]).withColumn(mask, F.col("_m")).drop("_m")


def open_mask(pixels: DataFrame, mask: str) -> DataFrame:
    return extreme_3x3(extreme_3x3(pixels, mask, False), mask, True)


def open_close(pixels: DataFrame, mask: str) -> DataFrame:
    """Opening, then closing."""
    return extreme_3x3(extreme_3x3(open_mask(pixels, mask), mask, True), mask, False)


def tile_starts(length: Column, tile: int = 256, stride: int = 224) -> Column:
    """Offsets of sliding tiles; the last one is shifted flush to the edge. One tile for short sides."""
    regular = F.sequence(F.lit(0), F.greatest(length - tile, F.lit(0)).cast("int"), F.lit(stride))
    return F.array_distinct(F.concat(regular, F.array(F.greatest(length - tile, F.lit(0)).cast("int"))))


def tiles(scenes: DataFrame, tile: int = 256, stride: int = 224) -> DataFrame:
    """Tiles of scenes (scene_id, height, width): offsets and valid sizes."""
    rows = scenes.select("scene_id", "height", "width", F.explode(tile_starts(F.col("height"), tile, stride)).alias("row_off"))
    both = rows.select("*", F.explode(tile_starts(F.col("width"), tile, stride)).alias("col_off"))
    return both.select("scene_id", "row_off", "col_off", F.least(F.lit(tile), F.col("height") - F.col("row_off")).alias("valid_h"), F.least(F.lit(tile), F.col("width") - F.col("col_off")).alias("valid_w"))


def stitch(probs: DataFrame) -> DataFrame:
    """Mean of the tiles' probabilities at each pixel; probs: scene_id, row_off, col_off, r, c, prob."""
    return probs.groupBy("scene_id", (F.col("row_off") + F.col("r")).alias("row"), (F.col("col_off") + F.col("c")).alias("col")).agg((F.sum("prob") / F.greatest(F.count("prob"), F.lit(1e-9))).alias("prob"))


def label_mask(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in raster order of their first pixels; 0 outside."""
    labels, runs, parent = np.zeros(mask.shape, np.int64), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    above: list[tuple[int, int, int]] = []
    for r, line in enumerate(mask):  # runs of a row join the runs of the row above that touch them
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(parent)
            parent.append(k)
            for x, y, j in above:
                if x <= b and a <= y:
                    i, j = root(k), root(j)
                    parent[max(i, j)] = min(i, j)
            here.append((a, b, k))
            runs.append((r, a, b, k))
        above = here
    number: dict[int, int] = {}
    for r, a, b, k in runs:
        labels[r, a:b] = number.setdefault(root(k), len(number) + 1)
    return labels


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each pixel with the first pixel, in raster order, of its part within the tile."""
    pdf = pdf.sort_values(["row", "col"])
    r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
    mask = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
    mask[r - r.min(), c - c.min()] = True
    _, first, part = np.unique(label_mask(mask)[r - r.min(), c - c.min()], return_index=True, return_inverse=True)
    return pdf.assign(p_row=r[first][part], p_col=c[first][part])[["scene_id", "row", "col", "p_row", "p_col"]]


def components(pixels: DataFrame, mask: str, min_pixels: int = 30, tile: int = TILE) -> DataFrame:
    """Pixels of the mask with the label of their component; those under ``min_pixels`` go, and the rest are numbered anew.

    Tiles of ``tile`` x ``tile`` pixels are labelled each in a group of its own, whatever the size of the scene. Parts that
    touch across tile borders are linked; a component goes by its first pixel, and components are numbered in that order.
    """
    on = pixels.where(mask).select(F.col("scene_id").cast("long"), F.col("row").cast("long"), F.col("col").cast("long"))
    square = [F.floor(F.col(c) / tile).alias(f"_{c}") for c in ("row", "col")]
    parts = kept(on.groupBy("scene_id", *square).applyInPandas(_label_tile, "scene_id long, row long, col long, p_row long, p_col long"), "parts")
    part = F.struct("scene_id", "p_row", "p_col")
    edge = F.lit(False)
    for c in ("row", "col"):
        edge = edge | F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = parts.where(edge).select("scene_id", "row", "col", part.alias("b"))
    ways = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = border.withColumn("w", ways).select("scene_id", (F.col("row") + F.col("w.x")).alias("row"), (F.col("col") + F.col("w.y")).alias("col"), F.col("b").alias("a"))
    found = smallest_reachable(near.join(border, ["scene_id", "row", "col"]).select("a", "b"))
    sizes = parts.groupBy(part.alias("node")).count().join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    whole = sizes.groupBy("root").agg(F.sum("count").alias("n")).where(F.col("n") >= min_pixels)
    # numbered within bands of rows, so that no task sees all components of a scene
    roots = whole.select("root", F.col("root.scene_id").alias("s"), F.floor(F.col("root.p_row") / tile).alias("band"))
    own = roots.withColumn("k", F.row_number().over(Window.partitionBy("s", "band").orderBy("root")))
    before = roots.groupBy("s", "band").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("s").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbers = own.join(before, ["s", "band"]).select("root", (F.col("before") + F.col("k")).cast("long").alias("label"))
    labels = sizes.select("node", "root").join(numbers, "root").select("node", "label")
    return parts.withColumn("node", part).join(labels, "node").select("scene_id", "row", "col", "label")


def blob_features(pixels: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """By scene and label: size, box, centroid, backscatter, texture, ratio, confidence.

    pixels: scene_id, label, row, col, vv_db, vh_db, local_var, prob. With the scene's size the box of a pixel more on
    each side, within the scene, comes too: box_top, box_bottom, box_left, box_right, all inside it.
    """
    raw = pixels.groupBy("scene_id", "label").agg(
        F.count("*").alias("pixel_count"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)],
        F.avg("row").alias("mean_row"), F.avg("col").alias("mean_col"), F.avg("vv_db").alias("mean_backscatter_db"), F.stddev_pop("vv_db").alias("texture_std_db"),
        F.avg("local_var").alias("texture_local_variance"), F.avg(F.col("vh_db") - F.col("vv_db")).alias("vh_vv_ratio_db"), F.avg("prob").alias("confidence"),
        ellipse_elongation(F.var_pop("row"), F.var_pop("col"), F.covar_pop("row", "col")).alias("elongation_ratio"),
    )
    if height is None or width is None:
        return raw
    low, high = (lambda c: F.greatest(F.col(c) - 1, F.lit(0))), (lambda c, n: F.least(F.col(c) + 1, F.lit(n - 1)))
    return raw.withColumns({"box_top": low("min_row"), "box_bottom": high("max_row", height), "box_left": low("min_col"), "box_right": high("max_col", width)})


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, x, y, to_x, to_y): the sides of pixels that have another label, or none, on the other side.

    A side points so that the pixel is at its right hand. That between two pixels of a label comes twice,
    and so goes; what is left grows with a blob's outline, not with its area.
    """
    x, y = F.col("col").cast("int"), F.col("row").cast("int")
    side = lambda a, b, c, d: F.struct((x + a).alias("x"), (y + b).alias("y"), (x + c).alias("to_x"), (y + d).alias("to_y"))
    sides = labelled.select("scene_id", "label", F.explode(F.array(side(0, 0, 1, 0), side(1, 0, 1, 1), side(1, 1, 0, 1), side(0, 1, 0, 0))).alias("e"))
    ends = [F.struct(F.col(f"e.{a}x").alias("x"), F.col(f"e.{a}y").alias("y")) for a in ("", "to_")]
    once = sides.groupBy("scene_id", "label", F.least(*ends).alias("low"), F.greatest(*ends).alias("high")).agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    return once.select("scene_id", "label", "e.*")


def simple_loops(ring: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The loops without repeated vertices that a ring falls into where it touches itself."""
    loops, path, place = [], [], {}
    for p in ring:
        if p in place:
            at = place[p]
            loops.append(path[at:])
            for q in path[at:]:
                del place[q]
            del path[at:]
        place[p] = len(path)
        path.append(p)
    return [*loops, path]


def corners(loop: np.ndarray) -> np.ndarray:
    """The vertices at which a loop turns."""
    before, after = loop - np.roll(loop, 1, axis=0), np.roll(loop, -1, axis=0) - loop
    return loop[before[:, 0] * after[:, 1] != before[:, 1] * after[:, 0]]


def parts_of(edges: np.ndarray) -> list[list[np.ndarray]]:
    """The parts of the area that the directed unit edges (x, y, to x, to y) of an outline enclose: a shell and its holes each, by their corners.

    Loops with the area at the right hand are shells, the others holes. A hole belongs to the ring that is met first from its
    leftmost side to the left, found for all of them in one order of the upright sides by row and column; if that is a
    hole too, to the same shell.
    """
    loops = [np.array(loop) for ring in outline_of(edges) for loop in simple_loops(ring)]
    ahead = [np.roll(p, -1, axis=0) for p in loops]
    hole = [(p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() < 0 for p, q in zip(loops, ahead, strict=True)]
    upright = [p[:, 0] == q[:, 0] for p, q in zip(loops, ahead, strict=True)]
    x = np.concatenate([p[v, 0] for p, v in zip(loops, upright, strict=True)])
    y = np.concatenate([np.minimum(p[v, 1], q[v, 1]) for p, q, v in zip(loops, ahead, upright, strict=True)])
    whose = np.repeat(np.arange(len(loops)), [v.sum() for v in upright])
    order = np.lexsort((x, y))
    left = np.empty(len(x), np.int64)
    left[order] = np.concatenate([[-1], whose[order][:-1]])
    owner = {k: k for k in range(len(loops)) if not hole[k]}
    first = np.full(len(loops), -1)
    by = np.lexsort((x, whose))
    first[whose[by][::-1]] = by[::-1]  # the leftmost side of each loop
    for k in sorted((k for k in range(len(loops)) if hole[k]), key=lambda k: x[first[k]]):
        owner[k] = owner[int(left[first[k]])]
    parts = {k: [corners(loops[k])] for k in range(len(loops)) if not hole[k]}
    for k in range(len(loops)):
        if hole[k]:
            parts[owner[k]].append(corners(loops[k]))
    return list(parts.values())


def blob_polygons(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, polygon): blobs with all their parts and holes, by the corners of pixels in columns (x) and rows (y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [[[{"x": float(a), "y": float(b)} for a, b in loop] for loop in part] for part in parts_of(pdf[["x", "y", "to_x", "to_y"]].to_numpy())]
        return pd.DataFrame([(pdf.scene_id.iloc[0], pdf.label.iloc[0], shape)], columns=["scene_id", "label", "polygon"])

    edges = boundary_edges(labelled).select(F.col("scene_id").cast("long").alias("scene_id"), F.col("label").cast("long").alias("label"), "x", "y", "to_x", "to_y")
    return edges.groupBy("scene_id", "label").applyInPandas(run, f"scene_id long, label long, polygon {POLYGON}")


OUTLINE_SCHEMA = f"scene_id long, label long, ring array<struct<x:double,y:double>>, vertices int, rings int, polygon {POLYGON}, lat double, lon double, area_km2 double"


def detections_from_blobs(labelled: DataFrame, top: float, left: float, lat_step: float, lon_step: float, most: int = 40, fraction: float = 0.012, crs: str | None = None) -> DataFrame:
    """Blobs as detections: polygon with all parts and holes, outline for display, centroid, area in km2 without the holes.

    ``labelled``: scene_id, label, row, col. A pixel's corner (col, row) lies at top - row * lat_step and left + col * lon_step,
    degrees of latitude and longitude, or northing and easting of ``crs``, a UTM zone; polygons, places and areas are those in
    degrees (EPSG:4326). ``polygon`` keeps every corner; ``ring`` is the longest shell, simplified to ``most`` vertices at most. Each
    blob's outline is one group.
    """
    zone = None if crs is None or crs.upper() in ("EPSG:4326", "OGC:CRS84") else utm_zone(crs)
    if crs is not None and crs.upper() not in ("EPSG:4326", "OGC:CRS84") and zone is None:
        raise ValueError(f"coordinates in {crs} aren't supported")
    names = ["scene_id", "label", "ring", "vertices", "rings", "polygon", "lat", "lon", "area_km2"]

    def lonlat(loop: np.ndarray) -> np.ndarray:
        x, y = left + loop[:, 0] * lon_step, top - loop[:, 1] * lat_step
        return np.column_stack([x, y] if zone is None else lonlat_of_utm(x, y, *zone))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [[lonlat(loop.astype(float)) for loop in part] for part in parts_of(pdf[["x", "y", "to_x", "to_y"]].to_numpy())]
        role = [(1 if k == 0 else -1, loop) for part in parts for k, loop in enumerate(part)]
        planar = [(k * abs(a), x, y) for k, loop in role for a, x, y in [_planar(loop)]]
        whole = sum(a for a, *_ in planar)
        lon, lat = (sum(p[0] * p[k] for p in planar) / whole for k in (1, 2))
        area = sum(k * polygon_area_km2(loop[:, 0], loop[:, 1]) for k, loop in role)
        ring = simplify(max((part[0] for part in parts), key=lambda r: abs(_planar(r)[0])), most, fraction)
        points = lambda loop: [{"x": float(a), "y": float(b)} for a, b in loop]
        return pd.DataFrame([(pdf.scene_id.iloc[0], pdf.label.iloc[0], points(ring), len(ring), len(role), [[points(loop) for loop in part] for part in parts], lat, lon, area)], columns=names)

    edges = boundary_edges(labelled).select(F.col("scene_id").cast("long").alias("scene_id"), F.col("label").cast("long").alias("label"), "x", "y", "to_x", "to_y")
    return edges.groupBy("scene_id", "label").applyInPandas(run, OUTLINE_SCHEMA)


def _planar(ring: np.ndarray) -> tuple[float, float, float]:
    """Signed area and centroid (x, y) of a ring, computed about its first vertex."""
    x, y = (ring - ring[0]).T
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    area = cross.sum() / 2
    return float(area), float(ring[0, 0] + ((x + nx) * cross).sum() / (6 * area)), float(ring[0, 1] + ((y + ny) * cross).sum() / (6 * area))


def ellipse_elongation(var_row: Column, var_col: Column, cov: Column) -> Column:
    """Axis ratio of the ellipse with the same moments; null (infinite) for a line, 1 for a single pixel."""
    mid, half = (var_row + var_col) / 2, F.sqrt(F.pow((var_row - var_col) / 2, 2) + cov * cov)
    major, minor = 4 * F.sqrt(F.greatest(mid + half, F.lit(0.0))), 4 * F.sqrt(F.greatest(mid - half, F.lit(0.0)))
    return F.when(minor < 1e-6, F.when(major > 1e-6, F.lit(None)).otherwise(1.0)).otherwise(major / F.when(minor < 1e-6, 1.0).otherwise(minor))


def primary_uv(mask_pixels: DataFrame, mask: str, height: int, width: int) -> DataFrame:
    """By scene, the centroid of the largest component of the opened mask as shares of the width (u) and height (v)."""
    labelled = components(open_mask(mask_pixels, mask), mask, 1)
    return primary_component(labelled, 1).select("scene_id", (F.col("mean_col") / (width - 1)).alias("u"), (F.col("mean_row") / (height - 1)).alias("v"))


def primary_component(labelled: DataFrame, min_pixels: int = 60) -> DataFrame:
    """The largest component of each scene if it has ``min_pixels``, the first on a tie."""
    sizes = labelled.groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.avg("row").alias("mean_row"), F.avg("col").alias("mean_col"))
    return sizes.withColumn("_r", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("n"), "label"))).where(f"_r = 1 and n >= {min_pixels}").drop("_r")


def outline(rows: np.ndarray, cols: np.ndarray) -> list[list[tuple[int, int]]]:
    """The boundary rings of a set of pixels as corner points (col, row); holes are rings of their own."""
    on, edges = set(zip(rows.tolist(), cols.tolist(), strict=True)), []
    for r, c in sorted(on):
        for inside, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if inside not in on:
                edges.append((*a, *b))
    return outline_of(np.array(edges, int).reshape(-1, 4))


def outline_of(edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """The rings that directed edges (x, y, to x, to y) make, each pixel at their right hand; where two pixels touch in a corner the rings part."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in edges.tolist():
        ahead.setdefault((a, b), []).append((c, d))
    rings, starts = [], iter(sorted(ahead))
    for start in starts:
        while start in ahead:
            ring, at, came = [start], start, (0, 0)
            while True:
                ways = ahead[at]
                # at a corner where four edges meet, turn right to stay with the same pixel
                k = max(range(len(ways)), key=lambda i: came[0] * (ways[i][1] - at[1]) - came[1] * (ways[i][0] - at[0]))
                to = ways.pop(k)
                if not ways:
                    del ahead[at]
                came, at = (to[0] - at[0], to[1] - at[1]), to
                if at == start:
                    break
                ring.append(at)
            rings.append(ring)
    return rings


def variants(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Rotated by 90 degrees counter-clockwise, flipped left to right, and turned by 180 degrees."""
    r, c = F.col("row"), F.col("col")
    forms = {"rot90": (width - 1 - c, r), "fliplr": (r, width - 1 - c), "rot180": (height - 1 - r, width - 1 - c)}
    each = [pixels.withColumns({"variant": F.lit(k), "row": a, "col": b}) for k, (a, b) in forms.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def mask_scores(pixels: DataFrame, truth: str, prob: str, sample: str = "scene_id", smooth: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """By sample: soft dice, IoU at the threshold (a strict one) and mean binary cross-entropy."""
    p, y = F.col(prob), F.col(truth).cast("double")
    hit = (p > threshold).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    sums = pixels.groupBy(sample).agg(
        ((2 * F.sum(p * y) + smooth) / (F.sum(p) + F.sum(y) + smooth)).alias("dice"),
        ((F.sum(hit * y) + 1e-7) / (F.sum(hit) + F.sum(y) - F.sum(hit * y) + 1e-7)).alias("iou"),
        F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("bce"),
    )
    return sums


def class_balance(pixels: DataFrame, label: str) -> DataFrame:
    counts = pixels.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(label, "n", (100.0 * F.col("n") / F.col("all")).alias("pct"))


def segment(tiles_df: DataFrame, model, schema: str) -> DataFrame:
    """Hook for a segmentation model: ``model`` maps a pandas frame of tiles to one of probabilities."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield model(frame)

    return tiles_df.mapInPandas(run, schema)


__all__ = [
    "binarize", "blob_features", "blob_polygons", "boundary_edges", "box_means", "box_sums", "calibrate", "class_balance", "components", "detections_from_blobs", "ellipse_elongation", "extreme_3x3", "label_mask", "land_masked", "land_spans", "lee_filter", "local_variance", "mask_scores", "open_close", "open_mask", "outline", "outline_of", "parts_of", "primary_component", "primary_uv", "segment", "stitch", "tile_starts", "tiles", "to_byte", "to_db", "variants", "water_mask",
]
