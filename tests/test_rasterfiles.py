"""TIFF and NetCDF files, written here by hand, read to the same values, whole or in parts."""

import struct
import zlib

import numpy as np
import pytest

from driftlode.operators import chunked
from driftlode.sources import rasterfiles


def tiff(path, pixels, tile=None, rows=3, deflate=False, predictor=1, apart=False, order="<", geo=True, big=False):
    """A TIFF of rows x columns x bands."""
    h, w, bands = pixels.shape
    data, at, sizes = b"", [], []
    cw, ch = (tile, tile) if tile else (w, rows)
    planes = [pixels[:, :, k : k + 1] for k in range(bands)] if apart else [pixels]
    for p in planes:
        for y in range(0, h, ch):
            for x in range(0, w, cw):
                c = p[y : y + ch, x : x + cw]
                if tile:
                    c = np.pad(c, ((0, ch - c.shape[0]), (0, cw - c.shape[1]), (0, 0)))
                if predictor == 2:
                    c = np.concatenate([c[:, :1], np.diff(c, axis=1)], axis=1)
                raw = np.ascontiguousarray(c.astype(c.dtype.newbyteorder(order))).tobytes()
                raw = zlib.compress(raw) if deflate else raw
                at.append(16 + len(data))
                sizes.append(len(raw))
                data += raw
    kind = {"f": 3, "u": 1, "i": 2}[pixels.dtype.kind]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [8 * pixels.itemsize] * bands), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 284: ("H", [2 if apart else 1]), 317: ("H", [predictor]), 339: ("H", [kind] * bands)}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", at), 325: ("I", sizes)} if tile else {273: ("I", at), 278: ("I", [rows]), 279: ("I", sizes)}
    if geo:
        tags |= {33550: ("d", [100.0, 50.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 444_000.0, 3_685_000.0, 0.0]), 34735: ("H", [1, 1, 0, 1, 3072, 0, 1, 32638])}
    entries, more, start = b"", b"", 16 + len(data)
    code, wide = {"H": 3, "I": 4, "d": 12}, (8 if big else 4)
    table = start + ((8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4))
    for tag in sorted(tags):
        form, values = tags[tag]
        raw = struct.pack(order + form * len(values), *values)
        head = struct.pack(order + ("HHQ" if big else "HHI"), tag, code[form], len(values))
        if len(raw) <= wide:
            entries += head + raw.ljust(wide, b"\0")
        else:
            entries += head + struct.pack(order + ("Q" if big else "I"), table + len(more))
            more += raw
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start)).ljust(14, b"\0")
    count = struct.pack(order + ("Q" if big else "H"), len(tags))
    path.write_bytes(head + data + count + entries + bytes(8 if big else 4) + more)


CASES = {
    "strips": {},
    "tiles": {"tile": 16},
    "deflated strips of other order": {"deflate": True, "order": ">"},
    "differences": {"deflate": True, "predictor": 2, "dtype": "u2"},
    "bands apart": {"apart": True, "dtype": "f8"},
    "tiles apart, big": {"apart": True, "tile": 16, "big": True, "dtype": "i2"},
}


@pytest.mark.parametrize("case", CASES)
def test_tiff_scenes(spark, tmp_path, case):
    how = dict(CASES[case])
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 3000, (37, 21, 2)).astype(how.pop("dtype", "f4"))
    tiff(tmp_path / "scene_a.tif", pixels, **how)
    rasterfiles.register(spark)
    whole = spark.read.format("scene_tiff").option("bands", "vv,vh").load(str(tmp_path / "scene_a.tif"))
    parts = spark.read.format("scene_tiff").option("bands", "vv,vh").option("partbytes", "700").load(str(tmp_path))
    assert parts.rdd.getNumPartitions() > 2 >= whole.rdd.getNumPartitions()
    for table in (whole, parts):
        rows = table.collect()
        got = np.full(pixels.shape, -1.0)
        for r in rows:
            got[r.row, r.col] = r.vv, r.vh
        assert len(rows) == 37 * 21 and (got == pixels).all() and rows[0].scene_id == "scene_a"
    (head,) = rasterfiles.scene_headers(f"file://{tmp_path}")
    assert (head["width"], head["height"], head["bands"], head["crs"]) == (21, 37, 2, "EPSG:32638") and (head["top"], head["left"], head["step_y"], head["step_x"]) == (3_685_000.0, 444_000.0, 50.0, 100.0)


def test_rows_beyond_the_bounds_are_not_read(spark, tmp_path):
    tiff(tmp_path / "a.tif", np.arange(40 * 5, dtype="u1").reshape(40, 5, 1), rows=4)
    rasterfiles.register(spark)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    table = spark.read.format("scene_tiff").option("partbytes", "1").option("pushdown", "true").load(str(tmp_path)).where("row >= 9 and row < 14")
    assert table.rdd.getNumPartitions() == 2 and sorted({r.row for r in table.collect()}) == [9, 10, 11, 12, 13]  # strips 8 to 11 and 12 to 15
    spark.conf.set(name, before)


def test_wrong_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no image at all, but long enough")
    (tmp_path / "b.nc").write_bytes(b"HDF nothing of the kind")
    rasterfiles.register(spark)
    for kind, name, said in (("scene_tiff", "a.tif", "no TIFF file"), ("field_netcdf", "b.nc", "no classic NetCDF file"), ("scene_tiff", "none", "has no file")):
        with pytest.raises(Exception, match=said):
            spark.read.format(kind).load(str(tmp_path / name)).collect()
    tiff(tmp_path / "a.tif", np.zeros((3, 3, 1), "f4"))
    with pytest.raises(Exception, match="1 bands, 2 were asked for"):
        spark.read.format("scene_tiff").option("bands", "vv,vh").load(str(tmp_path / "a.tif")).collect()


def netcdf(path, t, lat, lon, u, v, record=True, version=2, depth=False):
    """A classic file of packed currents (scale 0.01, -999 missing), with time as the record dimension or a fixed one."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    text = lambda k, s: name(k) + struct.pack(">ii", 2, len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    value = lambda k, kind, form, x: name(k) + struct.pack(">ii", kind, 1) + struct.pack(form, x).ljust(-(-struct.calcsize(form) // 4) * 4, b"\0")
    attrs = lambda *a: struct.pack(">ii", 12, len(a)) + b"".join(a) if a else struct.pack(">ii", 0, 0)
    dims = [("time", 0 if record else len(t)), ("depth", 1), ("latitude", len(lat)), ("longitude", len(lon))]
    shape = (0, 1, 2, 3) if depth else (0, 2, 3)
    packed = {n: np.where(np.isnan(x), -999, np.round(x / 0.01)).astype(">i2") for n, x in (("uo", u), ("vo", v))}
    pad = lambda b: b.ljust(-(-len(b) // 4) * 4, b"\0")
    parts = [("latitude", (2,), 6, attrs(), np.asarray(lat, ">f8").tobytes(), None), ("longitude", (3,), 5, attrs(), np.asarray(lon, ">f4").tobytes(), None), ("time", (0,), 6, attrs(text("units", "hours since 2024-01-01 00:00:00")), None, [struct.pack(">d", x) for x in t])]
    parts += [(n, shape, 3, attrs(value("scale_factor", 6, ">d", 0.01), value("_FillValue", 3, ">h", -999)), None, [p.tobytes() for p in packed[n]]) for n in ("uo", "vo")]
    offset = ">q" if version == 2 else ">i"
    head = b"CDF" + bytes([version]) + struct.pack(">i", len(t) if record else 0) + struct.pack(">ii", 10, 4) + b"".join(name(n) + struct.pack(">i", k) for n, k in dims) + attrs(text("title", "made by hand")) + struct.pack(">ii", 11, len(parts))
    size = len(head) + sum(len(name(n)) + 4 + 4 * len(d) + len(a) + 8 + struct.calcsize(offset) for n, d, _, a, *_ in parts)
    at, fixed, rec = size, b"", []
    begins = {}
    for n, _, _, _, whole, each in parts:
        if whole is not None or not record:
            body = pad(whole if whole is not None else b"".join(each))
            begins[n], at, fixed = at, at + len(body), fixed + body
        else:
            rec.append((n, [pad(e) for e in each]))
    for n, each in rec:
        begins[n], at = at, at + len(each[0])
    for n, d, kind, a, whole, each in parts:
        vsize = len(pad(whole if whole is not None else (each[0] if record else b"".join(each))))
        head += name(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", x) for x in d) + a + struct.pack(">ii", kind, vsize) + struct.pack(offset, begins[n])
    path.write_bytes(head + fixed + b"".join(each[k] for k in range(len(t)) for _, each in rec))


@pytest.mark.parametrize(("record", "version", "depth"), [(True, 2, False), (False, 1, True), (True, 1, True)])
def test_netcdf_fields(spark, tmp_path, record, version, depth):
    rng = np.random.default_rng(2)
    t, lat, lon = [0.0, 1.0, 2.0, 3.0], [29.0, 28.75, 28.5], [-89.5, -89.25, -89.0, -88.75, -88.5]
    u, v = rng.integers(-200, 200, (2, 4, 3, 5)) / 100
    u[1, 2, 3] = np.nan
    netcdf(tmp_path / "f.nc", t, lat, lon, u, v, record, version, depth)
    rasterfiles.register(spark)
    for options in ({}, {"partbytes": "300"}):
        table = spark.read.format("field_netcdf").options(**options).load(str(tmp_path))
        assert table.rdd.getNumPartitions() == (4 if options else 1)
        got = {(r.t, r.lat, r.lon): (r.u, r.v) for r in table.collect()}
        want = {(1704067200.0 + 3600 * t[k], lat[i], lon[j]): (None if np.isnan(u[k, i, j]) else u[k, i, j], v[k, i, j]) for k in range(4) for i in range(3) for j in range(5)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    axes = chunked.axes_of(table)
    assert axes.n == (4, 3, 5) and axes.step == pytest.approx((3600.0, 0.25, 0.25))
    with pytest.raises(Exception, match="no u10"):
        spark.read.format("field_netcdf").option("u", "u10").load(str(tmp_path)).collect()
