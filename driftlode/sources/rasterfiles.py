"""Readers of open raster formats as Spark data sources: TIFF scenes and classic NetCDF fields, in parts of files.

``register`` makes the formats ``scene_tiff`` and ``field_netcdf`` known to a session. A partition is a run of strips, tiles or times of one
file, read as byte ranges through Arrow's file systems; no task reads a file as a whole, and the driver reads headers only. With the
option ``pushdown`` bounds on ``row`` or ``t`` leave out the parts of a file beyond them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

PART_BYTES = 16 << 20  # of a file that one partition reads, about
ROWS = 1 << 16  # of a batch


def files_of(path: str, endings: tuple[str, ...]) -> list[tuple[fs.FileSystem, str]]:
    """The files at comma-separated paths or URIs; of a folder those with one of the endings, in order."""
    out = []
    for one in path.split(","):
        store, at = fs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (fs.LocalFileSystem(), one)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.path.lower().endswith(endings))
        else:
            found = [at]
        if not found or info.type == fs.FileType.NotFound:
            raise ValueError(f"{one} has no file")
        out += [(store, f) for f in found]
    return out


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class Bounds:
    """The least and the largest value that pushed filters leave to one column."""

    def __init__(self, column: str) -> None:
        self.column, self.low, self.high = column, -np.inf, np.inf

    def take(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """All filters stay Spark's to apply; the bounds only spare reading."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,) and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f

    def meets(self, low: float, high: float) -> bool:
        return low <= self.high and high >= self.low


# TIFF. The numbers of tags, field types and keys of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GEOGRAPHIC, PROJECTED = 33550, 33922, 34735, 2048, 3072
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "B", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d", 16: "Q"}


@dataclass(frozen=True)
class Tiff:
    """What a file's first directory says; ``chunks``: (band or -1, first row, first column, offset, bytes) of its strips or tiles."""

    width: int
    height: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    chunk_width: int
    chunk_height: int
    chunks: tuple[tuple[int, int, int, int, int], ...]
    top: float
    left: float
    step_y: float
    step_x: float
    crs: str | None


def read_tags(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first directory, of classic and big files."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("this is no TIFF file")
    big = version == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    count_kind, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    size = struct.calcsize(order + count_kind)
    n = struct.unpack(order + count_kind, f.read_at(size, at))[0]
    rows, tags = f.read_at(entry * n, at + size), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), rows[entry * k : entry * k + entry - inline])
        if kind not in FIELD_TYPES:
            continue
        form = FIELD_TYPES[kind]
        each = struct.calcsize(order + form)
        value = rows[entry * (k + 1) - inline : entry * (k + 1)]
        data = value[: each * count] if each * count <= inline else f.read_at(each * count, struct.unpack(order + ("Q" if big else "I"), value)[0])
        tags[tag] = struct.unpack(order + form * count, data)
    return order, tags


def read_tiff(f) -> Tiff:
    """The header; an error for what isn't read: other compressions than none and deflate, bits that differ, rotated grids."""
    order, tags = read_tags(f)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, form = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((form.pop(), bits.pop()))
    if kind is None or bits or form or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2) or (one(PREDICTOR, 1) == 2 and kind[0] == "f"):
        raise ValueError("samples or a compression of a kind that isn't read")
    tiled = TILE_AT in tags
    cw, ch = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across, down = -(-width // cw), -(-height // ch)
    apart = one(PLANAR, 1) == 2
    places = zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE], strict=True)
    chunks = tuple((k // (across * down) if apart else -1, k % (across * down) // across * ch, k % across * cw, at, n) for k, (at, n) in enumerate(places))
    scale, tie = tags.get(PIXEL_SCALE, (1.0, -1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6)
    keys = tags.get(GEO_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = known.get(PROJECTED, known.get(GEOGRAPHIC))
    return Tiff(width, height, samples, order + kind, one(COMPRESSION, 1), one(PREDICTOR, 1), cw, ch, chunks, tie[4] + tie[1] * scale[1], tie[3] - tie[0] * scale[0], scale[1], scale[0], f"EPSG:{code}" if code and code != 32767 else None)


def chunk_of(tiff: Tiff, data: bytes) -> np.ndarray:
    """A strip or tile as rows x columns x samples."""
    raw = zlib.decompress(data) if tiff.compression != 1 else data
    samples = 1 if any(c[0] >= 0 for c in tiff.chunks) else tiff.samples
    rows = len(raw) // (tiff.chunk_width * samples * np.dtype(tiff.dtype).itemsize)
    out = np.frombuffer(raw, tiff.dtype, rows * tiff.chunk_width * samples).reshape(rows, tiff.chunk_width, samples)
    return np.cumsum(out, axis=1, dtype=out.dtype) if tiff.predictor == 2 else out


class _Part(ds.InputPartition):
    def __init__(self, file: int, first: int, last: int) -> None:
        super().__init__((file, first, last))


def runs(sizes: list[int], wanted: list[bool], most: int) -> Iterator[tuple[int, int]]:
    """Runs of wanted neighbours of about ``most`` bytes."""
    first, held = None, 0
    for k, (n, on) in enumerate(zip(sizes, wanted, strict=True)):
        if first is not None and (not on or held + n > most):
            yield first, k
            first, held = None, 0
        if on:
            first = k if first is None else first
            held += n
    if first is not None:
        yield first, len(sizes)


class TiffReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema, self.bounds = options["path"], schema, Bounds("row")
        self.most = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[ds.InputPartition]:
        out = []
        for k, (store, path) in enumerate(files_of(self.path, (".tif", ".tiff"))):
            with store.open_input_file(path) as f:
                tiff = read_tiff(f)
            apart = len({c[0] for c in tiff.chunks})
            plane = tiff.chunks[: len(tiff.chunks) // apart]  # those of the other bands go with the first one's
            wanted = [self.bounds.meets(c[1], c[1] + tiff.chunk_height - 1) for c in plane]
            out += [_Part(k, a, b) for a, b in runs([c[4] * apart for c in plane], wanted, self.most)]
        return out

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        file, first, last = partition.value
        store, path = files_of(self.path, (".tif", ".tiff"))[file]
        with store.open_input_file(path) as f:
            tiff = read_tiff(f)
            per = len(tiff.chunks) // len({c[0] for c in tiff.chunks})
            for k in range(first, last):
                mine = [tiff.chunks[j] for j in range(k, len(tiff.chunks), per)]
                pixels = np.concatenate([chunk_of(tiff, f.read_at(n, at)) for *_, at, n in mine], axis=2)
                _, top, left, *_ = mine[0]
                pixels = pixels[: tiff.height - top, : tiff.width - left]
                rows, cols = (a.ravel() for a in np.mgrid[top : top + pixels.shape[0], left : left + pixels.shape[1]])
                values = pixels.reshape(-1, pixels.shape[2]).astype(float)
                for at in range(0, len(rows), ROWS):
                    part = slice(at, at + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([stem(path)] * len(rows[part])), pa.array(rows[part], pa.int32()), pa.array(cols[part], pa.int32()), *(pa.array(np.ascontiguousarray(values[part, b])) for b in range(len(self.schema) - 3))], names=self.schema.names)


class _Pushed:
    """With the option ``pushdown``: bounds on a column leave out parts of files. Spark asks for the setting
    spark.sql.python.filterPushdown.enabled then.
    """

    bounds: Bounds

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return self.bounds.take(filters)


def pushed(options: dict) -> bool:
    return str(options.get("pushdown", "false")).lower() == "true"


class PushedTiffReader(_Pushed, TiffReader):
    pass


class SceneTiff(ds.DataSource):
    """scene_id (the file's stem), row, col and a column for each band; ``bands`` names them, else band_1 and so on."""

    @classmethod
    def name(cls) -> str:
        return "scene_tiff"

    def schema(self) -> StructType:
        store, path = files_of(self.options["path"], (".tif", ".tiff"))[0]
        with store.open_input_file(path) as f:
            n = read_tiff(f).samples
        names = self.options["bands"].split(",") if "bands" in self.options else [f"band_{k + 1}" for k in range(n)]
        if len(names) > n:
            raise ValueError(f"{path} has {n} bands, {len(names)} were asked for")
        return StructType([StructField("scene_id", StringType()), StructField("row", IntegerType()), StructField("col", IntegerType()), *(StructField(b, DoubleType()) for b in names)])

    def reader(self, schema: StructType) -> TiffReader:
        options = dict(self.options)
        return (PushedTiffReader if pushed(options) else TiffReader)(options, schema)


def scene_headers(path: str) -> list[dict]:
    """Of each file at ``path``: scene_id, width, height, bands, crs and its place: top, left, step_y, step_x."""
    out = []
    for store, name in files_of(path, (".tif", ".tiff")):
        with store.open_input_file(name) as f:
            t = read_tiff(f)
        out.append({"scene_id": stem(name), "width": t.width, "height": t.height, "bands": t.samples, "crs": t.crs, "top": t.top, "left": t.left, "step_y": t.step_y, "step_x": t.step_x})
    return out


# Classic NetCDF. Types and tags of the format.
NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
UNIT_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


@dataclass(frozen=True)
class Variable:
    dims: tuple[int, ...]
    attributes: dict
    dtype: str
    begin: int
    record: bool


@dataclass(frozen=True)
class NetCDF:
    dims: tuple[tuple[str, int], ...]
    variables: dict[str, Variable]
    records: int
    record_size: int

    def shape(self, name: str) -> tuple[int, ...]:
        v = self.variables[name]
        return tuple(self.records if v.record and k == 0 else self.dims[d][1] for k, d in enumerate(v.dims))

    def values(self, f, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """Those of the first axis from ``first`` to before ``last``, unpacked; NaN where they lack."""
        v, shape = self.variables[name], self.shape(name)
        last = shape[0] if last is None else last
        each = int(np.prod(shape[1:], dtype=int)) * np.dtype(v.dtype).itemsize
        if v.record:
            raw = b"".join(f.read_at(each, v.begin + k * self.record_size) for k in range(first, last))
        else:
            raw = f.read_at(each * (last - first), v.begin + first * each)
        packed = np.frombuffer(raw, v.dtype).reshape(last - first, *shape[1:])
        out = packed.astype(float)
        for key in ("_FillValue", "missing_value"):
            if key in v.attributes:
                out[packed == np.asarray(v.attributes[key], v.dtype).ravel()[0]] = np.nan
        scale, offset = (float(np.ravel(v.attributes.get(k, d))[0]) for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset

    def seconds(self, f, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """Times as seconds since 1970, from units such as "hours since 1950-01-01"."""
        unit, _, since = self.variables[name].attributes.get("units", "seconds since 1970-01-01").partition(" since ")
        start = datetime.fromisoformat(since.strip().removesuffix("UTC").strip().replace("Z", "+00:00"))
        start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
        return self.values(f, name, first, last) * UNIT_SECONDS[unit.strip().lower().rstrip("s")] + start.timestamp()


def read_netcdf(f) -> NetCDF:
    """The header of a file of version 1 or 2 (64-bit offsets)."""
    data, at = f.read_at(min(f.size(), 1 << 20), 0), 8
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("this is no classic NetCDF file")

    def number(form: str = ">i") -> int:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += -(-n // 4) * 4
        return data[at - -(-n // 4) * 4 :][:n].decode()

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            name, kind, n = text(), number(), number()
            size = n * np.dtype(NC_TYPES[kind]).itemsize
            raw, at = data[at : at + size], at + -(-size // 4) * 4
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, NC_TYPES[kind])
        return out

    records = struct.unpack(">i", data[4:8])[0]
    number()
    dims = tuple((text(), number()) for _ in range(number()))
    attributes()
    number()
    variables, sizes = {}, []
    for _ in range(number()):
        name = text()
        ids = tuple(number() for _ in range(number()))
        attrs, kind, size = attributes(), number(), number()
        record = bool(ids) and dims[ids[0]][1] == 0
        variables[name] = Variable(ids, attrs, NC_TYPES[kind], number(">q" if data[3] == 2 else ">i"), record)
        if record:
            sizes.append((size, name))
    one = len(sizes) == 1  # the records of an only one aren't padded
    total = int(np.prod([dims[d][1] for d in variables[sizes[0][1]].dims[1:]], dtype=int)) * np.dtype(variables[sizes[0][1]].dtype).itemsize if one else sum(n for n, _ in sizes)
    return NetCDF(dims, variables, records, total)


class NetCDFReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bounds, self.most = options["path"], Bounds("t"), int(options.get("partbytes", PART_BYTES))
        self.names = {k: options.get(k, d) for k, d in (("u", "uo"), ("v", "vo"), ("lat", "latitude"), ("lon", "longitude"), ("time", "time"))}

    def partitions(self) -> list[ds.InputPartition]:
        out = []
        for k, (store, path) in enumerate(files_of(self.path, (".nc",))):
            with store.open_input_file(path) as f:
                nc = read_netcdf(f)
                if lacks := [n for n in self.names.values() if n not in nc.variables]:
                    raise ValueError(f"{path} has no {', '.join(lacks)}, but {', '.join(nc.variables)}")
                t = nc.seconds(f, self.names["time"])
            each = 16 * int(np.prod(nc.shape(self.names["u"])[1:], dtype=int))
            out += [_Part(k, a, b) for a, b in runs([each] * len(t), [self.bounds.meets(x, x) for x in t], self.most)]
        return out

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        file, first, last = partition.value
        store, path = files_of(self.path, (".nc",))[file]
        with store.open_input_file(path) as f:
            nc = read_netcdf(f)
            lat, lon = (nc.values(f, self.names[c]) for c in ("lat", "lon"))
            for k in range(first, last):
                t = float(nc.seconds(f, self.names["time"], k, k + 1)[0])
                u, v = (self.plane(nc, f, self.names[c], k, len(lat), len(lon)) for c in "uv")
                for at in range(0, len(u), ROWS):
                    n = np.arange(at, min(at + ROWS, len(u)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t)), pa.array(lat[n // len(lon)]), pa.array(lon[n % len(lon)]), *(pa.array(x[n], mask=np.isnan(x[n])) for x in (u, v))], names=["t", "lat", "lon", "u", "v"])

    @staticmethod
    def plane(nc: NetCDF, f, name: str, k: int, n_lat: int, n_lon: int) -> np.ndarray:
        """The values of one time; of several depths the first."""
        got = nc.values(f, name, k, k + 1)
        return got.reshape(-1, n_lat * n_lon)[0]


class PushedNetCDFReader(_Pushed, NetCDFReader):
    pass


class FieldNetCDF(ds.DataSource):
    """t (seconds since 1970), lat, lon, u, v; the options u, v, lat, lon and time name other variables. Missing values are null."""

    @classmethod
    def name(cls) -> str:
        return "field_netcdf"

    def schema(self) -> str:
        return "t double, lat double, lon double, u double, v double"

    def reader(self, schema: StructType) -> NetCDFReader:
        options = dict(self.options)
        return (PushedNetCDFReader if pushed(options) else NetCDFReader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SceneTiff)
    spark.dataSource.register(FieldNetCDF)
