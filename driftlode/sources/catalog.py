"""Scene catalogs, metadata, splits, event documents and where fields come from."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_scene(spark: SparkSession, path: str, bands: tuple[str, ...] = ("vv", "vh")) -> DataFrame:
    """A scene's pixel table (scene_id, row, col and a column for each band); an error if a band lacks. Bands are single precision."""
    table = spark.read.parquet(path)
    lacks = [c for c in ("scene_id", "row", "col", *bands) if c not in table.columns]
    if lacks:
        raise ValueError(f"{path} has no {', '.join(lacks)}; a scene has {len(bands)} bands")
    return table.withColumns({c: F.col(c).cast("float") for c in bands})


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files beside scenes, with the scene's stem."""
    return spark.read.schema("timestamp_utc string, satellite_pass_id string, incidence_angle double").option("multiLine", True).json(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """XML rows of sample_id and split, trimmed and in lower case."""
    rows = spark.read.format("xml").option("rowTag", "sample").schema("sample_id string, split string").load(path)
    return rows.select(F.trim("sample_id").alias("sample_id"), F.lower(F.trim("split")).alias("split"))


def read_detections(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The records of JSON files of an array ``detections``, in order; only the first so many if asked for."""
    rows = spark.read.option("multiLine", True).json(path).select(F.posexplode("detections").alias("seq", "d")).select("seq", "d.*")
    return rows if first is None else rows.where(F.col("seq") < first)


def read_wind_cache(spark: SparkSession, path: str) -> DataFrame:
    """Wind records, from a JSON list or from an object with ``records``."""
    record = "struct<lat:double,lon:double,timestamp_utc:string,wind_speed_ms:double>"
    text = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{record}>")).otherwise(F.from_json("value", f"struct<records:array<{record}>>")["records"])
    return text.select(F.posexplode(listed).alias("seq", "r")).select("seq", "r.*")


def resolve_metadata(scenes: DataFrame) -> DataFrame:
    """Time and pass: override, else sidecar, else tag; empty strings fall through, a missing one is an error.

    The incidence angle takes the first that isn't null. Columns: o_*, s_* and t_* of each.
    """
    first = lambda c: F.coalesce(*[F.nullif(F.col(f"{k}_{c}"), F.lit("")) for k in "ost"])
    need = lambda c: F.coalesce(first(c), F.raise_error(F.lit(f"no {c}")).cast("string"))
    return scenes.select("scene_id", need("timestamp").alias("timestamp"), need("pass_id").alias("pass_id"), F.coalesce("o_incidence", "s_incidence", "t_incidence").alias("incidence_angle"))


def scene_list(scenes: DataFrame) -> DataFrame:
    """Catalog rows with their defaults: title is the id, subtitle empty."""
    return scenes.select("scene_id", F.coalesce("title", F.col("scene_id").cast("string")).alias("title"), F.coalesce("subtitle", F.lit("")).alias("subtitle"), F.concat(F.lit("/api/scenes/"), F.col("scene_id").cast("string"), F.lit("/image")).alias("image_url"))


SHOWN = 20


def scene_by_id(scenes: DataFrame, scene_id) -> DataFrame:
    """The one scene. If there is none, an error that tells how many there are and the first SHOWN ids."""
    got = scenes.where(F.col("scene_id") == scene_id)
    if got.isEmpty():
        known = [r[0] for r in scenes.select("scene_id").orderBy("scene_id").limit(SHOWN).collect()]
        raise KeyError(f"no scene {scene_id!r}; {scenes.count()} known, the first of them: {known}")
    return got


def without_id(table: DataFrame) -> DataFrame:
    """A collection as it is served: without the store's own ``_id``."""
    return table.drop("_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with every field of ``new`` set in rows of its keys, nulls too; fields it lacks stay, and new keys are added.

    A key that ``new`` repeats is an error when the result is read, as it can't be told which of the rows holds; repeated keys of
    ``old`` are all updated. Rows of ``new`` with a null key are added as they are. No column name is reserved.
    """
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    once = F.when(F.count("*").over(Window.partitionBy(F.col(f"`{key}`"))) > 1, F.raise_error(F.concat(F.lit("a key comes twice in the new rows: "), F.col(f"`{key}`").cast("string"))).cast("boolean")).otherwise(True)
    keyed = new.where(F.col(f"`{key}`").isNotNull())
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    a = old.select(F.col(f"`{key}`").alias("k"), whole(old).alias("a"))
    b = keyed.select(F.col(f"`{key}`").alias("k"), whole(keyed).alias("b"), once.alias("once"))
    both = a.join(b, "k", "full")

    def value(c: str) -> Column:
        mine = F.col("a").getField(c) if c in old.columns else F.lit(None)
        return (F.when(F.col("once"), F.col("b").getField(c)).otherwise(mine) if c in new.columns else mine).alias(c)

    loose = new.where(F.col(f"`{key}`").isNull())
    return both.select(*map(value, names)).unionByName(loose, allowMissingColumns=True)


def assign_splits(samples: DataFrame, splits: DataFrame, val_percent: int = 10) -> DataFrame:
    """Each sample's split from the map (train, val or validation, test), else by a hash of its id; the same on every run.

    Samples that the map lacks or gives another word are dealt to val and train.
    """
    bucket = F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    word = F.when(F.col("split") == "validation", "val").when(F.col("split").isin("train", "val", "test"), F.col("split"))
    return samples.join(splits, "sample_id", "left").withColumn("split", F.coalesce(word, F.when(bucket < val_percent, "val").otherwise("train")))


def write_json(table: DataFrame, path: str) -> None:
    """A document a line; an earlier table at ``path`` is replaced as a whole."""
    table.write.mode("overwrite").json(path)


def replace_table(table: DataFrame, path: str) -> None:
    """Replace all rows at ``path``, or none: the new rows, which may come from the old ones, are written beside them and then take their name.

    Until the new rows are complete the old ones stay where they are; then these are moved aside, and back again if the new ones
    can't be moved in. What an earlier run that broke off has left beside is cleared, and put back where ``path`` is missing.
    """
    spark, end = table.sparkSession, path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, fresh, aside = (hadoop.Path(p) for p in (end, f"{end}.new", f"{end}.old"))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(aside) and not store.exists(here) and not store.rename(aside, here):
        raise OSError(f"{end} can't be put back")
    table.write.mode("overwrite").parquet(f"{end}.new")
    store.delete(aside, True)
    if store.exists(here) and not store.rename(here, aside):
        raise OSError(f"{end} can't be moved")
    if not store.rename(fresh, here):
        store.rename(aside, here)
        raise OSError(f"{end}.new can't be moved")
    store.delete(aside, True)
    spark.catalog.refreshByPath(end)


def cached_field(cache: DataFrame, key: str, now: float, ttl: float, load: Callable[[], str]) -> tuple[str, DataFrame]:
    """The payload of ``key`` in ``cache`` (key, payload, at) if younger than ``ttl`` seconds, else a new one; and the cache with it.

    A stale entry serves where loading fails; without one the failure goes on.
    """
    rows = cache.where(F.col("key") == key).orderBy(F.desc("at")).limit(1).collect()
    if rows and now - rows[0]["at"] < ttl:
        return rows[0]["payload"], cache
    try:
        payload = load()
    except Exception as e:
        if not rows:
            raise
        warnings.warn(f"the source of {key} failed, its last payload is used: {e}", stacklevel=2)
        return rows[0]["payload"], cache
    fresh = cache.sparkSession.createDataFrame([(key, payload, now)], cache.select("key", "payload", "at").schema)
    return payload, cache.where(F.col("key") != key).select("key", "payload", "at").union(fresh)


def resolve_field(sources: list[tuple[str, Callable[[], object]]], placeholder: object) -> tuple[object, str, bool]:
    """The first source that works, its name, and whether it is the placeholder; each failure warns."""
    for name, load in sources:
        try:
            got = load()
            if got is not None:
                return got, name, False
        except Exception as e:  # a source may fail in any way; the next one is tried
            warnings.warn(f"the current source {name} failed: {e}", stacklevel=2)
    return placeholder, "synthetic", True


def health(services: DataFrame) -> DataFrame:
    return services.agg(F.bool_and("up").alias("ok"), F.count_if(~F.col("up")).alias("down"))
