"""Table contracts, scans and sinks."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trackloom.functions import exprs


#: Columns of the tables by name.
TABLES = {
    "video_manifest": "video_id string, filename string, path string, sha256 string, size_bytes bigint, is_duplicate boolean, duplicate_of string, enabled boolean, "
    "perceptual_fingerprint string, readable boolean, fps double, frame_count bigint, duration_s double, width int, height int, camera_id string, "
    "recording_start timestamp, recording_end timestamp, timestamp_source string, timestamp_confidence double, ocr_samples array<struct<offset_s:double,timestamp:timestamp,raw_text:string>>, "
    "session_type string, session_id string, brightness double, saturation double, overlap_group_id string, canonical_video_id string, overlap_unverified boolean",
    "tracklets": "tracklet_id string, video_id string, session_id string, valid boolean, n_frames int, span double, net_dx double, duration_s double, start_s double, end_s double, direction string, mean_confidence double, mean_quality double, rejection_reasons array<string>",
    "frames": "tracklet_id string, rank int, frame_idx int, timestamp_s double, bbox array<double>, confidence double, quality double",
    "embeddings": "tracklet_id string, session_id string, video_id string, embedding array<float>, geometry_embedding array<float>, backend string, checkpoint string, checkpoint_sha256 string, preprocessing_profile string, crop_version string, embedding_schema_version string",
    "labels": "tracklet_id string, pseudo_id string, session_id string, video_id string, entity_id string, confirmed boolean, assignment_source string, notes string, updated_at string",
    "pair_reviews": "left_id string, right_id string, decision string, entity_id string, similarity double, notes string, updated_at string",
    "identity_exclusions": "entity_id string, tracklet_id string, reason string, updated_at string",
    "tracklet_reviews": "tracklet_id string, state string, split_at_s double, notes string, updated_at string",
    "keypoints": "tracklet_id string, frame_idx int, timestamp_s double, keypoint_name string, x_px double, y_px double, visibility double, model_name string, model_version string",
    "posture_observations": "tracklet_id string, entity_id string, video_id string, session_id string, observed_at string, score_mean double, score_median double, score_p90 double, score_max double, score_std double, "
    "n_scored_frames bigint, valid_frame_ratio double, measurement_uncertainty double, model_name string, model_version string, source_scores string",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the columns and types of schema: missing ones are null, what can't be cast is null, NaN is null."""
    own = {c.lower(): c for c in df.columns}

    def column(field: T.StructField):
        if field.name.lower() not in own:
            return F.lit(None).cast(field.dataType).alias(field.name)
        found = F.col(f"`{own[field.name.lower()]}`")
        source = df.schema[own[field.name.lower()]].dataType
        if isinstance(field.dataType, T.BooleanType) and not isinstance(source, T.BooleanType):
            found = F.when(found.isNotNull(), exprs.bool_text(found)) if isinstance(source, T.StringType) else found != 0
        elif source != field.dataType:
            found = found.try_cast(field.dataType)
        return (exprs.nan_to_null(found) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else found).alias(field.name)

    return df.select(*map(column, schema))


def required(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV table by its contract; a missing or empty file is an empty table."""
    schema = schema_of(name)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return conform(raw, schema) if raw.columns else spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Parallel arrays of an archive as rows of the embeddings table; arrays of one element are provenance of all rows."""
    import io

    import numpy as np

    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as data:
        arrays = {name: data[name] for name in data.files}
    n = len(arrays["tracklet_ids"])
    names = {"tracklet_ids": "tracklet_id", "session_ids": "session_id", "video_ids": "video_id", "embeddings": "embedding", "geometry_embeddings": "geometry_embedding"}
    columns = {names.get(k, k): v.tolist() if len(v) == n else v.tolist() * n for k, v in arrays.items()}
    rows = [dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)]
    fields = [f for f in schema_of("embeddings") if f.name in columns]
    return conform(spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows], T.StructType(fields)), schema_of("embeddings"))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.mp4", content_hash: bool = True) -> DataFrame:
    """Files below folder whose name matches pattern in either case: path, filename, size_bytes, sha256, video_id, duplicates marked.

    Without content_hash the content is never read.  A file whose hash an
    earlier path has is a duplicate of that one's id.
    """
    glob = re.sub(r"[A-Za-z]", lambda m: f"[{m[0].lower()}{m[0].upper()}]", pattern)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    found = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.col("length").alias("size_bytes"), *([F.sha2("content", 256).alias("sha256")] if content_hash else []))
    if not content_hash:
        return found.orderBy("path")
    from trackloom.operators.manifest import mark_duplicates

    return mark_duplicates(found.withColumn("video_id", exprs.content_id(F.col("sha256")))).orderBy("path")


def is_pointer_file(content):
    """Whether a file's content is the pointer of a large-file store instead of the file."""
    return F.startswith(content, F.lit(b"version https://git-lfs.github.com/spec/"))


def write_version(df: DataFrame, folder: str, keep: int = 5) -> str:
    """Writes a new version of a table, then its pointer; keep versions stay.

    A writer claims its number by creating a file that mustn't be there yet; the
    pointer is a new file too, and readers take the greatest: they see the old
    version or the new one, at no moment none.
    """
    spark = df.sparkSession
    fs = _files(spark, folder)
    version = max([0, *_numbers(spark, folder, "claim"), *_numbers(spark, folder, "pointer")]) + 1
    while not fs.createNewFile(_path(spark, f"{folder}/claim.{version:06d}")):
        version += 1
    df.write.mode("overwrite").parquet(f"{folder}/version={version:06d}")
    fs.create(_path(spark, f"{folder}/pointer.{version:06d}"), False).close()
    for v in sorted(_numbers(spark, folder, "pointer"))[:-keep]:
        for name in (f"pointer.{v:06d}", f"claim.{v:06d}", f"version={v:06d}"):
            fs.delete(_path(spark, f"{folder}/{name}"), True)
    return f"{folder}/version={version:06d}"


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    if not exists(spark, folder):
        return []
    names = [s.getPath().getName() for s in _files(spark, folder).listStatus(_path(spark, folder))]
    return [int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}\.(\d+)", n))]


def has_version(spark: SparkSession, folder: str) -> bool:
    return bool(_numbers(spark, folder, "pointer"))


def read_version(spark: SparkSession, folder: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
    number = version or max(_numbers(spark, folder, "pointer"), default=None)
    if number is None:
        if schema is None:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/version={number:06d}")


def held(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, so what made it runs once and a lost executor recomputes a scan.

    A local master that names no folder gets a temporary one; a cluster must name one that all share.
    """
    spark, key = df.sparkSession, "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    path = f"{folder.rstrip('/')}/trackloom/{spark.sparkContext.applicationId}/held/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").format(format).save(path)


def create_tables(spark: SparkSession, database: str, names: Sequence[str] = tuple(TABLES)) -> None:
    """Creates the tables that a database hasn't yet, as Parquet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name in names:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of(name))
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; with a numeric column and (least, most, partitions) it is read in ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def checked_keypoints(df: DataFrame, tracklet: str) -> DataFrame:
    """Keypoints of one tracklet; reading a row of another one or a visibility outside 0 to 1 fails."""
    good = (F.col("tracklet_id") == tracklet) & F.col("visibility").between(0, 1)
    return df.withColumn("tracklet_id", F.when(good, F.col("tracklet_id")).otherwise(F.raise_error(F.lit("bad keypoint row"))))


def renamed_keypoints(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """External keypoint names by a map; names without an entry stay."""
    if not names:
        return df
    lookup = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn("keypoint_name", F.coalesce(F.try_element_at(lookup, F.col("keypoint_name")), F.col("keypoint_name")))


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators; with_changes() merges nested names given as section.name."""

    similarity_threshold: float = 0.95
    unknown_threshold: float = 0.95
    min_margin: float = 0.02
    top_k: int = 5
    auto_cosine: float = 0.95
    auto_geometry: float = 0.5
    min_track_samples: int = 8
    min_track_span: float = 0.16
    min_best_frames: int = 3
    min_box_area: float = 0.010
    best_frames: int = 12
    sample_fps: float = 5.0
    roi: tuple[float, ...] = (0.0, 0.22, 1.0, 0.80)
    gate: tuple[float, float] = (0.18, 0.82)
    window_days: int = 30
    min_days: int = 3
    epsilon: float = 1e-6
    alert_z: float = 3.0
    min_valid_ratio: float = 0.6
    max_uncertainty: float = 0.05
    timestamp_tolerance_s: float = 3.0
    min_visibility: float = 0.25
    max_distance: float = 0.22
    max_missed: int = 8
    pooling_floor: float = 0.05

    def with_changes(self, changes: dict) -> Settings:
        """Nested mappings are merged by their last name; unknown names are refused."""
        flat: dict = {}

        def walk(part: dict) -> None:
            for key, value in part.items():
                walk(value) if isinstance(value, dict) else flat.__setitem__(key, tuple(value) if isinstance(value, list) else value)

        walk(changes)
        unknown = sorted(set(flat) - set(self.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return replace(self, **flat)


def load_settings(path: str | None = None, base: Settings | None = None) -> Settings:
    """Settings with the changes of a YAML file (JSON where no YAML reader is installed)."""
    settings = base or Settings()
    if path is None:
        return settings
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return settings.with_changes(json.loads(text or "{}"))
    return settings.with_changes(yaml.safe_load(text) or {})


def resolved_path(path: str, beside: str) -> str:
    """A path of a settings file: absolute ones and URLs as they are, others from the file's folder."""
    return path if "://" in path or os.path.isabs(path) else os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(beside)), path))


def existing(df: DataFrame, path_col: str, files: DataFrame) -> DataFrame:
    """Rows whose file is in a listing (path)."""
    return df.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows that name a parent that isn't there; null names none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_anti").select(*child.columns)


def anti_append(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key isn't in existing, one for each key: an idempotent insert."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")
