"""Readers of session files and manifests of folders. Paths may be in any store Spark reads."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.text import plain_number


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; fails on a blank or malformed line, and where there is none at all."""
    lines = spark.read.text(path)
    if lines.isEmpty():
        raise ValueError(f"{path} is empty")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.expr("try_parse_json(value)").alias("j"))
    ok = F.expr("trim(value) <> '' and j is not null and schema_of_variant(j) like 'OBJECT%'")
    return parsed.select(F.when(ok, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).alias("r")).select("r.*")


def read_arrays(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``session_id, row_idx, features`` of two-dimensional .npy files ``{session}_{kind}.npy``."""
    return parsed_arrays(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path), width)


def parsed_arrays(files: DataFrame, width: int) -> DataFrame:
    """The same of files that are read already (path, content); another shape than rows of ``width`` is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                if matrix.ndim != 2 or matrix.shape[1] != width:
                    raise ValueError(f"{name}: shape {matrix.shape}, not (rows, {width})")
                session = name.rsplit("/", 1)[-1].rsplit("_", 1)[0]
                for start in range(0, len(matrix), 4096):
                    part = matrix[start : start + 4096].astype(np.float64)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([session] * len(part)), pa.array(np.arange(start, start + len(part))), values], names=["session_id", "row_idx", "features"])

    return files.select("path", "content").mapInArrow(rows, "session_id string, row_idx long, features array<double>")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated transcripts with start_time, stop_time, speaker and value; bad rows are skipped.

    Scrubbed rows keep their times and lose their text. A file without these columns has no rows.
    """
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if not {"start_time", "stop_time", "speaker", "value"} <= set(raw.columns):
        return spark.createDataFrame([], "start_sec double, end_sec double, text string, privacy_scrubbed boolean, speaker_role string")
    text = F.trim("value")
    rows = raw.select(
        plain_number(F.col("start_time")).alias("start_sec"), plain_number(F.col("stop_time")).alias("end_sec"),
        F.when(F.lower(text).contains("scrubbed"), None).otherwise(text).alias("text"), F.lower(text).contains("scrubbed").alias("privacy_scrubbed"),
        F.when(F.lower("speaker").contains("participant"), "participant").when(F.lower("speaker").contains("ellie"), "interviewer").otherwise("unassigned").alias("speaker_role"),
    )
    return rows.filter("start_sec is not null and end_sec > start_sec")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, sha256`` of each file below a folder, outside .cache."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(folder.rstrip("/").split("://")[-1])
    path = F.expr("regexp_replace(path, '^[a-z]+:/*', '/')")
    relative = F.expr(f"substring({'_p'}, length(_root) + 2)")
    out = files.withColumn("_p", path).withColumn("_root", root).select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return out.filter(~F.col("path").rlike(r"(^|/)\.cache/"))


def manifest_digest(files: DataFrame) -> str:
    """One digest of a folder's manifest: of the lines of each folder in order of path, then of the folders' digests.

    No task joins more than the files of one folder, or one digest for each folder.
    """
    line = F.concat("path", F.lit("\x00"), F.col("size").cast("string"), F.lit("\x00"), "sha256", F.lit("\n"))
    joined = lambda at, x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, x.alias("_x")))), lambda r: r["_x"]), ""), 256)
    each = files.groupBy(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder")).agg(joined("path", line).alias("digest"))
    return each.agg(joined("folder", F.concat("folder", F.lit("\x00"), "digest", F.lit("\n")))).first()[0]
