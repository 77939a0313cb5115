"""Readers of session folders, feature files, transcripts, splits and labels.

Everything is read by Spark, so any file system that Spark knows will do. Where a file breaks a
rule, the check that says so is returned as rows (``..._violations``) or raised when rows are read
(``raise_error``), never by looking at all rows on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.functions.text import normal_id, plain_number

#: Column names that may hold a session's id, its split and its label, fixed values.
ID_COLUMNS = ("participant_id", "participant", "participantid", "index", "session_id", "video_id")
SPLIT_COLUMNS = ("fold", "split", "partition")
#: What a session may come as, the preferred first.
LAYOUTS = ("directory", "flat_directory", "zip")


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of all files below ``folder``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))


def session_layouts(files: DataFrame, directory: str = "_P", flat: str = "_COVAREP.csv", archive: str = "_P.zip") -> DataFrame:
    """``session_id, layout`` of the sessions that file paths name, by the preferred layout."""
    q = re.escape
    found = F.array(
        F.struct(F.regexp_extract("path", rf"/([^/]+){q(directory)}/[^/]+$", 1).alias("id"), F.lit(0).alias("rank")),
        F.struct(F.when(~F.col("path").rlike(rf"{q(directory)}/[^/]+$"), F.regexp_extract("path", rf"/([^/]+){q(flat)}$", 1)).alias("id"), F.lit(1).alias("rank")),
        F.struct(F.regexp_extract("path", rf"/([^/]+){q(archive)}$", 1).alias("id"), F.lit(2).alias("rank")),
    )
    rows = files.select(F.explode(found).alias("f")).select("f.*").filter("id is not null and id <> ''")
    layouts = F.array(*[F.lit(x) for x in LAYOUTS])
    return rows.groupBy(F.col("id").alias("session_id")).agg(F.min("rank").alias("r")).select("session_id", layouts[F.col("r")].alias("layout"))


def archive_member(members: DataFrame, name: str) -> DataFrame:
    """Of the members (session_id, member) called ``name``, each session's with the fewest folders, then
    the shortest path."""
    own = members.filter(F.element_at(F.split("member", "/"), -1) == name)
    depth = F.size(F.split("member", "/"))
    return own.groupBy("session_id").agg(F.min_by("member", F.struct(depth.alias("d"), F.length("member").alias("n"), F.col("member").alias("m"))).alias("member"))


def archive_members(spark: SparkSession, path: str, suffix: str = "_P.zip") -> DataFrame:
    """``session_id, member, content`` of zip archives; an archive is one task's work."""
    import io
    import zipfile

    def opened(batches):
        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.endswith("/"):
                            yield pd.DataFrame([(where.rsplit("/", 1)[-1].removesuffix(suffix), member, z.read(member))], columns=["session_id", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(opened, "session_id string, member string, content binary")


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_measures(spark: SparkSession, path: str, delimiter: str = ",", keep: list[str] | None = None) -> DataFrame:
    """A CSV of numbers with a header: names are trimmed, cells that are no numbers become null.

    ``keep`` are columns left as text. ``path`` of the row's file is added as ``source_path``.
    """
    raw = _trimmed(spark.read.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    names = set(keep or [])
    return raw.select(*[F.col(f"`{c}`") if c in names else plain_number(F.col(f"`{c}`")).alias(c) for c in raw.columns], F.input_file_name().alias("source_path"))


def read_positional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV without a header; its columns get these names, all double."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    return spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)


def read_recognised_speech(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of a speech recogniser (``start_sec, end_sec, text, confidence, privacy_scrubbed``).

    Columns may have either of two names; without all of them there are no rows. Scrubbed rows keep
    their time and lose their text; rows without times or text are passed over; a confidence that
    is not within 0 and 1 is dropped.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip().lower() for c in raw.columns])
    pick = lambda *names: next((n for n in names if n in raw.columns), None)
    start, end, text = pick("start_time", "start"), pick("end_time", "stop_time"), pick("text", "value")
    ddl = "start_sec double, end_sec double, text string, confidence double, privacy_scrubbed boolean"
    if not (start and end and text):
        return spark.createDataFrame([], ddl)
    said, sure = F.coalesce(F.col(text), F.lit("")), plain_number(F.col("confidence")) if "confidence" in raw.columns else F.lit(None).cast("double")
    scrubbed = F.lower(said).contains("scrubbed_entry")
    clean = F.trim(F.regexp_replace(said, r"\s+", " "))
    rows = raw.select(plain_number(F.col(start)).alias("start_sec"), plain_number(F.col(end)).alias("end_sec"), F.when(~scrubbed, clean).alias("text"), F.when(sure.between(0, 1), sure).alias("confidence"), scrubbed.alias("privacy_scrubbed"))
    return rows.filter("start_sec is not null and end_sec >= start_sec and start_sec >= 0 and (privacy_scrubbed or text <> '')")


def _resolved(columns: list[str], wanted: tuple[str, ...], what: str) -> str:
    by_name = {c.replace("﻿", "").strip().lower(): c for c in columns}
    for name in wanted:
        if name.lower() in by_name:
            return by_name[name.lower()]
    raise ValueError(f"no {what} column among {columns}")


def read_session_ids(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``session_id`` of a split file, of one split. Only the id and split columns are read, never a
    label; an id that occurs twice is an error."""
    raw = spark.read.option("header", True).csv(path)
    id_, own = _resolved(raw.columns, ID_COLUMNS, "session id"), raw
    if split is not None:
        at = _resolved(raw.columns, SPLIT_COLUMNS, "split")
        own = raw.filter(F.lower(F.trim(F.col(f"`{at}`"))) == split.lower())
    ids = own.select(F.trim(F.col(f"`{id_}`")).alias("session_id")).filter("session_id <> ''")
    counted = ids.groupBy("session_id").agg(F.count("*").alias("n"))
    return counted.select(F.when(F.col("n") == 1, F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate session id "), F.col("session_id")))).alias("session_id"))


def natural_order() -> list[Column]:
    """Numbers before other ids, by value."""
    number = F.when(F.col("session_id").rlike("^[0-9]+$"), F.col("session_id").cast("decimal(38,0)"))
    return [F.asc_nulls_last(number), F.asc("session_id")]


def select_sessions(ids: DataFrame, available: DataFrame, most: int | None = None) -> DataFrame:
    """The ids, all of which must be available; of them the first ``most`` in natural order."""
    known = available.select("session_id", F.lit(True).alias("_there")).distinct()
    checked = ids.join(known, "session_id", "left").select(F.when(F.col("_there"), F.col("session_id")).otherwise(F.raise_error(F.concat(F.lit("absent session "), F.col("session_id")))).alias("session_id"))
    return checked if most is None else checked.orderBy(*natural_order()).limit(most)


def read_labels(spark: SparkSession, path: str, label: str, threshold: float | None = None, splits: list[str] | None = None) -> DataFrame:
    """``session_id, label`` (and ``split``): ids without ``.0``, a label of 0 or 1, or a score at or
    above ``threshold``. Any other value is an error."""
    raw = spark.read.option("header", True).csv(path)
    id_, value = _resolved(raw.columns, ID_COLUMNS, "session id"), _resolved(raw.columns, (label,), label)
    number = plain_number(F.col(f"`{value}`"))
    bad = F.raise_error(F.concat(F.lit("bad label of "), F.coalesce(F.col(f"`{id_}`"), F.lit("?"))))
    strict = F.when(number.isin(0.0, 1.0), number.cast("int")).otherwise(bad.cast("int"))
    target = strict if threshold is None else F.when(number.isNull(), bad.cast("int")).otherwise((number >= threshold).cast("int"))
    rows = raw
    out = [normal_id(F.trim(F.col(f"`{id_}`"))).alias("session_id"), target.alias("label")]
    if splits is not None:
        at = F.lower(F.trim(F.col(f"`{_resolved(raw.columns, SPLIT_COLUMNS, 'split')}`")))
        rows, out = raw.filter(at.isin(*splits)), [*out, at.alias("split")]
    return rows.select(*out)


def read_participants(spark: SparkSession, path: str, label: str, threshold: float | None = None) -> DataFrame:
    """``session_id, label`` only, for a stratified split; nothing else of the file is kept."""
    return read_labels(spark, path, label, threshold).select("session_id", "label")


def supervised_splits(labels: DataFrame, mapping: dict[str, int]) -> dict[str, DataFrame]:
    """Raw rows (session_id, label, fold) to ``train`` and ``valid`` with targets, and ``test``, whose
    frame has no label column at all. An unknown label or fold is an error."""
    fold = F.lower(F.trim("fold"))
    target = F.lit(None).cast("int")
    for name, value in mapping.items():
        target = F.when(F.lower(F.trim("label")) == name, value).otherwise(target)
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"unknown {what} of "), F.col("session_id"), F.lit(": "), F.coalesce(F.col(c), F.lit("null"))))
    rows = labels.select("session_id", F.when(fold.isin("train", "valid", "test"), fold).otherwise(fail("fold", "fold")).alias("split"), "label")
    with_target = rows.filter("split <> 'test'").select("session_id", F.coalesce(target, fail("label", "label").cast("int")).alias("target"), "split")
    return {"train": with_target.filter("split = 'train'"), "valid": with_target.filter("split = 'valid'"), "test": rows.filter("split = 'test'").select("session_id", "split")}


def official_test_labels(labels: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """``session_id, label, duration`` of the test rows; labels and durations of others are never parsed."""
    test = labels.filter(F.lower(F.trim("fold")) == "test")
    value = F.lit(None).cast("int")
    for name, y in mapping.items():
        value = F.when(F.lower(F.trim("label")) == name, y).otherwise(value)
    seconds = plain_number(F.col("duration"))
    good = value.isNotNull() & (seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    fail = F.raise_error(F.concat(F.lit("bad test row "), F.coalesce("session_id", F.lit("?"))))
    return test.select("session_id", F.when(F.coalesce(good, F.lit(False)), value).otherwise(fail.cast("int")).alias("label"), seconds.alias("duration"))


def view_digest(rows: DataFrame, order: str, line: Column) -> DataFrame:
    """``digest``: SHA-256 over the lines' own digests in order, folded by ranges of 4,096 lines.

    No task joins more than one range's digests; the last one joins the ranges'.
    """
    at = rows.select(F.col(order).alias("_o"), F.sha2(line, 256).alias("_d"))
    ranges = at.groupBy(F.floor(F.col("_o") / 4096).alias("_r")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("_d"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))


def read_evidence_segments(spark: SparkSession, path: str) -> DataFrame:
    """``segment_id, start_sec, end_sec`` of the lines ``SEGMENT S000 | time a to b seconds | ...``; other lines
    are passed over, an empty range is an error."""
    pattern = r"^SEGMENT (S[0-9]+) \| time ([0-9]+(?:\.[0-9]+)?) to ([0-9]+(?:\.[0-9]+)?) seconds \|"
    return _timed_lines(spark, path, pattern, "segment_id", False)


def read_atomic_lines(spark: SparkSession, path: str) -> DataFrame:
    """``atomic_id, start_sec, end_sec`` of ``EVIDENCE E0000 | time a to b seconds`` lines; any other line is an error."""
    return _timed_lines(spark, path, r"^EVIDENCE (E[0-9]+) \| time ([0-9]+(?:\.[0-9]+)?) to ([0-9]+(?:\.[0-9]+)?) seconds", "atomic_id", True)


def _timed_lines(spark: SparkSession, path: str, pattern: str, key: str, strict: bool) -> DataFrame:
    lines = spark.read.text(path).filter("trim(value) <> ''")
    hit = F.col("value").rlike(pattern)
    own = lines.withColumn("value", F.when(hit, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))))) if strict else lines.filter(hit)
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = own.select(part(1).alias(key), part(2).cast("double").alias("start_sec"), part(3).cast("double").alias("end_sec"))
    good = F.col("end_sec") > F.col("start_sec")
    return rows.withColumn("end_sec", F.when(good, F.col("end_sec")).otherwise(F.raise_error(F.concat(F.lit("empty range of "), F.col(key))).cast("double")))


def unit_violations(units: DataFrame) -> DataFrame:
    """``source_path, reason`` of unit files that hold two sessions or repeat an id; must be none."""
    sessions = units.groupBy("source_path").agg(F.countDistinct("session_id").alias("n")).filter("n > 1").select("source_path", F.lit("several_sessions").alias("reason"))
    repeats = units.groupBy("source_path", "evidence_id").agg(F.count("*").alias("n")).filter("n > 1").select("source_path", F.lit("repeated_id").alias("reason")).distinct()
    return sessions.unionByName(repeats)


def index_rows(index: DataFrame) -> DataFrame:
    """Index lines (session_id, atomic_id, start_sec, end_sec, canonical_ids, modalities, source_ids) as one row
    for each canonical id; arrays that are not aligned or a range that is not positive are an error."""
    aligned = (F.size("canonical_ids") == F.size("modalities")) & (F.size("canonical_ids") == F.size("source_ids")) & (F.col("end_sec") > F.col("start_sec"))
    checked = index.withColumn("atomic_id", F.when(aligned, F.col("atomic_id")).otherwise(F.raise_error(F.concat(F.lit("bad index line "), F.col("atomic_id")))))
    cells = F.explode(F.arrays_zip("canonical_ids", "modalities", "source_ids")).alias("c")
    return checked.select("session_id", "atomic_id", "start_sec", "end_sec", cells).select("session_id", "atomic_id", "start_sec", "end_sec", F.col("c.canonical_ids").alias("canonical_id"), F.col("c.modalities").alias("modality"), F.col("c.source_ids").alias("source_id"))


def archived(files: DataFrame, name: str) -> DataFrame:
    """``session_id, member, content`` of the member called ``name`` in each archive ``{session}_P.zip`` of files (path,
    content): of several the one with the fewest slashes, then the shortest. An archive without it has no row.

    Each archive is opened once, in the task that reads it; only the wanted member is unpacked.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    own = [m for m in archive.namelist() if m.rsplit("/", 1)[-1] == name]
                    if own:
                        best = min(own, key=lambda m: (m.count("/"), len(m), m))
                        session = path.rsplit("/", 1)[-1].removesuffix("_P.zip")
                        yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([best]), pa.array([archive.read(best)], pa.binary())], names=["session_id", "member", "content"])

    return files.select("path", "content").mapInArrow(members, "session_id string, member string, content binary")


def read_archives(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The same of the archives below ``path``, in any store that Spark reads; an archive of over 2 GB is an error."""
    return archived(spark.read.format("binaryFile").option("pathGlobFilter", "*_P.zip").option("recursiveFileLookup", "true").load(path), name)


def bundle_fingerprints(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``bundle, files, fingerprint`` of each folder: a digest over name and content of its named files
    (a fixed few a bundle), in the order of the names."""
    return fingerprints(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), names)


def fingerprints(files: DataFrame, names: list[str]) -> DataFrame:
    """The same of files that are read already (path, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("name", name).filter(F.col("name").isin(*names)).withColumn("bundle", F.element_at(F.split("path", "/"), -2))
    one = F.sha2(F.concat(F.encode("name", "utf-8"), F.unhex(F.lit("00")), F.col("content"), F.unhex(F.lit("00"))), 256)
    return rows.select("bundle", "name", one.alias("d")).groupBy("bundle").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def cross_violations(canonical: DataFrame, index: DataFrame, atoms: DataFrame, tolerance: float = 5.001e-3) -> DataFrame:
    """What disagrees between units, index and atom lines: ``what, key``; must be none.

    Index and units must name the same ids with the same modality, index and lines the same atoms
    at the same times.
    """
    ids = index.select("canonical_id", F.col("modality").alias("m")).join(canonical.select(F.col("evidence_id").alias("canonical_id"), F.col("modality").alias("n")), "canonical_id", "full")
    reason = F.when(F.col("m").isNull(), "unit_without_index").when(F.col("n").isNull(), "index_without_unit").when(F.col("m") != F.col("n"), "modality_differs")
    one = ids.select(reason.alias("what"), F.col("canonical_id").alias("key"))
    own = index.groupBy("atomic_id").agg(F.min("start_sec").alias("a"), F.max("end_sec").alias("b"))
    times = own.join(atoms.select("atomic_id", F.col("start_sec").alias("c"), F.col("end_sec").alias("d")), "atomic_id", "full")
    far = (F.abs(F.col("a") - F.col("c")) > tolerance) | (F.abs(F.col("b") - F.col("d")) > tolerance)
    reason = F.when(F.col("a").isNull(), "line_without_index").when(F.col("c").isNull(), "index_without_line").when(far, "time_differs")
    return one.unionByName(times.select(reason.alias("what"), F.col("atomic_id").alias("key"))).filter("what is not null")


def configured(base: dict, override: dict, key: str = "dataset") -> dict:
    """``base`` with the values of ``override``; both must name the same data set."""
    if key in override and key in base and override[key] != base[key]:
        raise ValueError(f"{key} is {override[key]!r} in one and {base[key]!r} in the other")
    return {**base, **override}


def duplicated_keys(lines: DataFrame) -> DataFrame:
    """``value, duplicates`` of JSON lines in which an object names a key twice, at any depth."""
    import json

    def repeated(text: str) -> list[str]:
        found: list[str] = []

        def pairs(items):
            seen = set()
            for k, _ in items:
                (found.append(k) if k in seen else seen.add(k))
            return dict(items)

        try:
            json.loads(text, object_pairs_hook=pairs)
        except ValueError:
            return ["not JSON"]
        return found

    def run(batches):
        for batch in batches:
            bad = batch["value"].map(repeated)
            yield batch.assign(duplicates=bad)[bad.map(len) > 0]

    return lines.select("value").mapInPandas(run, "value string, duplicates array<string>")


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
