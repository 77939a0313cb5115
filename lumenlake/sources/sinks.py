"""Sinks: canonical JSON lines, manifests, packages that are written once, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def sorted_struct(c: Column, kind: T.DataType) -> Column:
    """``c`` with the fields of its structs in the order of their names, at any depth."""
    if isinstance(kind, T.StructType):
        fields = [sorted_struct(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: sorted_struct(x, kind.elementType))
    return c


def canonical_json(rows: DataFrame) -> DataFrame:
    """``value``: each row as compact JSON with sorted keys; nulls are told, other letters kept."""
    whole = F.struct(*[sorted_struct(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)])
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def write_once(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes to a new folder; one that exists is an error. Readers see all files or, by the missing
    ``_SUCCESS``, none."""
    rows.write.mode("errorifexists").format(form).save(path)


def write_replacing(spark: SparkSession, rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside ``path`` and renames over it, so that readers see the old folder or the new one."""
    beside = path.rstrip("/") + ".new"
    rows.write.mode("overwrite").format(form).save(beside)
    (old, fs), (new, _) = _path(spark, path), _path(spark, beside)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot rename {beside} to {path}")


def write_package(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes tables as canonical JSON lines below a new ``folder`` and returns ``table, rows, digest`` of them.

    A package is never changed: the folder must not exist, and appears under its name only when
    every table is written.
    """
    if exists(spark, folder):
        raise FileExistsError(folder)
    beside = folder.rstrip("/") + ".new"
    for name, rows in tables.items():
        canonical_json(rows).write.mode("overwrite").text(f"{beside}/{name}")
    (old, fs), (new, _) = _path(spark, folder), _path(spark, beside)
    if not fs.rename(new, old):
        raise OSError(f"cannot rename {beside} to {folder}")
    return package_digests(spark, folder, list(tables))


def package_digests(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """``table, rows, digest``: a digest that does not depend on files or their order, the 256-bit sum of
    the lines' SHA-256 in four words."""
    words = [F.expr(f"cast(conv(substring(sha2(value, 256), {16 * i + 1}, 16), 16, 10) as decimal(20, 0))") for i in range(4)]
    out = None
    for name in tables:
        own = spark.read.text(f"{folder}/{name}")
        sums = [F.coalesce(F.sum(w.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for w in words]
        row = own.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def verified(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a manifest that are missing, new or different: ``keys, state``; must be none."""
    values = [c for c in before.columns if c not in keys]
    own = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = own(now, "_now").join(own(before, "_before"), keys, "full")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_before").isNull(), "new").when(F.col("_now") != F.col("_before"), "changed")
    return both.select(*keys, state.alias("state")).filter("state is not null")


def is_complete(spark: SparkSession, folder: str, manifest: str, identity: dict[str, str]) -> bool:
    """Whether ``folder`` holds a finished result of the same identity (its one-row ``manifest`` says so)."""
    if not exists(spark, f"{folder}/{manifest}/_SUCCESS"):
        return False
    row = spark.read.json(f"{folder}/{manifest}").first()
    return row is not None and all(k in row and row[k] == v for k, v in identity.items())


def session_manifest(files: DataFrame) -> DataFrame:
    """``session_id, files, bytes`` and counts by status of file rows (session_id, size, status)."""
    return files.groupBy("session_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``place, line`` of a Markdown table of a report's rows, header first."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    body = rows.select(F.monotonically_increasing_id().alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "place long, line string")
    return head.unionByName(body)
