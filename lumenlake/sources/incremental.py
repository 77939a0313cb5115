"""Results that are compiled again only for the sessions whose input or configuration changed.

A folder has generations of results (``data/run=n``) and of manifests (``manifest/n``: which run holds
a session, and from which input). A refresh writes the changed sessions as a new run and then a new
manifest; until that is complete readers see the old one. So a crash leaves nothing but rows that
no manifest names, and a session's rows are replaced at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.sources.scratch import stored
from lumenlake.sources.sinks import exists


def identities(inputs: DataFrame, session: str, configuration: str) -> DataFrame:
    """``session_id, identity``: a digest of a session's rows, whatever their order, and of the configuration.

    Sums of the rows' own digests, so a large session is added up before it is shuffled. A null
    session is one too.
    """
    line = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(inputs.columns)]), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return inputs.groupBy(F.col(f"`{session}`").alias("session_id")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *words, F.lit(configuration)), 256).alias("identity"))


def latest(spark: SparkSession, folder: str) -> int:
    """The newest complete manifest; 0 without one. Numbers follow each other, so the way there is short."""
    n = 0
    while exists(spark, f"{folder}/manifest/{n + 1}/_SUCCESS"):
        n += 1
    return n


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """``session_id, identity, run`` of the newest manifest."""
    n = latest(spark, folder)
    return spark.read.parquet(f"{folder}/manifest/{n}") if n else None


def stale(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``session_id, state`` (new, changed or gone) where a manifest differs from the wanted identities."""
    both = wanted.select("session_id", F.col("identity").alias("_w")).alias("w").join(known.select("session_id", F.col("identity").alias("_k")).alias("k"), F.col("w.session_id").eqNullSafe(F.col("k.session_id")), "full")
    state = F.when(F.col("_k").isNull(), "new").when(F.col("_w").isNull(), "gone").when(F.col("_w") != F.col("_k"), "changed")
    return both.select(F.coalesce("w.session_id", "k.session_id").alias("session_id"), state.alias("state")).filter("state is not null")


def refresh(spark: SparkSession, folder: str, inputs: DataFrame, session: str, configuration: str, compile_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compiles the sessions of ``inputs`` that are new or changed, forgets those that are gone, and returns ``session_id,
    state`` of all of them.

    ``compile_rows`` gets the input rows of these sessions and returns rows with ``session_id``. When
    nothing changed, nothing is written.
    """
    wanted = stored(identities(inputs, session, configuration), "identities")
    known, n = manifest(spark, folder), latest(spark, folder)
    if known is None:
        known = wanted.limit(0).withColumn("run", F.lit(0))
    found = stored(stale(wanted, known), "stale")
    if found.isEmpty():
        return found
    run = n + 1
    own = found.filter("state <> 'gone'").select(F.col("session_id").alias("_s"))
    part = inputs.join(own, F.col(f"`{session}`").eqNullSafe(F.col("_s")), "left_semi")
    compile_rows(part).write.mode("overwrite").parquet(f"{folder}/data/run={run}")
    kept = known.join(found.select(F.col("session_id").alias("_s")), known["session_id"].eqNullSafe(F.col("_s")), "left_anti")
    new = wanted.join(own, wanted["session_id"].eqNullSafe(F.col("_s")), "left_semi").withColumn("run", F.lit(run))
    kept.unionByName(new).write.mode("overwrite").parquet(f"{folder}/manifest/{run}")
    return found


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all sessions as the newest manifest has them, with their ``run``."""
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    own = manifest(spark, folder).select(F.col("session_id").alias("_s"), F.col("run").alias("_r"))
    return rows.join(own, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r")), "left_semi")
