"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import exact, nearcopies, packing, pii, toxicity
from lumenlake.llm.common import fresh, release, stored, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Null and empty texts have the score of the intercept; repeated rows
    are scored alike; without labels of both kinds every document stays; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = docs.withColumnRenamed("score", fresh(docs, "score_")) if "score" in docs.columns else docs
    kept = toxicity.scored(keep, model, keep.columns).filter("score < 0.7").drop("score")
    return kept.toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id. Null counts as empty; of rows that repeat both one
    stays; a null doc_id is the smallest; an empty table stays empty.
    """
    kept = exact.exact_duplicates(docs, carry=docs.columns).filter("kept")
    return kept.select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the row with the smallest doc_id; of rows that share it, one. Near copies are found by
    SimHash fingerprints in the BK-trees of shards, and checked on whole sets of shingles.

    Null and empty texts are copies of each other; a null doc_id is the largest; an empty table
    stays empty.
    """
    bands, row = fresh(docs, "bands"), fresh(docs, "_row")
    rows = stored(nearcopies.banded(docs, docs.columns, bands=bands).withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    before = written()
    plain = rows.select(F.col(row).alias("_row"), "doc_id", "text", F.col(bands).alias("bands"))
    groups = stored(nearcopies.near_copies(plain).select(F.col("node").alias("_row"), "root"), "pipeline-groups")
    release(spark, before, keep=1)  # what the search stored
    keys = plain.select("_row", "doc_id").join(groups, "_row")
    # one row stays for each group: of those with its smallest key, the first; a null key is the largest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stays = stored(keys.groupBy("root").agg(first.alias("first")).select("first._row"), "pipeline-stays")
    gone = stored(groups.select("_row").join(stays, "_row", "left_anti").withColumnRenamed("_row", row), "pipeline-gone")
    release(spark, before, keep=1)
    clear, doubtful = nearcopies.split(rows.drop(bands), gone, row)
    return clear.unionByName(doubtful.join(gone, row, "left_anti")).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data generalised to its kind; n_chars follows the text.

    A null text stays null, repeated rows stay and are treated alike, an empty table stays empty.
    """
    found = pii.find(docs, docs.columns).withColumn("new", F.when(F.size("spans") > 0, pii.redacted("text", "spans")))
    changed, own = F.col("new").isNotNull(), lambda c: F.col(f"row.`{c}`")
    return found.select(
        *[
            F.coalesce("new", own(c)).alias(c) if c == "text"
            else F.when(changed, F.length("new").cast(docs.schema[c].dataType)).otherwise(own(c)).alias(c) if c == "n_chars"
            else own(c).alias(c)
            for c in docs.columns
        ]
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens. Null counts as empty, a document
    of one token; repeated rows are packed each; an empty table gives no piece.
    """
    return packing.pack_documents(docs, ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: SQL cannot express these stages; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=1)  # all but this stage's result
    return docs
