"""The streamed ledger against the batch operators, over a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import audit, records
from lumenlake.streaming import ledger

KINDS = ["agent_opened", "candidates_exposed", "evidence_released", "revision_recorded", "agent_closed", "agent_aborted", "metric_unlocked", None]


@pytest.fixture(scope="module")
def stores(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(8)
    rows = []
    for run in range(40):
        kinds = ["agent_opened"] * (run % 5 > 0) + [r.choice(KINDS) for _ in range(r.randrange(1, 9))]
        rows += [(run, k, kind, r.choice([None, 10.0, 300.5])) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "run_id int, order_key long, event_type string, cost double")


def run(spark, events, folder):
    """One query over what is there, a file a micro-batch; it goes on from its checkpoint."""
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = ledger.checked(stream, 600.0).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()


def test_three_batches_and_a_restart_equal_the_batch(spark, stores, events, tmp_path):
    for k, part in enumerate(["order_key < 2", "order_key between 2 and 4", "order_key > 4"]):
        events.filter(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k:  # the first run sees two files, the second goes on with the third
            run(spark, events, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").cache()
    assert got.count() == events.count()
    told = {r.run_id: sorted(x for x in r.v if x) for r in got.groupBy("run_id").agg(F.flatten(F.collect_list(F.split("violations", ","))).alias("v")).collect()}
    want = {r.run_id: sorted(r.violations) for r in audit.ledger_grammar(events).collect()}
    assert told == want
    whole = events.withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    fits = {(r.run_id, r.order_key): (r.used, r.remaining, r.fits) for r in records.within_budget(whole, "run_id", "order_key", "cost", 600).collect()}
    assert {(r.run_id, r.order_key): (r.used, r.remaining, r.fits) for r in got.collect()} == fits
    chained = {(r.run_id, r.sequence): (r.previous, r.entry) for r in records.chain(events.select("run_id", "order_key", F.col("event_type").alias("payload"))).collect()}
    assert {(r.run_id, r.sequence): (r.previous, r.entry) for r in got.collect()} == chained
    unlocks = events.filter("event_type = 'metric_unlocked'")
    once = {(r.run_id, r.order_key) for r in audit.unlock_once(unlocks, unlocks.limit(0), "run_id", "order_key").collect()}
    assert {(r.run_id, r.order_key) for r in got.filter("unlocks").collect()} == once


def test_idle_runs_are_told(spark, stores, events, tmp_path):
    own = events.filter("run_id in (1, 5)").withColumn("event_type", F.when(F.col("order_key") == 0, "agent_opened").otherwise("candidates_exposed"))
    own.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in/0")
    query = ledger.checked(stream, 600.0, idle=100).writeStream.format("memory").queryName("idle_runs").trigger(processingTime="200 milliseconds").start()
    for _ in range(120):
        time.sleep(0.5)
        if spark.table("idle_runs").filter("violations = 'abandoned'").count() == 2:
            break
    query.stop()
    assert sorted(r.run_id for r in spark.table("idle_runs").filter("violations = 'abandoned'").collect()) == [1, 5]
