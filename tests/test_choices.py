"""Guards, choices and checks on small rows; the bootstrap against numpy."""

import numpy as np
from pyspark.sql import functions as F

from lumenlake.functions import text
from lumenlake.operators import audit, baselines, selection


def test_numbers(spark):
    rows = spark.createDataFrame([(1.5,), (0.0,), (-0.0001,), (100.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = [r[0] for r in rows.select(text.number(F.col("x"))).collect()]
    assert got == ["1.5", "0", "0", "100", "unavailable", "unavailable", "unavailable"]


def test_ids_and_tokens(spark):
    rows = spark.createDataFrame([(" 300.0 ",), ("7",), ("7.5",), ("P1",), ("nan",)], "x string")
    assert [r[0] for r in rows.select(text.normal_id(F.col("x"))).collect()] == ["300", "7", "7.5", "P1", "nan"]
    odd = spark.createDataFrame([("  a b/c ",), ("///",), ("Straße 1",)], "x string")
    assert [r[0] for r in odd.select(text.safe_token(F.col("x"))).collect()] == ["a_b_c", "unknown", "Stra_e_1"]
    assert [r[0] for r in odd.select(text.normal_key(F.col("x"))).collect()] == ["abc", "", "strasse1"]


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    values = [(i, float(x), i % 3 == 0) for i, x in enumerate(rng.normal(2, 1, 600))]
    got = baselines.bootstrap(spark.createDataFrame(values, "id long, x double, y boolean"), "id", "x", "y", 2000, 1).first()
    x, y = np.array([v[1] for v in values]), np.array([v[2] for v in values])
    means = [np.concatenate([rng.choice(x[y == k], (y == k).sum()) for k in (True, False)]).mean() for _ in range(2000)]
    assert abs(got["estimate"] - x.mean()) < 1e-9
    assert np.allclose([got["low"], got["high"]], np.quantile(means, [0.025, 0.975]), atol=0.02)


def test_quota_takes_ties_by_key(spark):
    rows = spark.createDataFrame([(i, i // 7) for i in range(20)], "id long, v long")
    assert sorted(r["id"] for r in selection.lowest_quota(rows, "v", "id", 0.5).collect()) == list(range(10))
    assert selection.lowest_quota(rows.limit(0), "v", "id", 0.5).count() == 0


def test_places(spark):
    row = spark.range(1).select(
        selection.even_places(F.lit(10), 4).alias("a"), selection.uniform_places(F.lit(6), 3).alias("b"), selection.even_places(F.lit(6), 3).alias("c"), selection.even_places(F.lit(4), 1).alias("d"), selection.uniform_places(F.lit(4), 1).alias("e")
    ).first()
    assert [list(x) for x in row] == [[0, 3, 6, 9], [0, 3, 5], [0, 2, 5], [2], [1]]


def test_ledger_grammar(spark):
    logs = {
        1: ["agent_opened", "candidates_exposed", "evidence_released", "revision_recorded", "agent_closed"],
        2: ["agent_opened", "agent_aborted", "agent_closed"],
        3: ["agent_opened", "agent_aborted", "evidence_released"],
        4: ["agent_opened", "revision_recorded", "evidence_released", "agent_closed", "agent_closed"],
    }
    rows = spark.createDataFrame([(k, i, e) for k, v in logs.items() for i, e in enumerate(v)], "run_id long, order_key long, event_type string")
    got = {r["run_id"]: sorted(r["violations"]) for r in audit.ledger_grammar(rows).collect()}
    assert got == {1: [], 2: [], 3: ["records_after_abort"], 4: ["access_after_revision", "multiple_closes", "records_after_close", "revision_before_release"]}
