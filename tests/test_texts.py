"""Unicode composition against the library, and incremental results."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import text
from lumenlake.functions.json import names_label, unit_number
from lumenlake.operators import transcripts
from lumenlake.sources import incremental


def plain(value):
    value = unicodedata.normalize("NFKC", value)
    value = "".join(" " if c.isspace() else c for c in value).replace("|", " ")
    return re.sub(r"\s+", " ", value).strip()


def test_normalised_equals_the_library(spark):
    r = random.Random(6)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in every if unicodedata.combining(c)]
    texts = ["".join(every[i : i + 40]) for i in range(0, len(every), 40)] + [f"a{c}b {c}" for c in every if c.isspace() or c in "|ﬁ½…ｆ"]
    texts += ["".join(r.choice([r.choice(every), r.choice(marks), r.choice("ae가ᅡ ")]) for _ in range(r.randrange(1, 15))) for _ in range(10_000)]
    texts += ["", " ", "plain ascii|text \n", "plain ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", transcripts.normalised(F.col("t")).alias("n")).collect()
    assert len(rows) == len(texts)
    assert all(x.n == (None if texts[x.i] is None else plain(texts[x.i])) for x in rows)


def test_numbers_are_not_java_literals(spark):
    cells = {"1": 1.0, " -2.50 ": -2.5, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "1d": None, "5f": None, "5D": None, "NaN": None, "Infinity": None, "0x1": None, "1_0": None, "": None, "1 2": None}
    df = spark.createDataFrame([(k,) for k in cells], "c string").select("c", text.plain_number(F.col("c")).alias("n"), text.normal_id(F.col("c")).alias("id"))
    rows = {r.c: r for r in df.collect()}
    assert {k: r.n for k, r in rows.items()} == cells
    assert (rows["1d"].id, rows["5f"].id, rows["1e3"].id, rows["5."].id) == ("1d", "5f", "1000", "5")


def test_json_values(spark):
    raw = {'{"q":{"p":"x"},"p":0.2}': 0.2, '{"p": "0.2"}': None, '{"p": true}': None, '{"p": 1}': 1.0, '{"p": 1e-3}': 0.001, '{"p": null}': None, '{"p": 2}': None, "x": None, '{"q": 0.1}': None}
    df = spark.createDataFrame([(k,) for k in raw], "j string").select("j", unit_number(F.col("j"), "p").alias("n"))
    assert {r.j: r.n for r in df.collect()} == raw
    keys = spark.createDataFrame([(f'{{"a": [{{"{k}": 1}}]}}', k) for k in ("y_true", "Y-True", "phq 9", "label2", "Depressed", "labelled", "goal")], "j string, k string")
    assert {r.k for r in keys.filter(names_label(F.col("j"))).collect()} == {"y_true", "Y-True", "phq 9", "label2", "Depressed"}


def test_incremental(spark, tmp_path):
    folder = str(tmp_path / "compiled")
    df = lambda rows: spark.createDataFrame(rows, "s string, v int")
    made = []

    def compiled(rows):
        made.append(sorted({r.s or "" for r in rows.collect()}))
        return rows.groupBy(F.col("s").alias("session_id")).agg(F.sum("v").alias("v"))

    now = lambda: {r.session_id: (r.v, r.run) for r in incremental.current(spark, folder).collect()}
    run = lambda rows, c="c": {r.session_id: r.state for r in incremental.refresh(spark, folder, df(rows), "s", c, compiled).collect()}
    first = [("a", 1), ("a", 2), ("b", 3), ("b", 3), (None, 4), ("d", None)]
    assert run(first) == {"a": "new", "b": "new", None: "new", "d": "new"}
    assert now() == {"a": (3, 1), "b": (6, 1), None: (4, 1), "d": (None, 1)}
    assert run(first[::-1]) == {} and len(made) == 1
    assert run([("a", 2), ("a", 1), ("b", 3), (None, 5), ("e", 1)]) == {"b": "changed", None: "changed", "d": "gone", "e": "new"}
    assert made[-1] == ["", "b", "e"] and now() == {"a": (3, 1), "b": (3, 2), None: (5, 2), "e": (1, 2)}
    # a run without its manifest, as after a crash, is not seen and is written again
    spark.createDataFrame([("a", 99)], "session_id string, v long").write.parquet(f"{folder}/data/run=3")
    assert now()["a"] == (3, 1)
    assert run([("a", 7)], "other") == {"a": "changed", "b": "gone", None: "gone", "e": "gone"}
    assert now() == {"a": (7, 3)}
    with pytest.raises(Exception, match="label"):
        incremental.refresh(spark, folder, df([("z", 1)]), "s", "c", lambda rows: rows.select(F.raise_error(F.lit("label")).alias("session_id")))
    assert now() == {"a": (7, 3)}
