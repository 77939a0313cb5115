"""Empty tables, clashing columns, null keys, repeated rows and very long texts, for every operator and stage."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import chat, exact, licences, nearcopies, packing, pieces, pii, quality, simhash, toxicity
from lumenlake.llm.common import stored

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Names that operators and stages use inside, as columns of the documents.
CLASHES = ["kept", "keep_id", "group_size", "text_sha256", "_row", "row", "key", "sha", "norm", "n", "fp", "bands", "root", "node", "spans", "base", "low", "copy", "check", "terms", "new", "_text", "score", "block", "payload", "ids", "piece", "_word", "_bit", "component_id"]
HEAD = " ".join(f"w{i}x" for i in range(40_000))
LONG = f"{HEAD} bob@mail.example.com " + "x" * 200_000


@pytest.fixture(scope="module")
def hard(spark):
    """Null keys, texts and languages, repeats, ties, and texts of several hundred kilobytes."""
    rows = [(1, "plain words here", "en", "s", 16), (1, "plain words here", "en", "s", 16), (None, None, None, None, None), (None, "", "de", "s", 0), (2, LONG, "en", "s", len(LONG)), (3, LONG + " tail", None, "s", 1), (4, "PLAIN words here", "en", "t", 16)]
    return stored(spark.createDataFrame(rows, DDL), "hard")


def test_empty_tables(spark, tmp_path):
    docs, labels = spark.createDataFrame([], DDL), spark.createDataFrame([], LABELS)
    assert pieces.encode_decode(docs, ["doc_id"]).collect() == []
    assert packing.pack_documents(docs, ["doc_id"]).collect() == []
    assert simhash.near_duplicates(stored(simhash.fingerprints(docs, ["doc_id"]), "e")).collect() == []
    assert quality.judged(docs, labels).collect() == []
    assert licences.scan(docs, ["doc_id"]).collect() == []
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert exact.exact_duplicates(docs).collect() == []
    assert toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]).collect() == []
    assert pii.find(docs, ["doc_id"]).collect() == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_hard_rows(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    coded = pieces.encode_decode(hard, ["doc_id"]).select("doc_id", F.expr("cast(length(ids) / 4 as long)"), F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted(map(tuple, coded), key=repr) == sorted(brute.op1(rows), key=repr)
    packed = packing.pack_documents(hard, ["doc_id"]).collect()
    assert sum(r.length for r in packed) == sum(len(brute.token_ids(t)) for _, t in rows)
    got = exact.exact_duplicates(hard).select("row.doc_id", "keep_id", "group_size").collect()
    assert sorted((r.group_size for r in got)) == [1, 1, 2, 2, 3, 3, 3]
    judged = {(r.doc_id, r.lang): r for r in quality.judged(hard, spark.createDataFrame([(1, 1, 0), (4, 1, 0)], LABELS)).collect()}
    assert len(judged) == 6 and not judged[None, ""].kept and judged[2, "en"].perplexity > 1
    assert len(licences.scan(hard, ["doc_id"]).collect()) == 7
    found = {r.row.doc_id: r for r in pii.find(hard.filter("doc_id > 1"), ["doc_id"]).collect()}
    assert [(s.start, s.value) for s in found[2].base] == [(len(HEAD) + 1, "bob@mail.example.com")]
    prints = simhash.near_duplicates(stored(simhash.fingerprints(hard, ["doc_id"]), "p")).collect()
    assert len(prints) == 7 and {r.component_id for r in prints if r.doc_id in (1, 4)} == {1}


def test_string_keys(spark):
    docs = spark.createDataFrame([("a", "good words stand here " * 5, "en"), ("b", "zzqj xxkw vvpq " * 9, "en"), ("c", "good words stand here too", "en")], "doc_id string, text string, lang string")
    scores = {r.key: r.perplexity for r in quality.perplexities(docs, docs.filter("doc_id = 'a'").select("doc_id")).collect()}
    assert set(scores) == {"a", "b", "c"} and scores["c"] < scores["b"]
    assert {r.row.doc_id for r in exact.exact_duplicates(docs).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_clashing_names(spark, hard, stage, tmp_path):
    """Stages carry columns of any name, and keep their values."""
    own = hard.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    spark.createDataFrame([(1, 1, 0), (4, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, own, str(tmp_path))
    rows = out.collect()
    assert rows
    if stage != "packing":
        assert out.columns == own.columns
        assert all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)


def test_near_copies_of_equal_and_long_texts(spark, hard):
    rows = hard.withColumn("_row", F.monotonically_increasing_id())
    table = stored(nearcopies.banded(rows, ["_row", "doc_id", "text"]), "t")
    groups = {r.node: r.root for r in nearcopies.near_copies(table).collect()}
    by = {r._row: r.doc_id for r in table.collect()}
    assert sorted(sorted(str(by[n]) for n in groups if groups[n] == g) for g in set(groups.values())) == [["1", "1", "4"], ["2", "3"], ["None", "None"]]
