"""Queries that write a table as files of a session folder and read it back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlake.plans import views as v
from lumenlake.plans.catalog import query
from lumenlake.sources import sessions, sinks
from lumenlake.sources.scratch import scratch


def as_text(rows, name, header=None, sep=","):
    """Rows of a column ``value`` to a folder of text files, each with the header; its path."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    own = rows.select("value")
    if header is None:
        own.write.text(path)
    else:  # one field a line, as the readers take them
        own.select(F.split("value", "\x01").alias("c")).select(*[F.col("c")[i].alias(h) for i, h in enumerate(header)]).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("quoteAll", False).option("sep", sep).csv(path)
    assert sinks.exists(spark, path)
    return path


def cells(*columns):
    return F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).alias("value")


@query("s1_session_layouts", """SELECT o_orderkey::VARCHAR AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'directory' WHEN o_orderkey % 3 = 1 THEN 'flat_directory' ELSE 'zip' END AS layout FROM orders""")
def s1(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    path = F.expr("case when k % 3 = 0 then array(concat('/x/', k, '_P/', k, '_CLNF_pose.txt'), concat('/x/', k, '_COVAREP.csv')) when k % 3 = 1 then array(concat('/x/data/', k, '_COVAREP.csv'), concat('/x/', k, '_P.zip')) else array(concat('/x/', k, '_P.zip'), '/x/readme.txt') end")
    return sessions.session_layouts(o.select(F.explode(path).alias("path")))


@query("s2_archive_members", "SELECT o_orderkey::VARCHAR AS session_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a.csv' ELSE 'x/a.csv' END AS member FROM orders")
def s2(spark, d):
    members = F.expr("if(o_orderkey % 2 = 0, array('a.csv', 'x/a.csv', 'b.csv'), array('x/yy/a.csv', 'xx/a.csv', 'x/a.csv'))")
    return sessions.archive_member(v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), F.explode(members).alias("member")), "a.csv")


@query("s3_measures", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders")
def s3(spark, d):
    o = v.table(spark, d, "orders")
    path = as_text(o.select(cells(F.col("o_orderkey"), F.expr("case when o_orderkey % 10 = 0 then 'n/a' when o_orderkey % 5 = 0 then concat(o_orderkey, 'd') else concat(' ', o_totalprice) end"))), "measures", [" o_orderkey", " price "])
    return sessions.read_measures(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "price")


@query("s4_positional", "SELECT l_orderkey::DOUBLE AS key, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1")
def s4(spark, d):
    path = as_text(v.table(spark, d, "lineitem").select(F.concat_ws(",", "l_orderkey", "l_quantity", "l_tax").alias("value")), "positional")
    return sessions.read_positional(spark, path, ["key", "quantity", "tax"]).groupBy("key").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))


@query("s5_semicolons", "SELECT p_partkey::DOUBLE AS p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price, p_name AS name FROM part")
def s5(spark, d):
    rows = v.table(spark, d, "part").select(cells(F.col("p_partkey"), F.expr("if(p_partkey % 4 = 0, concat(p_partkey, 'f'), cast(p_retailprice as string))"), F.col("p_name")))
    return sessions.read_measures(spark, as_text(rows, "semicolons", ["p_partkey", "price", "name"], ";"), ";", ["name"]).select("p_partkey", "price", "name")


@query("s8_recognised_speech", """SELECT conv_id::DOUBLE * 100 + turn AS start_sec, conv_id::DOUBLE * 100 + turn + 1 AS end_sec, CASE WHEN turn % 4 <> 1 THEN 'said ' || role END AS text, CASE WHEN turn % 3 = 0 THEN 0.5::DOUBLE END AS confidence, turn % 4 = 1 AS privacy_scrubbed FROM conversations WHERE turn % 5 <> 4""")
def s8(spark, d):
    c = v.table(spark, d, "conversations").select("conv_id", "turn", "role")
    said = F.expr("case when turn % 5 = 4 then ' ' when turn % 4 = 1 then '<SCRUBBED_entry>' else concat(' said  ', role) end")
    rows = c.select(cells(F.expr("conv_id * 100 + turn"), F.expr("conv_id * 100 + turn + 1"), F.expr("if(turn % 5 = 4, '', " + "case when turn % 4 = 1 then '<SCRUBBED_entry>' else concat(' said  ', role) end)"), F.expr("case turn % 3 when 0 then '0.5' when 1 then '1.5' else 'x' end")))
    del said
    return sessions.read_recognised_speech(spark, as_text(rows, "speech", ["Start", "end_time", "Text", "Confidence"]))


def split_file(spark, d):
    o = v.table(spark, d, "documents")
    return as_text(o.select(cells(F.col("doc_id"), F.expr("element_at(array('Train', 'valid', 'TEST'), cast(doc_id % 3 + 1 as int))"), F.expr("if(doc_id % 3 = 2, 'hidden', cast(doc_id % 2 as string))"))), "splits", ["Participant_ID", "Split", "label"])


@query("s9_split_ids", "SELECT doc_id::VARCHAR AS session_id FROM documents WHERE doc_id % 3 = 0")
def s9(spark, d):
    return sessions.read_session_ids(spark, split_file(spark, d), "train")


@query("s10_selected_ids", "SELECT doc_id::VARCHAR AS session_id FROM documents WHERE doc_id % 3 = 1 ORDER BY doc_id LIMIT 25")
def s10(spark, d):
    available = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("session_id"))
    return sessions.select_sessions(sessions.read_session_ids(spark, split_file(spark, d), "VALID"), available, 25)


@query("s11_labels", "SELECT doc_id::VARCHAR AS session_id, (doc_id % 25 >= 10)::INTEGER AS label, CASE doc_id % 3 WHEN 0 THEN 'train' ELSE 'valid' END AS split FROM documents WHERE doc_id % 3 <> 2")
def s11(spark, d):
    rows = v.table(spark, d, "documents").select(cells(F.expr("concat(doc_id, '.0')"), F.expr("doc_id % 25"), F.expr("element_at(array('Train', 'valid', 'test'), cast(doc_id % 3 + 1 as int))")))
    return sessions.read_labels(spark, as_text(rows, "labels", ["Participant_ID", "PHQ_Score", "fold"]), "phq_score", 10.0, ["train", "valid"])


@query("s12_participants", "SELECT doc_id::VARCHAR AS session_id, quality AS label FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL")
def s12(spark, d):
    rows = v.table(spark, d, "labels").filter("quality is not null and doc_id is not null").select(cells(F.col("doc_id"), F.lit("x"), F.col("quality")))
    return sessions.read_participants(spark, as_text(rows, "participants", ["index", "name", "Binary"]), "binary")


RAW_SQL = "SELECT doc_id, ['train', 'valid', 'test'][doc_id % 3 + 1] AS fold, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS y FROM documents"


def raw_labels(spark, d):
    return v.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("session_id"), F.expr("if(doc_id % 3 = 2 and doc_id % 4 = 0, '???', if(doc_id % 2 = 0, 'normal', ' Depression '))").alias("label"), F.expr("element_at(array('train', 'Valid', 'test'), cast(doc_id % 3 + 1 as int))").alias("fold"), F.expr("if(doc_id % 3 = 2, cast(doc_id + 1 as string), 'x')").alias("duration"),
    )


MAPPING = {"normal": 0, "depression": 1}


@query("s13_supervised_splits", f"WITH r AS ({RAW_SQL}) SELECT doc_id::VARCHAR AS session_id, fold AS split, CASE WHEN fold <> 'test' THEN y END AS target FROM r")
def s13(spark, d):
    own = sessions.supervised_splits(raw_labels(spark, d), MAPPING)
    assert own["test"].columns == ["session_id", "split"]
    return own["train"].unionByName(own["valid"]).unionByName(own["test"], allowMissingColumns=True).select("session_id", "split", "target")


@query("s14_official_test", f"WITH r AS ({RAW_SQL}) SELECT doc_id::VARCHAR AS session_id, y AS label, (doc_id + 1)::DOUBLE AS duration FROM r WHERE fold = 'test' AND doc_id % 4 <> 0")
def s14(spark, d):
    return sessions.official_test_labels(raw_labels(spark, d).filter("label <> '???'"), MAPPING)


@query("s16_duplicate_keys", """SELECT '{"a": ' || doc_id || ', "b": {"c": 1, "c": 2}}' AS value, 'c' AS duplicates FROM documents WHERE doc_id % 3 = 0""")
def s16(spark, d):
    lines = v.table(spark, d, "documents").select(F.expr("""concat('{"a": ', doc_id, ', "b": {"c": 1, "', if(doc_id % 3 = 0, 'c', 'd'), '": 2}}')""").alias("value"))
    return sessions.duplicated_keys(lines).select("value", F.array_join("duplicates", ",").alias("duplicates"))


@query("s18_evidence_segments", "SELECT printf('S%03d', o_orderkey) AS segment_id, o_orderkey * 5::DOUBLE AS start_sec, o_orderkey * 5::DOUBLE + 2.5::DOUBLE AS end_sec FROM orders")
def s18(spark, d):
    o = v.table(spark, d, "orders").select(F.explode(F.expr("array(format_string('SEGMENT S%03d | time %d to %s seconds | 3 windows', o_orderkey, o_orderkey * 5, cast(o_orderkey * 5 + 2.5 as string)), 'AUDIO summary', '')")).alias("value"))
    return sessions.read_evidence_segments(spark, as_text(o, "segments"))


@query("s21_atomic_lines", "SELECT printf('E%04d', o_orderkey) AS atomic_id, o_orderkey::DOUBLE AS start_sec, o_orderkey + 4::DOUBLE AS end_sec FROM orders")
def s21(spark, d):
    o = v.table(spark, d, "orders").select(F.expr("format_string('EVIDENCE E%04d | time %d to %d.0 seconds | text', o_orderkey, o_orderkey, o_orderkey + 4)").alias("value"))
    return sessions.read_atomic_lines(spark, as_text(o, "atoms"))


@query("s19_unit_violations", """SELECT 'f' || s_nationkey AS source_path, 'several_sessions' AS reason FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) > 1
  UNION SELECT 'f' || s_nationkey, 'repeated_id' FROM (SELECT s_nationkey, s_suppkey % 4 AS id FROM supplier GROUP BY 1, 2 HAVING count(*) > 1)""")
def s19(spark, d):
    return sessions.unit_violations(v.table(spark, d, "supplier").selectExpr("concat('f', s_nationkey) as source_path", "s_suppkey % 2 as session_id", "s_suppkey % 4 as evidence_id"))


@query("s20_index_rows", "SELECT session_id, atomic_no AS atomic_id, unit_id AS canonical_id, modality, source_id FROM units", "units")
def s20(spark, d):
    u = v.units(spark, d)
    index = u.groupBy("session_id", F.col("atomic_no").cast("string").alias("atomic_id")).agg(
        F.min("start_sec").alias("start_sec"), (F.max("start_sec") + 5).alias("end_sec"), F.array_sort(F.collect_list(F.struct("unit_id", "modality", "source_id"))).alias("u"),
    )
    rows = index.select("session_id", "atomic_id", "start_sec", "end_sec", F.col("u.unit_id").alias("canonical_ids"), F.col("u.modality").alias("modalities"), F.col("u.source_id").alias("source_ids"))
    return sessions.index_rows(rows).select("session_id", F.col("atomic_id").cast("long").alias("atomic_id"), "canonical_id", "modality", "source_id")


@query("j18_cross_violations", """SELECT 'index_without_unit' AS what, unit_id::VARCHAR AS key FROM units WHERE unit_id % 50 = 0 UNION ALL SELECT 'modality_differs', unit_id::VARCHAR FROM units WHERE unit_id % 50 = 1
  UNION ALL SELECT DISTINCT 'index_without_line', atomic_no::VARCHAR FROM units WHERE atomic_no % 40 = 3 UNION ALL SELECT DISTINCT 'time_differs', atomic_no::VARCHAR FROM units WHERE atomic_no % 40 = 4""", "units")
def j18(spark, d):
    u = v.units(spark, d).withColumn("end_sec", F.col("start_sec") + 5)
    canonical = u.filter("unit_id % 50 <> 0").selectExpr("cast(unit_id as string) as evidence_id", "if(unit_id % 50 = 1, 'other', modality) as modality")
    index = u.selectExpr("cast(unit_id as string) as canonical_id", "modality", "cast(atomic_no as string) as atomic_id", "start_sec", "end_sec")
    lines = u.filter("atomic_no % 40 <> 3").selectExpr("cast(atomic_no as string) as atomic_id", "start_sec + if(atomic_no % 40 = 4, 0.1D, 0.001D) as start_sec", "end_sec").distinct()
    return sessions.cross_violations(canonical, index, lines)


@query("k2_canonical_json", """SELECT '{"a":{"b":"' || r_name || '","z":' || r_regionkey || '},"key":' || r_regionkey || ',"none":null}' AS value FROM region""")
def k2(spark, d):
    """K2 and X5."""
    r = v.table(spark, d, "region")
    return sinks.canonical_json(r.select(F.col("r_regionkey").alias("key"), F.lit(None).cast("string").alias("none"), F.struct(F.col("r_regionkey").alias("z"), F.col("r_name").alias("b")).alias("a")))


@query("k3_session_manifest", "SELECT o_custkey AS session_id, count(*) AS files, round(sum(o_totalprice), 4) AS bytes, count(*) FILTER (WHERE o_orderstatus = 'O') AS ok, count(*) FILTER (WHERE o_orderstatus <> 'O') AS failed FROM orders GROUP BY 1")
def k3(spark, d):
    return sinks.session_manifest(v.table(spark, d, "orders").selectExpr("o_custkey as session_id", "o_totalprice as size", "if(o_orderstatus = 'O', 'ok', 'x') as status")).withColumn("bytes", F.round("bytes", 4))


_WORDS_SQL = ", ".join(f"sum(('0x' || substr(sha256(l), {16 * i + 1}, 16))::UBIGINT::HUGEINT)::VARCHAR" for i in range(4))


@query("k6_package", f"""WITH l AS (SELECT 'orders' AS t, '{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}' AS l FROM orders
  UNION ALL SELECT 'parts', '{{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}}' FROM part) SELECT t AS "table", count(*) AS rows, sha256(concat_ws(',', {_WORDS_SQL})) AS digest, true AS verified FROM l GROUP BY 1""")
def k6(spark, d):
    """K1, K4, K6 and K8: a package is written once, and its digests hold when read again."""
    folder = scratch(spark, "package")
    made = sinks.write_package(spark, {"orders": v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "parts": v.table(spark, d, "part").select("p_size", "p_partkey")}, folder)
    again = sinks.package_digests(spark, folder, ["orders", "parts"])
    bad = sinks.verified(again, made, ["table"])
    return made.join(bad, "table", "left").select("table", "rows", "digest", F.col("state").isNull().alias("verified"))


@query("k8_manifest_differences", "SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 5 = 1 THEN 'new' ELSE 'changed' END AS state FROM nation WHERE n_nationkey % 5 IN (0, 1, 2)")
def k8(spark, d):
    n = v.table(spark, d, "nation").selectExpr("n_name as path", "n_nationkey as k", "n_regionkey as size")
    now = n.filter("k % 5 <> 0").selectExpr("path", "if(k % 5 = 2, size + 1, size) as size")
    return sinks.verified(now, n.filter("k % 5 <> 1").select("path", "size"), ["path"])


@query("k7_markdown", "SELECT '| r_name | r_regionkey |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || r_name || ' | ' || r_regionkey || ' |' FROM region")
def k7(spark, d):
    return sinks.markdown(v.table(spark, d, "region"), ["r_name", "r_regionkey"]).select("line")


@query("s2_archives", """SELECT k::VARCHAR AS session_id, CASE k % 2 WHEN 0 THEN 'notes.txt' ELSE 'x/notes.txt' END AS member, sha256(string_agg(sha256(coalesce(text, '')), ',' ORDER BY doc_id)) AS digest FROM (SELECT doc_id // 10 AS k, * FROM documents) WHERE k % 5 <> 4 GROUP BY k""")
def s2_archives(spark, d):
    """Whole documents, ten an archive, read back as the wanted member of each; a fifth of the archives lack it."""
    import io
    import zipfile

    import pyarrow as pa

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        k, buffer = key[0].as_py(), io.BytesIO()
        text = "\x00".join(t or "" for _, t in sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)))
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("x/y/notes.txt" if k % 5 < 4 else "other.txt", "deep")
            if k % 5 < 4:
                archive.writestr("notes.txt" if k % 2 == 0 else "x/notes.txt", text)
                archive.writestr("xx/notes.txt", "longer")
        return pa.table({"path": [f"/archives/{k}_P.zip"], "content": pa.array([buffer.getvalue()], pa.binary())})

    docs = v.table(spark, d, "documents").select("doc_id", "text", F.expr("doc_id div 10").alias("k"))
    made = docs.groupBy("k").applyInArrow(packed, "path string, content binary")
    each = F.transform(F.split(F.col("content").cast("string"), "\x00"), lambda t: F.sha2(t, 256))
    return sessions.archived(made, "notes.txt").select("session_id", "member", F.sha2(F.array_join(each, ","), 256).alias("digest"))


@query("k5_incremental", "SELECT o_custkey AS session_id, CASE WHEN o_custkey % 20 = 3 THEN 2 ELSE 1 END AS run, CASE WHEN o_custkey % 20 = 3 THEN 'changed' WHEN o_custkey % 20 = 7 THEN 'gone' END AS state, count(*) AS orders, round(sum(o_totalprice + CASE WHEN o_custkey % 20 = 3 THEN 1 ELSE 0 END), 2) AS total FROM orders GROUP BY 1")
def k5(spark, d):
    """Sessions compiled once, then again after a twentieth of them changed and another went; with what the
    second refresh found, and the rows of those that are gone as they were."""
    from lumenlake.sources import incremental

    folder = scratch(spark, "compiled")
    first = v.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    second = first.filter("o_custkey % 20 <> 7").withColumn("price", F.expr("if(o_custkey % 20 = 3, price + 1, price)"))
    totals = lambda rows: rows.groupBy(F.col("o_custkey").alias("session_id")).agg(F.count("*").alias("orders"), F.sum("price").alias("total"))
    incremental.refresh(spark, folder, first, "o_custkey", "v1", totals)
    before = spark.read.parquet(f"{folder}/data/run=1").withColumn("run", F.lit(1))
    found = incremental.refresh(spark, folder, second.repartition(3), "o_custkey", "v1", totals)
    gone = before.join(found.filter("state = 'gone'"), "session_id", "left_semi")
    rows = incremental.current(spark, folder).unionByName(gone).join(found, "session_id", "left")
    return rows.select("session_id", F.col("run").cast("int").alias("run"), "state", "orders", F.round("total", 2).alias("total"))
