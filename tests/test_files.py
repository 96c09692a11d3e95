"""Readers, writers and the incremental load on real files."""

import json

import pytest
from pyspark.sql import functions as F

from namesmith.operators import quality as DQ
from namesmith.operators import vectors as V
from namesmith.sources import payloads as P
from namesmith.sources import readers as R
from namesmith.streaming.loads import existing, known_keys, load_new


def test_commented_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('// head\n[[1, "가(加)", "운"],\n  // note\n [2]]\n', encoding="utf-8")
    rows = R.read_commented_json(spark, str(tmp_path / "a.json"), "ARRAY<ARRAY<STRING>>").first()["value"]
    assert rows == [["1", "가(加)", "운"], ["2"]]


def test_document_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"id": "a", "document": "d", "metadata": {"k": 1}}]), encoding="utf-8")
    (tmp_path / "bad.json").write_text(json.dumps({"id": "a"}), encoding="utf-8")
    got = {r["file"].rsplit("/", 1)[1]: (r["status"], r["id"]) for r in R.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"good.json": ("ok", "a"), "bad.json": ("source_json_must_be_list", None)}


def test_surname_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿성씨 한글명,성씨 한자명\n,金\n김,金\n금,金\n남궁,南宮\n", encoding="utf-8")
    rows = R.first_readings(R.read_surname_csv(spark, str(tmp_path / "s.csv")), "hanja", "hangul", "seq").collect()
    assert [(r["hanja"], r["hangul"]) for r in rows] == [("金", "김")]


def test_page_lines(spark):
    text = "앞\n=== PAGE 3 [본문] ===\n가\n나\n=== PAGE 4 [색인] ===\n다\n"
    rows = R.page_lines(spark.createDataFrame([(1, text)], "id long, t string"), "t", ["id"]).orderBy("line_no").collect()
    assert [(r["page"], r["section"], r["line"]) for r in rows] == [(0, "", "앞"), (3, "본문", "가"), (3, "본문", "나"), (4, "색인", "다")]


def test_html_table_skips_header_and_short_rows(spark):
    html = (
        '<table class="standard-table"><tr><th>이름</th><th>a</th><th>b</th><th>c</th></tr><tr><td> <b>가람</b> </td><td>강 &amp; 물</td><td>남</td><td>증가</td></tr>'
        "<tr><td>x</td></tr><tr><td></td><td>1</td><td>2</td><td>3</td></tr></table>"
    )
    rows = P.table_rows(spark.createDataFrame([(1, html)], "id long, html string"), "html", ["id"]).collect()
    assert [(r["name"], r["meaning"], r["gender"], r["trend"]) for r in rows] == [("가람", "강 & 물", "남", "증가")]


def _docs(spark, *ids):
    return spark.createDataFrame([(i, f"doc {i}") for i in ids], "id string, document string").withColumn(
        "metadata", F.create_map(F.lit("type"), F.lit("x"))
    )


def test_gate_writes_only_without_issues(spark, tmp_path):
    docs = _docs(spark, "a", "b")
    report = spark.createDataFrame([("failed", 1)], "status string, issue_count int")
    issues = spark.createDataFrame([("a", "empty")], "id string, issue string")
    with pytest.raises(DQ.ValidationFailed):
        DQ.gated_write(docs, issues, report, str(tmp_path / "out"), str(tmp_path / "report"))
    assert not (tmp_path / "out").exists() and spark.read.json(str(tmp_path / "report")).count() == 1
    DQ.gated_write(docs, issues.limit(0), report, str(tmp_path / "out"), str(tmp_path / "report"))
    assert spark.read.schema(R.DOCUMENT_SCHEMA).json(str(tmp_path / "out")).count() == 2


def test_recreate_and_append(spark, tmp_path):
    path = str(tmp_path / "col")
    rows = spark.createDataFrame([("c", "1", "x"), ("c", "2", "y")], "collection string, id string, body string")
    V.recreate(rows, str(tmp_path / "whole"))
    V.recreate(rows.limit(1), str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 1
    rows.write.parquet(path)
    more = spark.createDataFrame([("c", "2", "z"), ("c", "3", "w"), ("c", "3", "w")], rows.schema)
    for _ in range(2):
        V.append_new(spark, more, path, ["collection", "id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["1", "2", "3"]


def test_incremental_load_reads_new_files_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    schema = "id string, body string"
    spark.createDataFrame([("1", "a"), ("2", "b")], schema).write.mode("append").parquet(source)
    files = spark.read.parquet(source).schema
    load_new(spark, source, files, target, progress, ["id"])
    spark.createDataFrame([("2", "late"), ("3", "c")], schema).write.mode("append").parquet(source)
    for _ in range(2):
        load_new(spark, source, files, target, progress, ["id"])
    got = {r["id"]: r["body"] for r in existing(spark, target, files).collect()}
    assert got == {"1": "a", "2": "b", "3": "c"}


def test_load_takes_the_first_of_a_key_and_reads_touched_buckets(spark, tmp_path):
    source, target, progress = (str(tmp_path / d) for d in ("in", "out", "progress"))
    schema = "id string, body string"
    spark.createDataFrame([(str(i), "z") for i in range(40)] + [("7", "a"), ("99", "y"), ("99", "b")], schema).coalesce(1).write.parquet(source)
    files = spark.read.parquet(source).schema
    load_new(spark, source, files, target, progress, ["id"], buckets=8)
    spark.createDataFrame([("7", "late"), ("100", "new")], schema).coalesce(1).write.mode("append").parquet(source)
    load_new(spark, source, files, target, progress, ["id"], buckets=8)
    got = {r["id"]: r["body"] for r in existing(spark, target, files).collect()}
    assert got["7"] == "z" and got["99"] == "y" and got["100"] == "new" and len(got) == 42
    plan = known_keys(spark, target, files, ["id"], [3], "load-1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1] and "body" not in plan


def test_upsert_keeps_the_last_of_a_key(spark):
    there = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, body string")
    more = spark.createDataFrame([("2", "x", 2), ("2", "y", 1), ("3", "z", 1)], "id string, body string, seq int")
    assert sorted(map(tuple, V.upserted(there, more, ["id"], ["seq"]).collect())) == [("1", "a"), ("2", "x"), ("3", "z")]
    assert sorted(map(tuple, V.new_rows(there, more, ["id"], ["seq"]).collect())) == [("3", "z", 1)]


def test_balanced_elements(spark):
    html = "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>x</ul><ul class='n'></ul><ulx>no</ulx><ul><li>open"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = {r.id: r.b for r in df.select("id", P.balanced(F.col("html"), "ul").alias("b")).collect()}
    assert got[1] == ["<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "<ul class='n'></ul>"] and not got[2] and got[3] == []
    rows = P.listed_rows(df, "html", ["id"], "ul", "li", "ul", 1).collect()
    assert [(r.id, r.scope_no, r.row_no, r.cells) for r in rows] == [(1, 0, 0, ["b"])]


def test_csv_order_is_file_order(spark, tmp_path):
    head = "﻿" + ",".join(f.name for f in R.SURNAME_CSV.fields) if not isinstance(R.SURNAME_CSV, str) else None
    names = [c.split(" STRING")[0].strip().strip("`") for c in R.SURNAME_CSV.split(", ")] if head is None else [f.name for f in R.SURNAME_CSV.fields]
    at = {n: i for i, n in enumerate(names)}

    def lines(rows):
        out = []
        for hanja, hangul in rows:
            cells = [""] * len(names)
            cells[at["성씨 한자명"]], cells[at["성씨 한글명"]] = hanja, hangul
            out.append(",".join(cells))
        return "﻿" + ",".join(names) + "\n" + "\n".join(out) + "\n"

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text(lines([("林", ""), ("林", "임"), ("金", "김")]), encoding="utf-8")
    (tmp_path / "csv" / "b.csv").write_text(lines([("金", "금"), ("林", "림"), ("朴", "박")] + [("吳", f"오{i}") for i in range(50)]), encoding="utf-8")
    rows = R.first_readings(R.read_surname_csv(spark, str(tmp_path / "csv")), "hanja", "hangul", "seq").collect()
    assert {r.hanja: r.hangul for r in rows} == {"林": "임", "金": "김", "朴": "박", "吳": "오0"}
