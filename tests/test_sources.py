import json
import sqlite3

from pyspark.sql import functions as F

from corpusmill.operators import logs as L
from corpusmill.operators.markdown import normalise_lines, sanitise
from corpusmill.sources import readers as R
from corpusmill.sources import writers as W
from corpusmill.streaming import ledgers


def test_cases_are_read_in_order_with_offset(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"case_{i}.json").write_text(json.dumps({"case_id": str(i), "split": "dev" if i != 1 else "test"}, indent=1))
    got = R.read_cases(spark, str(tmp_path), "case_id string, split string", split="dev", offset=1, limit=2).collect()
    assert [r.case_id for r in got] == ["2", "3"]


def test_jsonl_keeps_rejects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": bad\n{"a": 2}\n')
    rows, rejects = R.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and rejects.count() == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"b": 2}\n')
    row = R.file_manifest(spark, str(tmp_path)).first()
    assert (row.records, row.fields, row.bytes) == (2, ["a", "b"], 18)


def test_manifest_of_equal_names_in_two_folders(spark, tmp_path):
    for folder, text in (("x", '{"a": 1}\n'), ("y", '{"b": 1}\n{"c": 2}\n')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.jsonl").write_text(text)
    (tmp_path / "empty.jsonl").write_text("")
    manifest = R.file_manifest(spark, str(tmp_path))
    assert sorted((r.file.split("/")[-2], r.records, r.fields) for r in manifest.collect() if r.records) == [("x", 1, ["a"]), ("y", 2, ["b", "c"])]
    assert manifest.count() == 2
    assert sorted(r.name for r in R.missing_files(manifest, ["x/part.jsonl", "z/part.jsonl", "empty.jsonl"]).collect()) == ["empty.jsonl", "z/part.jsonl"]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "p.db") as db:
        db.execute("create table k(id int, name text)")
        db.execute("insert into k values (1, 'x'), (2, 'y')")
    assert R.read_sqlite(spark, str(tmp_path / "p.db"), "select id, name from k", "id long, name string").count() == 2


def test_latest_run_prefers_exact_tags(spark):
    paths = spark.createDataFrame([("/r/1_tag",), ("/r/2_tag",), ("/r/3_tag_more",)], "path string")
    assert R.latest_run(paths, "tag").first().path == "/r/2_tag"
    assert R.latest_run(paths, "more").first().path == "/r/3_tag_more"


def test_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("c", 0, "z")], "k string, t int, v string")
    assert {r.k: r.v for r in W.upsert(old, new, ["k"], "t").collect()} == {"a": "y", "b": "x", "c": "z"}
    assert W.markdown_table(new.orderBy("k"), ["k", "t"]).splitlines()[2] == "| a | 1 |"


def test_ledger_counts_settled_before_reserved(spark):
    rows = [("s", "1", "reserved", 1, 5.0), ("s", "1", "completed", 2, 2.0), ("s", "2", "reserved", 3, 4.0), ("s", "2", "unknown", 4, 9.0), ("s", "3", "reserved", 5, 1.0), ("s", "3", "failed_known_zero", 6, None)]
    got = L.committed(spark.createDataFrame(rows, "scope string, call_id string, event string, seq int, usd double")).first()
    assert (got.committed, got.calls) == (6.0, 3)


def test_busy_time_and_concurrency(spark):
    spans = spark.createDataFrame([("g", 0, 4), ("g", 2, 3), ("g", 6, 8)], "g string, start long, end long")
    got = L.busy_time(spans, "g").first()
    assert (got.busy, got.gap, got.spans) == (6, 2, 3)
    events = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (4000, -1, 1), (4002, 0, -1)], "t long, generating int, prefilling int")
    got = {(r.generating, r.prefilling): r.seconds for r in L.concurrency(events).collect()}
    assert got[1, 0] == 3 and got[2, 0] == 3997 and got[1, 1] == 2 and got[None, 0] == 4000


def test_blocks():
    text = "**Label**：\na\n\nb。\nc\n- x\n  more\n1. y\n> q\n> r\n```\n# code\n```\n|a|b|\n|-|-|\n---\n# T\nend<br/>**k：**v"
    assert normalise_lines(text).split("\n\n") == ["## Label", "a\nb。", "c", "- x\n  more\n1. y", "> q\n> r", "```\n# code\n```", "|a|b|\n|-|-|", "---", "# T", "end\n**k：** v"]
    assert normalise_lines("|a|b||---|---||1|2|") == "|a|b||---|---||\n| 1|2|"
    assert normalise_lines("| a | b | |:---|---:| | 1 | **2** | | 3 | | 4 |") == "| a | b | |:---|---:||\n| 1 | **2** ||\n| 3 ||\n| 4 |"
    assert normalise_lines("|---|---|x|y|z|") == "|---|---|\n\nx|y|z|" and normalise_lines("|a|b||---|x||") == "|a|b||---|x||"
    assert normalise_lines("") == "" and normalise_lines("```\nopen") == "```\nopen"


def test_output_clean_up(spark):
    title = "# 交通事故分析报告"
    cases = {
        "<think>x # y</think>\r\nSure:\n```markdown\n## A\ntext\n```": f"{title}\n\n## A\n\ntext",
        "": "",
        None: "",
        " \n": "",
        "plain": f"{title}\n\nplain",
        "Here it is:\n# A\nb": "# A\n\nb",
        "one.\ntwo.\nthree.\nfour.\n# A\nb": "one.\n\ntwo.\n\nthree.\n\nfour.\n\n# A\n\nb",
        "lead\n## B\n# A": "lead\n\n## B\n\n# A",
        "```text\n# A\nb\n```": "# A\n\nb",
        "```thinking\nhm\n```\n# A": "# A",
        "\ufeff<Analysis id='1'>x\ny</ANALYSIS> # A": "# A",
        "# A\n```md2\nx\n```": "# A\n\n```md2\nx\n```",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = {r.i: r.x for r in df.select("i", sanitise(F.col("v")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_streams(spark, tmp_path):
    schema = "scope string, call_id string, event string, usd double"
    spark.createDataFrame([("s", "1", "reserved", 6.0), ("s", "2", "reserved", 6.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledgers.running_budget(ledgers.read_drops(spark, str(tmp_path / "in"), schema), 10.0)
    q = stream.writeStream.format("memory").queryName("granted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.call_id: r.granted for r in spark.table("granted").collect()} == {"1": True, "2": False}
    updates = ledgers.read_drops(spark, str(tmp_path / "in"), schema)
    ledgers.upsert_stream(updates, str(tmp_path / "out"), ["scope"], "usd", str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "v=0")).count() == 1
