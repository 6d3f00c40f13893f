"""Sources, streams, gates, and all queries against their SQL."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import types as T

from axisflow import queries
from axisflow.plans import gates, reports
from axisflow.plans.cli import main
from axisflow.sources import benchmark, text
from axisflow.streaming import refresh

DATA = Path("/root/testdata/sf0.001")


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \x0bthree\n", encoding="utf-8")
    (tmp_path / "g.txt").write_text("x\ny\nx\n")
    assert [r["value"] for r in text.read_lines(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == ["one", "two", "three"]
    pairs = text.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "g.txt")).orderBy("n").collect()
    assert [(r["value"], r["calibration_group"]) for r in pairs] == [("one", "x"), ("two", "y"), ("three", "x")]
    (tmp_path / "g.txt").write_text("x\n\nx\n")
    with pytest.raises(ValueError, match="empty lines"):
        text.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "g.txt"))


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "m.csv").write_text('hostname,family\n"a,b.com", sql \nshort\n,x\nc.com,\nd.com,shell\n')
    assert sorted(map(tuple, text.read_labelled_csv(spark, str(tmp_path / "m.csv")).collect())) == [("a,b.com", "sql"), ("d.com", "shell")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"hostname":"a"}\nbroken\n{"hostname":null}\n{"other":1}\n{"hostname":5}\n')
    assert sorted(r["value"] for r in text.read_jsonl_key(spark, str(tmp_path / "d")).collect()) == ["5", "None", "a"]
    text.write_jsonl(spark.createDataFrame([("x", None)], "b string, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"a":null,"b":"x"}'
    with pytest.raises(Exception):
        text.read_jsonl_strict(spark, str(tmp_path / "d" / "x.jsonl"), T.StructType([T.StructField("hostname", T.StringType())])).collect()


def test_benchmark_chunks(spark, tmp_path):
    for name, rows in (("l0", 2), ("l1", 1), ("h0", 3)):
        (tmp_path / f"{name}.csv").write_text("ROW_ID,LABEL\n" + "".join(f"{name}-{i},M\n" for i in range(rows)))
    chunks = lambda *names: {"chunks": [{"path": f"{n}.csv", "rows": 1} for n in names]}
    (tmp_path / "manifest.json").write_text(json.dumps({"datasets": {"user_logins": chunks("l0", "l1"), "dns_hostnames": chunks("h0")}}))
    both = benchmark.read_benchmark(spark, str(tmp_path), ["ROW_ID", "LABEL"])
    assert both.count() == 6 and both.filter("chunk_family = 'user_logins' and chunk = 1").count() == 1
    assert benchmark.read_benchmark(spark, str(tmp_path), ["ROW_ID", "LABEL"], "user_logins").count() == 3


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet(str(DATA / "events.parquet")).limit(500)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh.windowed_mass(stream, "ts", "event_type", "value", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("mass").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], round(r["mass"], 6)) for r in df.collect())
    assert key(spark.table("mass")) == key(refresh.windowed_mass(events, "ts", "event_type", "value"))
    seen = []
    refresh.refresh_each_batch(stream, lambda b: seen.append(b.count()), str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 500 and len(seen) > 1


def test_commands(spark, tmp_path):
    for name, rows in (("benign", ["www.example.com", "api.example.org", "mail.example.net"] * 4), ("hosts", ["a.example.com", "b.example.org"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + "\n")
    (tmp_path / "bad.csv").write_text("hostname,family\n" + "\n".join(f"x{i};curl.example,shell\ny{i}--.example,sql" for i in range(4)) + "\n")
    m = ["--model", str(tmp_path / "model")]
    main(["train-priors", *m, "--benign", str(tmp_path / "benign.txt"), "--malicious", str(tmp_path / "bad.csv"), "--cones", "32", "--dim", "16", "--alpha", "0.25"])
    main(["calibrate", *m, "--hosts", str(tmp_path / "benign.txt")])
    main(["score", *m, "--hosts", str(tmp_path / "hosts.txt"), "--out", str(tmp_path / "scores")])
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == ["hostname", "threshold", "score", "prediction"]
    main(["refresh-benign", *m, "--hosts", str(tmp_path / "benign.txt")])


def test_gates(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("{}\n{}\n")
    bundle = tmp_path / "b.tar"
    gates.build_bundle(bundle, [tmp_path / "r.jsonl"], tmp_path)
    audit = {k: 0 for k in gates.ZERO_KEYS} | {"n_rows": 2, "x": {"status": "pass"}}
    assert gates.check_release(spark, str(tmp_path / "r.jsonl"), audit, bundle) == 2
    gates.extract_bundle(bundle, tmp_path / "out")
    assert (tmp_path / "out" / "r.jsonl").read_text() == "{}\n{}\n"
    for bad in ({"n_rows": 3}, {"email_like": 1}, {"guid_like": None}, {"x": {"status": "review"}}, {"y": [{"CDB": 1}]}):
        with pytest.raises(gates.GateError):
            gates.check_audit(audit | bad, 2)
    with pytest.raises(gates.GateError):
        gates.safe_member("../x")
    bundle.write_bytes(bundle.read_bytes() + b"x")
    with pytest.raises(gates.GateError):
        gates.check_bundle(bundle)


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "NULL"
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x).tz_localize(None))
        return f"{float(x):.7g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name in queries.SQL:
        with duckdb.connect() as db:
            for p in DATA.glob("*.parquet"):
                db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
            want = db.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    else:
        assert len(got) > 0


def test_the_rest_stands_without_the_llm_folder():
    code = "import sys; sys.modules['axisflow.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_schema_of_ordinals(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "value string, ord int")
    assert [(r["value"], r["n"]) for r in text.numbered(df).orderBy("n").collect()] == [("a", 0), ("b", 1)]
    assert text.unique_longer(spark.createDataFrame([("abcdef", 2), ("abcdef", 1), ("abc", 0)], "value string, ord int")).collect()[0]["ord"] == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("resolved_benign", "train", "dns_host", "withheld"), ("unresolved", "test", "dns_host", "withheld")], "label string, split string, source_family string, time_bucket string")
    assert "- dns_host: 2" in reports.data_card(rows, "v1")
    files = reports.stage_manifests(rows, tmp_path / "m", "v1")
    assert len(files) == 9 and json.loads(files[3].read_text())["histograms"]["label"] == {"resolved_benign": 1, "unresolved": 1}
    audit = reports.audit_document(rows.selectExpr("count(*) AS n_rows"), rows.selectExpr("named_struct('status', 'pass', 'n_findings', 0) AS scan").limit(1))
    assert "| scan | pass (0) |" in reports.audit_markdown(audit) and audit["n_rows"] == 2
    assert reports.row_at(spark.range(5).withColumnRenamed("id", "n"), -2).first()["n"] == 3
