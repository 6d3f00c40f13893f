"""Operators on small tables with known results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from axisflow.operators import audit, augment, calibration, certify, edits, labels, metrics, release, scoring, sketch
from axisflow.plans.model import Config, Model


def scores(spark, xs, group=None):
    return spark.createDataFrame([(float(x), g) for x, g in zip(xs, group or [None] * len(xs))], "score double, g string")


def test_thresholds(spark):
    row = calibration.thresholds(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), 0.2).first()
    assert (row["threshold"], row["rank"], row["num_samples"]) == (0.5, 5, 5)
    got = {r["g"]: r["threshold"] for r in calibration.thresholds(scores(spark, [0.1, 0.4, 0.2, 0.8], ["a", "a", "b", "b"]), 0.5, "g").collect()}
    assert got == {"a": 0.4, "b": 0.8}
    assert calibration.thresholds(scores(spark, []), 0.1).count() == 0
    for n in (1, 7, 100):
        for alpha in (1e-4, 0.05, 0.5, 0.9):
            k = max(1, min(math.ceil((1.0 - alpha) * (n + 1)), n))
            xs = [(i * 37) % n for i in range(n)]
            assert calibration.thresholds(scores(spark, xs), alpha).first()["threshold"] == sorted(xs)[k - 1]
    ties = calibration.thresholds(scores(spark, [1.0] * 9 + [2.0], [None] * 10), 0.3, "g").first()
    assert ties["threshold"] == 1.0 and ties["g"] is None


def test_p_values(spark):
    benign = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0)], "score double")
    got = {r["score"]: r["p_value"] for r in calibration.p_values(spark.createDataFrame([(0.0,), (2.0,), (9.0,)], "score double"), benign).collect()}
    assert got == {0.0: 1.0, 2.0: 0.8, 9.0: 0.2}


def test_decisions(spark):
    rows = spark.createDataFrame([(0.5, "a"), (0.6, "a"), (0.5, "z"), (0.5, None)], "score double, calibration_group string")
    groups = spark.createDataFrame([("a", 0.5)], "calibration_group string, threshold double")
    assert sorted((r["calibration_group"] or "", r["prediction"]) for r in calibration.decided(rows, groups, 0.1).collect()) == [("", 1), ("a", 0), ("a", 1), ("z", 1)]
    with pytest.raises(Exception, match="no threshold"):
        calibration.decided(rows, groups, None).collect()


def test_two_axes_in_closed_form(spark):
    axes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cone int, axis array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    s = sketch.exploded(sketch.sketch(v, axes, r=1))
    benign = spark.createDataFrame([(0, 0.9, math.log(0.9)), (1, 0.1, math.log(0.1))], "cone int, p double, log_p double")
    bad = spark.createDataFrame([(f, c, p, math.log(p)) for f, ps in (("a", (0.2, 0.8)), ("b", (0.6, 0.4))) for c, p in enumerate(ps)], "family string, cone int, p double, log_p double")
    mix = scoring.mixture_weights(bad.select("family").distinct(), {"a": 1, "b": 3})
    want = math.log(0.25 * (0.2 / 0.9) ** 2 + 0.75 * (0.6 / 0.9) ** 2)
    assert scoring.scores(s, benign, bad, mix, 2.0).first()["score"] == pytest.approx(want)
    assert scoring.fast_scores(s, scoring.cone_scores(benign, bad, mix, 2.0)).first()["score"] == pytest.approx(want)
    assert scoring.batch_scores(v, axes, benign, bad, mix, 1, 10.0, 2.0).first()["score"] == pytest.approx(want)
    many = spark.createDataFrame([(i, [math.sin(i), math.cos(i * i)]) for i in range(40)], "vec_id long, embedding array<float>")
    slow = {r["vec_id"]: r["score"] for r in scoring.scores(sketch.exploded(sketch.sketch(many, axes, r=2)), benign, bad, mix, 2.0).collect()}
    assert {r["vec_id"]: r["score"] for r in scoring.batch_scores(many, axes, benign, bad, mix, 2, 10.0, 2.0).collect()} == pytest.approx(slow) and scoring.batch_scores(many.limit(0), axes, benign, bad, mix).count() == 0
    with pytest.raises(ValueError, match="lack"):
        scoring.mixture_weights(bad.select("family"), {"a": 1})


def test_sketches_agree_and_sum_to_one(spark):
    axes = sketch.random_axes(spark, 16, 4)
    v = spark.createDataFrame([(i, [math.sin(i + j) for j in range(4)]) for i in range(20)], "vec_id long, embedding array<float>")
    a = {(r["vec_id"], r["cone"]): r["weight"] for r in sketch.exploded(sketch.sketch(v, axes, 4)).collect()}
    b = {(r["vec_id"], r["cone"]): r["weight"] for r in sketch.sketch_sql(v, axes, 4).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert sum(a.values()) == pytest.approx(20)


def test_model_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(i, [math.sin(i * j + j) for j in range(8)], f"f{i % 2}") for i in range(60)], "vec_id long, embedding array<float>, family string")
    model = Model.fit(e.filter("vec_id < 30"), e.filter("vec_id >= 30"), Config(dim=8, cones=32, r=4, alpha=0.1))
    model.check()
    scored = model.score(e)
    model = model.calibrate(scored.filter("vec_id < 30"))
    model.save(str(tmp_path / "m"))
    again = Model.load(spark, str(tmp_path / "m"))
    key = lambda df: {r["vec_id"]: r["score"] for r in df.collect()}
    one, two = key(scored), key(again.score(e))
    assert one == pytest.approx(two) and again.threshold == model.threshold
    assert key(again.score(e, 4)) == pytest.approx(one)
    new, report = again.refresh(e.filter("vec_id < 10"))
    grouped = again.calibrate(again.score(e).join(e.select("vec_id", "family"), "vec_id"), "family")
    with pytest.raises(ValueError, match="group thresholds"):
        grouped.refresh(e)
    kept, said = grouped.refresh(e.filter("vec_id < 40"), group="family")
    assert said["n_calibration_groups"] == said["old_n_calibration_groups"] == kept.groups.count() == 2 and not said["grouped_thresholds_dropped"]
    bare, said = grouped.refresh(e, drop_groups=True, alpha=0.5)
    assert bare.groups is None and said["grouped_thresholds_dropped"] and said["alpha"] == 0.5 and said["rank"] == 31
    assert report["benign_prior_l1_delta"] > 0 and report["old_threshold"] == again.threshold and new.threshold != again.threshold and again.explain(e, 2).count() == 120
    with pytest.raises(ValueError, match="no finite"):
        again.refresh(spark.createDataFrame([(1, [0.0] * 8)], "vec_id long, embedding array<float>"))


def test_edits(spark):
    near = edits.neighbors("a.com")
    assert near == sorted(set(near)) and "a.com" not in near and {"a-com", "a.co", "A.com", "acom", "а.com", "%61.com", "a.com#", "61.com"} <= set(near)
    assert "café.example" in edits.neighbors("caf%C3%A9.example") and "0012.x" not in edits.neighbors("012.x") and "12.x" in edits.neighbors("012.x")
    df = spark.createDataFrame([("a-b.c.d",), ("x",), ("",)], "host string")
    for rule, native in edits.NATIVE.items():
        got = {r["host"]: r["n"] for r in df.select("host", native(F.col("host")).alias("n")).collect()}
        assert got == {h: edits.neighbors(h, [rule]) for h in got}
    ball = edits.edit_ball(df.limit(1), 2, rules=["E9_label_transpose", "E10_tld_swap", "E3_delimiter"])
    assert ball.filter("depth = 0").count() == 1 and ball.count() == ball.select("neighbor").distinct().count()
    with pytest.raises(ValueError, match="max_nodes"):
        edits.edit_ball(df.limit(1), 1, max_nodes=3)
    one = edits.random_edits(df, "host", samples=3, seed=5)
    assert sorted(one.collect()) == sorted(edits.random_edits(df.repartition(3), "host", samples=3, seed=5).collect())


def test_certificates(spark):
    rows = spark.createDataFrame([(1.5, 1.0), (0.2, 1.0), (1.25, 1.0), (0.75, 1.0)], "score double, threshold double")
    assert [r["certified"] for r in certify.with_margin_certificate(rows, F.lit(0.25), 1).collect()] == [True, True, False, True]
    length = lambda df: df.select("host", F.char_length("host").cast("double").alias("score"))
    hosts = spark.createDataFrame([("a.b",), ("abcdef.gh",)], "host string")
    got = {r["host"]: r for r in certify.certify_by_enumeration(hosts, length, 3.5, edits=["E3_delimiter"]).collect()}
    assert got["abcdef.gh"]["certified"] and not got["a.b"]["certified"] and len(got["a.b"]["counterexample"]) == 4 and got["a.b"]["checked"] == edits.neighbors("a.b", ["E3_delimiter"]).index(got["a.b"]["counterexample"]) + 1
    low, high = certify.clopper_pearson(8, 10)
    assert (low, high) == pytest.approx((0.4439, 0.9748), abs=1e-4) and certify.clopper_pearson(0, 5)[0] == 0 and certify.clopper_pearson(5, 5)[1] == 1


def test_label_policies(spark):
    rows = [(r, a, b) for r in ("", "M", "u") for a in ("B", "M", "x") for b in ("B", "M", "x")]
    df = spark.createDataFrame(rows, "r string, a string, b string")
    got = {p: [x["p"] for x in df.select(labels.resolved_label(p, *(F.col(c) for c in "rab")).alias("p")).collect()] for p in labels.POLICIES}
    at = lambda r, a, b: rows.index((r, a, b))
    assert got["resolved-or-disagree-malicious"][at("u", "M", "M")] == "U" and got["resolved-or-disagree-malicious"][at("", "B", "M")] == "M"
    assert got["any-malicious-else-benign"][at("", "x", "x")] == "B" and got["both-disagree-malicious"][at("", "B", "x")] == "U" and got["both-disagree-benign"][at("", "B", "x")] == "B" and got["both-disagree-unknown"][at("", "M", "B")] == "U"
    with pytest.raises(ValueError):
        labels.resolved_label("other", *(F.col(c) for c in "rab"))
    with pytest.raises(ValueError, match="both classes"):
        labels.require_both_classes(df.select(F.lit("B").alias("label")))


def test_release_is_row_unique_and_clean(spark):
    s = release.Secrets("a", "b", "c")
    rows = [(i, f"id{i}", "login.Evil-corp.example.com" if i < 60 else x, "dns_hostnames", "B") for i, x in enumerate(["x"] * 60 + ["10.1.2.3", "a@b.internal", "%41bc.com", "", "${jndi:ldap://x.y/z}", "xn--caf-dma.fr", "8.8.8.8.example"])]
    df = spark.createDataFrame(rows, "ord long, ROW_ID string, HOSTNAME string, DATASET_FAMILY string, RESOLVED_LABEL_BOTH_M string")
    public = release.public_rows(df, s).cache()
    release.require_public_schema(public)
    out = [r["released_artifact"] for r in public.collect()]
    assert len(set(out)) == len(out) == 67 and not any("evil" in o.lower() or "corp" in o.lower() or "@" in o for o in out)
    scan = audit.scans(public).first().asDict()
    assert all(scan[k] == 0 for k in ("foreign_ips", *audit.ROW_SCANNERS)) and scan["domain_like"] == scan["reserved_domain_like"]
    assert out == [r["released_artifact"] for r in release.public_rows(df, s).collect()] and out != [r["released_artifact"] for r in release.public_rows(df, release.Secrets("a", "other", "c")).collect()]
    check = audit.verified(public, release.public_rows(df, s)).first()
    assert check["missing_rows"] == check["integrity_failures"] == check["duplicate_ids"] == 0 and check["n_matched"] == 67
    assert sorted(release.shuffled(public, s).select("public_row_id").collect()) == sorted(public.select("public_row_id").collect())
    with pytest.raises(ValueError, match="forbidden"):
        release.require_public_schema(public.withColumn("CDB", F.lit(1)))


def test_metric_goldens(spark):
    row = lambda split, label, score=None, group=None: (split, label, score, group, None)
    schema = "split string, label string, score double, calibration_group string, flag boolean"
    pos, neg, un = metrics.POSITIVE, metrics.NEGATIVE, metrics.UNRESOLVED
    rows = [row("calibration", neg, x) for x in (0.1, 0.2, 0.3)] + [row("test", pos, 0.5), row("test", pos, 0.2), row("test", neg, 0.4), row("test", neg, 0.1), row("test", un, 0.9)]
    got = metrics.confusion(metrics.with_score_flag(spark.createDataFrame(rows, schema), 0.25), "score_flag").first()
    assert tuple(got)[:4] == (1, 1, 1, 1)
    grouped = [row("calibration", neg, x, g) for g, xs in (("g1", (0.1, 0.2)), ("g2", (0.8, 0.9))) for x in xs] + [row("test", pos, 0.3, "g1"), row("test", pos, 0.5, "g2"), row("test", neg, 0.95, "g2"), row("test", neg, 0.1, "g1")]
    flagged = metrics.with_score_flag(spark.createDataFrame(grouped, schema), 0.25)
    assert tuple(metrics.confusion(flagged, "score_flag").first())[:4] == (1, 1, 1, 1) and {(r["calibration_group"], r["threshold"]) for r in flagged.collect()} == {("g1", 0.2), ("g2", 0.9)}
    none = metrics.with_score_flag(spark.createDataFrame([row("test", pos)], schema), 0.25).first()
    assert none["threshold"] is None and none["effective_source"] == "none"


def test_json_types(spark):
    lines = ['{"split":"test","ccd_outputs":{"ccd_score_public":true,"ccd_flag":1},"score":"0.5"}', '{"ccd_outputs":{"ccd_score":2,"ccd_flag":"1","public_calibration_group":" g "}}', '{"ccd_outputs":{"ccd_flag":false}}', "{}"]
    got = [(r["score"], r["flag"], r["calibration_group"]) for r in metrics.from_json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(0.5, None, None), (2.0, True, "g"), (None, False, None), (None, None, None)]


def test_augmentation(spark):
    df = spark.createDataFrame([(i, f"portal{i}.mail.example.com", i % 2 == 0) for i in range(40)], "id long, hostname string, is_malicious boolean")
    one, two = augment.two_views(df, "id", seed=1), augment.two_views(df.repartition(5), "id", seed=1)
    assert sorted(one.collect()) == sorted(two.collect())
    rows = one.collect()
    assert sum(r["view1"] != r["hostname"] for r in rows) > 30 and any(r["view1"] != r["view2"] for r in rows)
    assert augment.CHANGES["truncate_subdomain"]("a.b.c", None) == "b.c" and augment.punctuation("a.b-c") == "a.bc"


def test_thresholds_narrow_by_sketches(spark):
    """Heavy tails, ties and groups of any size, with rounds of sketches: as by sorting."""
    import random

    r = random.Random(4)
    xs = [r.gauss(0, 1) for _ in range(3000)] + [1e300, -1e300] + [0.25] * 1500 + [10.0 ** r.uniform(-30, 30) for _ in range(500)]
    groups = [r.choice("aaaab") for _ in xs]
    for alpha in (1e-4, 0.05, 0.3, 0.5, 0.97):
        got = {r["g"]: (r["threshold"], r["num_samples"]) for r in calibration.thresholds(scores(spark, xs, groups).repartition(7), alpha, "g", small=20).collect()}
        for g in "ab":
            own = sorted(x for x, k in zip(xs, groups) if k == g)
            assert got[g] == (own[max(1, min(math.ceil((1.0 - alpha) * (len(own) + 1)), len(own))) - 1], len(own))
    for bad in (None, math.nan, math.inf):
        with pytest.raises(Exception, match="finite"):
            calibration.thresholds(spark.createDataFrame([(1.0,), (bad,)], "score double"), 0.1).collect()


def test_p_values_over_many_partitions(spark):
    import bisect
    import random

    r = random.Random(5)
    benign, xs = sorted(round(r.gauss(0, 1), 3) for _ in range(4000)), [round(r.gauss(0, 1), 3) for _ in range(6000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        for k in list(before)[1:]:
            spark.conf.set(k, "2k")
        df = spark.createDataFrame(list(enumerate(xs)), "id long, score double").repartition(5)
        got = {x["id"]: x["p_value"] for x in calibration.p_values(df, spark.createDataFrame([(x,) for x in benign], "score double").repartition(3)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 6000
    for i, x in enumerate(xs):
        assert got[i] == pytest.approx((1 + 4000 - bisect.bisect_left(benign, x)) / 4001, abs=1e-12)
    assert calibration.p_values(df.limit(3), df.select("score").limit(0)).select("p_value").distinct().first()[0] == 1.0


def test_nearest_axes_above_the_bound(spark):
    axes = sketch.random_axes(spark, 50, 6)
    v = spark.createDataFrame([(i, [math.sin(i * j + i) for j in range(6)]) for i in range(30)], "vec_id long, embedding array<float>")
    want = {(r["vec_id"], r["rank"]): r["cone"] for r in sketch.nearest_exact(v, axes, 4).collect()}
    assert want == {(r["vec_id"], r["rank"]): r["cone"] for r in sketch.sketch_sql(v, axes, 4).collect()}
    assert want == {(r["vec_id"], r["rank"]): r["cone"] for r in sketch.nearest_exact(v, axes, 4, bound=300).collect()}
    some = sketch.nearest_with_lsh(v, axes, 4, bound=300, tables=2, bits=8).collect()
    assert {(r["vec_id"], r["rank"]) for r in some} == set(want)
    wide = {(r["vec_id"], r["rank"]): r["cone"] for r in sketch.nearest_with_lsh(v, axes, 4, bound=300, tables=3, bits=4, radius=4).collect()}
    assert wide == want  # every bucket is probed


def test_augmentation_by_configuration(spark):
    import random

    from axisflow.functions import host as H

    texts = ["a b.com", "x%y\\z", "é.example", "", "A-Z._~9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, native in {"url": H.url_encoded_layer, "base64": H.base64url_layer, "base32": H.base32_layer, "nested": H.nested_escape_layer}.items():
        assert [r["x"] for r in df.select(native(F.col("t")).alias("x")).collect()] == [augment.LAYERS[name][1](t) for t in texts]
    assert augment.LAYERS["url"][1]("a b") == "a%20b" and augment.LAYERS["nested"][1]("a\\b%41") == "a\\\\b%2541" and augment.LAYERS["base32"][1]("ab") == "MFRA"
    still = augment.AugmentConfig(benign_max_edits=0)
    assert all(augment.augmented("a-b.example.com", False, random.Random(i), still) == "a-b.example.com" for i in range(20))
    one = augment.AugmentConfig(benign_min_edits=1)
    near = set(edits.neighbors("a-b.example.com", augment.BENIGN_RULES)) | {"a-b.example.com"}
    assert {augment.augmented("a-b.example.com", False, random.Random(i), one) for i in range(50)} <= near
    bare = augment.config_of("weighted", num_augs=0)
    assert not bare.normalize_input and not bare.use_edit_model and augment.augmented("example.com", True, random.Random(1), bare) == "example.com"
    toggled = augment.AugmentConfig(use_edit_model=False, use_weighted_augs=True, weighted=augment.WeightedConfig(1, {"toggle_protocol": 1.0}))
    assert augment.augmented("www.example.com", False, random.Random(2), toggled) == "example.com"
    for bad in ({"benign_min_edits": 2}, {"weighted": 0}):
        with pytest.raises(ValueError):
            augment.AugmentConfig(**bad) if "weighted" not in bad else augment.WeightedConfig(max_attempts=0)
    with pytest.raises(ValueError, match="mode"):
        augment.config_of("other")


def test_smoothed_votes_have_exact_bounds(spark):
    rows = spark.createDataFrame([(1, i < 8) for i in range(10)] + [(2, i < 5) for i in range(10)], "id long, p boolean")
    got = {r["id"]: r for r in certify.smoothed(rows, "id", "p").collect()}
    assert (got[1]["low"], got[1]["high"]) == pytest.approx(certify.clopper_pearson(8, 10)) and got[1]["prediction"] and (got[1]["top"], got[1]["second"], got[2]["top"]) == (8, 2, 5) and not got[2]["certified"]


def test_release_rules(spark):
    def one(rule, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("tag", F.lit("abcdefgh")).withColumn("digits", F.lit("0123456789" * 3))
        return [r["x"] for r in df.select(rule(F.col("v")).alias("x")).collect()]

    assert one(release.reserved_domains, "a.com b.co.uk", "x.test", "10.0.0.1", "plain") == ["a.test b.co.test", "x.test", "10.0.0.test", "plain"]
    assert one(release.reserved_end, "a.b.", "a", "a.longsuffix", "..") == ["a.test.", "a", "a.localhost", ".."]
    assert one(lambda v: release.without_internal_labels(v, F.col("tag")), "x.corp.y", "SVC", "internal") == ["x.abcd.y", "abc", "abcdefgh"]
    assert one(lambda v: release.documented_addresses(v, F.col("digits"), F.col("tag")), "8.8.8.8", "192.0.2.7 x", "a") == ["192.0.2.13.abcd.test", "192.0.2.7 x", "a"]
    assert one(lambda v: release.with_tag(v, F.col("tag")), "a", "a.b.test", "a.b", "test", "..", "xabcdefgh") == ["aabcdefgh.test", "a.babcdefgh.test", "a.babcdefgh.test", "testabcdefgh.test", "...abcdefgh.test", "xabcdefgh"]
    assert one(release.safely_spelled, "Hacker.evil", "hack eyJ", "localhost") == ["operator.edge", "host exj", "lqcalhost"]
    s = release.Secrets("a", "b", "c")
    raws = ["API-Gate_way9.Example.com/%2Fpath%zz", "1.2.3.4", "", "useast1.prod", "user@corp.local", "x" * 40 + ".com", "ünï.de", "%2Fcat%zz9"]
    got = [r for r in release.with_released_artifact(spark.createDataFrame(list(enumerate(raws)), "row_id string, raw string"), s).collect()]
    out = {r["raw"]: r["released_artifact"] for r in got}
    first = out[raws[0]]
    assert first.startswith("API-") and out["%2Fcat%zz9"].startswith("%2Fcat%") and "Gate" not in first and first[4].isupper() and first[12].isdigit()
    assert out["1.2.3.4"].startswith("192.0.2.") and out["useast1.prod"].startswith("useast1") and "@" not in out["user@corp.local"]
    assert all(o.rsplit(".", 1)[-1] in ("test", "invalid", "example", "localhost", "lqcalhost") for o in out.values() if "%" not in o)
    assert len(set(out.values())) == len(raws)
