"""Queries over the test tables, one or more for each group of operators, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.functions import host as H
from axisflow.functions import release as R
from axisflow.functions import vectors as V
from axisflow.operators import audit, augment, calibration, certify, edits, labels, metrics, release, scoring, sketch
from axisflow.plans.model import Config, Model
from axisflow.sources.text import score_rows, unique_longer
from axisflow.streaming.refresh import session_counts, windowed_mass

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SECRET, VERSION = "test-key", "v1"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


# --- sketches, priors, scores -------------------------------------------------------------------

N_AXES = 32  # axes by a formula that both sides know
AXIS_SQL = f"axes AS (SELECT CAST(c AS INTEGER) AS cone, [sin((c + 1.0) * (j + 1.0)) / sqrt(32.0) for j in range(0, 64)] AS axis FROM range(0, {N_AXES}) t(c))"


def model_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.sin((F.col("id") + 1.0) * (j + 1.0)) / F.sqrt(F.lit(32.0)))
    return table(spark, d, "embeddings"), spark.range(N_AXES).select(F.col("id").cast("int").alias("cone"), axis.alias("axis"))


SKETCH_SQL = f"""
{AXIS_SQL},
sims AS (SELECT v.vec_id, v.label, a.cone, list_dot_product(CAST(v.embedding AS DOUBLE[]), a.axis) AS sim FROM embeddings v CROSS JOIN axes a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cone) AS rank FROM sims),
tops AS (SELECT *, exp(10.0 * (sim - max(sim) OVER (PARTITION BY vec_id))) AS e FROM ranked WHERE rank <= 8),
sketch AS (SELECT vec_id, label, cone, rank, sim, e / sum(e) OVER (PARTITION BY vec_id) AS weight FROM tops)"""
PRIOR_SQL = SKETCH_SQL + f""",
cones AS (SELECT cone FROM axes),
parts AS (SELECT CASE WHEN label < 5 THEN NULL ELSE 'f' || label END AS family, cone, weight FROM sketch),
totals AS (SELECT family, sum(weight) AS total FROM parts GROUP BY family),
mass AS (SELECT family, cone, sum(weight) AS mass FROM parts GROUP BY family, cone),
priors AS (SELECT t.family, c.cone, (coalesce(m.mass, 0) + 1e-6) / (t.total + 1e-6 * {N_AXES}) AS p
           FROM totals t CROSS JOIN cones c LEFT JOIN mass m ON m.cone = c.cone AND m.family IS NOT DISTINCT FROM t.family)"""
SCORE_SQL = PRIOR_SQL + """,
h AS (SELECT s.vec_id, p.family, -sum(s.weight * ln(greatest(p.p, 1e-12))) AS h FROM sketch s JOIN priors p USING (cone) GROUP BY 1, 2),
terms AS (SELECT a.vec_id, ln(1.0 / count(*) OVER (PARTITION BY a.vec_id)) + b.h - a.h AS x FROM h a JOIN h b ON a.vec_id = b.vec_id AND b.family IS NULL WHERE a.family IS NOT NULL),
tm AS (SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS m FROM terms),
scores AS (SELECT vec_id, max(m) + ln(sum(exp(x - m))) AS score FROM tm GROUP BY vec_id)"""


def all_priors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e, axes = model_tables(spark, d)
    s = sketch.exploded(sketch.sketch(e, axes, 8, 10.0))
    known = s.join(e.select("vec_id", "label"), "vec_id")
    benign = scoring.priors(known.filter("label < 5"), axes)
    bad = scoring.priors(known.filter("label >= 5").withColumn("family", F.concat(F.lit("f"), F.col("label").cast("string"))), axes, "family")
    return s, benign, bad, scoring.mixture_weights(bad.select("family").distinct())


@query(f"WITH {SKETCH_SQL} SELECT vec_id, cone, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim, round(weight, 6) + 0.0 AS weight FROM sketch")
def cone_sketch_sql(spark, d):
    e, axes = model_tables(spark, d)
    return rounded(sketch.sketch_sql(e, axes, 8, 10.0).select("vec_id", "cone", "rank", "sim", "weight"), "sim", "weight")


@query(f"WITH {SKETCH_SQL} SELECT vec_id, cone, round(weight, 6) + 0.0 AS weight FROM sketch")
def cone_sketch_arrow(spark, d):
    e, axes = model_tables(spark, d)
    return rounded(sketch.exploded(sketch.sketch(e, axes, 8, 10.0)).select("vec_id", "cone", "weight"), "weight")


@query(f"WITH {PRIOR_SQL} SELECT coalesce(family, '') AS family, cone, round(p, 9) + 0.0 AS p FROM priors")
def smoothed_priors(spark, d):
    _, benign, bad, _ = all_priors(spark, d)
    return rounded(benign.select(F.lit("").alias("family"), "cone", "p").unionByName(bad.select("family", "cone", "p")), "p", digits=9)


@query(f"WITH {SCORE_SQL} SELECT vec_id, round(score, 6) + 0.0 AS score FROM scores")
def likelihood_scores(spark, d):
    return rounded(scoring.scores(*all_priors(spark, d)), "score")


@query(f"WITH {SCORE_SQL} SELECT vec_id, round(score, 6) + 0.0 AS score FROM scores")
def batched_scores(spark, d):
    """The same from vectors by matrix products, without moving them."""
    e, axes = model_tables(spark, d)
    _, benign, bad, mix = all_priors(spark, d)
    return rounded(scoring.batch_scores(e, axes, benign, bad, mix, 8, 10.0), "score")


@query(
    f"WITH {PRIOR_SQL}, t AS (SELECT a.cone, ln(1.0 / count(*) OVER (PARTITION BY a.cone)) + ln(a.p) - ln(b.p) AS x FROM priors a JOIN priors b ON a.cone = b.cone AND b.family IS NULL WHERE a.family IS NOT NULL), "
    "s AS (SELECT cone, ln(sum(exp(x))) AS score FROM t GROUP BY cone) SELECT k.vec_id, round(s.score, 6) + 0.0 AS score FROM sketch k JOIN s USING (cone) WHERE k.rank = 1"
)
def fast_scores(spark, d):
    s, benign, bad, mix = all_priors(spark, d)
    return rounded(scoring.fast_scores(s, scoring.cone_scores(benign, bad, mix)), "score")


@query(
    f"WITH {PRIOR_SQL}, f AS (SELECT cone, max(ln(p)) AS best, arg_max(family, (ln(p), family)) AS best_family, min(ln(p)) AS least FROM priors WHERE family IS NOT NULL GROUP BY cone) "
    "SELECT k.vec_id, CAST(k.rank AS INTEGER) AS rank, k.cone, round(k.weight, 6) + 0.0 AS weight, f.best_family, round(f.best - ln(b.p), 6) + 0.0 AS best_log_ratio, round(f.least - ln(b.p), 6) + 0.0 AS least_log_ratio "
    "FROM (SELECT vec_id, cone, weight, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, cone) AS rank FROM sketch) k JOIN priors b ON b.cone = k.cone AND b.family IS NULL JOIN f ON f.cone = k.cone WHERE k.rank <= 3"
)
def explained_scores(spark, d):
    s, benign, bad, _ = all_priors(spark, d)
    return rounded(scoring.explanations(s, benign, bad).select("vec_id", "rank", "cone", "weight", "best_family", "best_log_ratio", "least_log_ratio"), "weight", "best_log_ratio", "least_log_ratio")


@query(f"WITH {SKETCH_SQL}, m AS (SELECT vec_id, max(CASE WHEN rank = 1 THEN sim END) - max(CASE WHEN rank = 2 THEN sim END) AS margin FROM ranked GROUP BY vec_id) SELECT vec_id, round(margin, 6) + 0.0 AS margin, CAST(floor(round(margin, 9) / 0.1) AS BIGINT) AS radius FROM m")
def prototype_margins(spark, d):
    e, axes = model_tables(spark, d)
    out = scoring.margins(rounded(sketch.similarities(e, axes, "vec_id", "embedding"), "sim", digits=12))
    return rounded(out.withColumn("radius", F.floor(F.round("margin", 9) / 0.1)), "margin")


@query(f"WITH {PRIOR_SQL} SELECT round(max(abs(ln(a.p) - ln(b.p))), 6) + 0.0 AS envelope, round(sum(abs(a.p - b.p)), 6) + 0.0 AS l1 FROM priors a JOIN priors b ON a.cone = b.cone AND b.family IS NULL WHERE a.family = 'f7'")
def prior_distance(spark, d):
    _, benign, bad, _ = all_priors(spark, d)
    one = bad.filter("family = 'f7'")
    return rounded(scoring.log_ratio_envelope(benign, one).crossJoin(scoring.l1_delta(benign, one)).select("envelope", F.col("l1_delta").alias("l1")), "envelope", "l1")


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0) AS usable FROM embeddings")
def usable_vectors(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.usable(F.col("embedding"), 64)).alias("usable"))


NEAREST_SQL = f"WITH {SKETCH_SQL} SELECT vec_id, cone, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 8"


@query(NEAREST_SQL)
def lsh_nearest(spark, d):
    """Probes of all bits reach every bucket, so the search by hashes must give what an exact one gives."""
    e, axes = model_tables(spark, d)
    return sketch.nearest_with_lsh(e, axes, 8, tables=1, bits=5, radius=5).select("vec_id", "cone", "rank")


@query(NEAREST_SQL)
def nearest_in_blocks(spark, d):
    e, axes = model_tables(spark, d)
    return sketch.nearest_exact(e, axes, 8, bound=8 * 64 * 10).select("vec_id", "cone", "rank")


RANK_SQL = "greatest(1, least(CAST(ceil(CAST({a} AS DOUBLE) * (count(*) OVER ({w}) + 1.0)) AS BIGINT), count(*) OVER ({w})))"


@query(
    f"WITH {SCORE_SQL}, c AS (SELECT s.vec_id, round(s.score, 9) AS score, 'g' || (e.label % 2) AS g, e.label FROM scores s JOIN embeddings e USING (vec_id)), "
    f"b AS (SELECT g, score, row_number() OVER (PARTITION BY g ORDER BY score) AS r, {RANK_SQL.format(a='0.95', w='PARTITION BY g')} AS k FROM c WHERE label < 5), t AS (SELECT g, score AS threshold FROM b WHERE r = k) "
    "SELECT vec_id, g AS calibration_group, round(threshold, 6) + 0.0 AS threshold, round(score, 6) + 0.0 AS score, CAST(score > threshold AS INTEGER) AS prediction FROM c JOIN t USING (g)"
)
def fitted_model(spark, d):
    e, axes = model_tables(spark, d)
    model = Model.fit(e.filter("label < 5"), e.filter("label >= 5").withColumn("family", F.concat(F.lit("f"), "label")), Config(dim=64, cones=N_AXES, r=8, alpha=0.05), axes=axes)
    scored = model.score(e).withColumn("score", F.round("score", 9)).join(e.select("vec_id", F.concat(F.lit("g"), F.col("label") % 2).alias("calibration_group")), "vec_id")
    found = model.calibrate(scored.join(e.filter("label < 5").select("vec_id"), "vec_id"), "calibration_group").predict(scored)
    return rounded(found.select("vec_id", "calibration_group", "threshold", "score", "prediction"), "threshold", "score")


# --- calibration and decisions ------------------------------------------------------------------

BY_FLAG = RANK_SQL.format(a="0.99", w="PARTITION BY l_returnflag")


@query(f"SELECT l_returnflag, l_extendedprice AS threshold, n AS num_samples, k AS rank FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n, {BY_FLAG} AS k FROM lineitem) WHERE r = k")
def grouped_thresholds(spark, d):
    return calibration.thresholds(table(spark, d, "lineitem"), 0.01, "l_returnflag", "l_extendedprice")


@query(f"SELECT o_totalprice AS threshold, n AS num_samples, k AS rank FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n, {RANK_SQL.format(a='0.95', w='')} AS k FROM orders) WHERE r = k")
def global_threshold(spark, d):
    return calibration.thresholds(table(spark, d, "orders"), 0.05, None, "o_totalprice")


@query("SELECT c_custkey, (1 + (SELECT count(*) FROM supplier WHERE s_acctbal >= c_acctbal)) / ((SELECT count(*) FROM supplier) + 1.0) AS p_value FROM customer")
def conformal_p_values(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return calibration.p_values(c.select("c_custkey", F.col("c_acctbal").alias("score")), s.select(F.col("s_acctbal").alias("score"))).select("c_custkey", "p_value")


@query(
    f"WITH t AS (SELECT l_returnflag, l_extendedprice AS threshold FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, {BY_FLAG} AS k FROM lineitem WHERE l_returnflag <> 'R') WHERE r = k) "
    "SELECT l.l_returnflag, count(*) AS n, sum(CASE WHEN l_extendedprice > coalesce(t.threshold, 50000.0) THEN 1 ELSE 0 END) AS positive FROM lineitem l LEFT JOIN t USING (l_returnflag) GROUP BY 1"
)
def grouped_decisions(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("calibration_group"), F.col("l_extendedprice").alias("score"))
    t = calibration.thresholds(li.filter("calibration_group <> 'R'"), 0.01, "calibration_group")
    return calibration.decided(li, t, 50000.0).groupBy(F.col("calibration_group").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("positive"))


@query("SELECT o_orderkey, o_totalprice > 150000 AS prediction, abs(o_totalprice - 150000) AS margin, CASE WHEN o_totalprice > 150000 THEN o_totalprice - 150000 > 20000 ELSE 150000 - o_totalprice >= 20000 END AS certified FROM orders")
def margin_certificates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"), F.lit(150000.0).alias("threshold"))
    return certify.with_margin_certificate(o, F.lit(10000.0), 2).select("o_orderkey", "prediction", "margin", "certified")


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 6) + 0.0 AS p95, round(median(o_totalprice), 6) + 0.0 AS p50 FROM orders GROUP BY 1")
def exact_percentiles(spark, d):
    found = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", 0.95).alias("p95"), F.percentile("o_totalprice", 0.5).alias("p50"))
    return rounded(found, "p95", "p50")


@query("WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM v) SELECT user_id, CAST(sum(votes) AS BIGINT) AS n, max(CASE WHEN r = 1 THEN event_type END) AS prediction, max(votes) AS top, coalesce(max(CASE WHEN r = 2 THEN votes END), 0) AS second FROM r GROUP BY 1")
def smoothed_votes(spark, d):
    return certify.smoothed(table(spark, d, "events"), "user_id", "event_type").select("user_id", "n", "prediction", "top", "second")


# --- labels -------------------------------------------------------------------------------------

ANNOTATED = {"r": ["B", "", "malicious", "u", "Benign"], "a": [" m ", "B", "U", "benign"], "b": ["M", "b", "unknown"]}


def annotated(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", *(pick(v).alias(k) for k, v in ANNOTATED.items()))


ANNOTATED_SQL = "x AS (SELECT o_orderkey, " + ", ".join(f"[{', '.join(repr(v) for v in xs)}][o_orderkey % {len(xs)} + 1] AS {k}" for k, xs in ANNOTATED.items()) + " FROM orders)"
LETTERS_SQL = ANNOTATED_SQL + ", y AS (SELECT o_orderkey, trim(r) <> '' AS there, " + ", ".join(f"CASE upper(left(trim({k}), 1)) WHEN 'B' THEN 'B' WHEN 'M' THEN 'M' ELSE 'U' END AS {k}" for k in "rab") + " FROM x)"
AGREED_SQL = "CASE WHEN a = b THEN a WHEN a = '{0}' OR b = '{0}' THEN '{0}' ELSE 'U' END"
POLICY_SQL = ["r", f"CASE WHEN there THEN r ELSE {AGREED_SQL.format('M')} END", "a", "b", "CASE WHEN a = 'M' OR b = 'M' THEN 'M' ELSE 'B' END", AGREED_SQL.format("M"), AGREED_SQL.format("B"), "CASE WHEN a = b THEN a ELSE 'U' END"]


@query(f"WITH {LETTERS_SQL} SELECT o_orderkey, {', '.join(f'{s} AS p{i}' for i, s in enumerate(POLICY_SQL))}, CASE r WHEN 'B' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS as_int FROM y")
def resolved_labels(spark, d):
    df = annotated(spark, d)
    return df.select("o_orderkey", *(labels.resolved_label(p, F.col("r"), F.col("a"), F.col("b")).alias(f"p{i}") for i, p in enumerate(labels.POLICIES)), labels.as_int(F.col("r")).alias("as_int"))


@query(f"WITH {LETTERS_SQL} SELECT CASE WHEN a = b THEN a ELSE 'U' END AS label, count(*) AS rows FROM y GROUP BY 1")
def label_histogram(spark, d):
    return labels.label_counts(labels.select_rows(annotated(spark, d), labels.resolved_label("both-disagree-unknown", F.col("r"), F.col("a"), F.col("b")), drop_unknown=False))


@query("SELECT p_partkey, CASE WHEN s1 NOT IN ('', 'none') THEN s1 ELSE s2 END AS family, lower(trim(p_brand)) AS split FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(CASE WHEN p_size % 3 = 0 THEN ' None ' ELSE p_type END)), '[^a-z0-9_.:-]+', '_', 'g'), '^[_.:-]+|[_.:-]+$', '', 'g') AS s1, regexp_replace(lower(trim(p_brand)), '[^a-z0-9_.:-]+', '_', 'g') AS s2 FROM part)")
def positive_families(spark, d):
    p = table(spark, d, "part")
    first = F.when(F.col("p_size") % 3 == 0, F.lit(" None ")).otherwise(F.col("p_type"))
    return p.select("p_partkey", labels.positive_family([first, F.col("p_brand")]).alias("family"), labels.row_split([F.lit("  "), F.col("p_brand")]).alias("split"))


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey % 50 AS batch, o_orderpriority AS family, o_orderstatus = 'F' AS bad FROM orders), f AS (SELECT *, min(o_orderkey) OVER (PARTITION BY batch, bad, family) AS first FROM o) "
    "SELECT o_orderkey, CASE WHEN bad THEN dense_rank() OVER (PARTITION BY batch, bad ORDER BY first) - 1 ELSE -row_number() OVER (PARTITION BY batch, bad ORDER BY o_orderkey) END AS orbit FROM f"
)
def orbit_ids(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("batch"), F.col("o_orderpriority").alias("family"), (F.col("o_orderstatus") == "F").alias("bad"))
    return labels.orbits(o, ["batch"], "family", "o_orderkey", "bad").select("o_orderkey", F.col("orbit").cast("long").alias("orbit"))


# --- hosts and release fields -------------------------------------------------------------------


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))


PAGES_SQL = "p AS (SELECT page_id, coalesce(url, '') AS url FROM pages)"
HOST_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)"


@query(
    f"WITH {PAGES_SQL} SELECT page_id, {HOST_SQL} AS host, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') AS path_present, "
    "regexp_extract(url, '[?]([^#]*)', 1) <> '' AND regexp_matches(url, '^[^#]*[?]') AS query_present, regexp_extract(url, '#(.*)$', 1) <> '' AS fragment_present, regexp_matches(url, '://[^/?#]*:[0-9]') AS port_present FROM p"
)
def segmented_urls(spark, d):
    s = artifacts(spark, d).withColumn("s", H.segmented(F.col("url")))
    return s.select("page_id", "s.host", "s.scheme", "s.path_present", "s.query_present", "s.fragment_present", "s.port_present")


@query(
    f"WITH {PAGES_SQL}, h AS (SELECT page_id, url, {HOST_SQL} AS host FROM p) SELECT page_id, lower(host) AS normalized, length(host) BETWEEN 1 AND 253 AND len(list_filter(string_split(host, '.'), lambda x: length(x) BETWEEN 1 AND 63)) = len(string_split(host, '.')) AS valid, "
    "CAST(len(string_split(host, '.')) AS INTEGER) AS n_labels, regexp_full_match(host, '([0-9]{1,3}[.]){3}[0-9]{1,3}') AS ipv4, "
    "CASE WHEN length(url) <= 15 THEN '1-15' WHEN length(url) <= 31 THEN '16-31' WHEN length(url) <= 63 THEN '32-63' WHEN length(url) <= 127 THEN '64-127' ELSE '128+' END AS length_bucket, "
    "CASE WHEN len(string_split(host, '.')) > 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END AS shorter FROM h"
)
def host_functions(spark, d):
    h = artifacts(spark, d).withColumn("host", H.segmented(F.col("url"))["host"])
    c = F.col("host")
    return h.select("page_id", H.normalized(F.col("url")).alias("normalized"), H.is_valid(c).alias("valid"), H.label_count(c).alias("n_labels"), H.is_ipv4_like(c).alias("ipv4"), H.length_bucket(F.col("url")).alias("length_bucket"), H.without_first_label(c).alias("shorter"))


MASK_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(left(url, 96), '[^A-Za-z0-9._%$`;&|<>(){{}}\\[\\]''\"-]', '\u0001', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g'), '[$`;&|<>(){{}}\\[\\]''\"]', 'S', 'g')".replace("{{", "{").replace("}}", "}")


@query(f"WITH {PAGES_SQL}, m AS (SELECT page_id, replace({MASK_SQL}, '\u0001', 'x') || CASE WHEN length(url) > 96 THEN '+' ELSE '' END AS mask FROM p) SELECT page_id, mask, concat_ws('|', {', '.join(f'''CASE WHEN contains(mask, '{c}') THEN '{c}:' || least(len(mask) - len(replace(mask, '{c}', '')), 5) END''' for c in '%-.9AS_a')}) AS coarse FROM m")
def class_masks(spark, d):
    m = artifacts(spark, d).select("page_id", H.class_mask(F.col("url")).alias("mask"))
    return m.withColumn("coarse", H.coarse_mask(F.col("mask")))


SINK_SQL = (
    "CASE WHEN contains(lower(url), '${jndi') OR contains(lower(url), '${#') OR contains(url, '{{') THEN 'template' WHEN regexp_matches(lower(url), '\\b(select|union|pg_sleep|waitfor|benchmark|dbms_pipe)\\b|--|/[*]') THEN 'query' "
    "WHEN regexp_matches(url, '[`;&|]|[$][(]') OR regexp_matches(lower(url), '\\b(curl|wget|nslookup|ping|bash|sh|cmd|powershell)\\b') THEN 'shell' WHEN regexp_matches(lower(url), 'https?://') THEN 'url_fetch' ELSE 'none' END"
)
PRIVATE_SQL = f"""{PAGES_SQL}, q AS (SELECT page_id, url, ['user_logins', 'dns_hostnames', ' X'][page_id % 3 + 1] AS family, ['M', 'b', '', 'm '][page_id % 4 + 1] AS resolved, {SINK_SQL} AS sink FROM p),
r AS (SELECT *, CASE upper(trim(resolved)) WHEN 'M' THEN 'verified_executable_semantics' WHEN 'B' THEN 'resolved_benign' ELSE 'unresolved' END AS label FROM q),
rel AS (SELECT page_id, url, CASE family WHEN 'user_logins' THEN 'login_host' WHEN 'dns_hostnames' THEN 'dns_host' ELSE 'other_coarse_source' END AS source_family, label, sink,
 CASE WHEN label = 'resolved_benign' THEN 'none' WHEN sink IN ('shell', 'template', 'query') THEN 'sink_evaluated' WHEN sink = 'url_fetch' THEN 'artifact_supported' WHEN label <> 'unresolved' THEN 'syntax_only' ELSE 'none' END AS evidence FROM r)"""


def private_rows(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    a = artifacts(spark, d).select("page_id", "url", F.col("page_id").alias("ord"), F.col("page_id").cast("string").alias("ROW_ID"), F.col("url").alias("CONTENT"))
    return a.withColumn("DATASET_FAMILY", pick("user_logins", "dns_hostnames", " X")).withColumn("RESOLVED_LABEL_BOTH_M", pick("M", "b", "", "m "))


def released_fields(spark: SparkSession, d: str) -> DataFrame:
    p = private_rows(spark, d).select("page_id", "url", R.source_family(F.col("DATASET_FAMILY"), F.lit(None).cast("string")).alias("source_family"), R.label(F.col("RESOLVED_LABEL_BOTH_M")).alias("label"), R.sink_family(F.col("url")).alias("sink"))
    return p.withColumn("evidence", R.evidence_tier(F.col("label"), F.col("sink")))


OBFUSCATION_SQL = (
    "CASE (contains(url, '%'))::INT + (regexp_matches(url, '[^\\x00-\\x7F]'))::INT + (regexp_matches(url, '[\"''`;|&]'))::INT + (regexp_matches(url, '[A-Za-z0-9+/]{16,}'))::INT + (contains(url, '--') OR contains(url, '/*'))::INT WHEN 0 THEN 'none' WHEN 1 THEN "
    "CASE WHEN contains(url, '%') THEN 'percent' WHEN regexp_matches(url, '[^\\x00-\\x7F]') THEN 'unicode' WHEN regexp_matches(url, '[\"''`;|&]') THEN 'delimiter' WHEN regexp_matches(url, '[A-Za-z0-9+/]{16,}') THEN 'base64' ELSE 'quote_comment' END ELSE 'mixed' END"
)
HIDDEN_SQL = "label = 'verified_executable_semantics' AND sink = 'url_fetch' AND evidence = 'artifact_supported'"


@query(f"WITH {PRIVATE_SQL} SELECT page_id, source_family, label, sink, evidence, CASE WHEN {HIDDEN_SQL} THEN 'none' ELSE sink END AS public_sink, CASE WHEN {HIDDEN_SQL} THEN 'syntax_only' ELSE evidence END AS public_evidence, {OBFUSCATION_SQL} AS obfuscation FROM rel")
def release_fields(spark, d):
    three = [F.col(c) for c in ("label", "sink", "evidence")]
    return released_fields(spark, d).select("page_id", "source_family", *three, R.public_sink(*three).alias("public_sink"), R.public_evidence(*three).alias("public_evidence"), R.obfuscation_family(F.col("url")).alias("obfuscation"))


PADS = [bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")) for x in (0x36, 0x5C)]
BLOBS = ["'" + "".join(f"\\x{b:02X}" for b in p) + "'::BLOB" for p in PADS]


@query(
    f"WITH h AS (SELECT page_id, sha256({BLOBS[1]} || unhex(sha256({BLOBS[0]} || encode('{VERSION}|' || page_id)))) AS mac, sha256(CAST(page_id AS VARCHAR)) AS s FROM pages), u AS (SELECT *, CAST(('0x' || substr(s, 1, 8)) AS BIGINT) AS n FROM h) "
    "SELECT page_id, mac, CASE WHEN n / 4294967295.0 < 0.7 THEN 'train' WHEN n / 4294967295.0 < 0.8 THEN 'validation' WHEN n / 4294967295.0 < 0.9 THEN 'calibration' ELSE 'test' END AS split, CAST(n % 512 AS INTEGER) AS bucket FROM u"
)
def keyed_digests(spark, d):
    i = F.col("page_id").cast("string")
    return table(spark, d, "pages").select("page_id", R.hmac_hex(SECRET, F.concat(F.lit(f"{VERSION}|"), i)).alias("mac"), R.hash_split(i).alias("split"), R.bucket(i, 512).alias("bucket"))


@query("SELECT event_id, strftime(ts, '%G-W%V') AS week FROM events")
def week_buckets(spark, d):
    return table(spark, d, "events").select("event_id", H.week_bucket(F.col("ts").cast("string")).alias("week"))


COUNT_SQL = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' WHEN n <= 15 THEN '8-15' WHEN n <= 31 THEN '16-31' WHEN n <= 63 THEN '32-63' ELSE '64+' END"


@query(f"SELECT c_custkey, {COUNT_SQL} AS orders FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def order_count_buckets(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).select("c_custkey", H.count_bucket(F.col("n")).alias("orders"))


@query()
def public_release(spark, d):
    return release.public_rows(private_rows(spark, d), release.Secrets("row", "artifact", "order", VERSION))


@query()
def shuffled_release(spark, d):
    s = release.Secrets("row", "artifact", "order", VERSION)
    return release.repaired(release.shuffled(release.public_rows(private_rows(spark, d), s), s))


# --- audits and metrics -------------------------------------------------------------------------

DOMAIN_SQL = r"\b[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\b"
SCAN_SQL = ", ".join("count(*) FILTER (regexp_matches(url, '" + p.replace("(?U)", "").replace("'", "''") + f"')) AS {k}" for k, p in audit.ROW_SCANNERS.items())


@query(
    f"WITH {PAGES_SQL}, a AS (SELECT url, list_filter(regexp_extract_all(url, '{DOMAIN_SQL}'), lambda x: NOT regexp_full_match(x, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}')) AS d, list_filter(regexp_extract_all(url, '\\b(?:[0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}\\b'), lambda x: NOT (starts_with(x, '192.0.2.') OR starts_with(x, '198.51.100.') OR starts_with(x, '203.0.113.'))) AS ips FROM p) "
    f"SELECT count(*) AS n_rows, CAST(sum(len(ips)) AS BIGINT) AS foreign_ips, {SCAN_SQL}, CAST(sum(len(d)) AS BIGINT) AS domain_like, CAST(sum(len(list_filter(d, lambda x: lower(string_split(x, '.')[-1]) IN ('test', 'invalid', 'example', 'localhost')))) AS BIGINT) AS reserved_domain_like FROM a"
)
def privacy_scans(spark, d):
    return audit.scans(artifacts(spark, d), "url", None)


@query("SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) < 5000")
def sparse_combinations(spark, d):
    return audit.sparse(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber"), 5000)


@query("SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS excess FROM (SELECT coalesce(text, '') AS text FROM documents)")
def excess_duplicate_texts(spark, d):
    return audit.excess_duplicates(table(spark, d, "documents"), "text")


@query("SELECT count(*) AS matches FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de')")
def semi_join_matches(spark, d):
    docs = table(spark, d, "documents")
    return audit.intersection_count(docs, docs.filter("lang = 'de'"), "source", "source")


@query(
    "WITH fp AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS fp FROM documents), g AS (SELECT text, count(*) AS n, count(DISTINCT doc_id % 3) AS a, count(DISTINCT source) AS c, min(fp) AS fp FROM fp WHERE text <> '' GROUP BY text HAVING count(*) > 1) "
    "SELECT count(*) AS duplicate_groups, count(*) FILTER (a < n) AS artifact_groups, count(*) FILTER (c < n) AS canonical_groups, count(*) FILTER (fp < 20) AS rare_groups FROM g"
)
def linkable_groups(spark, d):
    docs = table(spark, d, "documents").withColumn("third", F.col("doc_id") % 3)
    return audit.linkable_groups(docs, "text", "third", "source", ("lang", "source"), 20)


@query(
    "WITH l AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT o_orderpriority, month(o_orderdate) AS m, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT max(n) / sum(n) AS p FROM g GROUP BY o_orderpriority, m), "
    "t AS (SELECT CAST(sum(n) AS BIGINT) AS n, max(n) / sum(n) AS majority, (SELECT max(p) FROM p) AS purity FROM l) SELECT n AS n_rows, round(purity, 9) + 0.0 AS max_purity, round(majority, 9) + 0.0 AS majority_rate, round(0.5 + least(greatest(purity - majority, 0), 0.5), 9) + 0.0 AS auroc_estimate, CASE WHEN purity - majority <= 0.05 THEN 'pass' ELSE 'review' END AS status FROM t"
)
def shortcut_audit(spark, d):
    return rounded(audit.shortcut(table(spark, d, "orders").withColumn("m", F.month("o_orderdate")), ("o_orderpriority", "m"), "o_orderstatus"), "max_purity", "majority_rate", "auroc_estimate", digits=9)


DELIMITERS_SQL = " + ".join("(len(url) - len(replace(url, '" + c.replace("'", "''") + "', '')) = len(o) - len(replace(o, '" + c.replace("'", "''") + "', '')))::INT" for c in audit.DELIMITERS)
BUCKETS_SQL = "(len({0}) > 15)::INT + (len({0}) > 31)::INT + (len({0}) > 63)::INT + (len({0}) > 127)::INT"


@query(
    f"WITH {PAGES_SQL}, j AS (SELECT url, replace(url, 'http', 'h-%') AS o FROM p) SELECT round(avg((len(string_split(url, '.')) = len(string_split(o, '.')))::INT), 9) + 0.0 AS dns_labels, round(sum({DELIMITERS_SQL}) / count(*) / {len(audit.DELIMITERS)}, 9) + 0.0 AS delimiters, "
    f"round(avg((contains(url, '%') = contains(o, '%') AND contains(lower(url), 'xn--') = contains(lower(o), 'xn--'))::INT), 9) + 0.0 AS encoding, round(avg(({BUCKETS_SQL.format('url')} = {BUCKETS_SQL.format('o')})::INT), 9) + 0.0 AS shape FROM j"
)
def preservation_rates(spark, d):
    j = artifacts(spark, d).withColumn("o", F.replace("url", F.lit("http"), F.lit("h-%")))
    return rounded(audit.preservation(j, "url", "o"), "dns_labels", "delimiters", "encoding", "shape", digits=9)


@query(
    "WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS l FROM customer), p AS (SELECT CAST(o_custkey AS VARCHAR) AS id, max(CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END) AS l, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1) "
    "SELECT count(*) AS n_expected, count(p.id) AS n_matched, count(*) FILTER (p.id IS NULL) AS missing_rows, count(*) FILTER (p.id IS NOT NULL AND e.l <> p.l) AS label_mismatches, (SELECT CAST(sum(n - 1) AS BIGINT) FROM p) AS duplicate_ids FROM e LEFT JOIN p USING (id)"
)
def verified_release(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderstatus = 'O'")
    same = lambda df, i, lab: df.select(i.cast("string").alias("public_row_id"), lab.alias("label"), *(lab.alias(x) for x in ("released_artifact", "released_canonical_artifact", "row_integrity_hash")))
    j = o.join(c, o.o_custkey == c.c_custkey)
    public = same(j, F.col("o_custkey"), F.when(F.col("o_custkey") % 7 == 0, "x").otherwise(F.col("c_mktsegment")))
    return audit.verified(public, same(c, F.col("c_custkey"), F.col("c_mktsegment"))).select("n_expected", "n_matched", "missing_rows", "label_mismatches", "duplicate_ids")


SCORED_SQL = """s AS (SELECT o_orderkey, ['train', 'calibration', 'test'][o_orderkey % 3 + 1] AS split, ['verified_executable_semantics', 'resolved_benign', 'unresolved', 'resolved_benign'][o_orderkey % 4 + 1] AS label, o_orderpriority AS source_family, o_totalprice AS score,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS calibration_group, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS flag FROM orders)"""


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", pick("train", "calibration", "test").alias("split"), pick("verified_executable_semantics", "resolved_benign", "unresolved", "resolved_benign").alias("label"), F.col("o_orderpriority").alias("source_family"), F.col("o_totalprice").alias("score"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("calibration_group"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") == "F").alias("flag"),
    )


THRESHOLD_SQL = SCORED_SQL + f""", b AS (SELECT * FROM s WHERE split = 'calibration' AND label = 'resolved_benign'),
g AS (SELECT calibration_group, score AS t FROM (SELECT calibration_group, score, row_number() OVER (PARTITION BY calibration_group ORDER BY score) AS r, {RANK_SQL.format(a='0.9', w='PARTITION BY calibration_group')} AS k FROM b WHERE calibration_group IS NOT NULL) WHERE r = k),
w AS (SELECT score AS t FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, {RANK_SQL.format(a='0.9', w='')} AS k FROM b) WHERE r = k),
f AS (SELECT s.*, coalesce(g.t, w.t) AS threshold, score > coalesce(g.t, w.t) AS score_flag FROM s LEFT JOIN g USING (calibration_group) CROSS JOIN w)"""


def confusion_sql(flag: str) -> str:
    part = lambda lab, hit: f"count(*) FILTER (label = '{lab}' AND {hit} {flag})"
    cells = {"tp": part(metrics.POSITIVE, ""), "fn": part(metrics.POSITIVE, "NOT"), "fp": part(metrics.NEGATIVE, ""), "tn": part(metrics.NEGATIVE, "NOT")}
    return f"WITH {THRESHOLD_SQL}, c AS (SELECT {', '.join(f'{v} AS {k}' for k, v in cells.items())} FROM f WHERE split <> 'calibration' AND {flag} IS NOT NULL) SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM c"


@query(confusion_sql("score_flag"))
def fixed_fpr_replay(spark, d):
    return metrics.confusion(metrics.with_score_flag(scored_rows(spark, d), 0.1), "score_flag")


@query(confusion_sql("flag"))
def released_flag_replay(spark, d):
    return metrics.confusion(scored_rows(spark, d), "flag")


@query(f"WITH {THRESHOLD_SQL} SELECT CASE WHEN flag IS NOT NULL THEN 'released' WHEN score_flag IS NOT NULL THEN 'score' ELSE 'none' END AS effective_source, coalesce(flag, score_flag) AS effective_flag, count(*) AS rows FROM f GROUP BY ALL")
def effective_flags(spark, d):
    return metrics.with_score_flag(scored_rows(spark, d), 0.1).groupBy("effective_source", "effective_flag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"WITH {SCORED_SQL} SELECT count(*) AS n_rows, count(*) FILTER (label = 'unresolved') AS unresolved_rows, count(*) FILTER (label <> 'unresolved') AS resolved_rows, count(*) FILTER (label = 'verified_executable_semantics') AS positive_rows, count(*) FILTER (label = 'resolved_benign') AS negative_rows, "
    "count(*) FILTER (label <> 'unresolved' AND split <> 'calibration') AS metric_rows, count(*) FILTER (label = 'resolved_benign' AND split = 'calibration') AS benign_calibration_rows, count(*) FILTER (label = 'resolved_benign' AND split = 'calibration' AND score IS NOT NULL) AS scored_benign_calibration_rows FROM s"
)
def label_accounting(spark, d):
    return metrics.accounting(scored_rows(spark, d))


@query(f"WITH {SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS rows FROM s GROUP BY {c}" for c in ("split", "source_family", "label")))
def release_breakdown(spark, d):
    return metrics.breakdown(scored_rows(spark, d), ("split", "source_family", "label"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS label, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal WHEN 2 THEN CAST(c_nationkey AS DOUBLE) END AS score, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'g' || c_nationkey END AS calibration_group, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer"
)
def json_metric_rows(spark, d):
    """Scores as numbers and as texts, below a boolean that is none, or missing; flags as text, boolean and number."""
    c = table(spark, d, "customer")
    value = F.col("c_acctbal").cast("string")
    kind, third = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    inner = [
        F.when(kind == 0, F.concat(F.lit('"ccd_score_public":'), value)), F.when(kind == 2, F.concat(F.lit('"ccd_score_public":true,"ccd_score":'), F.col("c_nationkey").cast("string"))),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"public_calibration_group":" g'), F.col("c_nationkey").cast("string"), F.lit(' "'))),
        F.when(third == 0, F.lit('"ccd_flag":" Yes "')).when(third == 1, F.lit('"ccd_flag":false')).otherwise(F.lit('"ccd_flag":1')),
    ]
    outer = F.concat(F.lit('{"label":"'), F.col("c_custkey").cast("string"), F.lit('"'), F.when(kind == 1, F.concat(F.lit(',"score":"'), value, F.lit('"'))).otherwise(""), F.lit(',"ccd_outputs":{'), F.concat_ws(",", *inner), F.lit("}}"))
    return metrics.from_json(c.select(outer.alias("value"))).select("label", "score", "calibration_group", "flag")


# --- edits, sets, order, text -------------------------------------------------------------------

HOSTS_SQL = f"{PAGES_SQL}, h AS (SELECT DISTINCT {HOST_SQL} AS host FROM p)"


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(spark, d).select(H.segmented(F.col("url"))["host"].alias("host")).distinct()


FRAGMENT_SQL = ", ".join("'" + f.replace("'", "''") + "'" for f in edits.FRAGMENTS)


@query(f"WITH {HOSTS_SQL} SELECT host, unnest(list_distinct(flatten([[substr(host, 1, i) || f || substr(host, i + 1) for f in [{FRAGMENT_SQL}]] for i in range(0, len(host) + 1)]))) AS neighbor FROM h")
def fragment_neighbors(spark, d):
    return hosts(spark, d).select("host", F.explode(edits.native_fragments(F.col("host"))).alias("neighbor"))


@query(
    f"WITH {HOSTS_SQL}, n AS (SELECT host, unnest(list_distinct(list_concat([substr(host, 1, i - 1) || CASE substr(host, i, 1) WHEN '.' THEN '-' ELSE '.' END || substr(host, i + 1) for i in range(1, len(host) + 1) if substr(host, i, 1) IN ('.', '-')], list_concat([substr(host, 1, i) || '.' || substr(host, i + 1) for i in range(1, len(host))], [substr(host, 1, i) || '-' || substr(host, i + 1) for i in range(1, len(host))])))) AS neighbor FROM h) "
    "SELECT host, neighbor FROM n WHERE neighbor <> host"
)
def delimiter_neighbors(spark, d):
    return hosts(spark, d).select("host", F.explode(edits.native_delimiters(F.col("host"))).alias("neighbor"))


@query(f"WITH {HOSTS_SQL}, l AS (SELECT host, string_split(host, '.') AS p FROM h), n AS (SELECT host, unnest([array_to_string(list_concat(list_concat(p[1:i], [p[i + 2], p[i + 1]]), p[i + 3:]), '.') for i in range(0, len(p) - 2)]) AS neighbor FROM l WHERE len(p) >= 3) SELECT DISTINCT host, neighbor FROM n WHERE neighbor <> host")
def transposed_neighbors(spark, d):
    return hosts(spark, d).select("host", F.explode(edits.native_transposed(F.col("host"))).alias("neighbor"))


@query()
def edit_neighbors(spark, d):
    return edits.with_neighbors(hosts(spark, d))


@query()
def random_edit_samples(spark, d):
    return edits.random_edits(hosts(spark, d), "host", samples=4, k=2)


@query()
def enumeration_certificates(spark, d):
    length = lambda df: df.select("host", F.char_length("host").cast("double").alias("score"))
    return certify.certify_by_enumeration(hosts(spark, d), length, 19.5, 1)


@query()
def augmented_views(spark, d):
    return augment.two_views(hosts(spark, d).withColumn("bad", F.col("host").contains("pills")), "host", "host", "bad")


@query("SELECT lower(word) AS value, min(doc_id * 1000000 + i) AS ord FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS word, unnest(range(0, len(string_split(coalesce(text, ''), ' ')))) AS i FROM documents) WHERE len(word) > 16 GROUP BY 1")
def long_unique_words(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("i", "word"))
    lines = words.filter(F.char_length("word") > 16).select(F.lower("word").alias("value"), (F.col("doc_id") * 1000000 + F.col("i")).alias("ord"))
    return unique_longer(lines, least=0)


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def set_differences(spark, d):
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    return n.join(c, n.n_nationkey == c.c_nationkey, "left_semi").join(s.filter("s_acctbal > 9000"), n.n_nationkey == s.s_nationkey, "left_anti").select("n_name")


@query("WITH k AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM k) SELECT vec_id, CAST(i AS INTEGER) AS i, r - 1 AS rank FROM r WHERE r <= 5")
def largest_elements(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.posexplode(V.top_k(F.col("v"), 5)).alias("rank", "i")).select("vec_id", "i", F.col("rank").cast("long").alias("rank"))


@query("WITH u AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(n), 6) + 0.0 AS u1, round(exp(e[1] - list_max(e)) / list_sum([exp(x - list_max(e)) for x in e]), 6) + 0.0 AS s1 FROM u")
def normalized_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return rounded(e.select("vec_id", V.unit(F.col("v"))[0].alias("u1"), V.softmax(F.col("v"))[0].alias("s1")), "u1", "s1")


@query("SELECT c_name AS hostname, printf('%.6f', 5000.0) AS threshold, printf('%.6f', c_acctbal) AS score, CAST(c_acctbal > 5000 AS INTEGER) AS prediction FROM customer")
def score_sink_rows(spark, d):
    c = table(spark, d, "customer").select("c_name", F.col("c_acctbal").alias("score"))
    return score_rows(calibration.decided(c, None, 5000.0), "c_name", threshold=True)


@query("SELECT event_type AS cone, time_bucket(INTERVAL 1 HOUR, ts) AS start, round(sum(value), 6) + 0.0 AS mass FROM events GROUP BY ALL")
def windowed_event_mass(spark, d):
    return rounded(windowed_mass(table(spark, d, "events"), "ts", "event_type", "value").select(F.col("event_type").alias("cone"), "start", "mass"), "mass")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, s"
)
def event_sessions(spark, d):
    return session_counts(table(spark, d, "events"), "user_id").select("user_id", "start", "events")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE printf('row-%012d', c_custkey) END AS row_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS artifact, "
    "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE CAST(c_nationkey AS DOUBLE) END AS score, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, regexp_replace(lower(c_name), '[^a-z0-9_.:-]+', '_', 'g') AS slug, "
    "CASE WHEN len(c_mktsegment) <= 5 THEN 'test' WHEN len(c_mktsegment) <= 8 THEN 'invalid' ELSE 'localhost' END AS suffix FROM customer"
)
def row_fields(spark, d):
    c = table(spark, d, "customer")
    third, odd = F.col("c_custkey") % 3, F.col("c_custkey") % 2 == 1
    return c.select(
        "c_custkey", R.private_row_id(F.when(third == 0, F.col("c_custkey").cast("string")).otherwise(""), F.lit(None).cast("string"), F.col("c_custkey")).alias("row_id"), R.first_nonempty(F.when(third == 0, F.col("c_name")), F.lit(""), F.col("c_mktsegment")).alias("artifact"),
        R.optional_double(F.when(odd, "nan").otherwise(F.col("c_acctbal").cast("string")), F.col("c_nationkey").cast("string")).alias("score"), R.optional_bool(F.when(third == 0, " Yes ").when(third == 1, "0").otherwise("maybe")).alias("flag"), R.slug(F.col("c_name")).alias("slug"), R.nearest_suffix(F.col("c_mktsegment")).alias("suffix"),
    )


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS hash FROM nation""")
def integrity_hashes(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", R.integrity_hash(["n_regionkey", "n_nationkey", "n_name"]).alias("hash"))


CHARS_SQL = "[x for x in string_split(c_address, '') if x <> '']"
BASE32_SQL = "substr(array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || rpad(substr({h}, 5 * (i // 4) + 1, 5), 5, '0'))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1) for i in range(0, {n})], ''), 1, {n})"


@query(
    "WITH c AS (SELECT c_custkey, c_name || ' 100% \\x' || c_nationkey AS c_address FROM customer) SELECT c_custkey, rtrim(replace(replace(to_base64(encode(c_address)), '+', '-'), '/', '_'), '=') AS base64, lower(hex(encode(c_address))) AS hex, "
    f"array_to_string([CASE WHEN regexp_full_match(x, '[0-9A-Za-z._~-]') THEN x ELSE '%' || upper(hex(encode(x))) END for x in {CHARS_SQL}], '') AS url, "
    f"{BASE32_SQL.format(h='hex(encode(c_address))', n='CAST(ceil(8 * length(c_address) / 5.0) AS BIGINT)')} AS base32, replace(replace(c_address, '\\', '\\\\'), '%', '%25') AS nested FROM c"
)
def encoding_layers(spark, d):
    text = F.concat("c_name", F.lit(" 100% \\x"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", H.base64url_layer(text).alias("base64"), F.lower(F.hex(F.encode(text, "UTF-8"))).alias("hex"), H.url_encoded_layer(text).alias("url"), H.base32_layer(text).alias("base32"), H.nested_escape_layer(text).alias("nested"))


@query(
    "WITH k AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 40) AS k, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT *, k / n AS p, 3.841458820694124 / n AS c FROM k) "
    "SELECT l_returnflag, round(greatest((p + c / 2) / (1 + c) - sqrt(p * (1 - p) * c + c * c / 4) / (1 + c), 0), 9) + 0.0 AS low, round(least((p + c / 2) / (1 + c) + sqrt(p * (1 - p) * c + c * c / 4) / (1 + c), 1), 9) + 0.0 AS high FROM w"
)
def wilson_intervals(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = certify.wilson(F.col("k"), F.col("n"))
    return rounded(k.select("l_returnflag", low.alias("low"), high.alias("high")), "low", "high", digits=9)


@query(f"WITH {LETTERS_SQL} SELECT o_orderkey, CASE WHEN a = b THEN a ELSE 'U' END AS label FROM y WHERE a = b AND a <> 'U' ORDER BY o_orderkey LIMIT 100")
def first_labelled_rows(spark, d):
    """A sampling operator: the first labelled rows in order."""
    return labels.select_rows(annotated(spark, d), labels.resolved_label("both-disagree-unknown", F.col("r"), F.col("a"), F.col("b")), max_rows=100, order=["o_orderkey"]).select("o_orderkey", "label")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Scores, thresholds by group and decisions of all vectors."""
    return fitted_model(spark, d)


