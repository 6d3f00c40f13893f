"""Column functions against plain Python."""

from __future__ import annotations

import hashlib
import hmac
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from axisflow.functions import host as H
from axisflow.functions import release as R
from axisflow.functions import vectors as V


def values(spark, xs, make, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, {schema}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_segmentation(spark):
    urls = ["https://user:pw@Host.example.com:8080/p?q#f", "host.example.com", "host:99/x", "[::1]:80", "a@b@c.com?x", "http://h/", None, "  tab.example\t"]
    got = values(spark, urls, H.segmented)
    assert [r["host"] for r in got] == ["Host.example.com", "host.example.com", "host", "::1", "c.com", "h", "", "tab.example"]
    first = got[0].asDict()
    assert first["scheme"] == "https" and all(first[k] for k in ("authority_present", "userinfo_present", "port_present", "path_present", "query_present", "fragment_present"))
    assert not got[5]["path_present"] and got[3]["bracketed_ipv6"] and got[3]["port_present"] and got[4]["query_present"]


def test_normalization(spark):
    got = values(spark, ["HTTP://Example.COM.", "caf%C3%A9.example", "Straße.example", "a%FFb", None, "", "x" * 70 + ".com"], H.normalized)
    assert got[:3] == ["example.com", "café.example", "strasse.example"] and got[3] == "aÿb" and got[4:6] == ["", ""] and got[6] == "x" * 70 + ".com"
    assert values(spark, [" A b.Example.. ", "café.example", None], H.canonical) == ["ab.example", "xn--caf-dma.example", ""]


def test_buckets_and_masks(spark):
    assert values(spark, ["", "a" * 15, "a" * 16, "a" * 64, "a" * 128], H.length_bucket) == ["1-15", "1-15", "16-31", "64-127", "128+"]
    assert values(spark, ["aB9.-_%$ é", "x" * 97], H.class_mask) == ["aA9.-_%Sxa", "a" * 96 + "+"]
    assert values(spark, ["aaaaaaaA.."], H.coarse_mask) == [".:2|A:1|a:5"]
    assert values(spark, ["2024-12-30T00:00:00Z", "", "no", None], H.week_bucket) == ["2025-W01", "unknown", "unknown", "unknown"]
    assert values(spark, ["a.b.c", "a-b_c", "a_b", "a.b", "ab"], H.punctuation_replaced) == ["a-b.c", "ab_c", "a-b", "a-b", "ab"]
    assert values(spark, ["a.b.c", "a.b"], H.without_first_label) == ["b.c", "a.b"]
    assert values(spark, ["a.b", "", "a..b", "x" * 64, None], H.is_valid) == [True, False, False, False, False]
    assert values(spark, ["a?b", "é"], H.base64url_layer) == ["YT9i", "w6k"] and values(spark, ["aé"], H.url_encoded_layer) == ["a%E9"]


def test_release_fields(spark):
    sinks = {"${jndi:x}": "template", "a{{b": "template", "x union y": "query", "xn--a": "query", "a;b": "shell", "ping x": "shell", "http://x": "url_fetch", "plain.example": "none", "shell.example": "none"}
    assert values(spark, list(sinks), R.sink_family) == list(sinks.values())
    assert values(spark, ["plain", "a%b", "é", "a--b", "a%b--", "A" * 16], R.obfuscation_family) == ["none", "percent", "unicode", "quote_comment", "mixed", "base64"]
    assert values(spark, ["com", "internal", "localhost1"], R.nearest_suffix) == ["test", "invalid", "localhost"]
    assert values(spark, [" x ", "nan", "1e3", "inf", None], lambda c: R.optional_double(c)) == [None, None, 1000.0, None, None]
    assert values(spark, ["YES", "0", "maybe"], lambda c: R.optional_bool(c)) == [True, False, None]
    assert values(spark, [" A b!C-"], R.slug) == ["a_b_c"]


def test_keyed_digests(spark):
    ids = ["r1", "", "ü"]
    for secret in ("k", "x" * 100):
        want = [hmac.new(secret.encode(), i.encode(), "sha256") for i in ids]
        assert values(spark, ids, lambda c: R.hmac_hex(secret, c)) == [w.hexdigest() for w in want]
        assert values(spark, ids, R.hmac_udf(spark, secret)) == [w.hexdigest() for w in want]
        assert values(spark, ids, lambda c: R.base32_prefix(R.hmac_hex(secret, c), 20)) == [b32encode(w.digest()).decode()[:20] for w in want]
    tags = [hmac.new(b"k", f"v|{i}|unique".encode(), "sha256").digest()[:8] for i in ids]
    assert values(spark, ids, lambda c: R.unique_tag(c, "k", "v")) == ["".join(chr(97 + b % 26) for b in t) for t in tags]
    assert values(spark, ids, lambda c: R.bucket(c, 512)) == [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 512 for i in ids]


def test_unsafe_groups_are_errors(spark):
    assert values(spark, ["g1", " ", None], lambda c: R.calibration_group(c)) == ["g1", None, None]
    for bad in ("a b", "tenant-7"):
        with pytest.raises(Exception, match="unsafe"):
            values(spark, [bad], lambda c: R.calibration_group(c))


def test_vectors(spark):
    xs = [[3.0, 4.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0]]
    assert values(spark, xs, lambda c: V.usable(c, 2), "x array<double>") == [True, False, False, False, False]
    assert values(spark, xs[:1], V.unit, "x array<double>") == [[0.6, 0.8]]
    assert values(spark, [[1.0, 3.0, 3.0, 2.0]], lambda c: V.top_k(c, 3), "x array<double>") == [[1, 2, 3]]
    assert sum(values(spark, [[1.0, 2.0]], V.softmax, "x array<double>")[0]) == pytest.approx(1)
