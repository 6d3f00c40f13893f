"""The stages of the pipeline and the registration of queries."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from axisflow.llm import queries

SIMILAR = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"document {i} has its very own words like w{i} and v{i * 7} in it", "en", f"s{i % 3}", 50, "clash") for i in range(30)]
    rows += [(100, SIMILAR, "en", "s0", 1, "c"), (101, SIMILAR + "end", "en", "s1", 1, "c"), (102, SIMILAR, "en", None, None, None), (103, "you are a worthless idiot and pathetic scum", "en", "s1", 1, "c")]
    rows += [(104, "write to someone@mail.example.com today", None, "s2", 1, "c"), (105, None, "en", "s2", 0, "c"), (106, "", "en", "s2", 0, "c"), (None, "no id", "en", "s1", 5, "c"), (None, "no id", "en", "s1", 5, "c"), (None, SIMILAR, "en", "s1", 5, "c"), (7, rows[7][1], "en", "s1", 50, "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(103, 1, 1), (1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in docs.collect()) - Counter(r["doc_id"] for r in clean.collect()) == Counter([103])
    one = stages["ngram_jaccard_join"](spark, clean, folder)
    ids = Counter(r["doc_id"] for r in one.collect())
    assert one.columns == docs.columns and ids == Counter([*range(30), 100, 104, 105, 106, None])
    private = stages["pii"](spark, one, folder)
    texts = {r["doc_id"]: r for r in private.collect()}
    assert private.columns == docs.columns and texts[104]["text"] == "write to <EMAIL> today" and texts[104]["n_chars"] == 22 and texts[105]["text"] is None and texts[3]["_score"] == "clash"
    mixed = stages["mixing"](spark, private, folder)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    pieces = stages["packing"](spark, mixed, folder).collect()
    assert Counter(r["doc_id"] for r in pieces).keys() == {r["doc_id"] for r in mixed.collect()}


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert not set(queries.oracle_sql()) - set(names)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_queries_keep_their_contracts(spark):
    """Every query with its production parameters over whole tables."""
    d = str(DATA)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {int(name[2:].split("_")[0]): query(spark, d).collect() for name, query in queries.queries().items()}
    for n in (2, 3, 4, 5, 6, 7, 8):
        assert sorted(r["doc_id"] for r in got[n]) == sorted(docs)
    for n in (1, 10):
        assert sorted(r["page_id"] for r in got[n]) == sorted(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got[2]) and {r["held_out"] for r in got[2]} == {True, False}
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in got[3])
    assert sum(r["size"] for r in got[3]) == pytest.approx(sum({r["source_size"]: r["target"] for r in got[3]}.values()), rel=1e-6)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] or r["base_sha256"] == empty for n in (4, 6) for r in got[n])
    assert all(not (r["base_failed"] and r["kept"]) and r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got[5])
    for r in got[7]:
        data = docs[r["doc_id"]].encode()
        data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert r["payload_bytes"] == len(data) and r["payload_sha256"] == hashlib.sha256(data).hexdigest()
    assert all(r["component_id"] <= r["doc_id"] for r in got[8])
    held, total = Counter(), Counter()
    for r in got[9]:
        held[r["doc_id"]] += r["length"]
        total[r["sequence_id"]] += r["length"]
    assert held == {r["doc_id"]: r["doc_tokens"] for r in got[9]} and held.keys() == docs.keys() and all(n == 2048 or n & (n - 1) == 0 for n in total.values())
    full = sum(n == 2048 for n in total.values())
    assert full >= 0.7 * len(total)
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) and r["payload_bytes"] == len(pages[r["page_id"]].encode()) for r in got[10])
