"""Operators over the whole of their input, where a part of it would give other results."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisflow.llm import html_templates, media, mixing, packing, pii, secrets, toxicity, warc


def plain_scores(docs, seed, k1=1.2, b=0.75):
    """BM25 of each document for the terms of one, by the formula."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        tf, score = Counter(d), 0.0
        for t in set(docs[seed]):
            idf = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
            score += idf * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / mean))
        out.append(score)
    return out


def random_documents(seed, n, terms=60, most=40):
    rng = np.random.default_rng(seed)
    return [[*(1 + np.minimum(rng.zipf(1.4, rng.integers(0, most)), terms)).tolist(), 1] for _ in range(n)]


def test_bm25_is_that_of_the_formula():
    docs = random_documents(1, 40)
    index = packing.Index([np.array(d, np.uint32) for d in docs])
    for seed in range(40):
        assert np.allclose(index.scores(seed), plain_scores(docs, seed))


@pytest.mark.parametrize("window, best", [(32, 3), (64, 16), (16, 1)])
def test_windows_are_those_of_brute_force(window, best):
    """Seeds in order; of the best unused neighbours the nearest that fits, else the nearest, cut."""
    docs = random_documents(window, 50)
    left, want = [len(d) % window for d in docs], [[(i, k * window, window)] for i, d in enumerate(docs) for k in range(len(d) // window)]
    for seed in range(50):
        if not left[seed]:
            continue
        pieces, left[seed], scores = [(seed, len(docs[seed]) - left[seed], left[seed])], 0, plain_scores(docs, seed)
        while (space := window - sum(p[2] for p in pieces)) and any(left):
            near = sorted((i for i in range(50) if left[i]), key=lambda i: (-round(scores[i], 9), i))[:best]
            while near and (space := window - sum(p[2] for p in pieces)):
                i = near.pop(next((k for k, i in enumerate(near) if left[i] <= space), 0))
                size = min(space, left[i])
                pieces.append((i, len(docs[i]) - left[i], size))
                left[i] -= size
        if sum(p[2] for p in pieces) == window:
            want.append(pieces)
    got = list(packing.pack_shard([np.array(d, np.uint32) for d in docs], window, best=best))
    assert got[: len(want)] == want
    rest = [sum(p[2] for p in s) for s in got[len(want) :]]
    assert all(n & (n - 1) == 0 for n in rest) and sum(rest) + window * len(want) == sum(map(len, docs))


def test_neighbours_share_a_window(spark):
    """Nearest neighbours of the whole table by brute force, which lie far apart in it, end in one sequence."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(3000)]
    firsts = [rng.choice(words[: 3000 // (1 + i % 3)], 60).tolist() for i in range(150)]
    seconds = [[str(rng.choice(words)) if rng.random() < 0.05 else w for w in f] for f in firsts]
    texts = [" ".join(x) for x in [*firsts, *seconds]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack_by_retrieval(docs, path, window=2048, shard_docs=32).collect()
    ids = [np.append(x, np.uint32(packing.END)) for x in packing.WordIds(path).encode([t.encode() for t in texts])]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    held = defaultdict(set)
    for r in rows:
        held[r["doc_id"]].add(r["sequence_id"])
    index, met = packing.Index(ids), 0
    for i in range(300):
        scores = index.scores(i)
        scores[i] = -1
        assert int(np.argmax(scores)) == (i + 150) % 300
        met += bool(held[i] & held[(i + 150) % 300])
    assert met >= 0.7 * 300  # by chance about one in fifty


def test_word_ids_are_the_tokenizer_s():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rng, tokenizer, encoder = random.Random(2), Tokenizer.from_file(path), packing.WordIds(path)
    some = [chr(c) for c in [*range(0x300), *range(0x370, 0x400), 0x1E9E, 0x2C65, 0x212B, 0x3042, 0x4E2D, 0xAC00, 0x1F600, 0x2019, 0x2028, 0x200B, 0x661, 0xB2]]
    texts = ["", " ", "don't !'s <|endoftext|> x", "x" * 3000, "I\u0307\u0130\u00c5A\u030a", "\x01\x02 a\x02b"]
    texts += ["".join(rng.choice(some if rng.random() < 0.5 else list("abcde'sStre vmlld 0189.,!-\n\t \u00c9\u00e9\u00c0\u0130\u023a")) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want


def test_merges_by_rank_are_the_tokenizer_s():
    """Merging by the rank of the merged bytes equals merging by the tokenizer's pairs if each entry, alone, merges to itself:
    neighbours that make up an entry can then only be the pair that its own last merge joins."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        merges = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(json.load(f)["model"]["merges"])}
    for a, b in merges:
        end = (a + b).endswith("</w>")
        symbols = list((a + b)[: -4 if end else None])
        symbols[-1] += "</w>" * end
        while len(symbols) > 1:
            rank, at = min((merges.get(pair, len(merges)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            assert rank < len(merges)
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]
        assert symbols == [a + b]


def test_keys_behind_names_and_paths():
    rng = np.random.default_rng(5)
    hexes = ["".join(rng.choice(list("0123456789ABCDEF"), 32)) for _ in range(300)]
    for before in ("id=", "path/", "example/", "EXAMPLE-"):
        found = [secrets.entropy_spans(f"see {before}{x} there") for x in hexes]
        bare = [secrets.entropy_spans(f"see {x} there") for x in hexes]
        assert sum(map(bool, found)) == sum(map(bool, bare)) > 290
    assert secrets.entropy_spans("sig=JBSWY3DPEHPK3PXPQ4TMZ6LC") == [("entropy", 4, 28)]
    assert secrets.entropy_spans("example/Zx81kQ0pLm93RtYu7Wv2Bn5s")[0][2] == 32
    # published examples and plain names stay
    for text in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "id=550e8400-e29b-41d4-a716-446655440000", "a/path/of/plain/words/without/keys", "20240101123456789012345"):
        assert secrets.entropy_spans(text) == []


def test_mixed_texts_sum_to_the_targets(spark):
    """A source with one long document, and a source that is repeated: words of the stage by source are those of the slots."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"a{i}w{k}" for k in range(int(rng.integers(1, 300)))), "a", 0) for i in range(40)] + [(100, " ".join(f"long{k}" for k in range(20_000)), "a", 0)]
    rows += [(200 + i, f" b{i}  x\ty{i} \n", "b", 0) for i in range(500)] + [(900, " ", "a", 0), (901, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.mix_to_weights(spark, docs, "").collect()
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(docs)[0].collect()}
    words = Counter()
    for r in got:
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert all(abs(words[s] - targets[s]) <= 64 for s in targets)
    texts = {i: t for i, t, *_ in rows}
    for i, n in Counter(r["doc_id"] for r in got).items():
        assert n <= 3 and i not in (900, 901)
    for r in got:
        left = iter(texts[r["doc_id"]].split())
        assert all(w in left for w in r["text"].split())  # in order, none twice
    assert mixing.cut_text(" a b  c d ", [(0, 1, 2), (1, 2, 1), (3, 4, 2)]) == ["a b\nd", "a\nd"] and mixing.cut_text(" a b ", [(0, 2, 1)]) == [" a b "]


def test_boxes_articles_and_sections(spark):
    box = "<div><p>Subscribe now</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<article><p>Quoted.</p>{box}<p>Own {i}</p></article><p>between</p><article><p>Second {i}</p></article><article><p>Teaser</p></article>") for i in range(20)]
    # a section of a quarter of the pages has a notice of its own
    rows += [(100 + i, f"http://s.example/{'news' if i % 4 == 0 else 'other'}/{i}", f"<div>{'<p>News notice</p>' if i % 4 == 0 else f'<p>Rest {i}</p>'}<p>Text {i}</p></div>") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_templates.extract_main_text(pages).collect()}
    assert got[3] == "Quoted.\nOwn 3\nSecond 3"
    assert got[104] == "Text 4" and got[105] == "Rest 5\nText 5"
    long = "A long text that mirrors share. " * 20
    same = spark.createDataFrame([(i, f"http://m.example/{i}", f"<article><div>{long}</div></article>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in html_templates.extract_main_text(same).collect()} == {long.strip()}


def test_toxic_rates_hold_for_samples(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        toxic = i % 10 == 0
        insult = rng.random() < (0.7 if toxic else 0.1)
        rows.append((i, f"they went to place{i} and came back{' you idiot' if insult else ''} at noon", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, few = (toxicity.fit_toxicity(docs, docs, sample=n)[1] for n in (600, 60))
    score = lambda c, t: 1 / (1 + np.exp(-(c[0] + np.dot(c[1:], toxicity.features(t, toxicity.Lexicon({}, {}))))))
    for t in ("nothing of the kind", "they came back, you idiot at noon"):
        assert abs(score(whole, t) - score(few, t)) < 0.15
    assert score(few, "nothing of the kind") < 0.1
    # with the labels' own rates known as they are in the sample nothing changes
    xs, ys = [[float(i % 3), 0.0, 0.0, 0.0] for i in range(30)], [int(i % 5 == 0) for i in range(30)]
    assert toxicity.fitted(xs, ys) == pytest.approx(toxicity.fitted(xs, ys, rates=(24.0, 6.0)))


def test_a_report_far_back_in_a_clause_counts():
    score = lambda t: toxicity.features(t, toxicity.Lexicon({}, {}))[0]
    report, far = "he said " + "word " * 2, "he said " + "word " * 60
    assert score(report + "idiot") == pytest.approx(score(far + "idiot")) and score(far + "idiot") < score("word " * 60 + "idiot")


def test_templates_decide_without_names(spark):
    """Menus, adverts and footers that say something new on each page and have telling names nowhere go by their shape; without the method they stay."""
    words = random.Random(6)
    some = lambda n: " ".join("".join(words.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    def page(i, frame):
        links = "".join(f"<li><a href=/{k}>{some(1)}</a>" for k in range(3 + i % 3))
        own = f"<h1>{some(3)}</h1><p>{some(30)}</p><p>{some(40)} <b>{some(2)}</b></p>"
        return f"<body><div class='q{i}'><ul>{links}</ul></div><div class='zz'>{some(6)}</div>{frame.format(own)}<div class='w'><p>{some(4)}</p></div></body>", own

    rows, want = [], {}
    for k, frame in enumerate(("<article>{}</article>", "<div class='m'>{}</div>", "<div><div>{}</div></div>")):
        for i in range(30):
            html, own = page(i, frame)
            rows.append((100 * k + i, f"http://h{k}.example/{i}", html))
            want[100 * k + i] = html_templates.main_text(own)
    html, own = page(1, "<article>{}</article>")
    rows.append((999, "http://few.example/", html))  # a host of one page: by the rules
    want[999] = html_templates.main_text(own)
    rows += [(1000 + i, "http://same.example/", html) for i in range(12)]  # a page in many copies stays whole
    want |= {1000 + i: want[999] for i in range(12)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_templates.extract_main_text(pages).collect()}
    assert got == want
    off = {r["page_id"]: r["text"] for r in html_templates.extract_main_text(pages, method=False).collect()}
    assert sum(off[i] != want[i] for i in want if 100 <= i < 300) == 60


def test_very_long_pages_and_clashing_columns(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    wide = "<p>" + "word " * 200_000 + "</p>" + "<li>x" * 20_000
    pages = spark.createDataFrame([(1, "http://a.example", deep, 7), (2, "http://a.example", wide, 8), (3, None, None, 9)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_templates.extract_main_text(pages).collect()}
    assert got[1] == "deep" and got[2].count("word") == 200_000 and got[2].count("x") == 20_000 and got[3] == ""


def test_grammar_is_that_of_brute_force():
    """The composed machines against looking back from each word, rule by rule."""
    reach, rng = toxicity.REACH, random.Random(7)

    def behind(symbols, opener, far, rewrite):
        return [rewrite.get(s, s) if opener in symbols[max(0, i - far) : i] else s for i, s in enumerate(symbols)]

    aim = {"I": "J", "P": "J", "T": "U", "H": "K"}
    for _ in range(2000):
        symbols = rng.choices(toxicity.INPUT, [6, 3, 3, 2, 1, 1, 1, 1], k=rng.randint(1, 14))
        weights = [rng.random() for _ in symbols]
        x = behind(symbols, "C", reach["copula"], {"I": "P"})
        x = behind(x, "M", reach["intention"], {"T": "H"})
        x = behind(x, "N", reach["negation"], {"I": "i", "P": "i", "T": "t", "H": "t"})
        x = behind(x, "R", 99, {"I": "q", "P": "q", "T": "t", "H": "q"})
        x = behind(behind(x, "Y", reach["target"], aim)[::-1], "Y", reach["target"], aim)[::-1]
        want = sum(toxicity.FACTORS.get(s, 0.0) * w for s, w in zip(x, weights))
        assert toxicity.clause_score(symbols, weights) == pytest.approx(want)


def test_phrases_predicates_and_threats():
    lexicon = toxicity.Lexicon({}, {})
    score = lambda text: toxicity.features(text, lexicon)[0]
    assert score("you are an idiot") > score("an idiot") > score("you are not an idiot") > 0
    assert score("they will kill you") > score("they kill you") > score("to kill") > score("he said they will not kill") > 0
    assert score("oh Shut up, now") > 0 and score("shut the door") == score("drop the ball") == 0 and score("they will make you pay") > 0
    threats = toxicity.threats_among(["zorp", "blib"], [("we will zorp them", 1), ("you are blib", 1), ("i will blib", 0)])
    assert threats == {"zorp"} and toxicity.Lexicon({"zorp": 3.0}, {}, threats).look("zorp") == ("T", 3.0)


def test_repeated_ids_do_not_multiply(spark):
    docs = spark.createDataFrame([(1, "you idiot")] * 50 + [(2, "fine words here")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)] * 40, "doc_id long, toxic int")
    lexicon, curve = toxicity.fit_toxicity(docs, labels)
    once = toxicity.fit_toxicity(docs.distinct(), labels.distinct())
    assert curve == pytest.approx(once[1]) and lexicon.words == once[0].words
    scores = [r["score"] for r in toxicity.score_toxicity(docs, (lexicon, (0.0, 0.0, 0.0, 0.0, 0.0))).collect()]
    assert len(scores) == 100 and set(scores) == {0.5}  # a tie counts as toxic


def test_planted_personal_data_is_found(spark):
    """Formats without a base, within prose, by trees of other synthetic candidates and of the corpus: precision and recall of each kind."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = []
    for i, (before, found, after, kind) in enumerate(pii.synthetic(99, 600)):
        head = f"{prose(12)} {before}"
        rows.append((i, f"{head}{found}{after} {prose(12)}", len(head), len(head) + len(found), kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, kind string")
    corpus = spark.createDataFrame([(i, f"{prose(9)} +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} {prose(5)} 10.{i}.3.{i} {prose(3)}") for i in range(200)], "doc_id long, text string")
    model = pii.fit_candidates(spark, corpus)
    assert set(model[1]) == set(pii.MORE)
    found = pii.with_spans(df, model).selectExpr("a", "b", "kind", "filter(_spans, s -> s.start < b and s.end > a).kind as kinds").collect()
    for kind in pii.MORE:
        hits = [kind in r["kinds"] for r in found if r["kind"] == kind]
        wrong = sum(kind in r["kinds"] for r in found if r["kind"] != kind)
        assert sum(hits) >= 0.95 * len(hits) and wrong <= 0.05 * sum(hits), kind
    fit, x, y = pii.shown_candidates(corpus, 50, "text")
    assert set(y) == {0.0, 1.0} and set(fit) == {True, False} and x.shape == (len(y), len(pii.FEATURES)) and len(y) <= 400


def test_personal_data_is_learned_from_every_text(spark):
    """No text is too late, and no candidate of a text, for trees and thresholds."""
    rows = [(i, f"call +1 (212) 555-{i:04d} now" if i % 2 else f"card 4111 1111 1111 1111 of {i}") for i in range(3400)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    first = corpus.orderBy(F.xxhash64("text")).limit(3000).localCheckpoint()
    assert pii.fit_candidates(spark, corpus) != pii.fit_candidates(spark, first)
    # one text for the trees and one for the thresholds, with eight candidates each and with 400 more
    head, rest = "call +1 (212) 555-0100 now " * 8, "card 4111 1111 1111 1111 too " * 400
    numbered = lambda tail: spark.range(40).selectExpr("id as doc_id", f"concat('{head}{tail}', id) as text")
    short, long = (spark.createDataFrame([numbered(tail).filter(f"pmod(xxhash64(text), 2) = {half}").first() for half in (0, 1)]) for tail in ("", rest))
    assert pii.fit_candidates(spark, short) != pii.fit_candidates(spark, long)
    fit, x, y, n = pii.counted_candidates(long, "text")
    assert sorted(zip(fit, y, n)) == [(half, label, count) for half in (False, True) for label, count in ((0.0, 400), (1.0, 8))]


def test_counts_of_personal_data_are_those_of_the_single_candidates(spark):
    rng = random.Random(11)
    piece = lambda: rng.choice([f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"10.{rng.randint(0, 300)}.3.{rng.randint(0, 99)}", "4111 1111 1111 1111", "a at b dot com x@y.zz", "words", f"{rng.randint(0, 10**9)}"])
    rows = [(i, " and ".join(piece() for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (501, "+1 (212) 555-0100 " * 3), (501, "+1 (212) 555-0100 " * 3)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fit, x, y, n = pii.counted_candidates(corpus, "text")
    one = pii.shown_candidates(corpus, 1000, "text", each=1000)
    assert Counter({(bool(a), bool(b), *map(int, v)): int(k) for a, v, b, k in zip(fit, x, y, n)}) == Counter((bool(a), bool(b), *map(int, v)) for a, v, b in zip(*one))
    again = pii.counted_candidates(corpus.repartition(7), "text")
    assert all((a == b).all() for a, b in zip((fit, x, y, n), again)) and pii.fit_candidates(spark, corpus.limit(0)) == pii.fit_candidates(spark)


def test_a_large_corpus_leaves_formats_without_a_base_alone(spark):
    corpus = spark.range(400).selectExpr("id as doc_id", "concat(repeat('call +1 (212) 555-0100 now ', 50), repeat('card 4111 1111 1111 1111 too ', 50), id) as text")
    assert pii.counted_candidates(corpus, "text")[3].sum() == 40000
    model = pii.fit_candidates(spark, corpus)
    more = spark.createDataFrame([(1, "call (030) 123-4567 now; SSN 123-45-6789, IBAN DE89370400440532013000, mail abc(at)klm(dot)com. Born 1987-05-03, version 1.2.3")], "doc_id long, text string")
    assert [s.split(":")[0] for s in pii.find_pii(more, model).first()["spans"].split(",")] == ["local_phone", "national_id", "iban", "spelled_email"]


def test_weights_of_trees_are_repetitions():
    rng = np.random.default_rng(3)
    x, y, n = rng.integers(0, 9, (60, 3)), rng.integers(0, 2, 60).astype(float), rng.integers(1, 6, 60)
    once, often = pii.boost(x, y, weight=n), pii.boost(np.repeat(x, n, axis=0), np.repeat(y, n))
    for a, b in zip(once, often):
        assert pii.tree_values(a, x) == pytest.approx(pii.tree_values(b, x))


def test_trees_see_every_cut_point():
    x = np.arange(500.0).reshape(-1, 1)
    y = (x[:, 0] > 400).astype(float)
    tree = pii.grow_tree(x, y - 0.5, np.full(500, 0.25), 1)
    assert tree[:2] == (0, 400.5) and tree[2] < 0 < tree[3]


def test_recall_of_random_keys():
    """Keys of every class, 20 to 40 characters, within prose; and names and numbers that are none."""
    rng = random.Random(9)
    for alphabet, least in (("0123456789abcdef", 0.95), ("0123456789ABCDEF", 0.95), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.95), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.95), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.8)):
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(24, 40))) for _ in range(400)]
        assert sum(bool(secrets.entropy_spans(f"set {k} now")) for k in keys) >= least * 400, alphabet
    for text in ("getUserNameFromIdentifierOrDefault", "HTTPRequestHandlerFactoryBean", "internationalizationalistically", "31415926535897932384626433", "SELECT_FROM_CUSTOMER_TABLE_NAMES"):
        assert secrets.entropy_spans(text) == []


def test_many_zip_marks_take_linear_time():
    import time
    import zipfile
    from io import BytesIO

    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 100)
    one = out.getvalue()
    kind, n, inside = media.sniff(b"PK\x03\x04" * 50_000 + b"PK\x05\x06" * 50_000 + one)
    assert inside == [("application/zip", 400_000, len(one))]
    began = time.process_time()
    media.sniff((b"PK\x03\x04" + b"PK\x05\x06") * 200_000)
    assert time.process_time() - began < 5
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    assert media.sniff(pdf + b" new /Prev 9 startxref 40 %%EOF tail")[:2] == ("application/pdf", len(pdf) + 31) and media.sniff(pdf + b" tail %%EOF")[1] == len(pdf)


def test_shards_have_fixed_sizes_and_quotas_hold(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("aaaab")) for i in range(600)] + [(1000, "w " * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, slots = mixing.mix_sources(docs, block_words=4, shard_slots=64)
    sizes = Counter(r["shard"] for r in slots.collect())
    regular = -(-slots.count() // 64)
    assert all(n <= 64 for n in sizes.values()) and sum(sizes.values()) == slots.count() and sum(n >= 40 for n in sizes.values()) >= 0.9 * regular
    counts = slots.groupBy("shard", "source_rank").count().collect()
    assert len({r["count"] for r in counts if r["source_rank"] == 0}) > 1  # drawn, not dealt evenly
    for r in taken.groupBy("source", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 4 * 3


def test_archive_of_clashing_columns_and_a_long_page(spark, tmp_path):
    long = "x" * 3_000_000
    rows = [(1, "http://a.example", long, "p", "q"), (2, "http://b.example", long, "p", "q"), (3, None, None, "p", "q"), (None, "u", "z", "p", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, sha1 string")
    warc.write_warc(pages, f"file://{tmp_path}/w", segment_bytes=1 << 20)
    got = {r["page_id"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert got[1]["refers_to"] == 2 and got[1]["record_type"] == "revisit" and got[2]["payload"] == long.encode() and got[3]["payload_bytes"] == 0 and got[None]["payload"] == b"z"
