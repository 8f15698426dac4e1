"""Searches, documents and passages on small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dates, passages
from corpusmill.functions.stem import stem
from corpusmill.operators import documents
from corpusmill.operators import retrieval as R
from corpusmill.operators import search as S
from corpusmill.plans import search as P


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_query_syntax():
    assert S.parse_query('a "B c" or -d e -"f g"') == [[(False, "a")], [(False, "b c"), (True, "d")], [(False, "e")], [(True, "f g")]]
    assert S.parse_query("or a or") == [[(False, "a")]] and S.parse_query(None) == [] and S.parse_query(' "" - ') == []


def test_full_text_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(f"d{i}", " ".join(rng.choice("red green blue black white grey".split()) for _ in range(rng.randrange(0, 7)))) for i in range(80)] + [("nul", None), ("d0", "red red")]
    queries = [("q1", "red blue"), ("q2", '"red blue"'), ("q3", "red or grey"), ("q4", "white -black"), ("q5", '"green red" or black -white'), ("q6", "-red"), ("q7", " "), ("q8", None), ("q9", "RED Red")]
    got = {tuple(r) for r in S.full_text(spark.createDataFrame(queries, "query_id string, query_text string"), spark.createDataFrame(docs, "id string, text string")).collect()}

    def holds(clauses, text):
        t = f" {' '.join((text or '').lower().split())} "
        return any(not any(n for n, _ in c) for c in clauses) and all(any((f" {p} " in t) != n for n, p in c) for c in clauses)

    assert got == {(q, d) for q, text in queries for d, t in docs if holds(S.parse_query(text), t)}


def test_routing_has_three_steps(spark):
    chunks = spark.createDataFrame([("c1", ["MCR 2.116(C)(7)", "MCR 2.116(C)(10)"]), ("c2", ["MCR 2.116(C)(10)", None]), ("c3", ["MCR 5.743b"]), ("c4", None), (None, ["MCR 9.999"])], "id string, citations array<string>")
    q = [("exact", "what is mcr2.116c10"), ("deep", "MCR 5.743b(A)(1) now"), ("under", "is Rule 2.116 in force"), ("none", "MCR 7.777"), ("gone", "MCR 9.999"), ("no", "hello"), ("nul", None)]
    got = {r.query_id: (r.citation, r.id, r.step) for r in S.route(spark.createDataFrame(q, "query_id string, query_text string"), chunks, ["5.743b"]).collect()}
    assert got == {"exact": ("MCR 2.116(C)(10)", "c1", 0), "deep": ("MCR 5.743b", "c3", 1), "under": ("MCR 2.116(C)(7)", "c1", 2)}


def test_search_facets_groups_and_blank_queries(spark):
    rng = random.Random(5)
    vocabulary = "court order guardian motion notice appeal".split()
    docs = spark.createDataFrame([("s", f"c{i:02d}", " ".join(rng.choices(vocabulary, k=6)), vocabulary[i % 6], [rng.random() for _ in range(4)] if i % 7 else None, f"g{i % 5}", "x" if i % 2 else "y") for i in range(40)], "scope string, id string, text string, heading string, vector array<double>, rule string, chapter string")
    queries = spark.createDataFrame([("q1", "guardian motion", [1.0, 0.0, 0.0, 0.0], "x"), ("q2", "appeal", [0.0, 1.0, 0.0, 0.0], None), ("q3", "  ", [0.0, 1.0, 0.0, 0.0], None), ("q4", "zzz", None, None)], "query_id string, query_text string, vector array<double>, chapter string")
    rows = S.search(queries, docs, 4, facets=("chapter",), group="rule").collect()
    own = {r.id: r for r in docs.collect()}
    by = {q: sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank) for q in ("q1", "q2", "q3", "q4")}
    assert not by["q3"] and not by["q4"] and [r.rank for r in by["q2"]] == [1, 2, 3, 4]
    assert by["q1"] and all(own[r.id].chapter == "x" for r in by["q1"]) and len({own[r.id].rule for r in by["q2"]}) == 4
    assert all(a.score >= b.score for a, b in zip(by["q2"], by["q2"][1:])) and {r.lane for r in rows} <= {"hybrid", "bm25", "dense"}
    some = S.search(queries, docs, 4, verified=docs.where("id = 'c01'")).collect()
    assert {r.id for r in some} <= {"c01"}
    assert S.search(queries, docs.limit(0), 4).count() == 0 and S.search(queries.limit(0), docs, 4).count() == 0


def test_bm25_over_stems_against_brute_force(spark):
    docs = [("a", "Hearings were granted", "motions"), ("b", "the hearing grants motion", ""), ("c", "unrelated words", "heading"), ("d", None, None)]
    got = {r.id: r.score for r in S.stemmed_bm25(spark.createDataFrame([("q", "granting hearings motion")], "query_id string, query_text string"), spark.createDataFrame([("s", *x) for x in docs], "scope string, id string, text string, heading string"), 10).collect()}
    stop = {"were", "the"}
    bags = {i: [stem(w) for w in (t or "").lower().split() if w not in stop] + 2 * [stem(w) for w in (h or "").lower().split()] for i, t, h in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    want = {}
    for i, bag in bags.items():
        total = 0.0
        for w in map(stem, ("granting", "hearings", "motion")):
            df, tf = sum(w in b for b in bags.values()), Counter(bag)[w]
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / mean)) if tf else 0
        if total:
            want[i] = round(total, 6)
    assert got == pytest.approx(want) and set(got) == {"a", "b"}


def test_lanes_are_the_same_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(f"d{i}", "".join(rng.choices("abcd ", k=30)), [rng.random() - 0.5 for _ in range(5)]) for i in range(60)], "id string, text string, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", "".join(rng.choices("abcd ", k=9)), [rng.random() - 0.5 for _ in range(5)]) for i in range(9)], "query_id string, query_text string, vector array<double>")
    run = lambda: (sorted(map(tuple, R.char_grams(queries, docs, 3).collect())), sorted(map(tuple, R.dense(queries, docs, 3).collect())))
    whole = run()
    monkeypatch.setattr(R, "BROADCAST_CELLS", 11)
    assert run() == whole and len(whole[1]) == 27


def test_full_text_broadcasts_queries_and_never_texts(spark, tmp_path):
    spark.createDataFrame([("d1", "red blue " * 50), ("d2", "blue"), ("d3", None)], "id string, text string").write.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([("q", "red")], "query_id string, query_text string")  # of unknown size to the planner, unlike the documents
    hits = S.full_text(queries, spark.read.parquet(str(tmp_path / "docs")))
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and [tuple(r) for r in hits.collect()] == [("q", "d1")]


def _lexical_case(spark):
    rng = random.Random(4)
    words = "court order guardian motion notice appeal rule 872".split()
    docs = [(f"d{i:03d}", "the " + " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.choice(words)) for i in range(150)] + [("nul", None, None), ("non", "unrelated", "")]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=1 + i % 4)) + " rule") for i in range(7)] + [("none", "zzz"), ("nul", None)]
    return spark.createDataFrame(queries, "query_id string, query_text string"), spark.createDataFrame([("s", *x) for x in docs], "scope string, id string, text string, heading string")


def test_bm25_scores_where_postings_are(spark, monkeypatch):
    """The same hits as by joins of pairs, in blocks of queries and documents too, and no join or row of a pair that isn't among the best of a task."""
    queries, docs = _lexical_case(spark)
    terms, shown = R.query_terms(queries), lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    ranked = lambda df: {(r.query_id, r.rank): (r.id, r.score) for r in df.collect()}
    want = ranked(R.bm25_by_scope(terms, docs, 9))
    hits = R.bm25(terms, docs, 9)
    assert ranked(hits) == want and len(want) == 63 and "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "SCORED_CELLS", 20)
    assert ranked(R.bm25(terms, docs, 9)) == want
    monkeypatch.setattr(R, "BROADCAST_CELLS", 90)
    assert ranked(R.bm25(terms, docs, 9)) == want
    assert shown(R.bm25(terms, docs, None)) == shown(R.bm25_by_scope(terms, docs, 1000))
    assert R.bm25(terms, docs.limit(0), 9).count() == 0 and R.bm25(terms.limit(0), docs, 9).count() == 0


def test_synonyms_and_feedback_add_terms_without_moving_texts(spark, tmp_path):
    queries, docs = _lexical_case(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    docs, terms = spark.read.parquet(str(tmp_path / "docs")), R.query_terms(queries)
    more = R.with_synonyms(terms, spark.createDataFrame([("g", "court"), ("g", "motion")], "group_id string, form string"))
    assert "Join" not in R.bm25(more, docs, 5)._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.query_id, r.rank): (r.id, r.score) for r in R.bm25(more, docs, 5).collect()}
    assert got == {(r.query_id, r.rank): (r.id, r.score) for r in R.bm25_by_scope(more, docs, 5).collect()}
    fed = R.with_feedback(terms, R.bm25(terms, docs, 5), docs)
    assert {r.term for r in fed.where("weight = 0.3").collect()} <= set("court order guardian motion notice appeal rule 872".split())
    assert "strategy=broadcast" in fed._jdf.queryExecution().optimizedPlan().toString()


def test_best_keeps_ties_by_id_and_trigrams_equal_their_definition():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    for pool in (1, 3, 50):
        best, rows = R.Best(["a", "b"], pool, 2), []
        for _ in range(6):
            ids, scores = [f"i{rng.randrange(10**6):06d}" for _ in range(40)], np.array([[rng.randrange(-2, 6) / 10 for _ in range(2)] for _ in range(40)])
            rows += [(q, -scores[i, j], ids[i]) for i in range(40) for j, q in enumerate("ab") if scores[i, j] > 0]
            best.add(scores, pa.array(ids))
            best.cut()
        got = sorted((r["query_id"], -r["score"], r["id"]) for b in best.taken() for r in b.to_pylist())
        assert got == [x for q in "ab" for x in sorted(r for r in rows if r[0] == q)[:pool]]
    texts = ["Ab  c-3ä", None, "İx", "aaaa aaaa"]
    row, gram, share = R._grams(texts)
    for i, t in enumerate(texts):
        count = Counter(w[j : j + 3] for w in (f" {x} " for x in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").lower()).split()) for j in range(len(w) - 2))
        norm = math.sqrt(sum(n * n for n in count.values()))
        number = lambda g: sum(" abcdefghijklmnopqrstuvwxyz0123456789".index(c) * 37 ** (2 - k) for k, c in enumerate(g))
        assert dict(zip(gram[row == i].tolist(), share[row == i].tolist())) == pytest.approx({number(g): n / norm for g, n in count.items()})


def test_hits_of_one_rule(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", ""), ("e", "")], "id string, rule string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("d", "e"), ("gone", "b")], "query_id string, id string")
    assert [tuple(r) for r in P.of_one_rule(pairs, docs).collect()] == [("a", "b")]


@pytest.mark.parametrize("name", ["hybrid_search", "engine_search", "index_search", "verified_search", "lane_comparison"])
def test_searches_make_the_index_once(spark, monkeypatch, name):
    made, indexed = [], P.indexed
    monkeypatch.setattr(P, "indexed", lambda s, d: made.append(d) or indexed(s, d))
    P.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_trigrams_of_many_queries_are_one_pass(spark):
    queries = spark.createDataFrame([(f"q{i:04d}", f"word{i}") for i in range(1500)] + [("long", "".join(random.Random(3).choices("abcdefgh ", k=900)))], "query_id string, query_text string")
    hits = R.char_grams(queries, spark.createDataFrame([("d", "word7 word1499")], "id string, text string"), 3)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {"q0007", "q1499"} <= {r.query_id for r in hits.collect()}


def test_dates(spark):
    for text, key in (("on 2024-03-09.", (2024, 3, 9)), ("3/9/2024", (2024, 3, 9)), ("3-9-24", (2024, 3, 9)), ("Rev. 03/2021", (2021, 3, 0)), ("edition of 1999", (1999, 0, 0)), ("no date 12345", None), (None, None)):
        got = value(spark, dates.date_key(F.lit(text).cast("string")))
        assert (tuple(got) if got else None) == key, text
    day = lambda x: F.lit(x).cast("date")
    assert value(spark, dates.is_stale(day("2023-11-30"), day("2025-06-01"))) and not value(spark, dates.is_stale(day("2023-12-01"), day("2025-06-01")))
    note = lambda at, by, ex: value(spark, dates.currency_note(day(at), day("2025-06-01"), F.lit(by).cast("string"), F.lit(ex)))
    assert (note("2020-01-02", "7", False), note("2020-01-02", None, False), note("2020-01-02", None, True), note("2025-01-01", None, False)) == ("superseded by 7", "not checked since 2020-01-02", "", "")


def test_passages(spark):
    assert value(spark, passages.clip(F.lit("one two three"), 9)) == "one two …" and value(spark, passages.clip(F.lit("short"), 9)) == "short"
    spans = [(0, None, None), (3, 3, "p. 3"), (3, 5, "pp. 3–5"), (3, None, "p. 3"), (None, 4, None)]
    assert [value(spark, passages.page_span(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b, _ in spans] == [x for *_, x in spans]
    assert value(spark, passages.without_reasoning(F.lit("<think>a\nb</think> yes"))) == "yes" and value(spark, passages.without_reasoning(F.lit("<THINK>open Answer: yes"))) == "yes" and value(spark, passages.without_reasoning(F.lit("<think>open"))) == ""
    assert value(spark, passages.once_in_a_row(F.lit("A b. A b. C. A b."))) == ["A b.", "C.", "A b."]
    assert value(spark, F.rlike(F.lit("see Foo  (Bar)\nbaz"), passages.flexible(F.lit("foo (bar) BAZ")))) and not value(spark, F.rlike(F.lit("foo xbar baz"), passages.flexible(F.lit("foo .bar baz"))))
    assert value(spark, passages.echo(F.lit("the guardian files motions"), F.lit("A guardian may file"), ("the",))) == pytest.approx(1 / 3)


def test_kinds_terms_and_hashed_vectors(spark):
    docs = spark.createDataFrame([("a", "law law law § 1"), ("b", "law"), ("c", "nothing here"), ("d", ""), ("e", None)], "id string, text string")
    got = {r.id: (r.kind, r.confidence) for r in documents.kinds(docs, [("x", "law", 1.0), ("y", "§", 3.0), ("x", "zzz", 9.0)]).collect()}
    assert got == {"a": ("y", 0.75), "b": ("x", 1.0), "c": ("other", 0.0), "d": ("other", 0.0), "e": ("other", 0.0)}
    terms = [(r.id, r.term) for r in documents.distinctive_terms(docs).orderBy("id", "rank").collect()]
    assert ("c", "nothing") in terms and ("a", "law") in terms
    vectors = {}
    for r in documents.hashed_vectors(docs).collect():
        vectors.setdefault(r.id, []).append(r.value)
    assert set(vectors) == {"a", "b", "c"} and all(sum(v * v for v in x) == pytest.approx(1, abs=1e-4) for x in vectors.values())
