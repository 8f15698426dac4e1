"""Core operators on small fixtures."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import citations as C
from corpusmill.functions import text as T
from corpusmill.functions.stem import stem
from corpusmill.operators import audit, evaluation, graph, references
from corpusmill.operators import retrieval as R
from corpusmill.operators import structure as Q
from corpusmill.plans import retrieval
from corpusmill.sources import files, sinks
from corpusmill.streaming import log

D = dt.datetime


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# references ------------------------------------------------------------------------------------------------------


def judge(refs, parents, key):
    out = []
    for a, k, t in refs:
        if k is None:
            continue
        own = [(x, y) for p, x, y in parents if p is not None and key(p) == key(k)]
        if not own:
            out.append((a, k, "missing"))
        elif t is not None and not any(x is not None and x <= t and (y is None or y > t) for x, y in own):
            loads = [x for x, _ in own if x is not None]
            out.append((a, k, "late" if not loads or min(loads) > t else "deleted"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_references_against_brute_force(spark, seed):
    rng = random.Random(seed)
    when = lambda: D(2025, rng.randrange(1, 13), rng.choice([1, 1, 15]), rng.choice([0, 12]))
    keys = [f"MCR {i}" for i in range(40)]
    parents = []
    for k in keys[:30]:
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            a = when()
            parents.append((k, a if rng.random() > 0.05 else None, a + dt.timedelta(rng.randrange(-10, 90)) if rng.random() < 0.5 else None))
    parents.append((None, D(2025, 1, 1), None))
    refs = [(f"a{i}", "MCR 0" if i % 3 == 0 else rng.choice(keys), when() if rng.random() > 0.05 else None) for i in range(400)] + [("n", None, when()), ("d", "mcr  1 ", when())]
    refs.append(refs[0])
    rf = spark.createDataFrame(refs, "answer_id string, ref_key string, recorded_at timestamp_ntz").withColumn("code", F.lit("clash"))
    pf = spark.createDataFrame(parents, "parent_key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("month", F.lit(1))
    got = references.orphan_references([references.Reference("t", rf, pf, references.citation_key)], key_ranges=3).collect()
    norm = lambda k: "".join(k.split()).lower().removeprefix("mcr")
    assert sorted((r.answer_id, r.ref_key, r.reason) for r in got) == judge(refs, parents, norm)


def test_references_empty(spark):
    rf = spark.createDataFrame([("a", "k", D(2025, 1, 1))], "answer_id string, ref_key string, recorded_at timestamp_ntz")
    pf = spark.createDataFrame([("k", D(2025, 1, 1), None)], "parent_key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    run = lambda r, p: [x.reason for x in references.orphan_references([references.Reference("t", r, p)]).collect()]
    assert run(rf, pf) == [] and run(rf.limit(0), pf) == [] and run(rf, pf.limit(0)) == ["missing"]
    # loaded at the very moment counts, deleted at it does not
    gone = pf.withColumn("deleted_at", F.lit(D(2025, 1, 1)).cast("timestamp_ntz"))
    assert run(rf, gone) == ["deleted"]


# text ------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("The clerk's Ordres — été 7B-1111 a"))) == ["clerk", "ordres", "été", "7b", "1111"]
    assert one(spark, T.clean(F.lit("a<br>b <b>x</b> | y\x00__z  .\n\n\n\n• \n c "))) == "a\nb x y z.\n\n• c"
    assert one(spark, T.dehyphenate(F.lit("exam-\n ple Left-\nRight"))) == "example Left-\nRight"
    assert [one(spark, T.looks_garbled(F.lit(t))) for t in ("short", "�" * 3 + "word " * 20, "x" * 250, "7" * 60, "The clerk files the order with the court and serves it. " * 2, " ".join("abcdefghijklmnop"))] == [False, True, True, True, False, False]
    assert one(spark, T.looks_garbled(F.lit("a b c d e f g h i j k l m n o p q r s t u v w x y z"))) is True
    assert one(spark, T.jaccard(F.lit(""), F.lit(""))) == 1 and one(spark, T.jaccard(F.lit("a"), F.lit(""))) == 0
    assert one(spark, T.summary(F.lit("# H\n\n| t |\n\n First one. \n\nx"))) == "First one."


def test_stem():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational valenci digitizer radicalli formaliti sensibiliti triplicate formative formalize hopeful goodness revival allowance adjustment adoption communism effective probate rate cease controll roll".split()
    stems = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop fall hiss fail file happi sky relat condit ration valenc digit radic formal sensibl triplic form formal hope good reviv allow adjust adopt commun effect probat rate ceas control roll".split()
    assert [stem(w) for w in words] == stems


def test_citation_functions(spark):
    assert one(spark, C.prefixes(F.lit("2.116"), F.lit("(C)(10)"))) == ["MCR 2.116(C)(10)", "MCR 2.116(C)", "MCR 2.116"]
    assert one(spark, C.marker_numbers(F.lit("a [1] b [1, 2-4, 6] c [1,2,] d [1-1000] e [1,2,banana]"), F.lit(6))) == [1, 1, 2, 3, 4, 6, 1, 2, 3, 4, 5, 6]
    assert one(spark, C.parent_of(F.lit("(A)(1)(a)"))) == "(A)(1)"
    for before, name in (("notwithstanding ", "overrides"), ("except as provided in ", "excepts"), ("subject to ", "conditions"), ("as defined in ", "defines"), ("see ", "refers")):
        assert one(spark, C.relation(F.lit(before))[0]) == name


def test_markers_with_dashes_and_ranges_that_fall(spark):
    text = "[4-10] [3-1] [1\u20133] [2\u20144] [7 - 8, 2] [99999999999] [5-99999999999]"
    assert one(spark, C.marker_numbers(F.lit(text), F.lit(6))) == [4, 5, 6, 7, 8, 9, 3, 1, 2, 3, 2, 3, 4, 7, 8, 2, 5]


def test_chain_is_streamed_and_nulls_and_ties_hold(spark):
    rows = [(1, 1, "a"), (1, 2, None), (1, 2, "b"), (None, 1, "x"), (2, 5, "z")]
    got = {(r.u, r.seq, r.hash[:6]) for r in audit.chain(spark.createDataFrame(rows, "u int, n int, body string"), "u", "n", "body").collect()}
    import hashlib

    h = lambda last, x: hashlib.sha256((last + x).encode()).hexdigest()
    one_, two = h("", "a"), h(h("", "a"), "")
    assert got == {(1, 1, one_[:6]), (1, 2, two[:6]), (1, 2, h(two, "b")[:6]), (2, 5, h("", "z")[:6])}


def test_publish_replaces_the_name_in_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        sinks.publish(spark.range(n), path, f"v{n}")
        assert sinks.current(spark, path).count() == n
    assert not list((tmp_path / "t").glob("_*.tmp"))


def test_elements_of_sorted_by_counts(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(9)) for g in "ab" for _ in range(rng.randrange(1, 40))] + [("a", None), ("c", 4)]
    got = {r.g: (r.n, r.p, r.q, r.max) for r in evaluation.nth_of_sorted(spark.createDataFrame(rows, "g string, v int"), "v", {"p": 0.5, "q": 0.9}, ["g"]).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), v[int(0.5 * len(v))], v[int(0.9 * len(v))], v[-1])


def test_canonical_citations():
    rules = frozenset({"5.743b"})
    cases = {"2.116(C)(10)": "MCR 2.116(C)(10)", "what is Rule 2.116?": "what is MCR 2.116?", "mcr 2.116c10": "MCR 2.116(C)(10)", "see mcr 5.743b": "see MCR 5.743b", "(2.116) no": "( MCR 2.116) no", "nothing": "nothing", "MCR 2.116 (C) (10) now": "MCR 2.116(C)(10) now"}
    assert {q: C.canonical(q, rules) for q in cases} == cases and C.canonical(None, rules) is None


def test_lines_and_rechunk(spark):
    spans = [("d", 1, 10.0, 50.0, "b"), ("d", 1, 12.9, 10.0, "a"), ("d", 1, 15.5, 10.0, "next"), ("d", 1, 740.0, 1.0, "foot"), ("d", 2, 1.0, 1.0, " "), ("d", 2, 1.0, None, "x"), ("d", 2, 5.0, 1.0, "z")]
    df = spark.createDataFrame(spans, "doc_id string, page int, y double, x double, text string")
    assert [(r.page, r.text) for r in Q.lines_from_spans(df).orderBy("page", "line").collect()] == [(1, "a b"), (1, "next"), (2, "z")]
    text = "(a) First part. (b) " + "Second part holds; " * 20 + "(1) third." + "x" * 90
    assert all(len(a) <= 100 or " " not in a for a in Q.atoms(text, 80)) and "".join(Q.atoms(text, 80)).replace(" ", "") == text.replace(" ", "")
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, text string")
    assert {r.doc_id for r in Q.rechunk(docs, 80).collect()} == {"d"}


# retrieval -------------------------------------------------------------------------------------------------------


def test_fuse_is_order_free_and_breaks_ties_by_id(spark):
    lane = lambda ids: spark.createDataFrame([("q", i, 1.0, n + 1) for n, i in enumerate(ids)], "query_id string, id string, score double, rank int")
    a, b = lane(["x", "y", "z"]), lane(["z", "w"])
    rows = [tuple(r) for r in R.fuse({"a": (a, 1.0), "b": (b, 1.0)}, 10).orderBy("rank").select("id", "lane").collect()]
    assert rows == [("z", "a+b"), ("x", "a"), ("w", "b"), ("y", "a")]
    assert rows == [tuple(r) for r in R.fuse({"b": (b, 1.0), "a": (a, 1.0)}, 10).orderBy("rank").select("id", "lane").collect()]


def test_budget_stops_and_keeps_the_first(spark):
    rows = [("q", "a", 1, 900), ("q", "b", 2, 50), ("r", "a", 1, 50), ("r", "b", 2, 70), ("r", "c", 3, 10)]
    df = spark.createDataFrame(rows, "query_id string, id string, rank int, n int")
    assert sorted((r.query_id, r.id) for r in R.budget(df, "n", 100).collect()) == [("q", "a"), ("r", "a")]


def test_dense_leaves_out_unusable_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [0.0, 0.0])], "id string, vector array<double>")
    q = spark.createDataFrame([("q", [2.0, 0.0]), ("n", None)], "query_id string, vector array<double>")
    assert [(r.query_id, r.id, r.score) for r in R.dense(q, v, 5).orderBy("rank").collect()] == [("q", "a", 1.0), ("q", "b", 0.707107)]


def test_mcnemar(spark):
    run = lambda ranks: spark.createDataFrame(list(enumerate(ranks)), "query_id int, rank int")
    p = lambda a, b: tuple(evaluation.mcnemar(run(a), run(b), 1).first())
    assert p([1] * 9, [1] * 9) == (9, 0, 0, 1.0)
    assert p([1] * 6, [None] * 6) == (6, 6, 0, 0.03125)
    assert p([1, None] * 3, [None, 1] * 3) == (6, 3, 3, 1.0)


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(str(i), rng.random() + 0.2, rng.random()) for i in range(200)], "query_id string, a double, b double")
    r = evaluation.bootstrap(df, 500).first()
    assert r.n == 200 and r.low < r["mean"] < r.high and r.low > 0


def test_bootstrap_truncation_draws_in_full(spark, monkeypatch):
    ranks = [spark.createDataFrame([(str(i), 1 + i * k % 7) for i in range(60)], "query_id string, rank int") for k in (2, 3)]
    monkeypatch.setattr(retrieval, "_ranks", lambda s, d, dims=None: ranks[dims is not None])
    pairs = ranks[0].selectExpr("query_id", "1 / rank AS a").join(ranks[1].selectExpr("query_id", "1 / rank AS b"), "query_id")
    low_high = lambda df: df.select("low", "high").first()
    assert low_high(retrieval.bootstrap_truncation(spark, "")) == pytest.approx(low_high(evaluation.bootstrap(pairs, 20_000)), rel=1e-9)


def test_near_duplicates_of_hits(spark):
    rows = [("q", 1, "a", "the clerk files the order"), ("q", 2, "b", "the clerk files the orders"), ("q", 3, "c", "a guardian appeals"), ("q", 4, "d", "")]
    df = spark.createDataFrame(rows, "query_id string, rank int, id string, text string")
    assert [(r.id, r["rank"]) for r in Q.without_near_duplicates(df, 3).orderBy("rank").collect()] == [("a", 1), ("c", 2), ("d", 3)]


# graph and audit -------------------------------------------------------------------------------------------------


def test_graph(spark):
    blocks = spark.createDataFrame(
        [("b1", "MCR 1.101(A)", "1.101", "Except as provided in MCR 2.202(B)(9), the clerk acts. See MCR 1.101."), ("b2", "MCR 2.202(B)", "2.202", "Subject to MCR 1.101(A) and MCR 9.999, see."), ("b3", "MCR 2.202", "2.202", None), ("b4", None, "3.3", "MCR 2.202")],
        "block_id string, citation string, rule string, text string",
    )
    e = graph.edges(blocks)
    assert sorted((r.src, r.dst, r.relation, r.force) for r in e.collect()) == [("MCR 1.101(A)", "MCR 2.202(B)", "excepts", 1), ("MCR 2.202(B)", "MCR 1.101(A)", "conditions", 2)]
    shown = spark.createDataFrame([("q", "MCR 2.202(B)", "2.202")], "query_id string, citation string, rule string")
    assert [(r.citation, r.force, r.way) for r in graph.expand(shown, e).collect()] == [("MCR 1.101(A)", 0.5, "in")]


def test_chain_detects_any_change(spark):
    rows = [(u, i, f"line {u} {i}") for u in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id int, event_id long, body string")
    logged = audit.chain(df, "user_id", "event_id", "body").withColumnRenamed("seq", "event_id").join(df, ["user_id", "event_id"])
    clean = audit.first_break(logged, "user_id", "event_id", "body", "hash")
    assert all(r.first_bad is None for r in clean.collect())
    changed = logged.withColumn("body", F.when((F.col("user_id") == 1) & (F.col("event_id") == 4), "x").otherwise(F.col("body")))
    assert {r.user_id: r.first_bad for r in audit.first_break(changed, "user_id", "event_id", "body", "hash").collect()} == {0: None, 1: 4, 2: None}


# structure -------------------------------------------------------------------------------------------------------


def test_paths(spark):
    rows = [("1.1", "b1", "A", 1), ("1.1", "b2", None, 2), ("1.1", "b3", "1", 2), ("1.1", "b4", "2", 2), ("1.1", "b5", None, 2), ("1.1", "b6", "B", 1), ("1.1", "b7", "1", 1), ("1.1", "b8", "D", 1), ("2.2", "b9", "a", 1), (None, "c", "a", 1), ("2.2", "d", None, None)]
    df = spark.createDataFrame(rows, "rule string, block_id string, marker string, depth int")
    got = {r.block_id: (r.subpath, r.problem) for r in Q.assign_paths(df).collect()}
    assert got == {"b1": ("(A)", ""), "b2": ("(A)", ""), "b3": ("(A)(1)", ""), "b4": ("(A)(2)", ""), "b5": ("(A)", ""), "b6": ("(B)", ""), "b7": ("(B)(1)", "one level further in than it stands"), "b8": ("(D)", "out of sequence"), "b9": ("(a)", ""), "d": ("(a)", "")}
    assert Q.may_follow("z") == {"aa"} and Q.may_follow("aa") == {"bb"} and Q.may_follow("ii") == {"iii", "jj"} and Q.may_follow("9") == {"10"}


def test_chunk_rules_never_cross_rules(spark):
    rng = random.Random(4)
    rows = [(f"{r}.1", f"b{r}{i:03d}", "(A)" * rng.randrange(1, 4), rng.randrange(5, 120)) for r in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "rule string, block_id string, subpath string, tokens int")
    out = Q.chunk_rules(df, 300).collect()
    assert sorted(r.block_id for r in out) == sorted(b for _, b, _, _ in rows)
    again = sorted(map(tuple, Q.chunk_rules(df.repartition(7), 300).collect()))
    assert again == sorted(map(tuple, out))
    for rule in {r.rule for r in out}:
        seq = [r.chunk for r in sorted((x for x in out if x.rule == rule), key=lambda x: x.block_id)]
        assert seq[0] == 0 and all(b - a in (0, 1) for a, b in zip(seq, seq[1:]))


def test_markdown_chunks():
    md = "<!-- page: 2 -->\n# Top\n" + "word " * 60 + "\n\n<!-- page: 3 -->\n## Sub\n" + "\n\n".join(["para " * 80] * 6) + "\n## Tail\nend"
    c = Q.markdown_chunks(md)
    assert c[0]["heading_path"] == [] or c[0]["heading_path"] == ["Top"]
    assert all("page:" not in x["text"] for x in c) and c[0]["page_start"] == 2 and c[-1]["page_end"] == 3
    assert any(x["text"].startswith("(Sub, continued)") for x in c) and all(len(x["text"]) <= 1.6 * 1500 for x in c)
    assert Q.markdown_chunks("") == [] and Q.markdown_chunks("x" * 4000)[0]["text"] == "x" * 1500


# sources, sinks, streams -----------------------------------------------------------------------------------------


def test_jsonl_and_index(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1, "more": 2}\n\n{broken\n{"id": "b"}\n')
    assert sorted(tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()) == [("a", 1), ("b", None)]
    (tmp_path / "i.json").write_text('{"documents": [{"doc_id": "d"}],\n "chunks": [{"chunk_id": "d:0", "doc_id": "d"}, {"chunk_id": "d:1"}]}')
    docs, chunks = files.read_index(spark, str(tmp_path / "i.json"), "doc_id string", "chunk_id string, doc_id string")
    assert docs.count() == 1 and chunks.count() == 2


def test_extract(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.txt").write_bytes("Source: x\ncaf\xe9 [[p|link]]\n\n\n----\n''end''".encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    got = {r.name: r for r in files.extract(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "# Title\n\na\tb\n\n| x | y |" and got["b.txt"].text == "café link\n\nend"
    assert got["c.docx"].text is None and "BadZipFile" in got["c.docx"].error


def test_upsert_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, kind string, ts timestamp, value double"
    rows = [(i % 5, "ab"[i % 2], D(2025, 1, 1, 0, i), float(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = log.read_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    log.upsert_stream(stream, str(tmp_path / "t"), ["user_id", "kind"], "ts", str(tmp_path / "c")).awaitTermination()
    want = {}
    for u, k, t, v in rows:
        want[u, k] = v
    assert {(r.user_id, r.kind): r.value for r in sinks.current(spark, str(tmp_path / "t")).collect()} == want


def test_streamed_counts_equal_batch(spark, tmp_path):
    schema = "user_id long, event_type string, ts timestamp, value double"
    rows = [(i % 3, "ab"[i % 2], D(2025, 1, 1, 0, 0) + dt.timedelta(minutes=i * 7), 1.0) for i in range(60)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = log.hourly_counts(log.read_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = log.hourly_counts(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.sql("SELECT * FROM counts").collect())) == sorted(map(tuple, batch.collect()))
    assert log.sessions(spark.createDataFrame(rows, schema)).agg(F.sum("n")).first()[0] == 60


def test_delta_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2)], "k string, v int")
    assert [r.k for r in sinks.insert_if_absent(df, df.where("k = 'b'"), ["k"]).collect()] == ["a"]
    sinks.write_manifest(df, str(tmp_path / "m"), ["k"])
    assert [r.k for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == ["a", "a", "b"]


# queries ---------------------------------------------------------------------------------------------------------

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p5_found", "p5_by_month", "bm25_topk", "hybrid_rrf", "dense_topk", "metrics_by_slice", "answer_audit", "clean_text", "xref_mentions", "sessions"])
def test_queries_equal_their_sql(spark, name):
    from tests.parity import compare

    assert compare(spark, name, SMALL) == ""


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.queries()
