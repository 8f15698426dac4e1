"""Queries on texts, citations, audits, lineage, reports and logs, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.functions import citations as C
from corpusmill.functions import text as T
from corpusmill.operators import audit as A
from corpusmill.operators import evaluation as E
from corpusmill.operators import graph as G
from corpusmill.operators import references
from corpusmill.operators import retrieval as R
from corpusmill.plans.retrieval import _KB, _bm25_sql, asked, kb
from corpusmill.sources.tables import table


def clean_text(s: SparkSession, d: str) -> DataFrame:
    c = T.clean(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("hash"))


def dehyphenated(s: SparkSession, d: str) -> DataFrame:
    """Texts whose long words are broken over lines, as a narrow column would, and joined again. (The texts as they are have none.)"""
    narrow = F.regexp_replace("text", r"([a-z]{4})([a-z]{4})", "$1-\n$2")
    return table(s, d, "documents").select("doc_id", narrow.alias("n"), T.dehyphenate(narrow).alias("c")).where("n <> c").select("doc_id", F.md5("c").alias("hash"))


def page_quality(s: SparkSession, d: str) -> DataFrame:
    """Reasons for which a document's text is flagged."""
    t = T.strip(F.coalesce("text", F.lit("")))
    reasons = F.array_compact(F.array(F.when(F.length(t) < 1, F.lit("empty_page")), F.when(T.looks_garbled(F.col("text")), F.lit("garbled_text"))))
    return table(s, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.array_join(reasons, ",").alias("reasons"))


def document_quality(s: SparkSession, d: str) -> DataFrame:
    flagged = table(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), T.looks_garbled(F.col("text")).alias("g"))
    rows = flagged.groupBy("source").agg(F.count("*").alias("n"), F.count_if("g").alias("flagged"))
    return rows.select("source", "n", "flagged", F.round(1 - F.col("flagged") / F.col("n"), 4).alias("score"), F.when(F.col("flagged") == 0, "clean").when(F.col("flagged") == F.col("n"), "rejected").otherwise("partial").alias("status"))


def answer_overlap(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "answers").select("answer_id", F.round(T.jaccard(F.col("question"), F.col("answer")), 6).alias("overlap")).distinct()


def guessed_language(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").groupBy(T.guess_language(F.col("text")).alias("guess"), F.lower(F.coalesce("lang", F.lit("none"))).alias("lang")).agg(F.count("*").alias("n"))


def summaries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


def key_phrases(s: SparkSession, d: str) -> DataFrame:
    """The twelve most repeated words and pairs of neighbouring words of each source; pairs count one more."""
    rows = table(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), T.tokens(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    said = rows.select("source", F.explode("w").alias("phrase"), F.lit(0).alias("more")).unionByName(rows.where("size(w) > 1").select("source", F.explode(pairs).alias("phrase"), F.lit(1).alias("more")))
    n = said.groupBy("source", "phrase").agg((F.count("*") + F.max("more")).alias("n"), F.count("*").alias("c")).where("c > 1")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "phrase"))
    return n.withColumn("rank", rank).where("rank <= 12").select("source", "phrase", "n", "rank")


def layout_signatures(s: SparkSession, d: str) -> DataFrame:
    """The shape of a document without its words: six densities."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), T.strip), lambda x: x != "")
    n = F.greatest(F.size("lines"), F.lit(1))
    share = lambda f: F.round(F.size(F.filter("lines", f)) / n, 4)
    mean = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / n
    return table(s, d, "documents").select("doc_id", lines.alias("lines")).select(
        "doc_id",
        share(lambda x: x.rlike(r"^[A-Za-z][A-Za-z ]{1,40}:\s*\S")).alias("field_density"),
        share(lambda x: x.rlike(r"\[[ xX]\]")).alias("checkbox_density"),
        share(lambda x: x.rlike(r"^\|?[ :|-]*-{3,}[ :|-]*$")).alias("table_density"),
        F.round(F.least(mean / 120.0, F.lit(1.0)), 4).alias("avg_line_len"),
        share(lambda x: F.length(x) <= 40).alias("short_line_ratio"),
        share(lambda x: (F.length(x) > 3) & x.rlike("[A-Z]") & ~x.rlike(r"[^\x00-\x7F]") & (F.upper(x) == x)).alias("allcaps_ratio"),
    )


def _body(s: SparkSession, d: str) -> DataFrame:
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "citation", "rule", "text", "kind", "deleted_at").where("kind = 'body' AND deleted_at IS NULL")
    return rows.select("block_id", "citation", F.regexp_replace("rule", r"[^0-9.A-Za-z]|(?i:mcr|rule)", "").alias("rule"), "text")


def xref_mentions(s: SparkSession, d: str) -> DataFrame:
    m = G.mentions(_body(s, d))
    name, force = C.relation(F.col("before"))
    return m.select("cited_rule", name.alias("relation"), force.alias("force")).groupBy("cited_rule", "relation", "force").agg(F.count("*").alias("n"))


def xref_edges(s: SparkSession, d: str) -> DataFrame:
    return G.edges(_body(s, d))


def xref_inbound(s: SparkSession, d: str) -> DataFrame:
    """How often each rule is referred to by others."""
    m = G.mentions(_body(s, d)).where("NOT (cited_rule <=> rule)")
    return m.groupBy(F.col("cited_rule").alias("rule")).agg(F.count("*").alias("inbound"), F.countDistinct("rule").alias("from_rules"))


def graph_expand(s: SparkSession, d: str) -> DataFrame:
    """The three bindings of each answer's citations that it did not show."""
    said = table(s, d, "answer_citations").where("citation IS NOT NULL").select(F.col("answer_id").alias("query_id"), "citation", F.regexp_extract("citation", r"(\d+\.\d+[A-Za-z]?)", 1).alias("rule")).distinct()
    return G.expand(said, G.edges(_body(s, d)))


def citation_prefixes(s: SparkSession, d: str) -> DataFrame:
    """The deepest citation of the corpus that each cited one falls under."""
    said = table(s, d, "answer_citations").where("citation IS NOT NULL").select("citation").distinct()
    cited = said.select(F.col("citation").alias("block_id"), F.posexplode(C.cited_rules(F.col("citation"))).alias("n", "m")).select("block_id", "n", F.col("m.rule").alias("cited_rule"), F.col("m.groups").alias("groups"))
    return G.resolve(cited, _body(s, d).where("citation IS NOT NULL").select("citation")).select(F.col("block_id").alias("citation"), "target")


def citation_markers(s: SparkSession, d: str) -> DataFrame:
    numbers = C.marker_numbers(F.col("answer"), F.lit(6))
    return table(s, d, "answers").where("answer IS NOT NULL").select("answer_id", "answer").distinct().select("answer_id", F.array_join(numbers, ",").alias("markers"), F.size(numbers).cast("long").alias("n")).distinct()


def refusal_flags(s: SparkSession, d: str) -> DataFrame:
    c = F.col("answer")
    return table(s, d, "answers").groupBy(A.refusal_by_pattern(c).alias("by_pattern"), A.refusal_by_lead(c).alias("by_lead"), A.refusal_by_term(c).alias("by_term"), F.coalesce("refused", F.lit(False)).alias("refused")).agg(F.count("*").alias("n"))


def grounded_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers that cite a passage they were given and do not refuse."""
    k = table(s, d, "answer_passages").where("chunk_id IS NOT NULL").groupBy("answer_id").agg(F.countDistinct("chunk_id").cast("int").alias("k"))
    rows = table(s, d, "answers").select("answer_id", "answer").distinct().join(k, "answer_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    ok = A.cited_numbers_ok(C.marker_numbers(F.col("answer"), F.lit(50)), F.col("k")) & ~A.refusal_by_lead(F.col("answer"))
    return rows.select("answer_id", "k", ok.alias("grounded")).distinct()


def answer_audit(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    return A.citation_audit(t("answer_citations"), t("blocks"), t("answer_passages"), t("chunks"), references.citation_key)


def provenance(s: SparkSession, d: str) -> DataFrame:
    """From answers over passages, chunks and their blocks to parse runs: rows of each run and source."""
    t = lambda n: table(s, d, n)
    chunks = R.latest(t("chunks"), "chunk_id", "loaded_at", "run_id", "block_ids").select("chunk_id", "run_id", F.explode("block_ids").alias("block_id"))
    blocks = t("blocks").where("block_id IS NOT NULL").select("block_id").distinct()
    passages = t("answer_passages").where("chunk_id IS NOT NULL").select("answer_id", "chunk_id").distinct()
    answers = t("answers").where("answer_id IS NOT NULL").select("answer_id").distinct()
    rows = passages.join(answers, "answer_id").join(chunks, "chunk_id").join(blocks, "block_id").join(t("parse_runs").select("run_id", "source_id"), "run_id")
    return rows.groupBy("run_id", "source_id").agg(F.count("*").alias("n_links"), F.countDistinct("answer_id").alias("n_answers"), F.countDistinct("block_id").alias("n_blocks"))


def stale_hashes(s: SparkSession, d: str) -> DataFrame:
    return A.stale_hashes(table(s, d, "chunks").where("chunk_id IS NOT NULL"), "chunk_id", "embed_text", "sha256", 16)


def audit_chain(s: SparkSession, d: str) -> DataFrame:
    """The hash chain of each user's events."""
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    return A.chain(table(s, d, "events").select("user_id", "event_id", body.alias("body")), "user_id", "event_id", "body")


def audit_chain_check(s: SparkSession, d: str) -> DataFrame:
    """Chains of which every 7th user's third line was changed after it was hashed."""
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    events = table(s, d, "events").select("user_id", "event_id", body.alias("body"))
    logged = A.chain(events, "user_id", "event_id", "body").withColumnRenamed("seq", "event_id").join(events, ["user_id", "event_id"])
    third = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) == 3
    tampered = logged.withColumn("body", F.when(third & (F.col("user_id") % 7 == 0), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return A.first_break(tampered, "user_id", "event_id", "body", "hash")


def querylog_stats(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "answers")
    return rows.groupBy(F.coalesce("generator", F.lit("unknown")).alias("generator")).agg(F.count("*").alias("answers"), F.count_if("refused").alias("refusals"), F.count_if(F.col("latency_ms").isNull()).alias("untimed"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    """p50, p90 and p95 of each generator: element int(f x n) of the sorted latencies."""
    rows = table(s, d, "answers").select(F.coalesce("generator", F.lit("unknown")).alias("generator"), "latency_ms").where("latency_ms IS NOT NULL")
    return E.nth_of_sorted(rows, "latency_ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ["generator"])


def facet_counts(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "documents").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("facet")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.expr("n * 100 DIV sum(n) OVER ()"))


def twin_groups(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the same text of more than eight words, as groups of ids by hash."""
    rows = table(s, d, "chunks").where((F.size(F.split(T.strip(F.col("text")), r"\s+")) > 8) & F.col("chunk_id").isNotNull())
    groups = rows.groupBy(F.sha2("text", 256).alias("hash")).agg(F.countDistinct("chunk_id").alias("n"), F.min("chunk_id").alias("first_id"))
    return groups.where("n > 1")


def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    rows = R.latest(table(s, d, "chunks"), "chunk_id", "loaded_at", "text").select(T.estimated_tokens(F.col("text")).alias("n"))
    w = W.orderBy("n")
    ranked = rows.groupBy("n").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(W.partitionBy()))
    at = lambda f, x: F.min(F.when(F.col("upto") > F.floor(F.col("all") * f), F.col("n"))).alias(x)
    return ranked.agg(F.max("all").alias("chunks"), F.min("n").alias("least"), at(0.5, "median"), at(0.9, "p90"), F.max("n").alias("most"))


def coverage(s: SparkSession, d: str) -> DataFrame:
    """Citations of body blocks that no chunk lists, by chapter."""
    have = table(s, d, "chunks").select(F.explode("citations").alias("citation")).distinct()
    blocks = table(s, d, "blocks").where("kind = 'body' AND citation IS NOT NULL").select("chapter", "citation").distinct()
    return blocks.join(have.withColumn("listed", F.lit(1)), "citation", "left").groupBy("chapter").agg(F.count("*").alias("citations"), (F.count("*") - F.count("listed")).alias("unlisted"))


def rule_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Rules that only the blocks or only the chunks have, and those of both with their rows."""
    key = lambda c: F.regexp_replace(c, r"[^0-9.]", "")
    side = lambda n: table(s, d, n).where("rule IS NOT NULL").groupBy(key(F.col("rule")).alias("rule")).agg(F.count("*").alias(n))
    both = side("blocks").join(side("chunks"), "rule", "full_outer")
    found = F.when(F.col("chunks").isNull(), "blocks_only").when(F.col("blocks").isNull(), "chunks_only").otherwise("both")
    return both.groupBy(found.alias("finding")).agg(F.count("*").alias("rules"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def missing_vectors(s: SparkSession, d: str) -> DataFrame:
    """Chunks that a delta load still has to embed, by run."""
    usable = F.expr("embedding IS NOT NULL AND size(embedding) = 64 AND NOT exists(embedding, x -> isnan(x)) AND exists(embedding, x -> x <> 0)")
    have = table(s, d, "chunks").where(usable).select("chunk_id").distinct()
    rows = table(s, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", F.coalesce("run_id", F.lit("none")).alias("run_id")).distinct()
    return rows.join(have.withColumn("h", F.lit(1)), "chunk_id", "left").groupBy("run_id").agg(F.count("*").alias("n"), (F.count("*") - F.count("h")).alias("missing"))


def latest_feedback(s: SparkSession, d: str) -> DataFrame:
    """The last value of each user and kind of event: an upsert by key."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("value"), F.max("ts").alias("ts"))


def stratified_pick(s: SparkSession, d: str) -> DataFrame:
    """Two hundred documents, one of each source at a time."""
    rows = table(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id")
    turn = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("turn", turn).where("turn <= 200").orderBy("turn", "source").limit(200)


def representatives(s: SparkSession, d: str) -> DataFrame:
    """Of each rule the block that stands for it: of depth one to three if there is one, then the longest."""
    rows = table(s, d, "blocks").where("kind = 'body' AND rule IS NOT NULL AND block_id IS NOT NULL AND deleted_at IS NULL")
    n = F.size(F.split(T.strip(F.coalesce("text", F.lit(""))), r"\s+"))
    order = W.partitionBy("rule").orderBy(F.when(F.col("depth").between(1, 3), 0).otherwise(1), F.desc(F.least(n, F.lit(120))), "block_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("rule", "block_id", "depth")


def size_bands(s: SparkSession, d: str) -> DataFrame:
    """Rules by the quartile of their characters, the bounds being elements int(f x n) of the sorted sizes."""
    sizes = table(s, d, "blocks").where("rule IS NOT NULL").groupBy("rule").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    # distinct sizes are few; the bounds come from their running counts
    upto = sizes.groupBy("chars").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(W.orderBy("chars"))).withColumn("all", F.sum("c").over(W.partitionBy()))
    at = lambda f: F.min(F.when(F.col("upto") > F.floor(F.col("all") * f), F.col("chars")))
    q0, q1, q2 = upto.agg(at(0.25), at(0.5), at(0.75)).first()
    band = F.when(F.col("chars") < F.lit(q0), "xs").when(F.col("chars") < F.lit(q1), "s").when(F.col("chars") < F.lit(q2), "m").otherwise("l")
    return sizes.groupBy(band.alias("band")).agg(F.count("*").alias("rules"), F.sum("chars").alias("chars"))


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Events of a user no more than thirty minutes apart."""
    w = F.session_window("ts", "30 minutes")
    rows = table(s, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rows.select("user_id", "n", F.col("first_ts").cast("timestamp_ntz"), F.col("last_ts").cast("timestamp_ntz"))


def hourly_log(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def newest_of_rule(s: SparkSession, d: str) -> DataFrame:
    """Documents of a rule that a later one of the same source supersedes."""
    rows = table(s, d, "documents").where("rule IS NOT NULL").select("doc_id", "rule", F.lower(F.trim("source")).alias("source"), "retrieved_at")
    newest = rows.groupBy("rule", "source").agg(F.max(F.struct("retrieved_at", "doc_id"))["doc_id"].alias("newest"), F.count("*").alias("n"))
    return newest.where("n > 1").select("rule", "source", "newest", (F.col("n") - 1).alias("superseded"))


def line_matches(s: SparkSession, d: str) -> DataFrame:
    """Lines that name a statute, by document: hits, and a score that saturates with their number."""
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    hits = lines.where(F.col("line").rlike(r"\b\d{1,4}[A-Z]{0,2}-\d{1,4}(?:\.\d+)?\b")).groupBy("doc_id").agg(F.count("*").alias("hits"))
    return hits.select("doc_id", "hits", F.round(F.col("hits") / (F.col("hits") + 1.5) + F.least("hits", F.lit(50)) * 1e-4, 6).alias("score"))


def page_of_line(s: SparkSession, d: str) -> DataFrame:
    """The page of each document's last line: that of the last anchor at or above it; null before the first."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))
    page = F.expr(r"try_cast(nullif(regexp_extract(line, r'<!-- page: (\d+) -->', 1), '') AS INT)")
    above = F.last(page, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("page", above).groupBy("doc_id").agg(F.max("n").cast("long").alias("last_line"), F.max(F.struct("n", "page"))["page"].alias("page"), F.countDistinct("page").alias("pages"))


def query_classes(s: SparkSession, d: str) -> DataFrame:
    """What questions, and the lines of documents as if they were asked, are looking for."""
    q = F.col("q")
    kind = (
        F.when(q.rlike(r'"[^"]{2,}"|“[^”]{2,}”'), "quoted")
        .when(q.rlike(r"(?i)\b\d{1,2}\s*U\.?\s*S\.?\s*C\.?\s*§?\s*\d{1,5}[a-z]?\b"), "usc")
        .when(q.rlike(r"(?i)\b\d{1,2}\s*C\.?\s*F\.?\s*R\.?\s*§?\s*\d{1,5}(?:\.\d+)?\b"), "cfr")
        .when(q.rlike(r"\b\d{1,4}[A-Z]{0,2}-\d{1,4}(?:\.\d+)?\b"), "statute")
        .when(q.rlike(r"\b[A-Z]{2,}[_\-]?\d{4,}(?:[_\-]\d+)*\b"), "bates")
        .otherwise("loose")
    )
    rows = table(s, d, "answers").select(F.lit("question").alias("origin"), F.coalesce("question", F.lit("")).alias("q")).unionByName(table(s, d, "documents").select(F.lit("line").alias("origin"), F.explode(F.split("text", r"\r\n|\n|\r")).alias("q")))
    return rows.groupBy("origin", kind.alias("kind")).agg(F.count("*").alias("n"))


def by_document(s: SparkSession, d: str) -> DataFrame:
    """The best hits of each query put together by document, in the order in which it first comes."""
    hits = R.bm25(R.query_terms(asked(s, d)), kb(s, d), 8).join(kb(s, d).select("id", "doc_id", "ordinal", "text"), "id")
    rows = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("first_rank"))
    return rows.select("query_id", "doc_id", place.alias("place"), F.md5("t").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, dehyphenated, page_quality, document_quality, answer_overlap, guessed_language, summaries, key_phrases, layout_signatures, xref_mentions, xref_edges, xref_inbound, graph_expand, citation_prefixes,
        citation_markers, refusal_flags, grounded_answers, answer_audit, provenance, stale_hashes, audit_chain, audit_chain_check, querylog_stats, latency_percentiles, facet_counts, twin_groups, chunk_stats, coverage,
        rule_reconcile, missing_vectors, latest_feedback, stratified_pick, representatives, size_bands, sessions, hourly_log, newest_of_rule, line_matches, page_of_line, query_classes, by_document,
    )
}

_WS = r"[ \t\n\r\f\x0B]"
_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\x{{0B}}\pZ]+|[\s\x{{0B}}\pZ]+$', '', 'g')"


def _clean_sql(c: str) -> str:
    for pattern, to in (
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "''"), (r"(?i)<br\s*/?>", "chr(10)"), (r"</?[a-zA-Z][^>]*>", "''"), (r"\x{A0}", "' '"), (r"\|+", "' '"), ("_+", "' '"), (r"[ \t]+", "' '"),
        (r"[ \t]+([.,;:)\]])", r"'\1'"), (r"([•·▪‣])[ \t]*\n+[ \t]*", r"'\1 '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "''"),
    ):
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return c


_GARBLED = r"""CASE WHEN length(t) < 40 THEN false WHEN length(regexp_replace(t, '[^\x{FFFD}]', '', 'g')) / length(t) > 0.02 THEN true
 WHEN length(t) > 200 AND sp < 0.02 THEN true WHEN le < 0.5 AND sp < 0.06 THEN true WHEN le < 0.2 THEN true
 WHEN len(w) > 0 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) > 18 THEN true WHEN len(w) >= 12 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) < 1.6 THEN true ELSE false END"""
_Q = rf"""WITH q0 AS (SELECT doc_id, lower(trim(source)) AS source, {_STRIP("coalesce(text, '')")} AS t FROM documents),
q1 AS (SELECT *, length(regexp_replace(t, '[^ ]', '', 'g')) / length(t) AS sp, length(regexp_replace(t, '[^\pL]', '', 'g')) / length(t) AS le, list_filter(regexp_extract_all(t, '[^\s\x{{0B}}|]+'), lambda x: regexp_matches(x, '[\pL\pN]')) AS w FROM q0),
q AS (SELECT *, {_GARBLED} AS g FROM q1)"""

_CITE2 = r"\bMCR\s+(\d+\.\d+[A-Za-z]?)((?:\s*\([A-Za-z0-9]{1,4}\))*)"
_BODY = r"""b0 AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY loaded_at DESC NULLS LAST, citation DESC NULLS LAST, rule DESC NULLS LAST, text DESC NULLS LAST, kind DESC NULLS LAST, deleted_at DESC NULLS LAST) AS rn FROM blocks WHERE block_id IS NOT NULL),
body AS (SELECT block_id, citation, regexp_replace(rule, '[^0-9.A-Za-z]|(?i:mcr|rule)', '', 'g') AS rule, coalesce(text, '') AS text FROM b0 WHERE rn = 1 AND kind = 'body' AND deleted_at IS NULL)"""
_MENTION = rf"""WITH {_BODY},
m0 AS (SELECT block_id, citation, rule, regexp_extract_all(text, '{_CITE2}', 1) AS rs, regexp_extract_all(text, '{_CITE2}', 2) AS gs, regexp_split_to_array(text, '{_CITE2}') AS bt FROM body),
m1 AS (SELECT block_id, citation, rule, rs, gs, bt, unnest(range(1, len(rs) + 1)) AS i FROM m0),
m AS (SELECT block_id, citation, rule, i, rs[i] AS cited_rule, regexp_replace(gs[i], '\s+', '', 'g') AS groups, right(bt[i], 90) AS before FROM m1)"""
_REL = "CASE " + " ".join(f"WHEN regexp_matches(before, '{p}') THEN '{n}'" for n, p, _ in C.RELATIONS) + " ELSE 'refers' END"
_FORCE = "CASE " + " ".join(f"WHEN relation = '{n}' THEN {f}" for n, _, f in C.RELATIONS) + f" ELSE {C.FORCE_REFERS} END"
_PREFIX = lambda r, g: rf"list_transform(range(0, len(regexp_extract_all({g}, '\([A-Za-z0-9]{{1,4}}\)')) + 1), lambda n: 'MCR ' || {r} || array_to_string(regexp_extract_all({g}, '\([A-Za-z0-9]{{1,4}}\)')[1:n], ''))"
_EDGES = rf"""{_MENTION},
v AS (SELECT DISTINCT citation FROM body WHERE citation IS NOT NULL),
e0 AS (SELECT *, unnest({_PREFIX("cited_rule", "groups")}) AS cand FROM m WHERE citation IS NOT NULL AND cited_rule IS DISTINCT FROM rule AND cited_rule IN (SELECT rule FROM body WHERE rule IS NOT NULL)),
e1 AS (SELECT e0.*, row_number() OVER (PARTITION BY block_id, i ORDER BY length(cand) DESC) AS k FROM e0 JOIN v ON v.citation = cand),
e2 AS (SELECT citation AS src, rule AS src_rule, cand AS dst, cited_rule AS dst_rule, {_REL} AS relation FROM e1 WHERE k = 1),
edges AS (SELECT src, dst, relation, min(src_rule) AS src_rule, min(dst_rule) AS dst_rule, min({_FORCE}) AS force FROM e2 GROUP BY src, dst, relation)"""
_CKEY = lambda c: rf"regexp_replace(regexp_replace({c}, '[\s\x{{85}}\x{{1c}}-\x{{1f}}\pZ]+', '', 'g'), '^(?i:mcr)', '')"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_PHRASES, _TERMS = _LIST(A.REFUSAL_PHRASES), _LIST(A.REFUSAL_TERMS)
_BYTERM = f"len(list_filter({_TERMS}, lambda p: contains(lower(coalesce(answer, '')), p))) > 0"
_LEAD = r"lower(regexp_extract(regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g'), '^((?s:.)*?(?:[.!?](?:\s|[A-Za-z]|$)|\n|$))', 1))"
_BYLEAD = rf"(len(list_filter({_PHRASES}, lambda p: contains({_LEAD}, p))) > 0 OR (len(list_filter({_PHRASES}, lambda p: contains(lower(coalesce(answer, '')), p))) > 0 AND NOT regexp_matches(lower(coalesce(answer, '')), '\[\d+')))"
_MARK = lambda most: rf"""flatten(list_transform(flatten(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d+(?:\s*[-\x{{2013}}\x{{2014}},]\s*\d+)*)\]', 1), lambda m: string_split(regexp_replace(m, '\s+', '', 'g'), ','))),
 lambda p: CASE WHEN regexp_matches(p, '[-\x{{2013}}\x{{2014}}]') AND TRY_CAST(regexp_extract(p, '[-\x{{2013}}\x{{2014}}](\d+)$', 1) AS BIGINT) > TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT)
  THEN range(TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT), least(TRY_CAST(regexp_extract(p, '(\d+)$', 1) AS BIGINT), TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT) + {most} - 1) + 1) ELSE [TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT)] END))"""  # noqa: E731
_LINES = r"regexp_split_to_array(text, '\r\n|\n|\r')"
_SRC = "lower(trim(source))"
_TOKS = lambda c: _KB.split("list_concat(", 1)[1].split(", list_concat", 1)[0].replace("text", c, 1)

ORACLE = {
    "clean_text": f"SELECT doc_id, length(c) AS n_chars, md5(c) AS hash FROM (SELECT doc_id, {_clean_sql('''coalesce(text, '')''')} AS c FROM documents)",
    "dehyphenated": r"WITH n AS (SELECT doc_id, regexp_replace(text, '([a-z]{4})([a-z]{4})', '\1-' || chr(10) || '\2', 'g') AS n FROM documents) SELECT doc_id, md5(c) AS hash FROM (SELECT doc_id, n, regexp_replace(n, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g') AS c FROM n) WHERE n <> c",
    "page_quality": _Q + " SELECT doc_id, length(t) AS chars, array_to_string(list_filter([CASE WHEN length(t) < 1 THEN 'empty_page' END, CASE WHEN g THEN 'garbled_text' END], lambda x: x IS NOT NULL), ',') AS reasons FROM q",
    "document_quality": _Q + " SELECT source, count(*) AS n, count(*) FILTER (WHERE g) AS flagged, round(1 - count(*) FILTER (WHERE g) / count(*), 4) AS score, CASE WHEN count(*) FILTER (WHERE g) = 0 THEN 'clean' WHEN count(*) FILTER (WHERE g) = count(*) THEN 'rejected' ELSE 'partial' END AS status FROM q GROUP BY source",
    "answer_overlap": "SELECT DISTINCT answer_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM (SELECT answer_id, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[0-9a-z]+')) AS x, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[0-9a-z]+')) AS y FROM answers)",
    "guessed_language": f"SELECT CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: list_contains({'[' + ', '.join(repr(x) for x in sorted(set(T.STOPWORDS))) + ']'}, x))) / len(w) >= 0.12 THEN 'en' ELSE 'unknown' END AS guess, lower(coalesce(lang, 'none')) AS lang, count(*) AS n FROM (SELECT lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents) GROUP BY ALL",
    "summaries": rf"SELECT doc_id, substr(coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda p: {_STRIP('p')}), lambda p: p <> '' AND NOT starts_with(p, '#') AND NOT starts_with(p, '|'))[1], ''), 1, 320) AS summary FROM documents",
    "key_phrases": f"""WITH r AS (SELECT {_SRC} AS source, {_TOKS("text")} AS w FROM documents),
u AS (SELECT source, unnest(w) AS phrase, 0 AS more FROM r UNION ALL SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 1 FROM r WHERE len(w) > 1),
n AS (SELECT source, phrase, count(*) + max(more) AS n, count(*) AS c FROM u GROUP BY ALL)
SELECT source, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, phrase) AS rank FROM n WHERE c > 1) WHERE rank <= 12""",
    "layout_signatures": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: {_STRIP("x")}), lambda x: x <> '') AS l FROM documents), k AS (SELECT *, greatest(len(l), 1) AS n FROM l)
SELECT doc_id, round(len(list_filter(l, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z ]{{1,40}}:\s*\S'))) / n, 4) AS field_density, round(len(list_filter(l, lambda x: regexp_matches(x, '\[[ xX]\]'))) / n, 4) AS checkbox_density,
 round(len(list_filter(l, lambda x: regexp_matches(x, '^\|?[ :|-]*-{{3,}}[ :|-]*$'))) / n, 4) AS table_density, round(least(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) / n / 120.0, 1.0), 4) AS avg_line_len,
 round(len(list_filter(l, lambda x: length(x) <= 40)) / n, 4) AS short_line_ratio, round(len(list_filter(l, lambda x: length(x) > 3 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[^\x00-\x7F]') AND upper(x) = x)) / n, 4) AS allcaps_ratio FROM k""",
    "xref_mentions": f"{_MENTION}, r AS (SELECT cited_rule, {_REL} AS relation FROM m) SELECT cited_rule, relation, {_FORCE} AS force, count(*) AS n FROM r GROUP BY ALL",
    "xref_edges": f"{_EDGES} SELECT * FROM edges",
    "xref_inbound": f"{_MENTION} SELECT cited_rule AS rule, count(*) AS inbound, count(DISTINCT rule) AS from_rules FROM m WHERE cited_rule IS DISTINCT FROM rule GROUP BY cited_rule",
    "graph_expand": rf"""{_EDGES}, shown AS (SELECT DISTINCT answer_id AS query_id, citation, regexp_extract(citation, '(\d+\.\d+[A-Za-z]?)', 1) AS rule FROM answer_citations WHERE citation IS NOT NULL),
u AS (SELECT s.query_id, e.dst AS citation, e.dst_rule AS rule, e.force::DOUBLE AS force, 'out' AS way FROM shown s JOIN edges e ON e.src = s.citation AND e.relation <> 'refers'
 UNION ALL SELECT s.query_id, e.src, e.src_rule, e.force - 0.5, 'in' FROM (SELECT DISTINCT query_id, rule FROM shown) s JOIN edges e ON e.dst_rule = s.rule AND e.relation IN ('overrides', 'excepts')),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, citation ORDER BY force, way) AS b FROM u WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.query_id = u.query_id AND s.citation = u.citation))
SELECT * FROM (SELECT query_id, citation, rule, force, way, row_number() OVER (PARTITION BY query_id ORDER BY force, citation) AS rank FROM b WHERE b = 1) WHERE rank <= 3""",
    "citation_prefixes": rf"""WITH {_BODY}, v AS (SELECT DISTINCT citation FROM body WHERE citation IS NOT NULL), c AS (SELECT DISTINCT citation FROM answer_citations WHERE citation IS NOT NULL),
x0 AS (SELECT citation, regexp_extract_all(citation, '{_CITE2}', 1) AS rs, regexp_extract_all(citation, '{_CITE2}', 2) AS gs FROM c), x1 AS (SELECT citation, rs, gs, unnest(range(1, len(rs) + 1)) AS i FROM x0),
x2 AS (SELECT citation, i, rs[i] AS r, regexp_replace(gs[i], '\s+', '', 'g') AS g FROM x1), x3 AS (SELECT citation, i, unnest({_PREFIX("r", "g")}) AS cand FROM x2)
SELECT citation, target FROM (SELECT x3.citation, cand AS target, row_number() OVER (PARTITION BY x3.citation, i ORDER BY length(cand) DESC) AS k FROM x3 JOIN v ON v.citation = cand) WHERE k = 1""",
    "citation_markers": f"SELECT DISTINCT answer_id, array_to_string(n, ',') AS markers, len(n) AS n FROM (SELECT answer_id, {_MARK(6)} AS n FROM answers WHERE answer IS NOT NULL)",
    "refusal_flags": f"SELECT regexp_matches(coalesce(answer, ''), '{A.NO_ANSWER}') AS by_pattern, {_BYLEAD} AS by_lead, {_BYTERM} AS by_term, coalesce(refused, false) AS refused, count(*) AS n FROM answers GROUP BY ALL",
    "grounded_answers": f"SELECT DISTINCT a.answer_id, coalesce(k, 0)::INT AS k, len(list_filter({_MARK(50)}, lambda n: n >= 1 AND n <= coalesce(k, 0))) > 0 AND NOT {_BYLEAD} AS grounded FROM (SELECT DISTINCT answer_id, answer FROM answers) a LEFT JOIN (SELECT answer_id, count(DISTINCT chunk_id) AS k FROM answer_passages WHERE chunk_id IS NOT NULL GROUP BY 1) p USING (answer_id)",
    "answer_audit": f"""WITH said AS (SELECT DISTINCT answer_id, {_CKEY("citation")} AS c FROM answer_citations WHERE citation IS NOT NULL AND answer_id IS NOT NULL), have AS (SELECT DISTINCT {_CKEY("citation")} AS c FROM blocks WHERE citation IS NOT NULL),
listed AS (SELECT DISTINCT chunk_id, {_CKEY("x")} AS c FROM (SELECT chunk_id, unnest(citations) AS x FROM chunks WHERE chunk_id IS NOT NULL) WHERE x IS NOT NULL),
r AS (SELECT said.answer_id, said.c, said.c IN (SELECT c FROM have) AS e, EXISTS (SELECT 1 FROM answer_passages p JOIN listed l USING (chunk_id) WHERE p.answer_id = said.answer_id AND l.c = said.c) AS g FROM said)
SELECT answer_id, count(*) AS n_citations, count(*) FILTER (WHERE e) AS n_exist, count(*) FILTER (WHERE g) AS n_retrieved, bool_and(e) AS all_exist, bool_and(g) AS all_retrieved FROM r GROUP BY answer_id""",
    "provenance": """WITH c0 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, run_id DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL), c AS (SELECT chunk_id, run_id, unnest(block_ids) AS block_id FROM c0 WHERE rn = 1)
SELECT r.run_id, r.source_id, count(*) AS n_links, count(DISTINCT a.answer_id) AS n_answers, count(DISTINCT b.block_id) AS n_blocks FROM (SELECT DISTINCT answer_id FROM answers WHERE answer_id IS NOT NULL) a JOIN (SELECT DISTINCT answer_id, chunk_id FROM answer_passages) p USING (answer_id)
 JOIN c USING (chunk_id) JOIN (SELECT DISTINCT block_id FROM blocks) b USING (block_id) JOIN parse_runs r ON r.run_id = c.run_id GROUP BY ALL""",
    "stale_hashes": "SELECT DISTINCT chunk_id, sha256 AS stored, left(sha256(coalesce(embed_text, '')), 16) AS fresh FROM chunks WHERE chunk_id IS NOT NULL AND sha256 IS DISTINCT FROM left(sha256(coalesce(embed_text, '')), 16)",
    "audit_chain": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id || '|' || event_type AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, sha256(body) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, sha256(c.hash || e.body) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1) SELECT user_id, event_id AS seq, hash FROM c""",
    "audit_chain_check": "SELECT user_id, CASE WHEN user_id % 7 = 0 THEN max(event_id) FILTER (WHERE n = 3) END AS first_bad FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY user_id",
    "querylog_stats": "SELECT coalesce(generator, 'unknown') AS generator, count(*) AS answers, count(*) FILTER (WHERE refused) AS refusals, count(*) FILTER (WHERE latency_ms IS NULL) AS untimed, round(avg(latency_ms), 4) AS mean_ms FROM answers GROUP BY 1",
    "latency_percentiles": "WITH s AS (SELECT coalesce(generator, 'unknown') AS generator, list_sort(list(latency_ms)) AS l FROM answers WHERE latency_ms IS NOT NULL GROUP BY 1) SELECT generator, len(l) AS n, l[floor(len(l) * 0.5)::INT + 1] AS p50, l[floor(len(l) * 0.9)::INT + 1] AS p90, l[floor(len(l) * 0.95)::INT + 1] AS p95, l[len(l)] AS max FROM s",
    "facet_counts": f"WITH n AS (SELECT coalesce({_SRC}, 'none') AS facet, count(*) AS n FROM documents GROUP BY 1) SELECT facet, n, (n * 100 // (SELECT sum(n) FROM n))::BIGINT AS share FROM n",
    "twin_groups": rf"SELECT sha256(text) AS hash, count(DISTINCT chunk_id) AS n, min(chunk_id) AS first_id FROM chunks WHERE chunk_id IS NOT NULL AND len(regexp_split_to_array({_STRIP('text')}, '{_WS}+')) > 8 GROUP BY 1 HAVING count(DISTINCT chunk_id) > 1",
    "chunk_stats": rf"WITH c0 AS (SELECT text, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL), s AS (SELECT list_sort(list(floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')) * 1.32)::BIGINT + 1)) AS l FROM c0 WHERE rn = 1) SELECT len(l) AS chunks, l[1] AS least, l[len(l) // 2 + 1] AS median, l[floor(len(l) * 0.9)::INT + 1] AS p90, l[len(l)] AS most FROM s",
    "coverage": "SELECT chapter, count(*) AS citations, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(citations) AS c FROM chunks) x WHERE x.c = b.citation)) AS unlisted FROM (SELECT DISTINCT chapter, citation FROM blocks WHERE kind = 'body' AND citation IS NOT NULL) b GROUP BY chapter",
    "rule_reconcile": "WITH b AS (SELECT regexp_replace(rule, '[^0-9.]', '', 'g') AS r, count(*) AS n FROM blocks WHERE rule IS NOT NULL GROUP BY 1), c AS (SELECT regexp_replace(rule, '[^0-9.]', '', 'g') AS r, count(*) AS n FROM chunks WHERE rule IS NOT NULL GROUP BY 1) SELECT 'both' AS finding, count(*) AS rules, sum(b.n)::BIGINT AS blocks, sum(c.n)::BIGINT AS chunks FROM b JOIN c USING (r) HAVING count(*) > 0 UNION ALL SELECT 'blocks_only', count(*), sum(n)::BIGINT, 0 FROM b WHERE r NOT IN (SELECT r FROM c) HAVING count(*) > 0 UNION ALL SELECT 'chunks_only', count(*), 0, sum(n)::BIGINT FROM c WHERE r NOT IN (SELECT r FROM b) HAVING count(*) > 0",
    "missing_vectors": "WITH h AS (SELECT DISTINCT chunk_id FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT run_id, count(*) AS n, count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM h WHERE chunk_id IS NOT NULL)) AS missing FROM (SELECT DISTINCT chunk_id, coalesce(run_id, 'none') AS run_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY run_id",
    "latest_feedback": "SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "stratified_pick": f"SELECT source, doc_id, turn FROM (SELECT {_SRC} AS source, doc_id, row_number() OVER (PARTITION BY {_SRC} ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source NULLS FIRST LIMIT 200",
    "representatives": rf"SELECT rule, block_id, depth FROM (SELECT rule, block_id, depth, row_number() OVER (PARTITION BY rule ORDER BY CASE WHEN depth BETWEEN 1 AND 3 THEN 0 ELSE 1 END, least(len(regexp_split_to_array({_STRIP('''coalesce(text, '')''')}, '{_WS}+')), 120) DESC, block_id) AS r FROM blocks WHERE kind = 'body' AND rule IS NOT NULL AND block_id IS NOT NULL AND deleted_at IS NULL) WHERE r = 1",
    "size_bands": "WITH s AS (SELECT rule, sum(length(coalesce(text, '')))::BIGINT AS chars FROM blocks WHERE rule IS NOT NULL GROUP BY rule), l AS (SELECT list_sort(list(chars)) AS l FROM s), q AS (SELECT l[floor(len(l) * 0.25)::INT + 1] AS a, l[floor(len(l) * 0.5)::INT + 1] AS b, l[floor(len(l) * 0.75)::INT + 1] AS c FROM l) SELECT CASE WHEN chars < a THEN 'xs' WHEN chars < b THEN 's' WHEN chars < c THEN 'm' ELSE 'l' END AS band, count(*) AS rules, sum(chars)::BIGINT AS chars FROM s, q GROUP BY 1",
    "sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY user_id, k",
    "hourly_log": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "newest_of_rule": f"SELECT rule, source, arg_max(doc_id, (retrieved_at, doc_id)) AS newest, count(*) - 1 AS superseded FROM (SELECT doc_id, rule, {_SRC} AS source, coalesce(retrieved_at, TIMESTAMP '1900-01-01') AS retrieved_at FROM documents WHERE rule IS NOT NULL) GROUP BY rule, source HAVING count(*) > 1",
    "line_matches": rf"SELECT doc_id, count(*) AS hits, round(count(*) / (count(*) + 1.5) + least(count(*), 50) * 1e-4, 6) AS score FROM (SELECT doc_id, unnest({_LINES}) AS line FROM documents) WHERE regexp_matches(line, '\b\d{{1,4}}[A-Z]{{0,2}}-\d{{1,4}}(?:\.\d+)?\b') GROUP BY doc_id",
    "page_of_line": rf"SELECT doc_id, len({_LINES}) - 1 AS last_line, TRY_CAST(p[len(p)] AS INT) AS page, len(list_distinct(p)) AS pages FROM (SELECT doc_id, text, regexp_extract_all(text, '<!-- page: (\d+) -->', 1) AS p FROM documents WHERE text IS NOT NULL)",
    "query_classes": r"""SELECT CASE WHEN regexp_matches(q, '"[^"]{2,}"|“[^”]{2,}”') THEN 'quoted' WHEN regexp_matches(q, '(?i)\b\d{1,2}\s*U\.?\s*S\.?\s*C\.?\s*§?\s*\d{1,5}[a-z]?\b') THEN 'usc' WHEN regexp_matches(q, '(?i)\b\d{1,2}\s*C\.?\s*F\.?\s*R\.?\s*§?\s*\d{1,5}(?:\.\d+)?\b') THEN 'cfr'
 WHEN regexp_matches(q, '\b\d{1,4}[A-Z]{0,2}-\d{1,4}(?:\.\d+)?\b') THEN 'statute' WHEN regexp_matches(q, '\b[A-Z]{2,}[_\-]?\d{4,}(?:[_\-]\d+)*\b') THEN 'bates' ELSE 'loose' END AS kind, origin, count(*) AS n FROM (SELECT 'question' AS origin, coalesce(question, '') AS q FROM answers UNION ALL SELECT 'line', unnest(regexp_split_to_array(text, '\r\n|\n|\r')) FROM documents) GROUP BY ALL""",
    "by_document": f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb", 8)}, g AS (SELECT query_id, doc_id, min(rank) AS first_rank, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS t FROM b JOIN kb USING (id) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS place, md5(t) AS hash FROM g""",
}
