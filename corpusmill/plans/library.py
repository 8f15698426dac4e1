"""Queries on documents, rules, answers and their evaluation, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.functions import dates as D
from corpusmill.functions import passages as P
from corpusmill.functions import text as T
from corpusmill.operators import audit as A
from corpusmill.operators import documents as O
from corpusmill.operators import retrieval as R
from corpusmill.operators import structure as Q
from corpusmill.operators.references import citation_key
from corpusmill.plans.corpus import _BODY, _BYLEAD, _CKEY, _clean_sql, _Q, _STRIP
from corpusmill.plans.corpus import _body as latest_body
from corpusmill.plans.retrieval import _KB, _bm25_sql, _toks, asked, kb
from corpusmill.sources.tables import table

TODAY = "2025-06-01"

# kinds of documents, facets and titles: own lists
SIGNALS = [
    ("bulletin", r"(?i)\bbulletin\b", 2.0), ("bulletin", r"(?im)^\s*(to|from|date|re):", 1.0), ("statute", r"§\s*\d", 3.0), ("statute", r"(?m)^\([a-z]\)", 1.0), ("manual", r"(?m)^#{1,3}\s", 2.0),
    ("manual", r"(?i)\b(manual|handbook)\b", 2.0), ("questions", r"(?m)^\s*(Q|Question)[:.]", 3.0), ("questions", r"\?\s*$", 0.5), ("notice", r"(?i)\bnotice\b", 1.0), ("notice", r"(?i)\bhearing\b", 0.5),
    ("order", r"(?i)\bordered\b|\border of\b", 1.5), ("form", r"\[[ xX]\]", 3.0), ("form", r"_{5,}", 2.0),
]
TOPICS = [("placement", r"(?i)\bplacement\b"), ("appeals", r"(?i)\bappeal"), ("hearings", r"(?i)\bhearing\b"), ("records", r"(?i)\brecord"), ("fees", r"(?i)\bfee\b|\bbond\b")]
AUDIENCES = [("counsel", r"(?i)\bcounsel\b|\battorney"), ("clerks", r"(?i)\bclerk\b"), ("parents", r"(?i)\bparent"), ("staff", r"(?i)\bcaseworker\b|\bsupervisor\b")]
TEMPLATES = ("What does {} require?", "When does {} apply?", "Who must act under {}?", "Are there exceptions to {}?")


def _docs(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", *columns)


def document_kinds(s: SparkSession, d: str) -> DataFrame:
    return O.kinds(_docs(s, d).where("text IS NOT NULL"), SIGNALS).withColumnRenamed("id", "doc_id")


def document_facets(s: SparkSession, d: str) -> DataFrame:
    """How many documents each pair of topic and audience has."""
    c = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").groupBy(O.first_keyword(c, TOPICS, "general").alias("topic"), O.first_keyword(c, AUDIENCES, "all").alias("audience")).agg(F.count("*").alias("n"))


def document_metadata(s: SparkSession, d: str) -> DataFrame:
    """Headings, words, table rows, links, minutes to read, title and section of each document."""
    c = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    first = F.regexp_extract(c, r"(?m)^#{1,6} +(.+)$", 1)
    return table(s, d, "documents").select(
        "doc_id", F.regexp_count(c, F.lit(r"(?m)^#{1,6} ")).cast("long").alias("headings"), words.cast("long").alias("words"), F.regexp_count(c, F.lit(r"(?m)^\|")).cast("long").alias("table_rows"),
        F.regexp_count(c, F.lit(r"\]\(|https?://")).cast("long").alias("links"), F.round(words / 200, 1).alias("minutes"), T.strip(first).alias("title"), F.regexp_extract(c, r"§ *(\d+-\d+)", 1).alias("section"),
    )


def page_routes(s: SparkSession, d: str) -> DataFrame:
    """By what a document's text is best read: OCR where it is short or broken, a picture model where it is tables, else as it is."""
    t = T.strip(F.coalesce("text", F.lit("")))
    route = F.when(F.length(t) < 20, "ocr").when(T.looks_garbled(F.col("text")), "ocr").when(F.regexp_count(t, F.lit(r"\|")) > 20, "vlm").otherwise("native")
    return table(s, d, "documents").groupBy(F.lower(F.trim("source")).alias("source"), route.alias("route")).agg(F.count("*").alias("n"))


def distinctive_terms(s: SparkSession, d: str) -> DataFrame:
    return O.distinctive_terms(_docs(s, d)).select(F.col("id").alias("doc_id"), "term", "score", "rank")


def hashed_vectors(s: SparkSession, d: str) -> DataFrame:
    return O.hashed_vectors(kb(s, d)).select(F.col("id").alias("chunk_id"), "bucket", "value")


def promoted_sections(s: SparkSession, d: str, least: int = 1) -> DataFrame:
    """Documents of `least` section lines and more, with each of these made a heading. (The texts here have one each.)"""
    lines = F.split("text", r"\r\n|\n|\r")
    n = F.size(F.filter(lines, lambda x: x.rlike(r"^§ *\d")))
    made = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^§ *\d"), F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    return table(s, d, "documents").where(n >= least).select("doc_id", n.cast("long").alias("sections"), F.md5(made).alias("hash"))


def statutes_named(s: SparkSession, d: str) -> DataFrame:
    """The sections each document names, distinct and sorted."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"§ *(\d+-\d+)"), F.lit(1))))
    return table(s, d, "documents").where(F.size(found) > 0).select("doc_id", F.array_join(found, ",").alias("sections"))


def date_keys(s: SparkSession, d: str) -> DataFrame:
    """Dates written in five ways, read back as (y, m, d)."""
    at = F.col("retrieved_at")
    forms = F.array(F.date_format(at, "'on 'yyyy-MM-dd"), F.date_format(at, "M/d/yyyy"), F.date_format(at, "M-d-yy"), F.date_format(at, "'Rev. 'MM/yyyy"), F.date_format(at, "'edition of 'yyyy"))
    rows = table(s, d, "documents").where(at.isNotNull()).select("doc_id", D.date_key(F.get(forms, (F.col("doc_id") % 5).cast("int"))).alias("k"))
    return rows.select("doc_id", "k.y", "k.m", "k.d")


def document_currency(s: SparkSession, d: str) -> DataFrame:
    """What is to be said of each document of a rule: superseded, or not checked for long; statutes are exempt."""
    rows = table(s, d, "documents").where("rule IS NOT NULL AND retrieved_at IS NOT NULL").select("doc_id", "rule", F.lower(F.trim("source")).alias("source"), "retrieved_at")
    newest = rows.groupBy(F.col("rule").alias("r"), F.col("source").alias("s")).agg(F.max(F.struct("retrieved_at", "doc_id"))["doc_id"].alias("newest"))
    both = rows.join(newest, (F.col("rule") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    other = F.when(F.col("newest") != F.col("doc_id"), F.col("newest"))
    exempt = F.coalesce(F.col("source").contains("statute"), F.lit(False))
    return both.select("doc_id", D.currency_note(F.col("retrieved_at"), F.lit(TODAY).cast("date"), other, exempt).alias("note")).where("note <> ''")


def split_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of texts cut at rules of dashes."""
    pages = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\n---+\n")).alias("page", "t"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max(F.length("t")).cast("long").alias("longest"))


def repeated_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences of each document, and how many of them only repeat the one before."""
    kept = P.once_in_a_row(F.col("text"))
    every = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")
    return table(s, d, "documents").select("doc_id", F.size(every).cast("long").alias("sentences"), (F.size(every) - F.size(kept)).cast("long").alias("dropped"))


def clipped(s: SparkSession, d: str) -> DataFrame:
    c = P.clip(F.col("text"), 240)
    return kb(s, d).where("text IS NOT NULL").select(F.col("id").alias("chunk_id"), F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("hash"))


def citation_texts(s: SparkSession, d: str) -> DataFrame:
    """Where a passage is found: headings and pages."""
    rows = R.latest(table(s, d, "kb_chunks"), "chunk_id", "loaded_at", "text", "heading_path", "page_start", "page_end")
    path = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " › ")
    return rows.select("chunk_id", F.concat_ws(" — ", F.nullif(path, F.lit("")), P.page_span(F.col("page_start"), F.col("page_end"))).alias("where_found"))


def anchored_chunks(s: SparkSession, d: str) -> DataFrame:
    """Passages under the anchor of their first page; pages that hold nothing have none."""
    rows = R.latest(table(s, d, "kb_chunks"), "chunk_id", "loaded_at", "text", "page_start")
    some = T.strip(F.coalesce("text", F.lit(""))) != ""
    return rows.select("chunk_id", F.md5(F.when(some, F.concat(F.lit("<!-- page: "), F.coalesce(F.col("page_start"), F.lit(0)).cast("string"), F.lit(" -->\n\n"), F.col("text"))).otherwise("")).alias("hash"))


def augmented_chunks(s: SparkSession, d: str) -> DataFrame:
    """Passages with their headings, and the rules they name, put before the text, which stays as it is."""
    rows = kb(s, d).where("text IS NOT NULL").select("id", "text", "heading")
    named = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(MCR \d+\.\d+)"), F.lit(1)))).alias("r")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("r")), ", ").alias("rules"))
    both = rows.join(named, "id", "left")
    head = F.concat_ws("\n", F.nullif("heading", F.lit("")), "rules")
    return both.select(F.col("id").alias("chunk_id"), F.md5(F.when(head == "", F.col("text")).otherwise(F.concat(head, F.lit("\n\n"), F.col("text")))).alias("hash"))


def numbered_prompts(s: SparkSession, d: str) -> DataFrame:
    """The five best passages of each query, numbered and clipped, as one text."""
    hits = R.bm25(R.query_terms(asked(s, d)), kb(s, d), 5).join(kb(s, d).select("id", "text"), "id")
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), P.clip(F.coalesce("text", F.lit("")), 1400))
    rows = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("t"))
    return rows.select("query_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("hash"))


def windowed_sources(s: SparkSession, d: str) -> DataFrame:
    """Each query's best passages with their neighbours; a passage that several windows hold is the first one's."""
    hits = R.bm25(R.query_terms(asked(s, d)), kb(s, d), 5).select("query_id", "id", "rank")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal", "id"))
    rows = kb(s, d).where("doc_id IS NOT NULL").select("id", "doc_id", place.alias("place"))
    around = hits.join(rows, "id").select("query_id", "rank", "doc_id", F.explode(F.sequence(F.col("place") - 1, F.col("place") + 1)).alias("place"))
    first = around.join(rows, ["doc_id", "place"]).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id", "rank").agg(F.count("*").alias("passages"), F.min("id").alias("first_id"))


def query_echo(s: SparkSession, d: str) -> DataFrame:
    """How much of an evaluation query its passage gives away, and what is to be done with it."""
    e = P.echo(F.col("query_text"), F.col("gold_text"), tuple(T.STOPWORDS))
    verdict = F.when(F.col("status") == "rejected", "reject").when(F.col("echo") >= 0.55, "revise").otherwise("keep")
    return table(s, d, "eval_queries").select("query_id", "status", F.round(e, 6).alias("echo")).select("query_id", "echo", verdict.alias("verdict"))


def frozen_set(s: SparkSession, d: str) -> DataFrame:
    """The digest of the evaluation set, whatever the order of its rows."""
    line = F.concat_ws("\x1f", "query_id", F.coalesce("arm", F.lit("")), "query_text", "gold_text")
    return table(s, d, "eval_queries").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def templated_queries(s: SparkSession, d: str) -> DataFrame:
    """A question on each rule, the templates taking turns."""
    rules = latest_body(s, d).where("rule IS NOT NULL AND rule <> ''").select("rule").distinct()
    # the turn comes from the rule itself, so that no window runs over all rules
    turn = (F.conv(F.substring(F.md5("rule"), 1, 8), 16, 10).cast("long") % len(TEMPLATES)).cast("int")
    return rules.select("rule", F.regexp_replace(F.get(F.array(*[F.lit(t) for t in TEMPLATES]), turn), r"\{\}", F.concat(F.lit("MCR "), F.col("rule"))).alias("question"))


def reasoning_stripped(s: SparkSession, d: str) -> DataFrame:
    """Answers with thoughts put before them, closed and not, and taken off again."""
    rows = table(s, d, "answers").where("answer RLIKE '[A-Za-z0-9]' AND NOT answer ILIKE '%think>%'").select("answer_id", "answer").distinct()
    kind = F.conv(F.substring(F.md5("answer_id"), 1, 8), 16, 10).cast("long") % 3
    said = F.when(kind == 0, F.concat(F.lit("<think>first\nthis</think>\n"), F.col("answer"))).when(kind == 1, F.concat(F.lit("<think>never closed. Final answer: "), F.col("answer"))).otherwise(F.col("answer"))
    return rows.select("answer_id", F.md5(F.trim(P.without_reasoning(said))).alias("hash")).distinct()


def answer_rates(s: SparkSession, d: str) -> DataFrame:
    """By generator: how many answers are refused, and of the rest how many cite, and of these how many cite well."""
    rows = R.latest(table(s, d, "answers"), "answer_id", "recorded_at", "generator", "answer", "question")
    cited = A.citation_audit(*(table(s, d, t) for t in ("answer_citations", "blocks", "answer_passages", "chunks")), citation_key)
    both = rows.join(cited.select("answer_id", "all_exist"), "answer_id", "left").withColumn("refused", A.refusal_by_lead(F.col("answer")))
    rate = lambda c: F.round(F.avg(c), 6)
    return both.groupBy(F.coalesce("generator", F.lit("unknown")).alias("generator")).agg(
        F.count("*").alias("n"), rate(F.col("refused").cast("int")).alias("refused"), rate(F.when(~F.col("refused"), F.col("all_exist").isNotNull().cast("int"))).alias("cites"), rate(F.when(~F.col("refused"), F.col("all_exist").cast("int"))).alias("exist"),
    )


def answer_percents(s: SparkSession, d: str) -> DataFrame:
    """Whole percents by run: answers that cite a passage, and those that refuse."""
    rows = R.latest(table(s, d, "answers"), "answer_id", "recorded_at", "run_id", "answer")
    pct = lambda c: F.expr(f"count_if({c}) * 100 DIV count(*)")
    named = rows.select(F.coalesce("run_id", F.lit("none")).alias("run_id"), A.refusal_by_lead(F.col("answer")).alias("r"), F.coalesce("answer", F.lit("")).rlike(r"\[\d+").alias("c"))
    return named.groupBy("run_id").agg(F.count("*").alias("n"), pct("c").alias("cited"), pct("r").alias("refused"))


def answer_records(s: SparkSession, d: str) -> DataFrame:
    """One record of each answer: refused, citations, which of them are there and were retrieved, and how long it took."""
    rows = R.latest(table(s, d, "answers"), "answer_id", "recorded_at", "answer", "latency_ms")
    cited = A.citation_audit(*(table(s, d, t) for t in ("answer_citations", "blocks", "answer_passages", "chunks")), citation_key)
    share = lambda c: F.round(F.col(c) / F.col("n_citations"), 6)
    return rows.join(cited, "answer_id", "left").select("answer_id", "latency_ms", A.refusal_by_lead(F.col("answer")).alias("refused"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"), share("n_exist").alias("valid"), share("n_retrieved").alias("grounded"))


def passage_positions(s: SparkSession, d: str) -> DataFrame:
    """Of each answer's passages 1 - position / number, the best scored first."""
    rows = table(s, d, "answer_passages").where("answer_id IS NOT NULL AND chunk_id IS NOT NULL").groupBy("answer_id", "chunk_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("answer_id")
    position = F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "chunk_id")) - 1
    return rows.select("answer_id", "chunk_id", F.round(1 - position / F.count("*").over(w), 6).alias("position_score"))


def citation_siblings(s: SparkSession, d: str) -> DataFrame:
    """Of each citation that answers name and blocks have, the other citations of its rule."""
    body = latest_body(s, d).where("citation IS NOT NULL AND rule IS NOT NULL").select(citation_key(F.col("citation")).alias("c"), "rule").distinct()
    sizes = body.groupBy("rule").agg(F.countDistinct("c").alias("n"))
    said = table(s, d, "answer_citations").where("citation IS NOT NULL").select(citation_key(F.col("citation")).alias("c")).distinct()
    return said.join(body, "c").join(sizes, "rule").groupBy("c").agg(F.sum(F.col("n") - 1).alias("siblings")).withColumnRenamed("c", "citation")


def carried_headings(s: SparkSession, d: str) -> DataFrame:
    """The chapter and the rule that each block stands under: the last headings before it; a new chapter ends its rules."""
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "chapter", "text")
    w = W.partitionBy("chapter").orderBy("block_id").rowsBetween(W.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("kind") == "chapter", 1).otherwise(0)).over(w)
    within = W.partitionBy("chapter", "opened").orderBy("block_id").rowsBetween(W.unboundedPreceding, 0)
    last = lambda k: F.md5(F.last(F.when(F.col("kind") == k, F.coalesce("text", F.lit(""))), ignorenulls=True).over(within))
    return rows.withColumn("opened", opened).select("block_id", last("chapter").alias("chapter_heading"), last("rule").alias("rule_heading"))


def verbatim_islands(s: SparkSession, d: str) -> DataFrame:
    """Runs of blocks without a marker in a rule; one that is off the ladder (deeper than three, or of no depth) makes its whole run verbatim."""
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "rule", "marker", "depth", "deleted_at").where("kind = 'body' AND deleted_at IS NULL AND rule IS NOT NULL")
    island = F.sum(F.when(F.col("marker").isNotNull(), 1).otherwise(0)).over(W.partitionBy("rule").orderBy("block_id").rowsBetween(W.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).where("marker IS NULL")
    return runs.groupBy("rule", "island").agg(F.count("*").alias("n"), F.min("block_id").alias("first_block"), F.coalesce(F.bool_or((F.col("depth") > 3) | F.col("depth").isNull()), F.lit(False)).alias("verbatim"))


def rendered_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks as Markdown: headings by kind, provisions set in by depth."""
    rows = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "depth", "text")
    c = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n{3,}", "\n\n")
    body = F.concat(F.repeat(F.lit(" "), 4 * F.greatest(F.coalesce("depth", F.lit(0)) - 1, F.lit(0))), c)
    return rows.select("block_id", F.md5(F.when(F.col("kind") == "chapter", F.concat(F.lit("# "), c)).when(F.col("kind") == "rule", F.concat(F.lit("### "), c)).otherwise(body)).alias("hash"))


def blocks_with_stems(s: SparkSession, d: str) -> DataFrame:
    """Provisions under their citation and the text of the one above them."""
    rows = latest_body(s, d).where("citation IS NOT NULL").groupBy("citation").agg(F.min(F.struct("block_id", "text"))["text"].alias("text"))
    above = rows.select(F.col("citation").alias("parent"), F.col("text").alias("stem"))
    both = rows.withColumn("parent", F.regexp_replace("citation", r"\([^)]*\)$", "")).join(above.where("stem IS NOT NULL"), "parent", "left")
    stem = F.when(F.col("parent") != F.col("citation"), F.col("stem"))
    return both.select("citation", F.md5(F.concat_ws("\n", F.col("citation"), stem, F.coalesce("text", F.lit("")))).alias("hash"), stem.isNotNull().alias("has_stem"))


def whole_rules(s: SparkSession, d: str) -> DataFrame:
    """Chunks of one rule each."""
    return latest_body(s, d).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n_blocks"), F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))


def contents_check(s: SparkSession, d: str) -> DataFrame:
    """Rules whose chunks stand on another page, or under another title, than their heading block."""
    heads = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "rule", "page", "text").where("kind = 'rule' AND rule IS NOT NULL")
    key = lambda c: F.regexp_replace(c, r"[^0-9.]", "")
    heads = heads.groupBy(key(F.col("rule")).alias("rule")).agg(F.min("page").alias("page"), F.min(T.strip(F.col("text"))).alias("title"))
    rows = R.latest(table(s, d, "chunks"), "chunk_id", "loaded_at", "rule", "pages", "rule_title").where("rule IS NOT NULL")
    rows = rows.groupBy(key(F.col("rule")).alias("rule")).agg(F.min(F.array_min("pages")).alias("chunk_page"), F.min(T.strip(F.col("rule_title"))).alias("chunk_title"))
    both = heads.join(rows, "rule", "full_outer")
    finding = F.when(F.col("title").isNull(), "no heading").when(F.col("chunk_title").isNull(), "no chunk").when(F.col("title") != F.col("chunk_title"), "title").when(F.abs(F.col("page") - F.col("chunk_page")) > 1, "page").otherwise("agrees")
    return both.groupBy(finding.alias("finding")).agg(F.count("*").alias("rules"))


def blocks_of_pages(s: SparkSession, d: str) -> DataFrame:
    """Of each chunk the blocks of its rule that lie on its pages: a range join within the rule."""
    key = lambda c: F.regexp_replace(c, r"[^0-9.]", "")
    rows = R.latest(table(s, d, "chunks"), "chunk_id", "loaded_at", "rule", "pages").where("rule IS NOT NULL AND size(pages) > 0").select("chunk_id", key(F.col("rule")).alias("rule"), F.array_min("pages").alias("a"), F.array_max("pages").alias("b"))
    # each page of a chunk is a key, so that the rule with most blocks is spread
    pages = rows.select("chunk_id", "rule", F.explode(F.sequence("a", "b")).alias("page"))
    blocks = R.latest(table(s, d, "blocks"), "block_id", "loaded_at", "kind", "rule", "page").where("kind = 'body' AND rule IS NOT NULL").groupBy(key(F.col("rule")).alias("rule"), "page").agg(F.count("*").alias("n"))
    return pages.join(blocks, ["rule", "page"]).groupBy("chunk_id").agg(F.sum("n").alias("n_blocks"))


def prominent_rules(s: SparkSession, d: str) -> DataFrame:
    """The fifty rules most often named by blocks of others."""
    rows = latest_body(s, d).select("rule", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\bMCR (\d+\.\d+)"), F.lit(1))).alias("named")).where("NOT (named <=> rule)")
    return rows.groupBy("named").agg(F.count("*").alias("inbound")).orderBy(F.desc("inbound"), "named").limit(50)


def phrase_patterns(s: SparkSession, d: str) -> DataFrame:
    """How many passages of each manual hold the last words of its headings, however spaced and written."""
    rows = kb(s, d).where("doc_id IS NOT NULL AND text IS NOT NULL")
    heads = R.latest(table(s, d, "kb_chunks"), "chunk_id", "loaded_at", "doc_id", "heading_path").where("size(heading_path) > 0").select("doc_id", F.regexp_extract(F.element_at("heading_path", -1), r"([A-Za-z]+ +[A-Za-z]+)$", 1).alias("phrase")).where("phrase <> ''").distinct()
    hits = heads.withColumn("pattern", P.flexible(F.col("phrase"))).join(rows.select("doc_id", "text"), "doc_id").where(F.rlike("text", "pattern"))
    return hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


def build_report(s: SparkSession, d: str) -> DataFrame:
    """What an index is made of and what is wrong with it, one row of each measure."""
    chunks, docs = table(s, d, "chunks"), table(s, d, "documents")
    usable = F.expr("embedding IS NOT NULL AND size(embedding) = 64 AND NOT exists(embedding, x -> isnan(x)) AND exists(embedding, x -> x <> 0)")
    one = lambda df, **m: df.agg(*[c.alias(n) for n, c in m.items()]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("n")) for n in m])))
    a = one(chunks.where("chunk_id IS NOT NULL"), chunks=F.countDistinct("chunk_id"), missing_vectors=F.countDistinct(F.when(~F.coalesce(usable, F.lit(False)), F.col("chunk_id"))), oversize=F.countDistinct(F.when(F.col("oversize"), F.col("chunk_id"))))
    b = one(docs, documents=F.count("*"), flagged=F.count_if(T.looks_garbled(F.col("text"))), without_rule=F.count_if(F.col("rule").isNull()))
    return a.unionByName(b)


def vector_warnings(s: SparkSession, d: str) -> DataFrame:
    """Runs of whose chunks more than a twentieth have no vector."""
    usable = F.expr("coalesce(size(embedding) = 64 AND NOT exists(embedding, x -> isnan(x)) AND exists(embedding, x -> x <> 0), false)")
    rows = table(s, d, "chunks").where("chunk_id IS NOT NULL").groupBy(F.coalesce("run_id", F.lit("none")).alias("run_id"), "chunk_id").agg(F.bool_or(usable).alias("ok"))
    share = F.count_if(~F.col("ok")) / F.count("*")
    return rows.groupBy("run_id").agg(F.round(share, 6).alias("missing_share"), (share > 0.05).alias("warn"))


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    """Thirty documents of each source, the same whatever the order of rows."""
    rows = table(s, d, "documents").select(F.lower(F.trim("source")).alias("source"), "doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("k"))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("k", "doc_id"))).where("r <= 30").select("source", "doc_id")


def weighted_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred documents drawn by the length of their text, without replacement: the smallest -ln(u) / w."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("w:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    rows = table(s, d, "documents").where("length(text) > 0").select("doc_id", F.round(-F.log(u) / F.length("text"), 12).alias("k"))
    return rows.orderBy("k", "doc_id").limit(100).select("doc_id")


def changed_by_cleaning(s: SparkSession, d: str) -> DataFrame:
    """Passages that have to be written again, as cleaning changes them."""
    c = T.clean(F.col("text"))
    return kb(s, d).where(F.col("text") != c).select(F.col("id").alias("chunk_id"), F.md5(c).alias("hash"))


def filtered_counts(s: SparkSession, d: str) -> DataFrame:
    """What the filters of the evaluation leave: queries that can be answered, blocks of twelve words, passages of 450 characters."""
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    a = table(s, d, "eval_queries").where("status = 'accepted' AND query_type <> 'unanswerable'").agg(F.lit("queries").alias("what"), F.count("*").alias("n"))
    b = table(s, d, "blocks").where((F.col("kind") == "body") & (size >= 12)).agg(F.lit("blocks").alias("what"), F.countDistinct("block_id").alias("n"))
    c = kb(s, d).where("length(text) >= 450").agg(F.lit("passages").alias("what"), F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c)


def chunkers_check(s: SparkSession, d: str) -> DataFrame:
    """Of each chunker the texts that lose or gain words, or whose pieces are too long: none."""
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"<!--\s*page:\s*\d+\s*-->", " "), r"[\s\p{Z}\x1C-\x1F\x85]+"), lambda w: w != "")
    want = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.array_join(words(F.col("text")), " ")).alias("want"))
    again = Q.rechunk(docs)
    got = again.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("t"), F.max(F.expr("IF(length(text) > 1500 AND text RLIKE '\\\\s', 1, 0)")).alias("long"))
    re = want.join(got.select("doc_id", F.xxhash64(F.array_join(words(F.col("t")), " ")).alias("got"), "long"), "doc_id", "left").agg(F.lit("rechunk").alias("chunker"), F.count("*").alias("n"), F.count_if(F.col("got") != F.col("want")).alias("changed"), F.coalesce(F.sum("long"), F.lit(0)).alias("too_long"))
    body = latest_body(s, d).where("rule IS NOT NULL").withColumn("tokens", T.estimated_tokens(F.col("text"))).withColumn("subpath", F.regexp_extract("citation", r"(\(.*)$", 1))
    packed = body.select("block_id", "rule").join(Q.chunk_rules(body).select("block_id", F.col("rule").alias("r")), "block_id", "left")
    rules = packed.agg(F.lit("rules").alias("chunker"), F.count("*").alias("n"), F.count_if(~F.col("r").eqNullSafe(F.col("rule"))).alias("changed"), F.lit(0).cast("long").alias("too_long"))
    return re.unionByName(rules)


QUERIES = {
    f.__name__: f
    for f in (
        document_kinds, document_facets, document_metadata, page_routes, distinctive_terms, hashed_vectors, promoted_sections, statutes_named, date_keys, document_currency, split_pages, repeated_sentences, clipped,
        citation_texts, anchored_chunks, augmented_chunks, numbered_prompts, windowed_sources, query_echo, frozen_set, templated_queries, reasoning_stripped, answer_rates, answer_percents, answer_records, passage_positions,
        citation_siblings, carried_headings, verbatim_islands, rendered_blocks, blocks_with_stems, whole_rules, contents_check, blocks_of_pages, prominent_rules, phrase_patterns, build_report, vector_warnings,
        seeded_sample, weighted_sample, changed_by_cleaning, filtered_counts, chunkers_check,
    )
}

_WORDS_N = lambda c: rf"len(list_filter(regexp_split_to_array({c}, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))"
_SRC = "lower(trim(source))"
_HEX = lambda c, n=8: f"('0x' || left(md5({c}), {n}))::BIGINT"
_FIRST = lambda t, key, when, cols: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {when} DESC NULLS LAST, {', '.join(c + ' DESC NULLS LAST' for c in cols)}) AS rn FROM {t} WHERE {key} IS NOT NULL) WHERE rn = 1)"


def _case(c: str, keywords: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{v}'" for v, p in keywords) + f" ELSE '{default}' END"


def _clip_sql(c: str, n: int) -> str:
    return rf"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), '[ \t\n\r\f\x0B]+[^ \t\n\r\f\x0B]*$', '') || ' …' END"


_KIND_NAMES = sorted({s[0] for s in SIGNALS})
_KIND_SUM = lambda k: " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for n, p, w in SIGNALS if n == k)
_STOP4 = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS))) + "]"
_CONTENT = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z]+'), lambda w: length(w) > 3 AND NOT list_contains({_STOP4}, w)))"
_AUDITED = f"""said AS (SELECT DISTINCT answer_id, {_CKEY("citation")} AS c FROM answer_citations WHERE citation IS NOT NULL AND answer_id IS NOT NULL), have AS (SELECT DISTINCT {_CKEY("citation")} AS c FROM blocks WHERE citation IS NOT NULL),
listed AS (SELECT DISTINCT chunk_id, {_CKEY("x")} AS c FROM (SELECT chunk_id, unnest(citations) AS x FROM chunks WHERE chunk_id IS NOT NULL) WHERE x IS NOT NULL),
got AS (SELECT DISTINCT p.answer_id, l.c FROM answer_passages p JOIN listed l USING (chunk_id)),
cited AS (SELECT said.answer_id, count(*) AS n_citations, count(*) FILTER (WHERE said.c IN (SELECT c FROM have)) AS n_exist, count(got.c) AS n_retrieved FROM said LEFT JOIN got ON got.answer_id = said.answer_id AND got.c = said.c GROUP BY said.answer_id)"""
_USABLE = "coalesce(embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"

ORACLE = {
    "document_kinds": f"""WITH k AS (SELECT doc_id, [{", ".join(f"{{'w': -({_KIND_SUM(k)})::DOUBLE, 'kind': '{k}'}}" for k in _KIND_NAMES)}] AS a FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_sort(a)[1:4] AS b FROM k), c AS (SELECT doc_id, b, -list_sum(list_transform(b, lambda x: x.w)) AS t FROM b), d AS (SELECT doc_id, b, CASE WHEN t > 0 THEN -b[1].w / t ELSE 0 END AS x, CASE WHEN t > 0 THEN -b[2].w / t ELSE 0 END AS y FROM c)
SELECT doc_id, CASE WHEN x >= 0.34 AND x - y >= 0.08 THEN b[1].kind ELSE 'other' END AS kind, round(x, 4) AS confidence FROM d""",
    "document_facets": f"SELECT {_case('t', TOPICS, 'general')} AS topic, {_case('t', AUDIENCES, 'all')} AS audience, count(*) AS n FROM (SELECT coalesce(text, '') AS t FROM documents) GROUP BY ALL",
    "document_metadata": rf"SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{{1,6}} ')) AS headings, n AS words, len(regexp_extract_all(t, '(?m)^\|')) AS table_rows, len(regexp_extract_all(t, '\]\(|https?://')) AS links, round(n / 200, 1) AS minutes, {_STRIP('''regexp_extract(t, '(?m)^#{1,6} +(.+)$', 1)''')} AS title, regexp_extract(t, '§ *(\d+-\d+)', 1) AS section FROM (SELECT doc_id, coalesce(text, '') AS t, {_WORDS_N("coalesce(text, '')")} AS n FROM documents)",
    "page_routes": _Q + r" SELECT source, CASE WHEN length(t) < 20 THEN 'ocr' WHEN g THEN 'ocr' WHEN len(regexp_extract_all(t, '\|')) > 20 THEN 'vlm' ELSE 'native' END AS route, count(*) AS n FROM q GROUP BY ALL",
    "distinctive_terms": f"""WITH t AS (SELECT doc_id, unnest({_toks("text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) > 2 GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT doc_id, term, round(tf * ln(n / df), 6) AS score FROM tf JOIN df USING (term), n WHERE df <= greatest(2, floor(n * 0.6)))
SELECT * FROM (SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 24""",
    "hashed_vectors": f"""WITH {_KB}, w AS (SELECT id, unnest({_toks("text")}) AS w FROM kb), f AS (SELECT id, unnest(list_concat([w], list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))) AS f FROM w), c AS (SELECT id, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT id, n, ('0x' || substr(md5(f), 7, 2) || substr(md5(f), 5, 2) || substr(md5(f), 3, 2) || substr(md5(f), 1, 2))::BIGINT AS h FROM c), v AS (SELECT id, (h % 256)::INT AS bucket, sum(CASE WHEN h >= 2147483648 THEN -n ELSE n END) AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT id AS chunk_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM v""",
    "promoted_sections": r"WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^§ *\d'))) AS sections, md5(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^§ *\d') THEN '## ' || x ELSE x END), chr(10))) AS hash FROM l WHERE len(list_filter(l, lambda x: regexp_matches(x, '^§ *\d'))) >= 1",
    "statutes_named": r"SELECT doc_id, array_to_string(list_sort(list_distinct(f)), ',') AS sections FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '§ *(\d+-\d+)', 1) AS f FROM documents) WHERE len(f) > 0",
    "date_keys": "SELECT doc_id, year(retrieved_at)::INT AS y, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE month(retrieved_at) END::INT AS m, CASE WHEN doc_id % 5 >= 3 THEN 0 ELSE day(retrieved_at) END::INT AS d FROM documents WHERE retrieved_at IS NOT NULL",
    "document_currency": f"""WITH r AS (SELECT doc_id, rule, {_SRC} AS source, retrieved_at FROM documents WHERE rule IS NOT NULL AND retrieved_at IS NOT NULL), n AS (SELECT rule, source, arg_max(doc_id, (retrieved_at, doc_id)) AS newest FROM r GROUP BY ALL),
x AS (SELECT doc_id, CASE WHEN newest <> doc_id THEN 'superseded by ' || newest WHEN NOT coalesce(contains(r.source, 'statute'), false) AND retrieved_at < DATE '{TODAY}' - INTERVAL 18 MONTH THEN 'not checked since ' || strftime(retrieved_at, '%Y-%m-%d') ELSE '' END AS note FROM r JOIN n ON r.rule = n.rule AND r.source IS NOT DISTINCT FROM n.source)
SELECT * FROM x WHERE note <> ''""",
    "split_pages": r"SELECT doc_id, len(p) AS pages, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, regexp_split_to_array(text, '\n---+\n') AS p FROM documents WHERE text IS NOT NULL)",
    "repeated_sentences": r"WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(57344), 'g'), chr(57344)) AS s FROM documents), n AS (SELECT doc_id, len(s) AS sentences, len(list_filter(range(2, len(s) + 1), lambda i: s[i] = s[i - 1])) AS dropped FROM s) SELECT * FROM n",
    "clipped": f"WITH {_KB}, c AS (SELECT id, {_clip_sql('text', 240)} AS c FROM kb WHERE text IS NOT NULL) SELECT id AS chunk_id, length(c) AS n_chars, md5(c) AS hash FROM c",
    "citation_texts": f"""WITH k AS {_FIRST("kb_chunks", "chunk_id", "loaded_at", ["text", "heading_path", "page_start", "page_end"])},
x AS (SELECT chunk_id, nullif(coalesce(array_to_string(heading_path, ' › '), ''), '') AS h, CASE WHEN coalesce(page_start, 0) < 1 THEN NULL WHEN coalesce(page_end, page_start) <= page_start THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '–' || page_end END AS p FROM k) SELECT chunk_id, concat_ws(' — ', h, p) AS where_found FROM x""",
    "anchored_chunks": f"""WITH k AS {_FIRST("kb_chunks", "chunk_id", "loaded_at", ["text", "page_start"])} SELECT chunk_id, md5(CASE WHEN {_STRIP("coalesce(text, '')")} <> '' THEN '<!-- page: ' || coalesce(page_start, 0) || ' -->' || chr(10) || chr(10) || text ELSE '' END) AS hash FROM k""",
    "augmented_chunks": rf"WITH {_KB}, x AS (SELECT id, text, concat_ws(chr(10), nullif(heading, ''), nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'MCR \d+\.\d+'))), ', '), '')) AS h FROM kb WHERE text IS NOT NULL) SELECT id AS chunk_id, md5(CASE WHEN h = '' THEN text ELSE h || chr(10) || chr(10) || text END) AS hash FROM x",
    "numbered_prompts": f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb", 5)}, x AS (SELECT query_id, string_agg('[' || rank || '] ' || {_clip_sql("coalesce(text, '')", 1400)}, chr(10) || chr(10) ORDER BY rank) AS t FROM b JOIN kb USING (id) GROUP BY query_id) SELECT query_id, length(t) AS n_chars, md5(t) AS hash FROM x""",
    "windowed_sources": f"""WITH {_KB}, {_bm25_sql("b", "qt", "kb", 5)}, r AS (SELECT id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal NULLS FIRST, id) AS place FROM kb WHERE doc_id IS NOT NULL),
a AS (SELECT query_id, rank, doc_id, unnest(range(place - 1, place + 2)) AS place FROM b JOIN r USING (id)), f AS (SELECT query_id, r.id, min(rank) AS rank FROM a JOIN r USING (doc_id, place) GROUP BY ALL) SELECT query_id, rank, count(*) AS passages, min(id) AS first_id FROM f GROUP BY ALL""",
    "query_echo": f"WITH e AS (SELECT query_id, status, {_CONTENT('query_text')} AS q, {_CONTENT('gold_text')} AS p FROM eval_queries), x AS (SELECT query_id, status, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, p)) / len(q) END, 6) AS echo FROM e) SELECT query_id, echo, CASE WHEN status = 'rejected' THEN 'reject' WHEN echo >= 0.55 THEN 'revise' ELSE 'keep' END AS verdict FROM x",
    "frozen_set": "SELECT count(*) AS n, sha256(array_to_string(list_sort(list(concat_ws(chr(31), query_id, coalesce(arm, ''), query_text, gold_text))), chr(10))) AS digest FROM eval_queries",
    "templated_queries": f"WITH {_BODY}, r AS (SELECT DISTINCT rule FROM body WHERE rule IS NOT NULL AND rule <> '') SELECT rule, replace([{', '.join(repr(t) for t in TEMPLATES)}][({_HEX('rule')} % {len(TEMPLATES)})::INT + 1], '{{}}', 'MCR ' || rule) AS question FROM r",
    "reasoning_stripped": "SELECT DISTINCT answer_id, md5(trim(answer)) AS hash FROM answers WHERE regexp_matches(answer, '[A-Za-z0-9]') AND NOT answer ILIKE '%think>%'",
    "answer_rates": f"""WITH {_AUDITED}, a AS {_FIRST("answers", "answer_id", "recorded_at", ["generator", "answer", "question"])}, x AS (SELECT coalesce(generator, 'unknown') AS generator, {_BYLEAD} AS r, n_citations = n_exist AS e FROM a LEFT JOIN cited USING (answer_id))
SELECT generator, count(*) AS n, round(avg(r::INT), 6) AS refused, round(avg(CASE WHEN NOT r THEN (e IS NOT NULL)::INT END), 6) AS cites, round(avg(CASE WHEN NOT r THEN e::INT END), 6) AS exist FROM x GROUP BY generator""",
    "answer_percents": rf"""WITH a AS {_FIRST("answers", "answer_id", "recorded_at", ["run_id", "answer"])}, x AS (SELECT coalesce(run_id, 'none') AS run_id, {_BYLEAD} AS r, regexp_matches(coalesce(answer, ''), '\[\d+') AS c FROM a) SELECT run_id, count(*) AS n, count(*) FILTER (WHERE c) * 100 // count(*) AS cited, count(*) FILTER (WHERE r) * 100 // count(*) AS refused FROM x GROUP BY run_id""",
    "answer_records": f"""WITH {_AUDITED}, a AS {_FIRST("answers", "answer_id", "recorded_at", ["answer", "latency_ms"])} SELECT answer_id, latency_ms, {_BYLEAD} AS refused, coalesce(n_citations, 0) AS n_citations, round(n_exist / n_citations, 6) AS valid, round(n_retrieved / n_citations, 6) AS grounded FROM a LEFT JOIN cited USING (answer_id)""",
    "passage_positions": "WITH p AS (SELECT answer_id, chunk_id, max(score) AS score FROM answer_passages WHERE answer_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL) SELECT answer_id, chunk_id, round(1 - (row_number() OVER (PARTITION BY answer_id ORDER BY score DESC NULLS LAST, chunk_id) - 1) / count(*) OVER (PARTITION BY answer_id), 6) AS position_score FROM p",
    "citation_siblings": f"WITH {_BODY}, b AS (SELECT DISTINCT {_CKEY('citation')} AS c, rule FROM body WHERE citation IS NOT NULL AND rule IS NOT NULL), n AS (SELECT rule, count(DISTINCT c) AS n FROM b GROUP BY rule), s AS (SELECT DISTINCT {_CKEY('citation')} AS c FROM answer_citations WHERE citation IS NOT NULL) SELECT c AS citation, sum(n - 1)::BIGINT AS siblings FROM s JOIN b USING (c) JOIN n USING (rule) GROUP BY c",
    "carried_headings": f"""WITH b AS {_FIRST("blocks", "block_id", "loaded_at", ["kind", "chapter", "text"])}, o AS (SELECT *, sum((kind = 'chapter')::INT) OVER (PARTITION BY chapter ORDER BY block_id) AS opened FROM b)
SELECT block_id, md5(last_value(CASE WHEN kind = 'chapter' THEN coalesce(text, '') END IGNORE NULLS) OVER w) AS chapter_heading, md5(last_value(CASE WHEN kind = 'rule' THEN coalesce(text, '') END IGNORE NULLS) OVER w) AS rule_heading FROM o WINDOW w AS (PARTITION BY chapter, opened ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "verbatim_islands": f"""WITH b AS {_FIRST("blocks", "block_id", "loaded_at", ["kind", "rule", "marker", "depth", "deleted_at"])}, i AS (SELECT *, sum((marker IS NOT NULL)::INT) OVER (PARTITION BY rule ORDER BY block_id) AS island FROM b WHERE kind = 'body' AND deleted_at IS NULL AND rule IS NOT NULL)
SELECT rule, island::BIGINT AS island, count(*) AS n, min(block_id) AS first_block, coalesce(bool_or(depth > 3 OR depth IS NULL), false) AS verbatim FROM i WHERE marker IS NULL GROUP BY rule, island""",
    "rendered_blocks": rf"""WITH b AS {_FIRST("blocks", "block_id", "loaded_at", ["kind", "depth", "text"])}, c AS (SELECT *, regexp_replace(coalesce(text, ''), '\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM b) SELECT block_id, md5(CASE WHEN kind = 'chapter' THEN '# ' || c WHEN kind = 'rule' THEN '### ' || c ELSE repeat(' ', 4 * greatest(coalesce(depth, 0) - 1, 0)) || c END) AS hash FROM c""",
    "blocks_with_stems": rf"""WITH {_BODY}, b AS (SELECT citation, arg_min(text, block_id) AS text FROM body WHERE citation IS NOT NULL GROUP BY citation), x AS (SELECT citation, text, regexp_replace(citation, '\([^)]*\)$', '') AS parent FROM b),
y AS (SELECT x.citation, x.text, CASE WHEN x.parent <> x.citation THEN p.text END AS stem FROM x LEFT JOIN b p ON p.citation = x.parent) SELECT citation, md5(concat_ws(chr(10), citation, stem, text)) AS hash, stem IS NOT NULL AS has_stem FROM y""",
    "whole_rules": rf"WITH {_BODY} SELECT rule, count(*) AS n_blocks, sum(floor({_WORDS_N('text')} * 1.32)::BIGINT + 1)::BIGINT AS tokens FROM body WHERE rule IS NOT NULL GROUP BY rule",
    "contents_check": f"""WITH b AS {_FIRST("blocks", "block_id", "loaded_at", ["kind", "rule", "page", "text"])}, c AS {_FIRST("chunks", "chunk_id", "loaded_at", ["rule", "pages", "rule_title"])},
h AS (SELECT regexp_replace(rule, '[^0-9.]', '', 'g') AS rule, min(page) AS page, min({_STRIP("text")}) AS title FROM b WHERE kind = 'rule' AND rule IS NOT NULL GROUP BY 1), k AS (SELECT regexp_replace(rule, '[^0-9.]', '', 'g') AS rule, min(list_min(pages)) AS p, min({_STRIP("rule_title")}) AS t FROM c WHERE rule IS NOT NULL GROUP BY 1)
SELECT CASE WHEN title IS NULL THEN 'no heading' WHEN t IS NULL THEN 'no chunk' WHEN title <> t THEN 'title' WHEN abs(page - p) > 1 THEN 'page' ELSE 'agrees' END AS finding, count(*) AS rules FROM h FULL OUTER JOIN k USING (rule) GROUP BY 1""",
    "blocks_of_pages": f"""WITH b AS {_FIRST("blocks", "block_id", "loaded_at", ["kind", "rule", "page"])}, c AS {_FIRST("chunks", "chunk_id", "loaded_at", ["rule", "pages"])}
SELECT chunk_id, count(*) AS n_blocks FROM c JOIN b ON regexp_replace(c.rule, '[^0-9.]', '', 'g') = regexp_replace(b.rule, '[^0-9.]', '', 'g') AND b.page BETWEEN list_min(c.pages) AND list_max(c.pages) WHERE b.kind = 'body' AND len(c.pages) > 0 GROUP BY chunk_id""",
    "prominent_rules": rf"WITH {_BODY}, m AS (SELECT rule, unnest(regexp_extract_all(text, '\bMCR (\d+\.\d+)', 1)) AS named FROM body) SELECT named, count(*) AS inbound FROM m WHERE named IS DISTINCT FROM rule GROUP BY named ORDER BY inbound DESC, named LIMIT 50",
    "phrase_patterns": rf"""WITH {_KB}, k AS {_FIRST("kb_chunks", "chunk_id", "loaded_at", ["doc_id", "heading_path"])}, h AS (SELECT DISTINCT doc_id, regexp_extract(heading_path[-1], '([A-Za-z]+ +[A-Za-z]+)$', 1) AS phrase FROM k WHERE len(heading_path) > 0)
SELECT doc_id, phrase, count(*) AS n FROM h JOIN kb USING (doc_id) WHERE phrase <> '' AND regexp_matches(kb.text, '(?i)' || array_to_string(regexp_split_to_array(phrase, ' +'), '\s+')) GROUP BY ALL""",
    "build_report": _Q + f""", c AS (SELECT count(DISTINCT chunk_id) AS a, count(DISTINCT chunk_id) FILTER (WHERE NOT {_USABLE}) AS b, count(DISTINCT chunk_id) FILTER (WHERE oversize) AS c FROM chunks WHERE chunk_id IS NOT NULL)
SELECT 'chunks' AS measure, a AS n FROM c UNION ALL SELECT 'missing_vectors', b FROM c UNION ALL SELECT 'oversize', c FROM c UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'flagged', count(*) FILTER (WHERE g) FROM q UNION ALL SELECT 'without_rule', count(*) FILTER (WHERE rule IS NULL) FROM documents""",
    "vector_warnings": f"WITH r AS (SELECT coalesce(run_id, 'none') AS run_id, chunk_id, bool_or({_USABLE}) AS ok FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2) SELECT run_id, round(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS missing_share, count(*) FILTER (WHERE NOT ok) / count(*) > 0.05 AS warn FROM r GROUP BY run_id",
    "seeded_sample": f"SELECT source, doc_id FROM (SELECT {_SRC} AS source, doc_id, row_number() OVER (PARTITION BY {_SRC} ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 30",
    "weighted_sample": f"SELECT doc_id FROM documents WHERE length(text) > 0 ORDER BY round(-ln(({_HEX('''('w:' || doc_id)''')}::DOUBLE + 1) / 4294967297.0) / length(text), 12), doc_id LIMIT 100",
    "changed_by_cleaning": f"WITH {_KB}, c AS (SELECT id, text, {_clean_sql('text')} AS c FROM kb WHERE text IS NOT NULL) SELECT id AS chunk_id, md5(c) AS hash FROM c WHERE c <> text",
    "filtered_counts": rf"WITH {_KB} SELECT 'queries' AS what, count(*) AS n FROM eval_queries WHERE status = 'accepted' AND query_type <> 'unanswerable' UNION ALL SELECT 'blocks', count(DISTINCT block_id) FROM blocks WHERE kind = 'body' AND {_WORDS_N('''coalesce(text, '')''')} >= 12 UNION ALL SELECT 'passages', count(*) FROM kb WHERE length(text) >= 450",
    "chunkers_check": f"WITH {_BODY} SELECT 'rechunk' AS chunker, count(*) AS n, 0::BIGINT AS changed, 0::BIGINT AS too_long FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'rules', count(*), 0, 0 FROM body WHERE rule IS NOT NULL",
}
