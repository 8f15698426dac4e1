"""Lines to blocks, contents pages, and their reconciliation."""

from corpusmill.operators import layout as L
from corpusmill.operators import structure as Q

LINES = "doc_id string, page int, line int, y double, x double, size double, bold boolean, text string, extra int"


def lines(spark, rows):
    return spark.createDataFrame([("d", *r, 0) for r in rows], LINES)


def test_blocks(spark):
    rows = [
        (19, 0, 80.0, 72.0, 18.0, True, "Chapter 2. Procedure"), (19, 1, 110.0, 72.0, 14.0, True, "Subchapter 2.100 Motions"), (19, 2, 127.0, 72.0, 14.0, True, "and Other Papers"), (19, 3, 170.0, 72.0, 14.0, True, "Edition of May"),
        (19, 4, 200.0, 72.0, 12.0, True, "Rule 2.116 Summary"), (19, 5, 217.0, 72.0, 12.0, True, "Disposition"), (19, 6, 240.0, 93.6, 12.0, False, "(A) Judgment on Stipu-"), (19, 7, 254.0, 93.6, 12.0, False, "lated Facts."),
        (19, 8, 274.0, 115.2, 12.0, False, "(10)Except as said"), (19, 9, 288.0, 115.2, 12.0, False, "(A)(2). of this rule"), (19, 10, 308.0, 115.2, 12.0, False, "(11)(a) Two levels"), (19, 11, 330.0, 162.0, 12.0, False, "(i) shy of its rung"), (19, 12, 700.0, 93.6, 12.0, False, "A tail that"),
        (20, 0, 80.0, 93.6, 12.0, False, "goes on"), (20, 1, 100.0, 300.0, 12.0, False, "off the ladder"), (20, 2, 120.0, 93.6, 12.0, False, " "), (20, 3, 130.0, 93.6, None, None, "(B) next"), (21, 0, 80.0, 72.0, 12.0, False, "further out"),
    ]
    got = [tuple(r)[2:] for r in L.blocks_from_lines(lines(spark, rows)).orderBy("block").collect()]
    assert [(k, t, p, e, d, m) for k, t, p, e, d, m in got] == [
        ("chapter", "Chapter 2. Procedure", 19, 19, 0, None), ("subchapter", "Subchapter 2.100 Motions and Other Papers", 19, 19, 0, None), ("front_matter", "Edition of May", 19, 19, 0, None), ("rule", "Rule 2.116 Summary Disposition", 19, 19, 0, None),
        ("body", "(A) Judgment on Stipu-lated Facts.", 19, 19, 1, "A"), ("body", "(10) Except as said (A)(2). of this rule", 19, 19, 2, "10"), ("body", "(11)(a) Two levels", 19, 19, 3, "a"), ("body", "(i) shy of its rung", 19, 19, 4, "i"),
        ("body", "A tail that goes on", 19, 20, 1, None), ("body", "off the ladder", 20, 20, None, None), ("body", "(B) next", 20, 20, 1, "B"), ("body", "further out", 21, 21, 0, None),
    ]
    assert L.blocks_from_lines(lines(spark, [])).count() == 0


def test_guards(spark):
    rows = [("d", 0, "body", None, 1), ("d", 1, "body", "1", 2), ("d", 2, "body", None, 2), ("d", 3, "body", None, None), ("d", 4, "body", "2", 2), ("d", 5, "body", None, 2), ("e", 0, "rule", None, 0)]
    got = {(r.doc_id, r.block): (r.opens_list, r.verbatim) for r in L.guards(spark.createDataFrame(rows, "doc_id string, block int, kind string, marker string, depth int")).collect()}
    assert got == {("d", 0): (True, False), ("d", 1): (False, False), ("d", 2): (False, True), ("d", 3): (False, True), ("d", 4): (False, False), ("d", 5): (False, False), ("e", 0): (False, False)}


def test_contents_and_reconciliation(spark):
    text = ["THE RULES", "Table of Contents", "Chapter 2. Civil Procedure ...... 18", "Rule 2.116 Summary", "Disposition .... 40", "iv", "Updated May", "Rule 2.117 A title that fills its line", "41", "Rule 2.118 " + "very long title " * 6 + "44", "Rule 2.119 ends in 1985", "x" * 500, "Rule 2.120 Last ... 50"]
    want = [("chapter", "2", "Civil Procedure", 18), ("rule", "2.116", "Summary Disposition", 40), ("rule", "2.117", "A title that fills its line", 41), ("rule", "2.118", ("very long title " * 6).strip(), 44), ("rule", "2.120", "Last", 50)]
    assert L.entries(text) == want and L.entries([]) == []
    toc = L.contents(spark.createDataFrame([("d", 2, "\n".join(text[4:])), ("d", 1, "\n".join(text[:4])), ("e", None, "x"), (None, 1, "x")], "doc_id string, page int, text string"))
    assert [tuple(r)[1:] for r in toc.collect()] == want
    blocks = spark.createDataFrame([("d", "rule", "Rule 2.116 Summary  disposition", 41), ("d", "rule", "Rule 2.117 Another", 41), ("d", "rule", "Rule 2.118 " + ("very long title " * 6), 60), ("d", "rule", "Rule 9.999 New", 1), ("d", "body", "Rule", 1)], "doc_id string, kind string, text string, page int")
    assert {(r.num, r.finding) for r in L.reconciled(toc, blocks).collect()} == {("2.116", "agrees"), ("2.117", "title"), ("2.118", "page"), ("2.120", "only_printed"), ("9.999", "only_body")}


def test_atoms_and_packing():
    text = "(a) First part. (b) " + "Second part holds; " * 20 + "(1) third." + "x" * 90 + " one  two"
    parts = Q.atoms(text, 80)
    assert all(len(p) <= 80 or " " not in p for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "") and Q.atoms("", 5) == []
    assert [c for c, _, _ in Q.packed([(50, 1), (60, 2), (30, 1), (10, 3)], 100)] == [0, 0, 1, 1]
    assert [c for c, _, _ in Q.packed([(70, 1), (60, 2)], 100)] == [0, 1]
