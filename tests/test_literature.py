from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortflow.functions import text
from cohortflow.operators import literature as lit

HIT = "candidate_id string, source_name string, pmid string, doi string, title string, year string, abstract string, predicted_direction string"


def grade(spark, title, abstract=None, predicted="up", **context):
    df = spark.createDataFrame([("c", "s", "1", None, title, None, abstract, predicted)], HIT)
    return lit.grade(df, **context).first()


@pytest.mark.parametrize(
    "title, predicted, direction, stance, level",
    [
        ("A activates B in a knockout", "up", "up", "supports", "A"),
        ("A inhibits B", "up", "down", "contradicts", "X"),
        ("A binds B", "up", "unknown", "supports", "B"),
        ("A is associated with B", "unknown", "unknown", "supports", "C"),
        ("A and B in a pathway", "up", "unknown", "supports", "D"),
        ("A increases B", "up", "up", "supports", "D"),
        ("A increases and decreases B", "up", "unknown", "unrelated", "N"),
        ("A meets B", "up", "unknown", "unrelated", "N"),
        ("", "up", "unknown", "unrelated", "N"),
    ],
)
def test_grading(spark, title, predicted, direction, stance, level):
    r = grade(spark, title, predicted=predicted)
    assert (r.relation_direction, r.stance, r.evidence_level) == (direction, stance, level)
    assert r.evidence_sentence == (title or lit.ABSENCE)


def test_context_flags(spark):
    r = grade(spark, "A in HUMAN liver", organism="Human", tissue="brain")
    assert (r.same_species, r.same_tissue, r.same_condition) == (True, False, None)


def test_query_keeps_only_given_terms(spark):
    row = spark.range(1).select(text.search_query(F.lit("A"), F.lit("B"), tissue="liver").alias("q")).first()
    assert row.q == "(A) AND (B) AND (regulat* OR bind* OR interact* OR phosphorylat*) AND (liver)"


def test_identity_checks_fail_closed(spark):
    rows = [
        ("ok", "s", "1", "10.1000/a", "The  Title", None, "binds", "up"), ("title", "s", "2", None, "Wrong", None, "binds", "up"), ("fake", "s", "99", "10.1000/z", "x", None, "binds", "up"),
        ("doi", "s", "3", "10.1000/other", "T3", None, "binds", "up"), ("nodoi", "s", "4", "10.1000/n", "T4", None, "binds", "up"), ("only", "s", None, "10.1000/a", "The Title", None, "binds", "up"),
    ]
    bib = spark.createDataFrame([("1", "the title", "10.1000/A"), ("2", "Right", None), ("3", "T3", "10.1000/c"), ("4", "T4", None)], "pmid string, title string, doi string")
    out = lit.fail_closed(lit.grade(lit.verify_ids(spark.createDataFrame(rows, HIT), bib)))
    got = {r.candidate_id: (r.pmid_authentic, r.doi_authentic, r.evidence_level) for r in out.collect()}
    assert got == {
        "ok": (True, True, "B"), "title": (False, False, "N"), "fake": (False, False, "N"), "doi": (True, False, "B"), "nodoi": (True, True, "B"), "only": (False, False, "N"),
    }
    assert {r.evidence_sentence for r in out.where("NOT pmid_authentic").collect()} == {lit.ABSENCE}


def test_no_hit_gives_an_explicit_record(spark):
    c = spark.createDataFrame([("c", "A", "B", "up")], "candidate_id string, source_id string, target_id string, predicted_direction string")
    graded = lit.fail_closed(lit.grade(lit.verify_ids(spark.createDataFrame([], HIT), spark.createDataFrame([], "pmid string, title string, doi string"))))
    r = lit.evidence_table(c, graded).first()
    assert (r.evidence_level, r.stance, r.evidence_sentence, r.reviewer_status, r.claim_kind) == ("N", "unrelated", lit.ABSENCE, "needs_review", "hypothesis")


def test_dedupe_and_cap(spark):
    rows = [("c", "b", "1", None, "t", None, None, "up"), ("c", "a", "1", None, "t", None, None, "up"), ("c", "a", None, "d", "t", None, None, "up"), ("c", "a", None, None, "t", None, None, "up"), ("c", "b", None, None, "t", None, None, "up")]
    df = spark.createDataFrame(rows, HIT).withColumn("rank", F.when(F.col("source_name") == "a", 0).otherwise(1))
    out = lit.first_hits(df, ["candidate_id"], ["rank"])
    assert out.count() == 4 and out.where("pmid = '1'").first().source_name == "a"
    many = spark.range(500).select(F.lit("c").alias("k"), "id")
    assert sorted(r.id for r in lit.capped_hits(many, ["k"], ["id"], 3).collect()) == [0, 1, 2]


def test_corpus_match(spark):
    corpus = spark.createDataFrame([(1, "Foo", "with BAR"), (2, "foo", "only"), (3, None, "bar foo")], "i int, title string, abstract string")
    c = spark.createDataFrame([("x", "foo", "Bar", "up", 1), ("y", "foo", "zzz", "up", 2)], "candidate_id string, source_id string, target_id string, predicted_direction string, rk int")
    assert {(r.i, r.candidate_id) for r in lit.match_corpus(corpus, c, 5, ["rk"]).collect()} == {(1, "x"), (3, "x")}
    with pytest.raises(ValueError):
        lit.match_corpus(corpus, c, 51, ["rk"])


def test_small_text_helpers(spark):
    r = spark.range(1).select(
        text.doi_from_text(F.lit("doi: 10.5/x ")).alias("a"), text.doi_from_text(F.lit("none")).alias("b"), text.year_prefix(F.lit(" 2020 Mar")).alias("c"), text.year_prefix(F.lit("20")).alias("d"),
        text.well_formed_doi(F.lit("10.1000/x y")).alias("e"), text.well_formed_doi(F.lit(None).cast("string")).alias("f"), text.well_formed_pmid(F.lit("12a")).alias("g"),
    ).first()
    assert tuple(r) == ("10.5/x", None, "2020", None, False, False, False)
