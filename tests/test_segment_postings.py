"""Postings of a segment: counted in each row, merged only where documents share a key."""

from tidemark.operators import search as se

DOC = "doc_key string, doc_type string, doc_id string, entity_type string, tenant_id string, boost double, text string"


def docs(spark, *rows):
    return spark.createDataFrame([(k, "entity", k, "order", "t", 1.0, text) for k, text in rows], DOC)


def counts(rows):
    return sorted((r["token"], r["doc_key"], r["tf"]) for r in rows.collect())


def test_equal_to_grouped_postings(spark):
    for rows in ([("a", "pay order pay"), ("b", "order"), ("c", ""), ("d", None)], [("a", "pay order pay"), ("a", "pay"), ("b", "x y x"), ("b", None)]):
        frame = docs(spark, *rows)
        assert counts(se.segment_postings(frame)) == counts(se.postings(frame))


def test_no_occurrence_is_shuffled(spark):
    plan = se.segment_postings(docs(spark, ("a", "pay order pay"), ("b", "order")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
