"""Rows are left out by id through a bitmap and a join, as by a plain anti-join."""

from barloom.llm.near_dedup import _of_ids, without_ids


def test_without_ids(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text").unionByName(spark.createDataFrame([(None, "none"), (7, "again")], "doc_id long, text string"))
    ids = spark.createDataFrame([(i,) for i in [*range(0, 3000, 7), 7, 7, 99_999, None]], "doc_id long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in without_ids(docs, ids).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id % 7)
    assert got == want
    assert without_ids(docs.limit(0), ids).count() == 0 and without_ids(docs, ids.limit(0)).count() == 3002
    assert sorted(r.text for r in _of_ids(docs, ids.distinct()).collect()) == sorted(["again", *[f"t{i}" for i in range(0, 3000, 7)]])
