"""Counts inside the row and what is shuffled for them."""

from collections import Counter

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import mining as K
from newsloom.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_runs(spark):
    lists = [["b", "a", "b", None, ""], [], None, ["x"], ["é", "e", "é", "é"], [None]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id long, v array<string>")
    for r in df.select("v", X.term_runs("v").alias("runs")).collect():
        want = Counter(w for w in r["v"] or [] if w is not None)
        assert sorted((x["term"], x["count"]) for x in r["runs"] or []) == sorted(want.items())


def test_a_bag_of_words_is_shuffled_by_term_only(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a b"), (3, None)], "doc_id long, text string")
    bag = K.bag_of_words(docs, "doc_id", "text", lambda c: F.split(c, " "), 2)
    assert sorted(map(tuple, bag.collect())) == [(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 1)]
    assert "hashpartitioning(doc_id" not in plan(bag)


def test_only_the_best_phrases_are_counted_by_topic(spark):
    df = registry.queries()["g3_keyword_stats"](spark, SF)
    assert df.count() > 0
    # What is left of the plan starts from the cells of the best phrases; no text is read again.
    assert "FileScan" not in plan(df)
