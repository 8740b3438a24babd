"""Literals that tell texts a pattern cannot match, and results that do not depend on them."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions.matches import folded, literals_of, may_match
from newsloom.operators import entities as E
from newsloom.plans import registry
from newsloom.resources import entity_patterns, indicator_patterns as P

ALL = [P.full(p) for v in P.INDICATORS.values() for p, _ in v] + [P.full(p) for *_, p in P.SOCIAL]


@pytest.mark.parametrize("pattern, wanted", [
    (r"(?iU)a[.,]?b+cd\s*(?:x y|z)(?!.*q)(?:w)?", (("a",), ("cd",), ("x y", "z"))),
    (r"(?:one|two)|three", ()),
    (r"(?:(?:in|out) side|up){2}last", (("last",),)),
    (r"(?:a(?:b|c)|d\d)", (("a", "d"),)),
])
def test_literals(pattern, wanted):
    assert literals_of(pattern) == wanted


def test_no_match_is_passed_over(spark):
    rng = random.Random(3)
    parts = [w for p in ALL for ws in literals_of(p) for w in ws] + [" 5,3 %", " 12.345 tỷ", " 1,5 triệu USD", " 2024", " II ", "İIP", "ſ", "CPı"]
    rows = [(i, "".join(rng.choice([str.upper, str.lower, str])(rng.choice(parts)) + rng.choice(["", " "]) for _ in range(12))) for i in range(300)]
    rows += [(1000, "Cİ IİP tăng 5,3%"), (1001, "chỉ ſố giá đạt 101,5")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("low", folded("t"))
    missed = [F.count_if(F.col("t").rlike(p) & ~may_match(F.col("low"), p, fold=True)) for p in ALL]
    assert set(df.agg(*missed).first()) == {0}


def test_entities_are_found_behind_the_literals(spark):
    text = "Ông Nguyễn Văn An, UBND Tỉnh Hưng Yên, quý II/2024, 5 tỷ đồng, 01/02/2024"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id long, t string")
    got = {(r["id"], r["type"], r["entity"]) for r in E.extract_entities(df, "id", "t", offsets=True).collect()}
    assert {(1, "PERSON", "Ông Nguyễn Văn An"), (1, "DATE", "01/02/2024"), (1, "MONEY", "5 tỷ"), (1, "MONEY", "5 tỷ đồng")} <= got
    assert {i for i, *_ in got} == {1}
    # Of the patterns, all but the plain date are told by literals.
    assert sum(not literals_of(p) for _, p in entity_patterns.patterns()) == 1


def test_orders_are_dealt_out_before_the_patterns(spark):
    df = registry.queries()["c15_entities"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_panel_is_extracted_once(spark):
    plan = registry.queries()["n8_save_panel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
