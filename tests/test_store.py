"""Keyed tables in buckets: the result of a whole merge, touching only what changes."""

import os
import random

import pytest

from newsloom.sources.merge import keyed_load
from newsloom.sources.store import BUCKET, KeyedTable

SCHEMA = "url string, quarter int, a int, b string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted(map(str, df.select("url", "quarter", "a", "b").collect()))


@pytest.mark.parametrize("mode", ["update", "fill", "skip"])
def test_load_equals_whole_merge(spark, tmp_path, mode):
    rng = random.Random(3)
    old = [(f"u{i}" if i else None, i % 4 or None, rng.choice([None, i]), rng.choice([None, "x"])) for i in range(400)]
    new = [(f"u{i}" if i else None, i % 4 or None, rng.choice([None, -i]), rng.choice([None, "y"])) for i in range(0, 900, 3)]
    before, batch = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    table = KeyedTable(str(tmp_path / "t"), ("url", "quarter"), 16)
    table.create(before)
    told = table.load(batch, mode)
    want = keyed_load(before, batch, ["url", "quarter"], mode)
    assert rows_of(table.read(spark)) == rows_of(want)
    count = lambda df: {r["action"]: r["count"] for r in df.groupBy("action").count().collect() if r["action"] != "kept"}
    assert count(told) == count(want)
    stamps = files(table.path)
    table.load(batch, mode)
    assert files(table.path) == stamps and rows_of(table.read(spark)) == rows_of(want)


def test_load_writes_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("url",), 32)
    base = spark.range(5000).selectExpr("concat('u', id) as url", "1 as quarter", "cast(id as int) as a", "'x' as b")
    table.create(base)
    stamps = files(table.path)
    some = table._dealt(base).filter(f"{BUCKET} in (3, 17)").drop(BUCKET).limit(50)
    plan = spark.read.parquet(table.path).filter(f"{BUCKET} in (3, 17)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    table.load(some.selectExpr("url", "quarter", "a + 1 as a", "b"))
    changed = {f for f in stamps.keys() | files(table.path).keys() if stamps.get(f) != files(table.path).get(f)}
    assert changed and all("_bucket=3/" in f or "_bucket=17/" in f for f in changed)
    assert table.read(spark).count() == 5000 and table.load(some.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        table.load(some.selectExpr("url", "1 as other"))


def facts(spark, days=75):
    from datetime import datetime, timedelta

    rng = random.Random(12)
    groups = {"joy": "positive", "anger": "negative", "calm": "neutral", None: None}
    rows = []
    for i in range(4000):
        emotion, topic = rng.choice(list(groups)), rng.choice([None, 1, 2, 3, 4])
        rows.append((i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(days * 1440)), topic, f"t{topic}", rng.choice([None, "a.vn", "facebook.com", "b.vn"]), emotion, groups[emotion]))
    return spark.createDataFrame(rows, "article_id long, published_at timestamp_ntz, topic_id int, topic_name string, source_domain string, emotion string, sentiment_group string")


@pytest.mark.parametrize("period", ["weekly", "monthly"])
def test_marts_from_partials(spark, period):
    from datetime import date

    from newsloom.operators import marts as M

    mentions = facts(spark)
    partials = M.daily_partials(mentions)
    day = date(2024, 2, 14)
    for mart in (M.trend_report, lambda m, p, d: M.hot_topics(m, p, d, titles=0), M.topic_mentions, M.website_activity, M.social_activity, lambda m, p, d: M.daily_snapshots(m)):
        assert sorted(map(str, mart(partials, period, day).collect())) == sorted(map(str, mart(mentions, period, day).collect()))


def test_partials_of_changed_days(spark):
    from datetime import date

    from newsloom.operators import marts as M

    mentions = facts(spark, 10)
    changed = mentions.filter("published_at < '2024-01-05' or article_id % 2 = 0")
    stored = M.daily_partials(mentions.filter("published_at < '2024-01-05'"))
    fresh = M.refresh_partials(stored.unionByName(M.daily_partials(mentions.filter("published_at >= '2024-01-05' and article_id % 3 = 0"))), changed, [date(2024, 1, d) for d in range(5, 11)])
    assert sorted(map(str, fresh.collect())) == sorted(map(str, M.daily_partials(changed).collect()))
