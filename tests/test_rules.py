"""Hand-computed cases for the thresholds and edges of the rules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, numbers, text, urls
from newsloom.operators import classify, indicators, marts, mining, normalize, panel, ranking, search, topics, trends
from newsloom.resources import lexicon
from newsloom.sources import files, html, mappers, merge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_chain(spark):
    raw = "Xem http://a.vn/x liên hệ me@a.vn 0912 345 678 &amp; &#39; ko heeeello ✨ hoà"
    # The phone rule takes the blanks around the digits with it.
    assert one(spark, text.clean_standard(F.lit(raw))) == "xem liên hệko heello hòa"
    assert one(spark, text.clean_standard(F.lit("Ko biết, VN ơi"))) == "không biết, việt nam ơi"
    assert one(spark, text.clean_standard(F.lit(None).cast("string"))) == ""
    assert one(spark, text.clean_enhanced(F.lit("<p>Heeello a và WWW www.a.vn</p>"), remove_stopwords=True)) == "Heello WW"
    assert one(spark, text.clean_for_topics(F.lit("Và người dân Hưng Yên"))) == "dân hưng yên"
    decomposed = "tiếng"
    assert one(spark, text.clean_standard(F.lit(decomposed))) == "tiếng"


def test_tokens_and_phrases(spark):
    assert one(spark, text.words(F.lit("Tôi đọc TIN tức 24h, và tin"))) == ["đọc", "tin", "tức", "tin"]
    assert one(spark, text.phrases(F.array(*map(F.lit, ["a", "b", "c"])))) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, text.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, text.hashtags(F.lit("#Tin_Mới và #tin_mới #x!"))) == ["tin_mới", "x"]
    assert one(spark, text.tidy_phrase(F.lit("của_người dân  và"))) == "người dân"
    assert one(spark, text.occurrences(F.lit("aaaa"), "aa")) == 2


@pytest.mark.parametrize("raw, expected", [
    ("1704067200", "2024-01-01 00:00:00"), ("1704067200.5", "2024-01-01 00:00:00"), ("2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("14/09/2025", "2025-09-14 00:00:00"), ("14-10-2018 20:47:13", "2018-10-14 20:47:13"),
    ("11/28/25", "2025-11-28 00:00:00"), ("2024/05/06", "2024-05-06 00:00:00"), ("hôm qua", None), ("", None)])
def test_timestamps(spark, raw, expected):
    assert one(spark, F.date_format(dates.parse_timestamp(F.lit(raw)), "yyyy-MM-dd HH:mm:ss")) == expected


def test_periods():
    assert dates.period_range("weekly", date(2024, 1, 17)) == (date(2024, 1, 15), date(2024, 1, 21), date(2024, 1, 8), date(2024, 1, 14), "Tuần 3/2024")
    assert dates.period_range("monthly", date(2024, 2, 10))[:4] == (date(2024, 2, 1), date(2024, 2, 29), date(2024, 1, 3), date(2024, 1, 31))
    assert dates.period_range("daily", date(2024, 3, 1))[:4] == (date(2024, 3, 1), date(2024, 3, 1), date(2024, 2, 29), date(2024, 2, 29))
    assert dates.period_range("all_time", date(2024, 1, 1))[0] == date(2020, 1, 1)
    with pytest.raises(ValueError):
        dates.period_range("hourly", date(2024, 1, 1))


@pytest.mark.parametrize("raw, expected", [("950", 950), ("46.3K", 46300), ("1.2M", 1200000), ("2B", 2000000000), ("n/a", 0), (None, 0)])
def test_view_counts(spark, raw, expected):
    assert one(spark, numbers.view_count(F.lit(raw).cast("string"))) == expected


def test_platforms_and_domains(spark):
    find = lambda u: one(spark, urls.platform_of_url(F.lit(u)))
    assert find("https://m.facebook.com/p/1") == "facebook"
    assert find("https://fedex.com/x.com") is None
    assert find("https://vietnamnet.com") is None
    assert one(spark, urls.platform_of_url(F.lit("https://fedex.com/"), substring=True)) == "twitter"
    assert one(spark, urls.domain_of_url(F.lit("https://www.Tuoitre.VN:8080/a"))) == "tuoitre.vn"
    none = F.lit(None).cast("string")
    assert one(spark, urls.domain(none, F.lit("Báo Dân Trí"), none, none)) == "dantri.com.vn"
    assert one(spark, urls.domain(none, none, F.lit("Threads"), none)) == "threads.net"


def test_numbers(spark):
    s = lambda c: one(spark, c)
    assert s(indicators.value_vnd(F.lit("đạt 40.000 tỷ đồng"))) == 40000
    assert s(indicators.value_vnd(F.lit("thu 4.786,5 tỷ"))) == 4786.5
    assert s(indicators.value_vnd(F.lit("ước đạt 40,5 nghìn tỷ"))) == 40500
    assert s(indicators.value_usd(F.lit("150 triệu USD"))) == 150
    assert s(indicators.value_usd(F.lit("1,5 tỷ USD"))) == 1500
    assert s(indicators.growth(F.lit("TĂNG 7,70%"))) == 7.7
    assert s(indicators.growth(F.lit("giảm 5%"))) == -5
    assert s(numbers.last_quarter_in(F.lit("quý I và quý III/2025"))) == 3
    assert s(numbers.number_with_unit(F.lit("1,5"), F.lit("triệu"))) == 1500000
    assert s(indicators.forecast(F.lit("kế hoạch ước đạt 12.500 tỷ"))) is None
    period = numbers.period_of_title
    assert tuple(s(period(F.lit("Báo cáo tháng mười một năm 2025"), 2024))) == (2025, 11, None)
    assert tuple(s(period(F.lit("Quý I/2025"), 2024))) == (2024, None, 1)


def test_emotion_rules(spark):
    df = spark.createDataFrame([(1, "rất vui"), (2, "không vui"), (3, "hơi vui"), (4, ""), (5, None), (6, "vui"), (7, "theo")], "id int, t string")
    rows = {r["id"]: r for r in classify.emotion_scores(df, "t", lexicon.emotion_table(spark)).select("id", F.col("scores")[0]["score"].alias("joy")).collect()}
    assert [round(rows[i]["joy"] or 0, 3) for i in (1, 2, 3, 6)] == [1.5, 0.0, 0.7, 1.0]
    done = {r["id"]: r for r in classify.analyze_emotion(df, "t").collect()}
    assert (done[6]["emotion"], done[6]["sentiment_group"]) == ("vui_mừng", "positive")
    assert (done[4]["emotion"], done[4]["confidence"]) == ("trung_lập", 0.6)
    assert (done[5]["emotion"], done[5]["confidence"]) == ("trung_lập", 0.6)
    assert done[6]["confidence"] == round(min(0.95, 0.4 + 1 / 1.11 * 0.6), 4)
    # One neutral word scores 0.5, just enough to count.
    assert done[7]["emotion"] == "trung_lập"


def test_category_ties_go_to_the_first(spark):
    table = lexicon.category_table(spark, {"b": ["x y"], "a": ["x", "y"]})
    df = spark.createDataFrame([(1, "x y", None), (2, "zzz", None), (3, None, "y")], "id int, content string, title string")
    rows = {r["id"]: r for r in classify.classify_category(df, "content", "title", table).collect()}
    assert rows[1]["category"] == "b" and rows[1]["category_confidence"] == round(0.3 + 0.2 * 0.65, 4)
    assert rows[2]["category"] == "khac" and rows[2]["category_confidence"] == 0.5
    assert rows[3]["category"] == "a"


def mention(i, ts, topic, group, name=None):
    return (i, ts, topic, name or f"t{topic}", "a.vn", group, group, f"title {i}")


SCHEMA = "article_id int, published_at timestamp_ntz, topic_id int, topic_name string, source_domain string, emotion string, sentiment_group string, title string"


def test_alert_edges(spark):
    now, cur, old = datetime(2024, 1, 3), datetime(2024, 1, 2, 12), datetime(2024, 1, 1, 12)
    rows, n = [], 0

    def put(topic, when, count, negative=0):
        nonlocal n
        for k in range(count):
            rows.append(mention(n, when, topic, "negative" if k < negative else "neutral"))
            n += 1

    put(0, cur, 10)                       # new topic with id 0: +100 %
    put(1, cur, 15); put(1, old, 10)      # exactly +50 %: no spike
    put(2, cur, 5); put(2, old, 10)       # exactly -50 %: no drop
    put(3, old, 12)                       # vanished
    put(4, cur, 5, 2)                     # exactly 40 % negative: no crisis
    put(5, cur, 5, 3)                     # 60 %: medium
    put(6, datetime(2024, 1, 2), 10)      # on the boundary: current only
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["alert_type"], r["topic_id"], r["alert_level"]) for r in trends.alerts(df, now).collect()}
    assert found == {("spike", 0, "low"), ("spike", 6, "low"), ("drop", 3, "low"), ("crisis", 5, "medium")}


def test_hot_topics_without_a_past(spark):
    df = spark.createDataFrame([mention(i, datetime(2024, 1, 16), 0, "negative" if i == 0 else "positive") for i in range(4)], SCHEMA)
    row = marts.hot_topics(df, "weekly", date(2024, 1, 17)).first()
    assert (row["mention_velocity"], row["hot_score"], row["is_hot"], row["crisis_score"], row["is_crisis"]) == (1.0, 8.0, True, 0.25, False)
    assert row["sample_titles"] == ["title 0", "title 1", "title 2", "title 3"]
    assert marts.hot_topics(df, "weekly", date(2023, 1, 1)).count() == 0


def test_counts_add_up(spark):
    from newsloom.plans import fixtures

    m = fixtures.mentions(spark, "/root/testdata/sf0.001")
    for row in marts.topic_mentions(m, "weekly", date(2024, 1, 17)).collect():
        assert row["positive_count"] + row["negative_count"] + row["neutral_count"] == row["mention_count"] == sum(row["emotion_distribution"].values())
    ranks = sorted(r["rank_by_negative"] for r in marts.topic_mentions(m, "weekly", date(2024, 1, 17)).collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_overall_rank_equals_a_sort(spark):
    rows = [(i % 3, (i * 37) % 50, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    ranked = {r["k"]: r["rank"] for r in ranking.overall_rank(df, [F.desc("v"), F.col("k")]).collect()}
    expected = {k: i for i, (_, _, k) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    assert ranked == expected
    grouped = {r["k"]: r["rank"] for r in ranking.overall_rank(df, [F.desc("v"), F.col("k")], group=["g"]).collect()}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [grouped[r[2]] for r in own] == list(range(1, len(own) + 1))


def test_drift_bounds(spark):
    day = lambda d: datetime(2024, 1, d)
    same = spark.createDataFrame([mention(i, day(10 if i % 2 else 28), i // 2 % 2, "neutral") for i in range(8)], SCHEMA)
    apart = spark.createDataFrame([mention(1, day(10), 0, "neutral"), mention(2, day(28), 1, "neutral")], SCHEMA)
    empty = same.filter("article_id < 0")
    value = lambda df: topics.drift(df, "topic_id", "published_at", date(2024, 1, 31)).first()["drift"]
    assert value(same) == 0 and value(apart) == 1 and value(empty) == 0


def test_keyed_load_modes(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", 2, 2)], "k string, q int, v int")
    new = spark.createDataFrame([("a", None, None), ("b", None, 5), ("b", 2, 7), ("b", 2, 9)], "k string, q int, v int").withColumn("o", F.col("v"))
    got = lambda mode: {(r["k"], r["q"]): (r["v"], r["action"]) for r in merge.keyed_load(old, new, ["k", "q"], mode, order=["o"]).collect()}
    assert got("update") == {("a", None): (1, "updated"), ("b", 2): (7, "updated"), ("b", None): (5, "inserted")}
    assert got("fill") == {("a", None): (1, "updated"), ("b", 2): (2, "updated"), ("b", None): (5, "inserted")}
    assert got("skip") == {("a", None): (1, "skipped"), ("b", 2): (2, "skipped"), ("b", None): (5, "inserted")}


def test_validation_messages(spark):
    rows = [("https://a.vn", "0123456789", "t", datetime(2024, 1, 1), 1), (None, "012345678", " ", None, -1), ("ftp://a", None, "t", datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "url string, content string, title string, published_at timestamp, likes bigint")
    got = [r["errors"] for r in normalize.validate(df).collect()]
    assert got == [[], ["Missing URL", "Content too short or missing", "Missing title", "Missing published date", "Negative likes count"],
                   ["Content too short or missing", "Invalid URL format"]]


def test_envelopes_of_every_shape(spark, tmp_path):
    record = '{"url": "https://a.vn/%d", "content": "nội dung", "id": %d}'
    (tmp_path / "a.json").write_text('{"data_type": "x", "records": [%s, %s]}' % (record % (1, 1), record % (2, 2)))
    (tmp_path / "b.json").write_text('{"data": [%s]}' % (record % (3, 3)))
    (tmp_path / "c.json").write_text("[%s, %s]" % (record % (4, 4), record % (5, 5)))
    (tmp_path / "d.json").write_text(record % (6, 6))
    rows = files.read_envelopes(spark, str(tmp_path), mappers.raw_schema("newspaper"))
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3, 4, 5, 6]


def test_csv_casts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("year,grdp,province\n2024, 1.5,Hưng Yên\nx,,\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), {"year": "int", "grdp": "double"}).collect()
    assert [tuple(r) for r in rows] == [(2024, 1.5, "Hưng Yên"), (None, None, None)]


def test_processed_output(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", -1)], "source_type string, v int")
    stats = files.write_processed(df, str(tmp_path / "out"), valid=F.col("v") > 0)
    assert stats == {"total": 3, "success": 2, "failed": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_main_text():
    body = "nội dung " * 40
    page = f"<html><nav>menu</nav><div class='top-menu'>x</div><article><script>var a;</script><p>{body}</p><footer>f</footer></article></html>"
    assert html.main_text(page) == body.strip()
    assert html.main_text("<p>short</p>") is None
    assert html.main_text(f"<div class='post-content'>ngắn</div><p>{body}</p>") == body.strip()
    assert html.main_text(None) is None


def test_spacing_and_budget(spark):
    assert one(spark, search.spaced(F.array(*[F.lit(x) for x in (100, 300, 520, 950)]), 400, 2)) == [100, 520]
    df = spark.createDataFrame([(1, "g", 5), (2, "g", 6), (3, "g", 1)], "k int, g string, n int")
    assert [r["k"] for r in search.within_budget(df, ["g"], [F.col("k")], "n", 10).collect()] == [1]


def test_ranges(spark):
    err = lambda name, v, yearly=False: one(spark, panel.range_errors(F.lit(name), F.lit(v), F.lit(yearly), F.lit(5.0), F.lit(4)))
    assert err("retail", 150000.0) == [] and err("retail", 150001.0) == ["value out of range"]
    assert err("retail", 600000.0, True) == [] and err("cpi", 121.0, True) == ["value out of range"]
    assert err("iip", -5.0) == [] and err("unknown", 1.0) == []


def test_class_scores_are_never_negative(spark):
    df = spark.createDataFrame([(1, "alpha beta", 0), (2, "alpha beta", 0), (3, "gamma delta", 1)], "id int, t string, label int")
    assert all(r["score"] >= 0 for r in mining.class_tfidf_phrases(df, "t", "label", max_df=1.0).collect())


def test_sections_and_entities(spark):
    from newsloom.operators import entities

    df = spark.createDataFrame([(1, "Mở đầu\n1. Tăng trưởng kinh tế\nnội dung\nII. Nông nghiệp\nkhác")], "id int, t string")
    rows = entities.sections(df, "id", "t").orderBy("section").collect()
    assert [r["title"].split("\n")[0] for r in rows] == ["1. Tăng trưởng kinh tế", "II. Nông nghiệp"]
    text_row = spark.createDataFrame([(1, "Ông Nguyễn Văn An ở tỉnh Hưng Yên, ngày 14/09/2025 nhận 5 tỷ đồng tại Hà Nội")], "id int, t string")
    fast = {(r["type"], r["entity"]) for r in entities.extract_entities(text_row, "id", "t").collect()}
    slow = {(r["type"], r["entity"]) for r in entities.extract_entities(text_row, "id", "t", offsets=True).collect()}
    assert fast == slow and ("PERSON", "Ông Nguyễn Văn An") in fast and ("LOCATION", "Hà Nội") in fast


def test_sources_map_to_one_schema(spark, tmp_path):
    import json

    meta = {"reactions": {"like": 3, "love": 2}, "reshare_count": 4, "comments_count": 1, "timestamp": 1704067200, "author": {"id": "7", "name": "A"},
            "album_preview": [{"type": "photo", "image_file_uri": "p1"}, {"type": "video", "url": "v1"}], "image": "p2"}
    (tmp_path / "f.json").write_text(json.dumps({"records": [{"url": "https://facebook.com/a/1", "id": 5, "content": "x" * 120, "meta_data": meta},
                                                            {"url": "", "content": "y" * 20}, {"url": "https://facebook.com/b", "content": "ngắn"}]}))
    raw = files.read_envelopes(spark, str(tmp_path / "f.json"), mappers.raw_schema("facebook"))
    rows = mappers.map_sources({"facebook": raw}).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["likes_count"], r["shares_count"], r["comments_count"], r["account_name"], r["post_type"]) == (5, 4, 1, "A", "post")
    assert r["title"] == "x" * 100 + "..." and r["images"] == ["p1", "p2"] and r["videos"] == ["v1"]
    assert r["published_date"] == 1704067200.0


def test_null_emotions_and_groups(spark):
    from datetime import date, datetime

    from newsloom.operators import marts

    at = datetime(2024, 1, 17, 5)
    rows = [(1, at, 7, "t", "a.vn", None, "neutral"), (2, at, 7, "t", "a.vn", "joy", "positive"), (3, at, 7, "t", None, None, None)]
    df = spark.createDataFrame(rows, "article_id long, published_at timestamp_ntz, topic_id int, topic_name string, source_domain string, emotion string, sentiment_group string")
    report = marts.trend_report(df, "daily", date(2024, 1, 17)).first()
    assert report["emotion_distribution"] == {"joy": 1} and report["total_mentions"] == 3
    assert marts.hot_topics(df, "daily", date(2024, 1, 17)).first()["dominant_emotion"] == "joy"
    assert marts.topic_mentions(df, "daily", date(2024, 1, 17)).first()["dominant_emotion"] == "joy"


def test_no_value_is_cut(spark):
    from newsloom.operators import marts

    rows = spark.range(1001).selectExpr("'k' as k", "cast(id as string) as v")
    assert len(marts.count_map(rows, "k", "v", "m").first()["m"]) == 1001
    long_word = spark.createDataFrame([("x" * 12000 + " yy",)], "t string")
    assert {r["word"] for r in marts.keyword_counts(long_word, "t", None, []).collect()} == {"x" * 12000}


def test_large_lookup_tables_are_refused_before_they_are_gathered(spark):
    import pytest
    from newsloom.functions.columns import attach_table

    df = spark.range(3).toDF("x")
    assert len(attach_table(df, spark.range(5), "t", 5).first()["t"]) == 5
    with pytest.raises(Exception, match="more than 5 rows"):
        attach_table(df, spark.range(6), "t", 5).collect()


def test_running_total(spark):
    from pyspark.sql import functions as F
    from newsloom.operators.ranking import running_total

    rows = running_total(spark.range(1000).withColumn("g", F.col("id") % 3), "id", [F.desc("id")], "s", ["g"]).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: -r["id"]):
            total += r["id"]
            assert r["s"] == total


def test_contexts(spark):
    from newsloom.operators import indicators as N

    filler = "x" * 2000
    text = f"bán lẻ đạt 5 tỷ {filler} Tổng mức bán lẻ cả năm tăng 7% {filler} bán lẻ"
    df = spark.createDataFrame([(1, text, "retail", 2024), (2, "không có gì", "retail", 2024), (3, None, "retail", None)], "id long, t string, indicator string, y int")
    rows = N.keyword_contexts(df, "id", "t", year="y").orderBy("id", "rank").collect()
    assert [(r["id"], r["rank"]) for r in rows] == [(1, 1), (1, 2)]
    assert "Tổng mức" in rows[0]["context"] and rows[1]["position"] == 0
    assert text[rows[0]["position"]:].lower().startswith(("bán lẻ", "tổng mức bán lẻ"))
