"""Readers on small files, and rules that SQL doesn't cover."""

import json

import numpy as np
import pytest

from tallywind.functions import dates, text
from tallywind.operators import frequency, search, series
from tallywind.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_articles_and_dead_letters(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    whole = [{"an": "a1", "title": None, "body": "one\ntwo"}, {"an": "a2", "title": "T", "body": ""}]
    for i, a in enumerate(whole):
        (tmp_path / "deep" / f"ft-{i}.JSON").write_text(json.dumps(a, indent=1))
    (tmp_path / "broken.json").write_text('{"an": "a3", "title": ')
    (tmp_path / "empty.json").write_text(" \n")
    (tmp_path / "other.txt").write_text("{}")
    got, dead = readers.articles(spark, str(tmp_path))
    assert got.count() == 2 and {(r.an, r.title, r.body, r.name) for r in got.collect()} == {("a1", None, "one\ntwo", "ft-0.JSON"), ("a2", "T", "", "ft-1.JSON")}
    assert dead.count() == 2 and {r.path.rsplit("/")[-1] for r in dead.collect()} == {"broken.json", "empty.json"} and {r.error_type for r in dead.collect()} == {"corrupt"}
    assert readers.articles(spark, str(tmp_path), "ft-*")[0].count() == 2
    (tmp_path / "lines.jsonl").write_text("\n".join([*map(json.dumps, whole), "{bad", "", json.dumps({"an": "a4"})]))
    got, dead = readers.articles(spark, str(tmp_path), "*.jsonl", lines=True)
    assert [r.an for r in got.orderBy("an").collect()] == ["a1", "a2", "a4"] and [r.text for r in dead.collect()] == ["{bad"]


def test_country_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<all><Country><countryname>New_Land</countryname><nationality>\nNewlander\nLander\n</nationality><capital>Port_Town</capital><majorcities>\nPort Town\nHill\n</majorcities></Country><Country><countryname>Old</countryname></Country></all>")
    got = {(r.country, r.alias) for r in readers.country_aliases(spark, str(tmp_path / "c.xml")).collect()}
    assert got == {("new land", x) for x in ("new land", "newlander", "lander", "port town", "hill")} | {("old", "old")}


def test_other_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "k.csv").write_text("fear,risk\nfear,threat\n,financial&crisis\n")
    assert {(r.grp, tuple(r.term)) for r in readers.keyword_groups(spark, str(tmp_path / "k.csv")).collect()} == {("fear", ("fear",)), ("risk", ("threat",)), ("risk", ("financial", "crisis"))}
    (tmp_path / "i.json").write_text(json.dumps({"issue": "x", "articles": [{"title": "t", "paras": ["a- \nb", "c", "d"]}]}))
    assert [(r.an, r.title, r.snippet, r.body) for r in readers.issues(spark, str(tmp_path / "i.json")).collect()] == [("i.json-0", "t", "ab c", "ab c d")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.json", "[1]")
        z.writestr("c.txt", "no")
    known = spark.createDataFrame([("a.json",)], "member string")
    assert [(r.member, r.content) for r in readers.zipped_json(spark, str(tmp_path / "z.zip"), known).collect()] == [("b.json", "[1]")]
    entry = {"title": "t", "link": "l", "published_parsed": [2020, 5, 6], "extracted_content": {"bodyXML": "one two"}}
    (tmp_path / "site_2020-01_2020-02.json").write_text(json.dumps([entry, {"title": "u"}]))
    got = readers.scraped_news(spark, str(tmp_path / "site_2020-01_2020-02.json")).orderBy("title").collect()
    assert [(r.newspaper_name, r.time_end, r.year, r.day, r.body, r.body_length) for r in got][0] == ("site", "2020-02", 2020, 6, "one two", 2) and got[1].body is None
    df = spark.createDataFrame([('"{\\"a\\": 1}"',)], "j string")
    assert [tuple(r) for r in readers.twice_encoded(df, "j", "a int").collect()] == [(1,)]
    data = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    readers.write_partitioned(data, str(tmp_path / "out"), "k")
    readers.write_partitioned(data.where("k = 'b'").selectExpr("x + 5 as x", "k"), str(tmp_path / "out"), "k")
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 7]


def dense_trend(x, smooth):
    n = len(x)
    d = np.zeros((n - 2, n))
    for i in range(n - 2):
        d[i, i : i + 3] = 1, -2, 1
    return np.linalg.solve(np.eye(n) + smooth * d.T @ d, x)


@pytest.mark.parametrize("n", [3, 4, 7, 80])
def test_trend_is_the_dense_solution(n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    for smooth in (100.0, 1600.0, 14400.0):
        assert np.allclose(series.hp_trend(x, smooth), dense_trend(x, smooth), atol=1e-6)


def test_anomalies_match_numpy(spark):
    rng = np.random.default_rng(42)
    x = np.sin(np.linspace(0, 20, 200)) + 0.02 * rng.normal(size=200)
    x[[50, 120, 170]] += 3.0
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("a", 200, None), ("b", 0, 1.0)]
    got = {(r.k, r.t): r for r in series.hp_mad(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v", alpha=0.01).collect()}
    gap = x - dense_trend(x, 1600.0)
    score = np.abs(gap - np.median(gap)) / np.abs(gap - gap.mean()).mean()
    limit = score.mean() + score.std(ddof=1) * np.log(2 / 0.01)
    assert [got["a", i].anomaly for i in range(200)] == (score > limit).astype(int).tolist() and {50, 120, 170} <= {i for i in range(200) if got["a", i].anomaly}
    assert np.allclose([got["a", i].score for i in range(200)], score) and got["a", 200].score is None and got["a", 200].anomaly == 0 == got["b", 0].anomaly


def test_text_functions(spark):
    F = text.F
    assert one(spark, text.clean_tokens(F.array(*map(F.lit, ["growth!", "(market)", "interest_rate", "year2020", "the", "with", "abc", "x" * 21, "NUMBERs", "plain", "«mot"])))) == ["interest_rate", "year2020", "plain"]
    assert one(spark, text.chunks(F.array(*map(F.lit, range(5))), 2)) == [[0, 1], [2, 3], [4]]
    assert one(spark, text.title_case(F.lit("guinea-bissau of new"))) == "Guinea-Bissau Of New"
    assert one(spark, text.token_price(F.lit("model-4-mini"), F.lit(500), {"model": 1.0, "model-4": 2.0})) == 1.0
    assert abs(one(spark, text.similarity(F.lit("abcd"), F.lit("abxd"))) - 0.75) < 1e-9
    joined = frequency.join_phrases(spark.createDataFrame([(["a", "b", "c", "a", "b"],), (None,), ([],), (["a", None, "b"],)], "w array<string>"), "w", frequency.Phrases([[("a", "b")], [("a_b", "c")]]))
    assert [r.w for r in joined.collect()] == [["a_b_c", "a_b"], None, [], ["a_b"]]
    df = spark.createDataFrame([(1, ",asiaz,china,", "x"), (2, "NA", "the Chinese"), (3, "NA", None)], "i int, r string, t string")
    assert [r.i for r in df.where(search.region_or_title(F.col("r"), ["china"], F.col("t"), ["chinese"])).collect()] == [1, 2]
    assert search.overlap_groups(["climate change", "climate change review", "copper"]) == (["climate change review", "copper"], ["climate change"])
    sample = spark.createDataFrame([(1, "this is about climate change review Climate policy")], "i int, t string")
    assert {(r.keyword, r.n) for r in search.overlapping_counts(sample, "i", "t", ["climate", "climate change", "climate change review"]).collect()} == {("climate change review", 1), ("climate change", 1), ("climate", 1)}


def test_dates(spark):
    F = text.F
    day = lambda c: str(one(spark, c))
    assert [day(dates.article_date(F.lit(x))) for x in ("2020-02-03", "1580688000000", "no")] == ["2020-02-03", "2020-02-03", "None"]
    assert day(dates.issue_date(F.lit("issue: date: February 21, 1998, page: 0038"))) == "1998-02-21"
    assert [day(dates.half_year(F.lit(x))) for x in ("1990:1", "1990:2")] == ["1990-01-01", "1990-07-01"]
    assert [day(dates.crisis_token(F.lit(x), 12)) for x in ("1998-06", "1998")] == ["1998-06-01", "1998-12-01"]
    with pytest.raises(Exception, match="not a month"):
        day(dates.crisis_token(F.lit("19980601x"), 1))
    assert day(dates.js_date(F.lit("/Date(1580688000000)/"))).startswith("2020-02-03")
    assert [str(x) for x in one(spark, dates.month_starts(F.lit("2020-01-15").cast("date"), F.lit("2020-03-01").cast("date")))] == ["2020-01-01", "2020-02-01", "2020-03-01"]
    rows = spark.createDataFrame([("x", "1998-06&2001", "1999-02&2002")], "country string, start string, end string")
    assert [(r.seq, str(r.start), str(r.peak)) for r in readers.crisis_dates(rows).collect()] == [(0, "1998-06-01", "1999-02-01"), (1, "2001-01-01", "2002-12-01")]


def test_dead_letters_of_raw_articles(spark):
    from tallywind.operators import corpus

    rows = [("http://x/thing/ABC-1", "T", "2020-01-02T03:04", "<p>one two</p>", None), ("http://x/thing/abc-1", "T2", "2020-01-03T00:00", "<p>later</p>", "u"), ("x/2", None, "2020-01-01T", "<p>b</p>", "u"), ("x/3", "T", "2020-01-01T", None, "u"), ("x/4", "T", "2020-01-01T", "<p></p>", "u")]
    good, dead = corpus.canonical(spark.createDataFrame(rows, "id string, title string, publishedDate string, bodyXML string, webUrl string"), "feed", "ft-")
    assert [(r.an, r.title, r.publication_date, r.body, r.snippet, r.weburl) for r in good.collect()] == [("ft-abc-1", "T2", "2020-01-03", "later", "later", "u")]
    assert sorted(map(tuple, dead.collect())) == [("ft-2", "no title"), ("ft-3", "no body"), ("ft-4", "empty body")]


def test_outcomes_by_hand(spark):
    from tallywind.operators import evaluate

    F = text.F
    spikes = spark.createDataFrame([(1.0, "a", "1998-01-01"), (1.0, "a", "1998-08-01"), (1.0, "a", "2005-01-01"), (1.0, "b", "1990-01-01"), (2.0, "a", "1997-06-01")], "k double, country string, p string").select("k", "country", F.to_date("p").alias("period"))
    crises = spark.createDataFrame([("a", 1, "1998-06-01", "1999-02-01"), ("a", 2, "1999-10-01", "2000-03-01"), ("c", 1, "1998-06-01", "1999-02-01")], "country string, seq int, s string, e string").select("country", "seq", F.to_date("s").alias("start"), F.to_date("e").alias("peak"))
    grid = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "k double")
    got = {(r.k, r.country): (r.tp, r.fp, r.fn) for r in evaluate.outcomes(spikes, crises, ["k"], grid=grid).collect()}
    assert got == {(1.0, "a"): (3, 1, 0), (1.0, "b"): (0, 1, 0), (1.0, "c"): (0, 0, 1), (2.0, "a"): (1, 0, 1), (2.0, "c"): (0, 0, 1), (3.0, "a"): (0, 0, 2), (3.0, "c"): (0, 0, 1)}


def test_small_rules(spark):
    from tallywind.operators import corpus

    F = text.F
    assert one(spark, corpus.sliding(F.array(*map(F.lit, "abcde")), 3)) == [["a", "b", "c"], ["c", "d", "e"]] and one(spark, corpus.sliding(F.array(F.lit("a")), 3)) == []
    profiles = {"en": ["the", "and"], "fr": ["les", "une"]}
    assert [one(spark, corpus.language(F.lit(x), profiles)) for x in ("the les the thing", "une et les the", "short the", "nothing that is known")] == ["en", "fr", "NA", "NA"]
    with pytest.raises(Exception, match="no label for"):
        one(spark, corpus.index_name(F.lit("z"), {"a": "A"}))
    terms, vocabulary = spark.createDataFrame([("climate change",), ("the new tax",), ("zzz",)], "term string"), spark.createDataFrame([(x,) for x in ("climate_change", "climate", "the", "new", "tax")], "token string")
    assert {tuple(r) for r in corpus.search_terms(terms, vocabulary, ["the"]).collect()} == {("climate change", "climate_change"), ("the new tax", "new&tax")}
