import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallywind.functions import dimensions, identify
from tallywind.operators import evaluate
from tallywind.sources import stored


def test_versions_come_and_go(spark, tmp_path):
    path = str(tmp_path / "m")
    texts = spark.createDataFrame([("the house and the tree", "en"), ("das haus und der baum", "de")], "t string, l string")
    profiles, languages = identify.learn(texts, "t", "l")
    assert stored.keep(path, {"languages": languages}, {"profiles": profiles}) == 1
    got = stored.load(spark, path)
    assert got.version == 1 and got.settings == {"languages": ["de", "en"]} and sorted(got.tables["profiles"].collect()) == sorted(profiles.collect())
    new = spark.createDataFrame([(1, "the tree and the house"), (2, "der baum und das haus")], "k long, t string")
    assert {r.k: r.language for r in identify.identify(new, "k", "t", got.tables["profiles"], got.settings["languages"]).collect()} == {1: "en", 2: "de"}
    with pytest.raises(Exception, match="lost"):
        stored.keep(path, {}, {"a": texts.limit(0), "b": texts.select(F.raise_error(F.lit("lost")).alias("x"))})
    assert stored.versions(path) == [1] and os.path.isdir(f"{path}/v00000002")
    assert stored.keep(path, {}, {"none": texts.limit(0)}) == 3
    empty = stored.load(spark, path)
    assert empty.version == 3 and empty.tables["none"].schema == texts.schema and empty.tables["none"].count() == 0
    assert stored.load(spark, path, 1).settings["languages"] == languages
    os.makedirs(f"{path}/v00000004")
    assert stored.clean(path, 1) == [1, 2] and stored.versions(path) == [3] and os.path.isdir(f"{path}/v00000004")
    for v in (1, 4, 9):
        with pytest.raises(FileNotFoundError):
            stored.load(spark, path, v)
    with pytest.raises(ValueError, match="no name"):
        stored.keep(path, {}, {"../x": texts})
    with pytest.raises(ValueError, match="at least one"):
        stored.clean(path, 0)


def test_spark_models(spark, tmp_path):
    from pyspark.ml.feature import CountVectorizer

    words = spark.createDataFrame([(["a", "b", "a"],), (["b"],)], "w array<string>")
    model = CountVectorizer(inputCol="w", outputCol="v").fit(words)
    stored.keep(str(tmp_path), {}, {}, {"counter": model})
    again = stored.load(spark, str(tmp_path)).models["counter"]
    assert again.vocabulary == model.vocabulary and again.transform(words).collect() == model.transform(words).collect()


def test_fixed_dimensions(spark):
    crises = {(r.country, r.seq): (r.start, r.peak) for r in dimensions.crises(spark).collect()}
    assert len(crises) == 27 and crises["mexico", 2] == (dt.date(1992, 10, 1), dt.date(1996, 3, 1)) and all(a <= b for a, b in crises.values())
    assert dimensions.regions(spark).count() == 20 and dimensions.payment_crises(spark).where("country = 'spain'").count() == 0
    rows = [("mexico", "1992-09-01"), ("mexico", "1992-10-01"), ("mexico", "1994-12-01"), ("mexico", "1996-04-01"), ("nowhere", "1994-12-01"), (None, "1994-12-01"), ("mexico", None), ("mexico", "1992-10-01")]
    df = spark.createDataFrame(rows, "country string, p string").select("country", F.to_date("p").alias("period"), F.lit(5).alias("n"))
    got = evaluate.mark_months(df, dimensions.crises(spark), dimensions.payment_crises(spark).unionAll(dimensions.payment_crises(spark)))
    assert got.columns == ["country", "period", "n", "crisis_window", "bop_crisis"]
    assert sorted((str(r.country), str(r.period), r.crisis_window, r.bop_crisis) for r in got.collect()) == sorted([
        ("mexico", "1992-09-01", 0, 0), ("mexico", "1992-10-01", 1, 0), ("mexico", "1992-10-01", 1, 0), ("mexico", "1994-12-01", 1, 1), ("mexico", "1996-04-01", 0, 0), ("nowhere", "1994-12-01", 0, 0), ("None", "1994-12-01", 0, 0), ("mexico", "None", 0, 0)])


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from tallywind.operators import search

    rng = np.random.default_rng(5)
    values = [float(x) for x in np.round(rng.normal(size=2001), 1)] + [7.25]
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, "y")], "v double, n string").repartition(5)
    shares = [0.0, 0.03, 0.333, 0.5, 0.95, 1.0]
    assert np.allclose(list(search.quantiles(df, "v", shares).first()), np.quantile(values, shares))
    assert list(search.quantiles(df.where("v is null"), "v", [0.5]).first()) == [None]
    assert list(search.quantiles(df.where("v = 7.25"), "v", [0.5]).first()) == [7.25]
    low, high = np.quantile(values, [0.03, 0.95])
    got = search.quantile_band(df, "v")
    assert got.columns == ["v", "n"] and sorted(r.v for r in got.collect()) == sorted(v for v in values if low < v < high)
