"""Topics by clustering, their words and coherence; training over panels and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import save


def class_tfidf(tokens: DataFrame, group: str, token: str) -> DataFrame:
    """M-12: (group, token, n, weight): n * ln(1 + A / f), f a word's count in all groups, A the mean words of a group."""
    n = tokens.groupBy(group, token).agg(F.count(F.lit(1)).alias("n"))
    f = n.groupBy(token).agg(F.sum("n").alias("f"))
    a = n.agg((F.sum("n") / F.count_distinct(group)).alias("a"))  # one row
    return n.join(f, token).crossJoin(F.broadcast(a)).select(group, token, "n", (F.col("n") * F.log1p(F.col("a") / F.col("f"))).alias("weight"))


def cv_coherence(docs: DataFrame, doc: str, words: str, topics: DataFrame, window: int = 110, eps: float = 1e-12) -> DataFrame:
    """A-32: c_v by topic. docs(doc, words array), topics(topic, rank, word): short lists.

    Windows of `window` words slide by one; a shorter document is one window. A word's vector has its normalised
    pointwise mutual information with each word of the topic; the coherence is the mean cosine of the words' vectors to
    their sum. Windows aren't made: a word at p is in those that start in (p - window, p], less what its last place
    covered, so that each place adds one range of starts. Ranges are cut at multiples of the window before they meet."""
    t = F.broadcast(topics)
    size = docs.select(F.sum(F.when(F.size(words) > 0, F.greatest(F.size(words) - window, F.lit(0)) + 1)).alias("all"))
    at = docs.select(doc, F.size(words).alias("len"), F.posexplode(words).alias("p", "word")).join(F.broadcast(topics.select("word").distinct()), "word", "left_semi")
    before = F.lag("p").over(Window.partitionBy(doc, "word").orderBy("p"))
    low = F.greatest(F.col("p") - window + 1, F.coalesce(before + 1, F.lit(0)), F.lit(0))
    ranges = at.withColumn("a", low).withColumn("b", F.least("p", F.greatest(F.col("len") - window, F.lit(0)))).where("a <= b").select(doc, "word", "a", "b")
    cut = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / window), F.floor(F.col("b") / window))))
    cut = cut.select(doc, "word", "block", F.greatest("a", F.col("block") * window).alias("a"), F.least("b", (F.col("block") + 1) * window - 1).alias("b"))
    single = ranges.groupBy("word").agg(F.sum(F.col("b") - F.col("a") + 1).alias("d"))
    pairs = topics.select("topic", F.col("word").alias("x")).join(topics.select("topic", F.col("word").alias("y")), "topic").where("x != y")
    wanted = F.broadcast(pairs.select("x", "y").distinct())
    x, y = (cut.select(doc, "block", F.col("word").alias(n), F.col("a").alias(f"{n}a"), F.col("b").alias(f"{n}b")) for n in "xy")
    shared = F.least("xb", "yb") - F.greatest("xa", "ya") + 1
    both = x.join(y, [doc, "block"]).where("x < y and xa <= yb and ya <= xb").groupBy("x", "y").agg(F.sum(shared).alias("dxy"))
    mutual = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "dxy")).join(wanted, ["x", "y"], "left_semi")
    mutual = mutual.unionByName(single.select(F.col("word").alias("x"), F.col("word").alias("y"), F.col("d").alias("dxy")))
    square = topics.select("topic", F.col("word").alias("x")).join(topics.select("topic", F.col("word").alias("y")), "topic")
    full = square.join(mutual, ["x", "y"], "left").join(single.select(F.col("word").alias("x"), F.col("d").alias("dx")), "x", "left").join(single.select(F.col("word").alias("y"), F.col("d").alias("dy")), "y", "left").crossJoin(F.broadcast(size))
    p = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("all")
    joint = p("dxy") + eps
    npmi = F.when((p("dx") > 0) & (p("dy") > 0), F.log(joint / (p("dx") * p("dy"))) / -F.log(joint)).otherwise(0.0)
    v = full.select("topic", "x", "y", npmi.alias("v"))
    centre = v.groupBy("topic", "y").agg(F.sum("v").alias("s"))
    cosine = F.try_divide(F.sum(F.col("v") * F.col("s")), F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("s") * F.col("s"))))
    per_word = v.join(centre, ["topic", "y"]).groupBy("topic", "x").agg(F.coalesce(cosine, F.lit(0.0)).alias("cosine"))
    return per_word.groupBy("topic").agg(F.avg("cosine").alias("coherence"))


def _features(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def components(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """F-71: df with `components`, its vectors' k main components. The driver holds the dimensions' covariance only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _features(df, vector)
    found = PCA(k=k, inputCol="features", outputCol="components").fit(v).transform(v)
    return found.withColumn("components", vector_to_array("components")).drop("features")


def cluster_topics(df: DataFrame, vector: str, k: int, dimensions: int = 5, seed: int = 1) -> DataFrame:
    """M-12: df with `cluster`, of k-means on main components (in place of UMAP and HDBSCAN, which Spark lacks)."""
    from tallywind.operators.models import clusters

    return clusters(components(df, vector, dimensions), "components", k, seed).drop("components")


def _rotated(m):
    """Arrays times a small matrix."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, m.shape[0]) @ m
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], [b.schema.names[0], "v"])

    return run


def latent_topics(weights: DataFrame, doc: str, term: str, weight: str, k: int, terms: int = 10, rounds: int = 8) -> DataFrame:
    """M-05 (LSI): (topic, singular, rank, term, loading) of a truncated singular value decomposition of the document by
    term weights, by subspace iteration: k + 8 directions, with a value for each term, go through the weights and back, and are made
    orthonormal by their products, of which the driver gets (k + 8)^2 numbers. Documents and terms stay tables, of any
    size. With few terms the result is exact; else a topic's error falls with (the k + 9th singular value / its own)^(2 rounds),
    and rounds end where the topics' singular values stay, after `rounds` at most.
    The sign of a topic is such that its largest loading is positive."""
    import numpy as np

    spark = weights.sparkSession
    rows = save(weights.select(F.col(doc).alias("d"), F.col(term).alias("t"), F.col(weight).cast("double").alias("w")).where("d is not null and t is not null and w is not null"), "latent-rows")
    names = rows.select("t").distinct()
    width = names.count()
    r = min(k + 8, width)
    schema = "topic int, singular double, rank int, term string, loading double"
    if not r:
        return spark.createDataFrame([], schema)

    def through(table: DataFrame, size: int, on: str, to: str) -> DataFrame:
        return save(rows.join(table, on).groupBy(to).agg(F.array(*(F.sum(F.col("w") * F.col("v")[i]) for i in range(size))).alias("v")), "latent")

    def products(table: DataFrame, size: int) -> np.ndarray:
        found = table.agg(F.array(*(F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(size) for j in range(size))).alias("g")).first().g
        return np.array(found).reshape(size, size)

    def turned(table: DataFrame, m: np.ndarray) -> DataFrame:
        return save(table.mapInArrow(_rotated(m), table.schema), "latent")

    def orthonormal(table: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
        value, vector = np.linalg.eigh(products(table, size))
        keep = value > 1e-13 * value.max()
        return turned(table, vector[:, keep] / np.sqrt(value[keep])), value[keep][::-1]

    x, value = orthonormal(save(names.select("t", F.array(*((F.pmod(F.xxhash64("t", F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1) for i in range(r))).alias("v")), "latent"), r)
    for _ in range(rounds if r < width else 1):
        before = value[:k]
        x, value = orthonormal(through(through(x, len(value), "t", "d"), len(value), "d", "t"), len(value))
        if len(before) == len(value[:k]) and np.allclose(before, value[:k], rtol=1e-6):
            break
    value, vector = np.linalg.eigh(products(through(x, len(value), "t", "d"), len(value)))
    best = np.argsort(-value)[:k]
    told = turned(x, vector[:, best]).select(F.col("t").alias("term"), F.posexplode("v").alias("topic", "loading"))
    ends = told.groupBy("topic").agg(F.max("loading").alias("high"), F.min("loading").alias("low"))  # a row a topic
    singular = spark.createDataFrame([(i, float(np.sqrt(max(value[b], 0.0)))) for i, b in enumerate(best)], "topic int, singular double")
    signed = told.join(ends, "topic").join(singular, "topic").withColumn("loading", F.when(F.abs("high") >= F.abs("low"), F.col("loading")).otherwise(-F.col("loading")))
    order = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.abs("loading")), "term"))
    return signed.withColumn("rank", order - 1).where(F.col("rank") < terms).select("topic", "singular", "rank", F.col("term").cast("string").alias("term"), "loading")


def panel_cv(df: DataFrame, entity: str, vector: str, label: str, k: int = 5, estimator=None) -> DataFrame:
    """M-11: df with fold and prediction; each fold's rows are predicted by a model of the other folds, and an entity's
    rows are in one fold (S-12). estimator: any of Spark ML's classifiers; a logistic regression if none is given."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression

    from tallywind.operators.panel import folds

    model = estimator or LogisticRegression(maxIter=50)
    rows = _features(df, vector).join(F.broadcast(folds(df, entity, k)), entity).withColumn("_y", F.col(label).cast("double"))
    model = model.copy({model.featuresCol: "features", model.labelCol: "_y"})
    parts = [model.fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i)).select(*df.columns, "fold", "prediction") for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def accuracy(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """A-29: rows and the share predicted right."""
    hit = F.avg((F.col(label).cast("double") == F.col(prediction)).cast("double"))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), hit.alias("accuracy"))


def grid_search(df: DataFrame, entity: str, vector: str, label: str, grid: dict[str, list], estimator, k: int = 3, metric: str = "accuracy") -> DataFrame:
    """M-13, A-33: (params, metric) of each combination, the mean over k panel folds, the best first."""
    import itertools
    import json

    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    from tallywind.operators.panel import folds

    rows = _features(df, vector).join(F.broadcast(folds(df, entity, k)), entity).withColumns({"_y": F.col(label).cast("double"), "fold": F.col("fold").cast("int")})
    combinations = [dict(zip(grid, c, strict=True)) for c in itertools.product(*grid.values())]
    maps = [{estimator.getParam(n): v for n, v in c.items()} for c in combinations]
    judge = MulticlassClassificationEvaluator(labelCol="_y", metricName=metric)
    model = estimator.copy({estimator.featuresCol: "features", estimator.labelCol: "_y"})
    found = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=judge, numFolds=k, foldCol="fold").fit(rows).avgMetrics
    scored = [(json.dumps(c, sort_keys=True), float(m)) for c, m in zip(combinations, found, strict=True)]
    return df.sparkSession.createDataFrame(sorted(scored, key=lambda s: (-s[1], s[0])), f"params string, {metric} double")


def normed(df: DataFrame, keys: list[str], period: str, value: str, corpus: DataFrame) -> DataFrame:
    """W-15: every month of corpus(period, value) between its first and last for each key, and the key's value less the
    corpus's; null where either has none. A corpus has a row a month, so that its months are broadcast."""
    ends = corpus.agg(F.min(period).alias("a"), F.max(period).alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(period)).join(corpus.select(period, F.col(value).alias("_all")), period, "left")
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(months))
    return frame.join(df.select(*keys, period, value), [*keys, period], "left").withColumn("normed", F.col(value) - F.col("_all")).drop("_all")


def sampled(key: Column, share: float, seed: int = 1) -> Column:
    """S-11, SNK-16: whether a key falls into a share of all keys, the same in every run and for every layout."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def outlier_share(df: DataFrame, cluster: str, outlier: int = -1) -> DataFrame:
    """A-30: (topics, outlier_percent): the clusters, and the share of rows in none."""
    none = F.col(cluster) == outlier
    return df.agg(F.count_distinct(F.when(~none, F.col(cluster))).alias("topics"), (100 * F.count_if(none) / F.count(F.lit(1))).alias("outlier_percent"))
