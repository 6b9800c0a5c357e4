"""Registered queries on words, sentiment, topic quality, classifiers and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywind.functions import dimensions, identify, tables
from tallywind.functions import language as L
from tallywind.functions import text as T
from tallywind.operators import density, evaluate, frequency, networks, seeded, series, subwords, topics
from tallywind.plans.catalogue import MONTH, MONTHLY, TERMS, TOPICS, UP, WORDS, document_tokens, documents, monthly, query, scores_sql, table, token_rows, z_sql
from tallywind.sources import feeds, matrices, shared, stored
from tallywind.sources.avro import Avro

LEMMAS = {"was": "be", "are": "be", "is": "be", "has": "have", "had": "have", "fue": "ser", "war": "sein"}
LEXICON = {"the": 0.4, "with": 1.9, "than": -2.2, "der": -1.5, "les": 2.3, "los": 0.7, "which": -0.9}
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
VALENCE = "CASE w " + " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in LEXICON.items()) + " ELSE 0 END"
SENTIMENT = f"""s AS (SELECT doc_id, i, list_sum(list_transform(regexp_extract_all(lower(s), '[\\p{{L}}'']+'), lambda w: {VALENCE})) AS v FROM (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS i FROM documents)),
 d AS (SELECT doc_id, avg(coalesce(v, 0) / sqrt(coalesce(v, 0) * coalesce(v, 0) + 15)) AS score FROM s GROUP BY 1)"""
KNOWN = "k(topic, rank, word) AS (VALUES " + ", ".join(f"({t}, {r}, '{w}')" for t, r, w in TOPICS) + ")"


@query(f"SELECT doc_id, CAST(len({SENTENCES}) AS INTEGER) AS n FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(L.sentences(F.col("text"))).alias("n"))


@query(f"WITH {SENTIMENT} SELECT doc_id, round(score, 6) AS score FROM documents LEFT JOIN d USING (doc_id)")
def document_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(L.sentiment(F.col("text"), LEXICON), 6).alias("score"))


@query(f"WITH {SENTIMENT} SELECT {MONTH} AS period, CAST(count(score) AS BIGINT) AS n, round(avg(score), 6) AS score FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1")
def sentiment_by_month(spark, d):
    return documents(spark, d).select("period", L.sentiment(F.col("text"), LEXICON).alias("s")).groupBy("period").agg(F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("score"))


@query(f"""WITH {SENTIMENT}, a AS (SELECT source, {MONTH} AS period, score FROM documents LEFT JOIN d USING (doc_id)), c AS (SELECT period, avg(score) AS corpus FROM a GROUP BY 1), m AS (SELECT source, period, avg(score) AS score FROM a WHERE month(period) <> 4 GROUP BY ALL),
 e AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period FROM c) SELECT source, period, round(score, 6) AS score, round(score - corpus, 6) AS normed FROM (SELECT DISTINCT source FROM a) CROSS JOIN e LEFT JOIN m USING (source, period) LEFT JOIN c USING (period)""")
def normed_sentiment(spark, d):
    rows = documents(spark, d, "source").select("source", "period", L.sentiment(F.col("text"), LEXICON).alias("score"))
    by = rows.where(F.month("period") != 4).groupBy("source", "period").agg(F.avg("score").alias("score"))
    every = topics.normed(by, ["source"], "period", "score", rows.groupBy("period").agg(F.avg("score").alias("score")))
    return every.select("source", "period", F.round("score", 6).alias("score"), F.round("normed", 6).alias("normed"))


@query(f"SELECT doc_id, array_to_string(list_transform({WORDS}, lambda w: CASE w " + " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in LEMMAS.items()) + " ELSE w END), ' ') AS lemmas FROM documents")
def lemmatised(spark, d):
    return table(spark, d, "documents").select("doc_id", L.lemmas(T.words(F.col("text")), LEMMAS).alias("lemmas"))


# Stems have no SQL; tests compare them with published pairs.
@query()
def stem_counts(spark, d):
    """Words are counted first: Python gets each distinct one, not whole texts."""
    words = table(spark, d, "documents").where("lang = 'en'").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.get(L.stems(F.array("word")), F.lit(0)).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


@query(f"""WITH t AS (SELECT source, unnest({WORDS}) AS token FROM documents), n AS (SELECT source, token, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT token, sum(n) AS f FROM n GROUP BY 1), a AS (SELECT sum(n) / count(DISTINCT source) AS a FROM n)
 SELECT source, token, CAST(n AS BIGINT) AS n, round(n * ln(1 + a / f), 5) AS weight FROM n JOIN f USING (token), a""")
def words_by_source(spark, d):
    return topics.class_tfidf(token_rows(spark, d, "source"), "source", "token").withColumn("weight", F.round("weight", 5))


# Every window of every document, as the definition says.
@query(f"""WITH {KNOWN}, b AS (SELECT doc_id, {WORDS} AS words FROM documents), z AS (SELECT sum(greatest(len(words) - 110, 0) + 1) AS total FROM b WHERE len(words) > 0),
 h AS (SELECT doc_id, greatest(len(words) - 110, 0) AS last, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM b),
 s AS (SELECT DISTINCT doc_id, word, unnest(generate_series(greatest(p - 109, 0), least(p, last))) AS start FROM h WHERE word IN (SELECT word FROM k)),
 j AS (SELECT x.word AS x, y.word AS y, count(*) AS n FROM s x JOIN s y USING (doc_id, start) GROUP BY ALL), q AS (SELECT word, count(*) AS n FROM s GROUP BY 1),
 v AS (SELECT a.topic, a.word AS x, b.word AS y, CASE WHEN qx.n > 0 AND qy.n > 0 THEN ln((coalesce(j.n, 0) / total + 1e-12) / ((qx.n / total) * (qy.n / total))) / -ln(coalesce(j.n, 0) / total + 1e-12) ELSE 0 END AS v
  FROM k a JOIN k b ON a.topic = b.topic CROSS JOIN z LEFT JOIN j ON j.x = a.word AND j.y = b.word LEFT JOIN q qx ON qx.word = a.word LEFT JOIN q qy ON qy.word = b.word),
 m AS (SELECT topic, y, sum(v) AS s FROM v GROUP BY ALL), c AS (SELECT topic, x, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS cosine FROM v JOIN m USING (topic, y) GROUP BY ALL)
 SELECT topic, round(avg(cosine), 6) AS coherence FROM c GROUP BY 1""")
def cv_coherence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    return topics.cv_coherence(docs, "doc_id", "words", spark.createDataFrame(TOPICS, "topic int, rank int, word string")).withColumn("coherence", F.round("coherence", 6))


# Components, clusters and classifiers have no SQL; tests compare them with numpy or held-out rows.
@query()
def principal_components(spark, d):
    return topics.components(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "components")


@query()
def topic_clusters(spark, d):
    return topics.cluster_topics(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8).select("vec_id", "cluster")


@query()
def latent_topics(spark, d):
    rows = frequency.tfidf(document_tokens(spark, d), "doc_id", "token")
    words = frequency.doc_frequency(document_tokens(spark, d), "doc_id", "token", 20, 0.5, 500_000)
    return topics.latent_topics(rows.join(words.select("token"), "token", "left_semi"), "doc_id", "token", "tfidf", 5)


def labelled_vectors(spark, d):
    rows = table(spark, d, "embeddings").join(table(spark, d, "labels"), F.col("vec_id") == F.col("doc_id")).where("quality is not null")
    return rows.select("vec_id", "embedding", "quality", F.pmod("vec_id", F.lit(17)).alias("country"))


@query()
def panel_predictions(spark, d):
    return topics.panel_cv(labelled_vectors(spark, d), "country", "embedding", "quality").select("vec_id", "fold", F.col("prediction").cast("int").alias("prediction"))


@query()
def parameter_grid(spark, d):
    from pyspark.ml.classification import LogisticRegression

    return topics.grid_search(labelled_vectors(spark, d), "country", "embedding", "quality", {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}, LogisticRegression(maxIter=20))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (n_chars > 400) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def accuracy_by_source(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null")
    return topics.accuracy(rows.withColumn("guess", (F.col("n_chars") > 400).cast("int")), "quality", "guess", ["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT doc_id, '<<' || source || '>> ' || replace(text, chr(10), ' ') AS text FROM documents")
def wrapped_names(spark, d):
    piece = lambda value, name: F.struct(value.alias("Value"), name.alias("Name"))
    none = F.lit(None).cast("string")
    body = F.concat(F.array(F.array(piece(none, F.col("source")))), F.transform(F.split("text", "\n"), lambda x: F.array(piece(x, none))))
    return table(spark, d, "documents").select("doc_id", L.paragraph_text(body).alias("text"))


@query("SELECT page_id, url, 'page ' || page_id AS title, 'The Paper' AS publisher FROM pages")
def feed_sub_articles(spark, d):
    html = F.format_string('<ol><li><a href="%s" target="_blank">page <b>%d</b></a>&nbsp;<font color="#6f6f6f">The Paper</font></li><li><a href="x">no publisher</a></li><li></li></ol>', "url", "page_id")
    return table(spark, d, "pages").select("page_id", F.explode(feeds.sub_articles(html)).alias("s")).select("page_id", "s.*")


@query("WITH n AS (SELECT n_regionkey, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) // 2 AS c FROM nation) SELECT n_regionkey, string_agg(n_name, ' OR ' ORDER BY n_name) || ' site:news.example' AS search FROM n GROUP BY n_regionkey, c")
def feed_searches(spark, d):
    names = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", F.explode(feeds.chunk_queries(F.col("names"), 2, "news.example")).alias("search"))


BODIES = f"b0 AS (SELECT doc_id, {WORDS} AS words FROM documents), t0 AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM b0)"


def pairs_sql(i: int, least: int, threshold: float) -> str:
    """Over t<i>(doc_id, w, i): n<i> with each word's follower, and the accepted pairs p<i>."""
    return f"""n{i} AS (SELECT doc_id, w, i, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM t{i}), o{i} AS (SELECT w, count(*) AS n FROM t{i} GROUP BY 1),
 p{i} AS (SELECT n{i}.w AS a, nx AS b, CAST(count(*) AS BIGINT) AS nab, (count(*) - {least}) * (SELECT count(*) FROM o{i}) / (any_value(x.n) * any_value(y.n)) AS score
  FROM n{i} JOIN o{i} x ON x.w = n{i}.w JOIN o{i} y ON y.w = nx GROUP BY n{i}.w, nx HAVING count(*) >= {least} AND (count(*) - {least}) * (SELECT count(*) FROM o{i}) / (any_value(x.n) * any_value(y.n)) > {threshold})"""


# Pairs are joined from the left: of a run of accepted pairs the first, the third and so on.
JOINED = """h AS (SELECT n0.*, a IS NOT NULL AS hit FROM n0 LEFT JOIN p0 ON w = a AND nx = b), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) AS run FROM h),
 k AS (SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, hit, run ORDER BY i) % 2 = 1 AS take FROM g), l AS (SELECT *, lag(take) OVER (PARTITION BY doc_id ORDER BY i) AS gone FROM k),
 t1 AS (SELECT doc_id, i, CASE WHEN take THEN w || '_' || nx ELSE w END AS w FROM l WHERE NOT coalesce(gone, false))"""


def bodies(spark, d):
    return table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("words"))


@query(f"WITH {BODIES}, {pairs_sql(0, 5, 10)}, {JOINED}, {pairs_sql(1, 5, 15)} SELECT 2 AS level, a, b, nab, round(score, 6) AS score FROM p0 UNION ALL SELECT 3, a, b, nab, round(score, 6) FROM p1")
def phrases_of_two_levels(spark, d):
    return frequency.learn_phrases(bodies(spark, d), "doc_id", "words", 3, 5, 10.0)[1].withColumn("score", F.round("score", 6))


@query(f"WITH {BODIES}, {pairs_sql(0, 5, 10)}, {JOINED} SELECT doc_id, CAST(count(i) AS BIGINT) AS n, CAST(count(i) FILTER (contains(w, '_')) AS BIGINT) AS phrases FROM b0 LEFT JOIN t1 USING (doc_id) GROUP BY 1")
def documents_with_phrases(spark, d):
    found, _ = frequency.learn_phrases(bodies(spark, d), "doc_id", "words", 2, 5, 10.0)
    joined = frequency.join_phrases(bodies(spark, d), "words", found)
    return joined.select("doc_id", F.size("words").cast("long").alias("n"), F.size(F.filter("words", lambda w: F.contains(w, F.lit("_")))).cast("long").alias("phrases"))


# Clusters have no SQL; tests compare them with a version that cuts the complete graph from the top.
def clustered(spark, d):
    return density.density_clusters(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5, 3, cosine=True)


@query()
def density_topics(spark, d):
    return clustered(spark, d).select("vec_id", "cluster", F.round("strength", 6).alias("strength"))


@query()
def density_outliers(spark, d):
    return topics.outlier_share(clustered(spark, d), "cluster").withColumn("outlier_percent", F.round("outlier_percent", 6))


# Tests compare a network's gradients with differences, and its steps with one task's.
@query()
def network_predictions(spark, d):
    """Classes by a network that learns nothing from every fourth vector."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    net, _ = networks.train(rows, "embedding", "label", F.col("vec_id") % 4 == 0, rate=2e-3)
    return networks.predict(rows, "embedding", net).select("vec_id", (F.col("vec_id") % 4 == 0).alias("held_out"), "prediction")


# Tests compare layouts, and planted topics with their seeds.
@query()
def seeded_topics(spark, d):
    seeds = spark.createDataFrame([("the", 0), ("and", 0), ("der", 1), ("und", 1), ("les", 2), ("une", 2), ("los", 3), ("del", 3)], "term string, topic int")
    lam = seeded.seeded_topics(document_tokens(spark, d).select("doc_id", "token"), "doc_id", "token", 4, seeds, 5)
    return seeded.topic_terms(lam).withColumn("weight", F.round("weight", 6))


# Gradients are tested against differences, draws by their shares, and planted words of two fields by their scores.
@query()
def subword_vectors(spark, d):
    """Vectors of all words, the rarer ones than the trained by their n-grams."""
    docs = bodies(spark, d)
    model = subwords.train(docs, "doc_id", "words", size=32, least=20, passes=2, buckets=200_000)
    found = subwords.vectors_of(model, docs.select(F.explode("words").alias("word")), "word", size=32, buckets=200_000)
    return found.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS letters, md5(text) AS digest FROM documents")
def avro_documents(spark, d):
    """All documents by way of Avro files, which are read by ranges of 4 MB."""
    spark.dataSource.register(Avro)
    path = shared.new_folder(spark, "avro")
    table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").write.format("tallywind_avro").mode("append").save(path)
    read = spark.read.format("tallywind_avro").option("rangebytes", 4 << 20).load(path)
    return read.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("letters"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {TERMS} SELECT doc_id, token, CAST(count(*) AS DOUBLE) AS n, count(*) OVER (PARTITION BY token) AS df FROM t GROUP BY doc_id, token")
def matrix_market_bag(spark, d):
    """All documents' counts by way of a Matrix Market corpus and its dictionary."""
    path = shared.new_folder(spark, "matrix")
    docs, _ = matrices.write_bag(document_tokens(spark, d), "doc_id", "token", path)
    entries, _ = matrices.read_matrix(spark, f"{path}/corpus")
    terms, _ = matrices.read_dictionary(spark, f"{path}/dictionary")
    rows = entries.join(docs.select(F.col("number").alias("row"), F.col("doc").alias("doc_id")), "row")
    return rows.join(terms.withColumn("column", F.col("id") + 1), "column").select("doc_id", "token", F.col("value").alias("n"), "df")


@query(f"SELECT doc_id, CAST(unnest(range(len({SENTENCES}))) AS INTEGER) AS position, unnest({SENTENCES}) AS sentence FROM documents")
def sentence_rows(spark, d):
    """A document to its sentences by a table function called from SQL."""
    tables.register(spark)
    return spark.sql("SELECT * FROM text_units(TABLE(SELECT doc_id, text FROM {docs}), 'sentence')", docs=table(spark, d, "documents"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000, false) AS fresh FROM events WHERE ts IS NOT NULL),
 s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS "first", max(us) AS "last", count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark, d):
    """Runs of a user's events no more than six hours apart, by a table function with a partition for each user."""
    tables.register(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return spark.sql("SELECT * FROM sessions(TABLE(SELECT user_id, at FROM {log}) PARTITION BY user_id ORDER BY (at), 21600000000)", log=table(spark, d, "events").select("user_id", at))


# Languages are tested against a brute-force version and by held-out accuracy.
@query()
def languages_by_grams(spark, d):
    """The language of all documents, by profiles learnt from three quarters of their labels."""
    rows = table(spark, d, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles, languages = identify.learn(rows.where(~held), "text", "lang")
    return identify.identify(rows, "doc_id", "text", profiles, languages).join(rows.select("doc_id", held.alias("held_out")), "doc_id")


# The rules are tested against a scan by hand.
@query()
def ruled_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(L.ruled_sentiment(F.col("text"), LEXICON), 6).alias("score"))


DIMS = dimensions.countries()
NAMED = "n AS (SELECT * FROM (VALUES " + ", ".join(f"('NATION_{i}', '{c[0]}')" for i, c in enumerate(DIMS)) + ") v(nation, country))"
FIXED = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', {i}, DATE '{s}', DATE '{p}')" for c in DIMS for i, (s, p) in enumerate(zip(c[2], c[3], strict=True), 1)) + ") v(country, seq, start, peak))"
PAYMENTS = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', DATE '{m}')" for c in DIMS for m in c[4]) + ") v(country, period))"
# The tables' nations, which have numbers, stand for the dimension's countries in turn; the last five for none. Months lie 12 years before the orders'.
STAND_FOR = f"{MONTHLY}, {NAMED}, q AS (SELECT coalesce(n.country, lower(m.country)) AS country, CAST(period - INTERVAL 12 YEAR AS DATE) AS period, m.n FROM m LEFT JOIN n ON nation = m.country)"


def countries_monthly(spark, d):
    names = spark.createDataFrame([(f"NATION_{i}", c[0]) for i, c in enumerate(DIMS)], "nation string, name string")
    m = monthly(spark, d).join(F.broadcast(names), F.col("country") == F.col("nation"), "left")  # 20 names
    return m.select(F.coalesce("name", F.lower("country")).alias("country"), F.add_months("period", -144).alias("period"), "n")


@query(f"WITH {STAND_FOR}, {FIXED}, {PAYMENTS}, {z_sql('q', 'country', 'period', 'n', 24)} SELECT country, period, n, {UP} AS pred, CAST(EXISTS (SELECT 1 FROM c WHERE c.country = z.country AND z.period BETWEEN start AND peak) AS INTEGER) AS crisis_window, CAST(EXISTS (SELECT 1 FROM b WHERE b.country = z.country AND b.period = z.period) AS INTEGER) AS bop_crisis FROM z")
def export_with_crises(spark, d):
    """A series with its spikes and both kinds of crisis months of the fixed dimensions."""
    z = series.spikes(series.rolling_z(countries_monthly(spark, d), ["country"], "period", "n")).select("country", "period", "n", "pred")
    return evaluate.mark_months(z, dimensions.crises(spark), dimensions.payment_crises(spark))


@query(f"WITH {STAND_FOR}, {FIXED}, {z_sql('q', 'country', 'period', 'n', 24)}, s AS (SELECT country, period FROM z WHERE {UP} = 1), {scores_sql('s')}")
def scores_of_fixed_crises(spark, d):
    """Early warnings of the fixed dimensions' crises; spikes of countries without any crisis are false."""
    spikes = series.spikes(series.rolling_z(countries_monthly(spark, d), ["country"], "period", "n")).where("pred = 1").select("country", "period")
    return evaluate.score(evaluate.outcomes(spikes, dimensions.crises(spark), []), [])


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('NATION_{i}', '{c[1]}')" for i, c in enumerate(DIMS)) + ") v(nation, region)) SELECT region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON nation = n_name GROUP BY region")
def customers_by_region_code(spark, d):
    codes = dimensions.regions(spark).join(F.broadcast(spark.createDataFrame([(f"NATION_{i}", c[0]) for i, c in enumerate(DIMS)], "n_name string, country string")), "country").select("n_name", "region")
    keyed = table(spark, d, "nation").join(codes, "n_name", "left").select("n_nationkey", "region")
    by = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"))
    return by.join(keyed, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("region").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query(f"""WITH {TERMS}, f AS (SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents), i AS (SELECT item_id, unnest({WORDS}) AS token FROM benchmark)
 SELECT item_id, token, count(*) AS tf, any_value(coalesce(df, 0)) AS df, round(count(*) * ln(((SELECT n FROM n) + 1) / (any_value(coalesce(df, 0)) + 1)), 6) AS weight FROM i LEFT JOIN f USING (token) GROUP BY item_id, token""")
def items_by_stored_frequencies(spark, d):
    """Benchmark items weighed by the documents' frequencies, which are fitted, stored and loaded."""
    docs, path = table(spark, d, "documents"), shared.new_folder(spark, "stored")
    df = document_tokens(spark, d).select("doc_id", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stored.keep(path, {"documents": docs.count()}, {"frequencies": df})
    model = stored.load(spark, path)
    items = table(spark, d, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    both = items.join(model.tables["frequencies"], "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return both.select("item_id", "token", "tf", "df", F.round(F.col("tf") * F.log((F.lit(model.settings["documents"]) + 1) / (F.col("df") + 1)), 6).alias("weight"))
