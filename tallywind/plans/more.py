"""More registered queries: documents by entity, vocabularies, panels, small relational rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywind.functions import text as T
from tallywind.operators import corpus, evaluate, frequency, publish, search, series
from tallywind.plans.catalogue import ALIASES, C, DAILY, DOWN, HOST, MONTH, MONTHLY, SPACED, STOP, TERMS, TOP_WORDS, UP, WORDS, crises, daily, document_tokens, documents, monthly, precrisis_labels, query, scores_sql, table, token_rows, top_words, with_z, z_sql
from tallywind.sources.shared import save

TAGS = "list_filter([" + ", ".join(f"CASE WHEN len(list_intersect({WORDS}, [{', '.join(map(repr, a))}])) > 0 THEN '{e}' END" for e, a in ALIASES.items()) + "], lambda x: x IS NOT NULL)"
ENTITY = f"e AS (SELECT doc_id, {MONTH} AS period, unnest({TAGS}) AS entity FROM documents)"
HASH = "md5(token || '#' || seed)"
VOCABULARY = "v AS (SELECT token FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20)"
SEARCH = ["the and", "with", "economic crisis", "der und die", "qqqq"]
PROFILES = {"en": ["the", "and", "of", "with"], "fr": ["les", "une", "des", "dans"], "de": ["der", "und", "die", "mit"], "es": ["los", "del", "una", "con"]}


def tagged(spark, d):
    return documents(spark, d).select("doc_id", "period", search.entity_tags(F.col("text"), ALIASES, "token").alias("entities"))


def vocabulary(spark, d):
    return frequency.doc_frequency(document_tokens(spark, d), "doc_id", "token", 20, 1.0, 500_000)


@query(f"WITH {ENTITY}, n AS (SELECT entity, period, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL) SELECT entity, period, n, CAST(sum(n) OVER w AS BIGINT) AS total, round(avg(n) OVER w, 6) AS mean FROM n WINDOW w AS (PARTITION BY entity)")
def docs_by_entity_month(spark, d):
    return corpus.monthly_counts(corpus.by_entity(tagged(spark, d), "entities"), "entity", "period").withColumn("mean", F.round("mean", 6))


@query(f"WITH {ENTITY} SELECT doc_id FROM e WHERE entity = 'alpha' AND period = DATE '2016-03-01'")
def docs_of_entity_and_month(spark, d):
    return tagged(spark, d).where(F.array_contains("entities", "alpha") & (F.col("period") == F.lit("2016-03-01").cast("date"))).select("doc_id")


@query(f"SELECT doc_id, CAST(len({TAGS}) AS INTEGER) AS country_n, 'corpus/' || source || '/' || doc_id || '.json' AS path FROM documents WHERE len({TAGS}) > 0")
def tagged_documents(spark, d):
    one = documents(spark, d, "source").withColumn("country_n", F.size(search.entity_tags(F.col("text"), ALIASES, "token")))
    return one.where("country_n > 0").select("doc_id", "country_n", F.concat(F.lit("corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))


@query(f"SELECT doc_id FROM documents WHERE length(text) > 0 AND {MONTH} = DATE '2017-05-01'")
def docs_of_month(spark, d):
    return documents(spark, d).where((F.length("text") > 0) & (F.col("period") == F.trunc(F.lit("2017-05-20").cast("date"), "month"))).select("doc_id")


@query(f"WITH {TERMS}, {VOCABULARY} SELECT token, CAST(count(*) AS BIGINT) AS n FROM t WHERE token IN (SELECT token FROM v) GROUP BY 1")
def vocabulary_counts(spark, d):
    return corpus.in_vocabulary(token_rows(spark, d).select("token"), vocabulary(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TERMS}, {VOCABULARY} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (token NOT IN (SELECT token FROM v)) AS BIGINT) AS oov, round(count(*) FILTER (token NOT IN (SELECT token FROM v)) / count(*), 6) AS oov_rate FROM t GROUP BY 1")
def oov_by_document(spark, d):
    return corpus.oov_rate(token_rows(spark, d).select("doc_id", "token"), vocabulary(spark, d), "doc_id").withColumn("oov_rate", F.round("oov_rate", 6))


@query(f"WITH {TERMS}, {VOCABULARY} SELECT DISTINCT doc_id FROM t WHERE token IN (SELECT token FROM v)")
def documents_with_a_bag(spark, d):
    return corpus.in_vocabulary(token_rows(spark, d).select("doc_id", "token"), vocabulary(spark, d)).select("doc_id").distinct()


@query(f"""WITH {TERMS}, {VOCABULARY}, s AS (SELECT unnest({SEARCH!r}) AS term), p AS (SELECT term, generate_subscripts(string_split(term, ' '), 1) AS pos, unnest(string_split(term, ' ')) AS token FROM s),
 k AS (SELECT term, string_agg(token, '&' ORDER BY pos) AS kept FROM p WHERE token IN (SELECT token FROM v) AND token NOT IN {STOP} GROUP BY 1)
 SELECT term, CASE WHEN replace(term, ' ', '_') IN (SELECT token FROM v) THEN replace(term, ' ', '_') ELSE kept END AS kept FROM s LEFT JOIN k USING (term) WHERE kept IS NOT NULL OR replace(term, ' ', '_') IN (SELECT token FROM v)""")
def search_terms_in_vocabulary(spark, d):
    return corpus.search_terms(spark.createDataFrame([(x,) for x in SEARCH], "term string"), vocabulary(spark, d), T.STOP_WORDS)


def profile_sql() -> str:
    hits = {k: f"len(list_filter(string_split_regex(lower(text), '[^a-zà-öø-ÿ]+'), lambda w: w IN ({', '.join(map(repr, p))})))" for k, p in PROFILES.items()}
    return "SELECT doc_id, CASE WHEN length(text) <= 10 OR greatest(" + ", ".join(PROFILES) + ") = 0 THEN 'NA' " + " ".join(f"WHEN {k} = greatest({', '.join(PROFILES)}) THEN '{k}'" for k in PROFILES) + " END AS language FROM (SELECT doc_id, text, " + ", ".join(f"{v} AS {k}" for k, v in hits.items()) + " FROM documents)"


@query(profile_sql())
def detected_language(spark, d):
    return table(spark, d, "documents").select("doc_id", corpus.language(F.col("text"), PROFILES).alias("language"))


@query("SELECT doc_id, md5(left(lower(text), 200)) AS head_md5, md5(source || ' ; ' || text) AS joined_md5, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers FROM documents")
def text_parts(spark, d):
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "documents").select("doc_id", md5(F.left(F.lower("text"), F.lit(200))).alias("head_md5"), md5(F.concat("source", F.lit(" ; "), "text")).alias("joined_md5"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query(f"WITH p AS (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN len({SPACED.replace('text', 'line')}) >= 20 THEN lang END AS topic FROM p")
def paragraph_topics(spark, d):
    p = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return p.select("doc_id", "pos", F.when(F.size(T.spaced(F.col("line"))) >= 20, F.col("lang")).alias("topic"))


@query(f"SELECT {HOST} AS host, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (html IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (length(html) > 30) AS BIGINT) AS with_body FROM pages GROUP BY 1")
def body_gaps_by_host(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("html").isNull()).alias("missing"), F.count_if(F.length("html") > 30).alias("with_body"))


# Every address goes through the decoder: encoded as the news feed does, and decoded back.
@query("SELECT page_id, url AS decoded FROM pages")
def decoded_urls(spark, d):
    hidden = F.translate(F.regexp_replace(F.base64(F.concat(F.lit("\x08\x13\x22"), "url", F.lit("\x01\x01")).cast("binary")), "[\r\n=]", ""), "+/", "-_")
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://news.example/articles/"), hidden, F.lit("?oc=5")).alias("link"))
    return p.select("page_id", corpus.google_url(F.col("link")).alias("decoded"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fenced_json(spark, d):
    return table(spark, d, "events").select("event_id", corpus.fenced_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k int").getField("k").alias("k"))


@query(f"""WITH r AS (SELECT 'page-' || regexp_extract(lower(url), '([^/]*)$', 1) AS an, page_id, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS publication_date, CASE WHEN page_id % 7 = 0 THEN 'NA' ELSE url END AS weburl FROM pages WHERE page_id % 5 <> 0 AND page_id % 11 <> 0)
 SELECT an, publication_date, weburl, page_id FROM r QUALIFY row_number() OVER (PARTITION BY an ORDER BY publication_date DESC, 'body ' || page_id DESC) = 1""")
def canonical_articles(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id")
    raw = p.select(
        F.col("url").alias("id"), F.when(i % 5 != 0, F.lit("a title")).alias("title"), F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T07:00:00Z")).alias("publishedDate"),
        F.when(i % 11 != 0, F.concat(F.lit("<p>body "), i.cast("string"), F.lit("</p>"))).alias("bodyXML"), F.when(i % 7 != 0, F.col("url")).alias("webUrl"),
    )
    return corpus.canonical(raw, "feed", "page-")[0].select("an", "publication_date", "weburl", F.regexp_extract("body", "([0-9]+)", 1).cast("long").alias("page_id"))


# Series and panels.


@query(f"WITH {MONTHLY}, {z_sql('m', 'country', 'period', 'n', 24)} SELECT country, period, {UP} AS pred FROM z WHERE period <= DATE '2000-06-01'")
def series_until(spark, d):
    return series.spikes(with_z(spark, d)).where(F.col("period") <= F.lit("2000-06-01").cast("date")).select("country", "period", "pred")


@query(f"WITH {MONTHLY}, {z_sql('m', 'country', 'period', 'n', 24)} SELECT country, period, n, round(z, 6) AS z FROM z WHERE z IS NOT NULL")
def complete_rows(spark, d):
    return with_z(spark, d).na.drop(subset=["z"]).select("country", "period", "n", F.round("z", 6).alias("z"))


@query(f"WITH {MONTHLY} SELECT country, period, round((n - avg(n) OVER w) / stddev_samp(n) OVER w, 6) AS score FROM m WINDOW w AS (PARTITION BY country)")
def zscore_of_series(spark, d):
    w = Window.partitionBy("country")
    return monthly(spark, d).select("country", "period", F.round((F.col("n") - F.avg("n").over(w)) / F.stddev_samp("n").over(w), 6).alias("score"))


@query("SELECT year(o_orderdate) AS year, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P, CAST(count(*) FILTER (o_orderstatus = 'X') AS BIGINT) AS X FROM orders GROUP BY 1")
def counts_by_year_wide(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", list("FOPX")).agg(F.count(F.lit(1))).na.fill(0)


@query("WITH e AS (SELECT CAST(generate_series AS DATE) AS period FROM generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM orders)::TIMESTAMP, (SELECT max(date_trunc('month', o_orderdate)) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH)), m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, avg(o_totalprice) AS mean, CAST(count(*) AS BIGINT) AS n FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1) SELECT period, CAST(coalesce(n, 0) AS BIGINT) AS n, round(mean, 4) AS mean FROM e LEFT JOIN m USING (period)")
def resampled_months(spark, d):
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"))
    ends = m.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("period"))
    return ends.join(m.where(F.month("period") != 4), "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 4).alias("mean"))


PANEL = f"""{MONTHLY}, {C}, {z_sql('m', 'country', 'period', 'n', 24)}, p AS (SELECT country, period, CAST(EXISTS (SELECT 1 FROM c WHERE c.country = z.country AND period BETWEEN start AND peak) AS INTEGER) AS crisis, {UP} AS pred FROM z),
 o AS (SELECT *, CASE WHEN lead(crisis) OVER w = 1 AND crisis = 0 THEN 1 ELSE 0 END AS onset FROM p WINDOW w AS (PARTITION BY country ORDER BY period)),
 q AS (SELECT *, CASE WHEN crisis = 0 THEN max(onset) OVER (PARTITION BY country ORDER BY period ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) ELSE 0 END AS pre FROM o)"""


def panel_rows(spark, d):
    hits = series.spikes(with_z(spark, d)).select("country", "period", "pred")
    return precrisis_labels(spark, d).join(hits, ["country", "period"])


@query(f"WITH {PANEL} SELECT country, period, CASE WHEN crisis = 1 OR pre = 1 THEN 'crisis_pre' ELSE 'crisis_tranqull' END AS label, CAST(pre + crisis > 0 AS INTEGER) AS any_signal, pre * pred AS pre_signal, 1 - crisis - pre * pred AS tranquil_signal FROM q")
def panel_class_labels(spark, d):
    label = corpus.one_hot_label(["crisis", "crisis_pre", "crisis_tranqull"])
    signal = F.col("crisis_pre") * F.col("pred")
    return panel_rows(spark, d).select("country", "period", F.when(label == "crisis", "crisis_pre").otherwise(label).alias("label"), (F.col("crisis") + F.col("crisis_pre") > 0).cast("int").alias("any_signal"), signal.alias("pre_signal"), (1 - F.col("crisis") - signal).alias("tranquil_signal"))


@query(f"""WITH {PANEL}, k AS (SELECT *, CASE WHEN lag(pre) OVER w IS DISTINCT FROM pre THEN 1 ELSE 0 END AS ch FROM q WINDOW w AS (PARTITION BY country ORDER BY period)), i AS (SELECT *, sum(ch) OVER (PARTITION BY country ORDER BY period) AS run FROM k),
 g AS (SELECT country, run, max(pre) AS pre, sum(pre * pred) AS hit FROM i GROUP BY ALL) SELECT CAST((SELECT sum(pre * pred) FROM q) AS BIGINT) AS tp, CAST((SELECT count(*) FROM q WHERE pre = 0 AND crisis = 0 AND pred = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (pre = 1 AND hit = 0) AS BIGINT) AS fn FROM g""")
def island_scores(spark, d):
    return corpus.island_scores(panel_rows(spark, d), "country", "period", "crisis_pre", "crisis_tranqull", "pred")


@query(f"""WITH {MONTHLY}, {C}, {z_sql('m', 'country', 'period', 'n', 24)}, t AS (SELECT round(1 + i / 10.0, 1)::DOUBLE AS thresh FROM range(30) r(i)), s AS (SELECT thresh, country, period FROM z, t WHERE coalesce(z >= thresh OR over_, false)), f AS ({scores_sql('s', 'thresh').replace('tp AS', 'WITH tp AS', 1)})
 SELECT country, thresh, fscore, recall FROM f WHERE fscore IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY fscore DESC, recall DESC, thresh) = 1""")
def best_threshold(spark, d):
    from tallywind.plans.catalogue import threshold_sweep

    scored = threshold_sweep(spark, d).where("fscore is not null")
    first = F.struct("fscore", F.coalesce("recall", F.lit(-1.0)), -F.col("thresh"))
    return scored.groupBy("country").agg(*(F.max_by(x, first).alias(x) for x in ("thresh", "fscore", "recall")))


@query(f"WITH {MONTHLY}, {C}, {z_sql('m', 'country', 'period', 'n', 24)}, s AS (SELECT country, period FROM z WHERE {UP} = 1), f AS ({scores_sql('s').replace('tp AS', 'WITH tp AS', 1)}) SELECT country, fscore, recall, CAST(row_number() OVER (ORDER BY fscore DESC NULLS LAST, recall DESC NULLS LAST, country) AS INTEGER) AS place FROM f WHERE country <> 'aggregate' QUALIFY place <= 10")
def ranked_scores(spark, d):
    from tallywind.plans.catalogue import early_warning_scores

    order = [F.desc_nulls_last("fscore"), F.desc_nulls_last("recall"), F.asc("country")]
    top = early_warning_scores(spark, d).where("country != 'aggregate'").select("country", "fscore", "recall").orderBy(*order).limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ten rows


@query(f"""WITH {MONTHLY}, {C}, w AS ({"SELECT country, period, n + 40 AS n FROM m WHERE period >= DATE '2001-01-01'"}), u AS (SELECT country, period, n FROM m WHERE period NOT IN (SELECT period FROM w) UNION ALL SELECT * FROM w), {z_sql('u', 'country', 'period', 'n', 24)} SELECT country, period, n, {UP} AS pred FROM z WHERE period >= DATE '2001-01-01'""")
def month_update(spark, d):
    old = monthly(spark, d).select("country", "period", "n")
    merged = publish.upsert_periods(old, old.where("period >= date'2001-01-01'").withColumn("n", F.col("n") + 40), "period")
    return series.spikes(series.rolling_z(merged, ["country"], "period", "n")).where("period >= date'2001-01-01'").select("country", "period", "n", "pred")


@query(f"""WITH {MONTHLY}, {C}, {z_sql('m', 'country', 'period', 'n', 24)} SELECT z.country, period, n, {UP} AS pred, {DOWN} AS pred_decr, CAST(c.country IS NOT NULL AS INTEGER) AS crisis_window FROM z LEFT JOIN (SELECT DISTINCT country, CAST(u AS DATE) AS period FROM (SELECT country, unnest(generate_series(start, peak, INTERVAL 1 MONTH)) AS u FROM c)) c USING (country, period)""")
def signal_export(spark, d):
    z = with_z(spark, d)
    both = series.spikes(z).join(series.spikes(z, direction="decr").select("country", "period", F.col("pred").alias("pred_decr")), ["country", "period"])
    on = evaluate.crisis_months(crises(spark, d)).withColumn("crisis_window", F.lit(1))
    return both.join(on, ["country", "period"], "left").select("country", "period", "n", "pred", "pred_decr", F.coalesce("crisis_window", F.lit(0)).alias("crisis_window"))


@query(f"""WITH {MONTHLY}, l AS (SELECT country, period, 'n' AS code, CAST(n AS DOUBLE) AS "value" FROM m UNION ALL SELECT country, period, 'total', total FROM m), k AS (SELECT country, period, 'n' AS code, 'orders in ' || strftime(period, '%Y-%m') AS tip FROM m WHERE n > 5)
 SELECT country, period, CASE code WHEN 'n' THEN 'Number of orders' ELSE 'Order value' END AS indexes, "value", tip AS tool_tips FROM l LEFT JOIN k USING (country, period, code)""")
def index_with_tooltips(spark, d):
    m = monthly(spark, d).withColumn("n", F.col("n").cast("double"))
    tips = m.where("n > 5").select("country", "period", F.lit("n").alias("code"), F.concat(F.lit("orders in "), F.date_format("period", "yyyy-MM")).alias("tool_tips"))
    long = publish.to_long(m, ["country", "period"], ["n", "total"], "code", "value").join(tips, ["country", "period", "code"], "left")
    return long.select("country", "period", corpus.index_name(F.col("code"), {"n": "Number of orders", "total": "Order value"}).alias("indexes"), "value", "tool_tips")


@query(f"""WITH {TERMS}, a AS (SELECT DISTINCT token FROM t), sd AS (SELECT CAST(i AS INTEGER) AS seed FROM range(100) r(i)), dr AS (SELECT seed, token, row_number() OVER (PARTITION BY seed ORDER BY {HASH}, token) AS r FROM a, sd QUALIFY r <= 250),
 {VOCABULARY}, h AS (SELECT seed, token, CAST(row_number() OVER (PARTITION BY seed ORDER BY r) AS INTEGER) AS rank FROM dr WHERE token IN (SELECT token FROM v)) SELECT seed, token, rank FROM h WHERE rank <= 50""")
def random_words(spark, d):
    return corpus.random_words(token_rows(spark, d), "token", 100, 50, vocabulary(spark, d))


CS = "c AS (SELECT country, seq, s AS start, p AS peak FROM (SELECT DISTINCT source AS country FROM documents), (VALUES (1, DATE '2016-10-01', DATE '2016-12-01'), (2, DATE '2018-02-01', DATE '2018-04-01')) v(seq, s, p))"


@query(f"""WITH {TERMS}, a AS (SELECT DISTINCT token FROM t), t0 AS (SELECT CAST(i AS INTEGER) AS seed FROM range(100) r(i)), dr AS (SELECT seed, token, row_number() OVER (PARTITION BY seed ORDER BY {HASH}, token) AS r FROM a, t0 QUALIFY r <= 250),
 {VOCABULARY}, hh AS (SELECT seed, token, row_number() OVER (PARTITION BY seed ORDER BY r) AS rank FROM dr WHERE token IN (SELECT token FROM v)), h AS (SELECT seed, token FROM hh WHERE rank <= 50),
 w AS (SELECT source AS country, {MONTH} AS period, unnest({WORDS}) AS token FROM documents), n AS (SELECT country, period, CAST(count(*) AS BIGINT) AS total FROM w GROUP BY ALL), g AS (SELECT seed, country, period, count(*) AS hit FROM w JOIN h USING (token) GROUP BY ALL),
 x AS (SELECT seed, country, period, CAST(coalesce(hit, 0) * 1000000 // total AS BIGINT) AS freq FROM n CROSS JOIN t0 LEFT JOIN g USING (seed, country, period)), {CS}, {z_sql('x', 'seed, country', 'period', 'freq', 12)},
 s AS (SELECT seed, country, period FROM z WHERE {UP} = 1), {scores_sql('s', 'seed').replace('FROM t CROSS JOIN c', 'FROM t0 CROSS JOIN c')}""")
def random_word_benchmark(spark, d):
    drawn = F.broadcast(save(corpus.random_words(token_rows(spark, d), "token", 100, 50, vocabulary(spark, d)).select("seed", "token"), "random-words"))  # 50 words a seed
    seeds = spark.range(100).select(F.col("id").cast("int").alias("seed"))
    known = drawn.select("token", F.col("token").alias("word")).distinct()  # other words count in the total only, as one
    rows = token_rows(spark, d, "source").join(F.broadcast(known), "token", "left").groupBy(F.col("source").alias("country"), "period", "word").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("country", "period").agg(F.sum("n").alias("total")).crossJoin(F.broadcast(seeds))
    hit = rows.join(drawn, F.col("word") == F.col("token")).groupBy("seed", "country", "period").agg(F.sum("n").alias("hit"))
    index = total.join(hit, ["seed", "country", "period"], "left").select("seed", "country", "period", F.expr("coalesce(hit, 0) * 1000000 div total").alias("freq"))
    dates = spark.createDataFrame([(1, "2016-10-01", "2016-12-01"), (2, "2018-02-01", "2018-04-01")], "seq int, s string, p string").select("seq", F.to_date("s").alias("start"), F.to_date("p").alias("peak"))
    c = table(spark, d, "documents").select(F.col("source").alias("country")).distinct().crossJoin(F.broadcast(dates))
    hits = series.spikes(series.rolling_z(index, ["seed", "country"], "period", "freq", 12)).where("pred = 1").select("seed", "country", "period")
    return evaluate.score(evaluate.outcomes(hits, c, ["seed"], grid=seeds), ["seed"])


# Small relational rules.


@query("SELECT vec_id, quality, toxic FROM embeddings JOIN labels ON vec_id = doc_id")
def vectors_with_labels(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "labels"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "quality", "toxic")


@query("SELECT doc_id, lang, CAST(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INTEGER) AS crisis FROM documents")
def crisis_document_flag(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "documents").join(ids, "doc_id", "left").select("doc_id", "lang", F.coalesce("hit", F.lit(0)).alias("crisis"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_event_per_user(spark, d):
    return corpus.first_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT o_orderpriority, min(date_trunc('month', o_orderdate)) AS a, date_diff('month', min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate))) + 1 AS n FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, a, unnest(range(0, n - 2, 2)) AS i FROM e)
 SELECT o_orderpriority, strftime(a + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') || ' ' || strftime(a + to_months(CAST(i + 1 AS INTEGER)), '%Y-%m-%d') || ' ' || strftime(a + to_months(CAST(i + 2 AS INTEGER)), '%Y-%m-%d') AS periods FROM s""")
def month_tuples(spark, d):
    ends = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(F.trunc("o_orderdate", "month")).alias("a"), F.max(F.trunc("o_orderdate", "month")).alias("b"))
    months = F.transform(F.sequence("a", "b", F.expr("interval 1 month")), lambda x: F.date_format(x, "yyyy-MM-dd"))
    return ends.select("o_orderpriority", F.explode(corpus.sliding(months, 3)).alias("p")).select("o_orderpriority", F.array_join("p", " ").alias("periods"))


SEGMENTS = ["AUTO", "BUILD", "FURNISHING", "HOUSE", "MACHINES"]


@query("WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), l AS (SELECT unnest(" + repr(SEGMENTS) + ") AS label, generate_subscripts(" + repr(SEGMENTS) + ", 1) AS i) SELECT c_mktsegment, label, round(1 - levenshtein(c_mktsegment, label) / greatest(length(c_mktsegment), length(label)), 6) AS similarity FROM s, l QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(1 - levenshtein(c_mktsegment, label) / greatest(length(c_mktsegment), length(label)), 9) DESC, i) = 1")
def closest_label(spark, d):
    return corpus.closest(table(spark, d, "customer").select("c_mktsegment").distinct(), "c_mktsegment", SEGMENTS).withColumn("similarity", F.round("similarity", 6))


@query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS token FROM documents WHERE lang = 'en' EXCEPT SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) FROM documents WHERE lang <> 'en'")
def list_difference(spark, d):
    rows = token_rows(spark, d, "lang")
    return rows.where("lang = 'en'").select("token").distinct().join(rows.where("lang != 'en'").select("token").distinct(), "token", "left_anti")


@query(f"WITH {DAILY}, a AS (SELECT event_type, day, n FROM m WHERE day <= DATE '2024-01-20'), b AS (SELECT event_type, day, n + 1000 AS n FROM m WHERE day >= DATE '2024-01-15') SELECT event_type, day, coalesce(b.n, a.n) AS n FROM a FULL JOIN b USING (event_type, day)")
def merge_last_wins(spark, d):
    m = daily(spark, d).select("event_type", "day", "n")
    return corpus.merge_last(m.where("day <= date'2024-01-20'"), m.where("day >= date'2024-01-15'").withColumn("n", F.col("n") + 1000), ["event_type", "day"], "n")


# A topic's texts come in parts of 64 ids: no task holds a whole topic.
@query("SELECT source, lang, doc_id // 64 AS part, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS ids, md5(string_agg(text, ' ' ORDER BY doc_id)) AS text_md5, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def ids_per_topic(spark, d):
    parts = corpus.texts_by_topic(table(spark, d, "documents"), ["source", "lang"], "doc_id", "text", 64)
    return parts.select("source", "lang", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("ids").cast("long").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def column_summary(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    long = publish.to_long(table(spark, d, "lineitem").select(*names), [], names, "name", "value")
    return long.groupBy("name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT CAST(count(DISTINCT label) - 1 AS BIGINT) AS topics, round(100.0 * count(*) FILTER (label = 0) / count(*), 6) AS outlier_percent FROM embeddings")
def topic_outliers(spark, d):
    return table(spark, d, "embeddings").agg((F.count_distinct("label") - 1).alias("topics"), F.round(100 * F.count_if(F.col("label") == 0) / F.count(F.lit(1)), 6).alias("outlier_percent"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def feed_month_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS entries, least(round(count(*) / 8.0, 4), 1) AS filled FROM conversations GROUP BY 1")
def entries_per_conversation(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries")).withColumn("filled", F.least(F.round(F.col("entries") / 8, 4), F.lit(1.0)))


@query("SELECT doc_id, CASE WHEN ('0x' || left(md5(doc_id || '#7'), 4))::INTEGER % 10 < 8 THEN 'train' ELSE 'test' END AS part FROM documents")
def train_test_split(spark, d):
    h = F.conv(F.left(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("#7")).cast("binary")), F.lit(4)), 16, 10).cast("int")
    return table(spark, d, "documents").select("doc_id", F.when(h % 10 < 8, "train").otherwise("test").alias("part"))


# An event type's columns as an export names them.
@query("WITH t AS (SELECT DISTINCT event_type AS t FROM events) SELECT 'index-' || t AS renamed, t AS name FROM t UNION ALL SELECT 'pred-' || t, t || '_pred_crisis' FROM t UNION ALL SELECT DISTINCT 'country', 'country' FROM events")
def column_names(spark, d):
    of = F.array("event_type", F.concat("event_type", F.lit("_pred_crisis")), F.lit("country"))
    return table(spark, d, "events").select(F.explode(of).alias("name")).distinct().select(corpus.column_name(F.col("name")).alias("renamed"), "name")


NAME = "replace(lower(n_name), '_', ' ')"
TITLE = f"array_to_string(list_transform(string_split({NAME}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""SELECT 'agg_' || replace(lower(n_name), ' ', '_') || '_month_z2.1.csv' AS file, {TITLE} AS country, {NAME} AS plain, CASE WHEN contains({NAME}, ' ') THEN '"' || {NAME} || '"' ELSE {NAME} END AS quoted FROM nation""")
def file_countries(spark, d):
    file = F.concat(F.lit("agg_"), F.translate(F.lower("n_name"), " ", "_"), F.lit("_month_z2.1.csv")).alias("file")
    names = table(spark, d, "nation").select(file).withColumn("country", corpus.file_country(F.col("file")))
    plain = corpus.plain_term(F.concat(F.lit("\u00a0 "), "country", F.lit(" ")))
    return names.select("file", "country", plain.alias("plain"), corpus.quoted(plain).alias("quoted"))


# Each source's words and their shares, printed as a topic model prints them, and read back; the small ones go.
@query(f"WITH {TOP_WORDS}, s AS (SELECT source, sum(n) AS total FROM wn GROUP BY 1) SELECT source, token AS word, round(round(n / total, 5), 4) AS weight FROM top JOIN s USING (source) WHERE round(round(n / total, 5), 4) >= 0.02")
def topic_terms(spark, d):
    every = token_rows(spark, d, "source").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    one = F.format_string('%.5f*"%s"', F.round(F.col("n") / F.col("total"), 5), "token")
    lines = top_words(spark, d).join(every, "source").groupBy("source").agg(F.array_join(F.collect_list(one), " + ").alias("line"))  # ten words a source
    weights = F.transform(F.regexp_extract_all("line", F.lit(r"([0-9.]+)\*"), F.lit(1)), lambda w: F.round(w.cast("double"), 4))
    each = lines.select("source", F.explode(F.arrays_zip(corpus.topic_words(F.col("line")).alias("word"), weights.alias("weight"))).alias("x"))
    return each.select("source", "x.word", "x.weight").where(F.abs("weight") >= 0.02)
