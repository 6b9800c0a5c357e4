"""Documents, vocabularies and small relational rules of the corpus scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_entity(df: DataFrame, entities: str, entity: str = "entity") -> DataFrame:
    """J-05, FLT-05, FLT-08: a row per document and entity that it names; documents without any have none."""
    return df.withColumn(entity, F.explode(entities))


def monthly_counts(df: DataFrame, entity: str, period: str) -> DataFrame:
    """A-05, A-06: n by entity and period, with the entity's total and mean of its periods."""
    n = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy(entity).agg(F.sum("n").alias("total"), F.avg("n").alias("mean")), entity)


def in_vocabulary(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """FLT-10, FLT-24: the tokens that the vocabulary has. Its `keep` bounds it (S-06), so that it is broadcast."""
    return tokens.join(F.broadcast(vocabulary.select(token).distinct()), token, "left_semi")


def oov_rate(tokens: DataFrame, vocabulary: DataFrame, doc: str, token: str = "token") -> DataFrame:
    """A-34: tokens, those outside the vocabulary, and their share, by document. The vocabulary, which its `keep` bounds (S-06),
    is broadcast: what is shuffled are two sums a document and task."""
    known = F.broadcast(vocabulary.select(token).distinct().withColumn("known", F.lit(1)))
    by = tokens.select(doc, token).join(known, token, "left").groupBy(doc).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("known").isNull()).alias("oov"))
    return by.withColumn("oov_rate", F.col("oov") / F.col("n_tokens"))


def search_terms(terms: DataFrame, vocabulary: DataFrame, stop: list[str], term: str = "term", token: str = "token") -> DataFrame:
    """FLT-23: a term as one `_`-joined word where the vocabulary has it, else its parts that it has and that aren't stop
    words, `&`-joined; terms without any go. terms is a list written by hand; vocabulary(token) may be large."""
    parts = terms.select(term, F.posexplode(F.concat(F.array(F.replace(term, F.lit(" "), F.lit("_"))), F.filter(F.split(term, r"\s+"), lambda t: t != ""))).alias("pos", token))
    known = parts.join(F.broadcast(vocabulary.join(F.broadcast(parts.select(token).distinct()), token, "left_semi").select(token).distinct()), token)
    at = known.groupBy(term).agg(F.array_sort(F.collect_list(F.struct("pos", token))).alias("at"))
    single = F.filter("at", lambda p: p.pos == 0)
    several = F.filter("at", lambda p: (p.pos > 0) & ~p[token].isin(stop))
    kept = F.when(F.size(single) > 0, single[0][token]).when(F.size(several) > 0, F.array_join(F.transform(several, lambda p: p[token]), "&"))
    return at.select(term, kept.alias("kept")).where("kept is not null")


def language(text: Column, profiles: dict[str, list[str]], least: int = 10) -> Column:
    """F-15: the language whose frequent words a text has most of, the first in order where several do; 'NA' for texts
    of at most `least` characters and where no such word is there."""
    among = lambda p: lambda w: w.isin(p)
    hits = lambda known: F.array_max(F.array(*(F.struct(F.size(F.filter(known, among(p))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(profiles.items()))))
    known = F.filter(F.split(F.lower(text), r"[^a-zà-öø-ÿ]+"), among(sorted({w for p in profiles.values() for w in p})))
    # Arrays of one element: what a lambda gets has been worked out once, else a text is cut for each profile and use.
    best = F.transform(F.transform(F.array(known), hits), lambda b: F.when(b.getField("n") > 0, b.getField("name")).otherwise("NA"))[0]
    return F.when(F.length(text) > least, best).otherwise("NA")


def canonical(df: DataFrame, source: str, prefix: str, words: int = 50) -> tuple[DataFrame, DataFrame]:
    """PRJ-04, F-49, FLT-07, SNK-01: (articles, dead letters) of raw rows (id, title, publishedDate, bodyXML, webUrl).

    The id is the prefix and the raw id's last part in lower case, the date what stands before `T`, a missing address
    'NA'. Rows without a title or a body are dead letters with their reason. Of rows with one id the latest stays, by
    date, then by body."""
    from tallywind.functions.text import first_words, html_text

    body = html_text(F.col("bodyXML"))
    rows = df.select(
        F.concat(F.lit(prefix), F.element_at(F.split(F.lower("id"), "/"), -1)).alias("an"), F.lit("NA").alias("language_code"), body.alias("body"), F.split("publishedDate", "T")[0].alias("publication_date"),
        F.lit(source).alias("source_name"), "title", F.lit("NA").alias("region_codes"), first_words(body, words).alias("snippet"), F.coalesce("webUrl", F.lit("NA")).alias("weburl"),
    )
    reason = F.when(F.col("title").isNull(), "no title").when(F.col("body").isNull(), "no body").when(F.length("body") == 0, "empty body")
    told = rows.withColumn("error_type", reason)
    latest = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce("publication_date", F.lit("")), "body"))
    return told.where("error_type is null").groupBy("an").agg(latest.alias("a")).select("a.*"), told.where("error_type is not null").select("an", "error_type")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-17, J-20: a key's first row in a stated order. One row a key and task is shuffled, not all of them."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def sliding(items: Column, n: int) -> Column:
    """W-18: overlapping tuples of n, each starting at the last item of the one before; shorter rests go."""
    starts = F.sequence(F.lit(0), F.size(items) - n, F.lit(n - 1))
    return F.when(F.size(items) >= n, F.transform(starts, lambda i: F.slice(items, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def google_url(url: Column) -> Column:
    """F-26: the address within a base64-url path part: from its first 'http' to before the next, without the last two
    characters, bytes that aren't UTF-8 left out. Null for a link that holds no address."""
    part = F.split(F.element_at(F.split(url, "/"), -1), r"\?")[0]
    full = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    held = F.try_to_binary(F.translate(full, "-_", "+/"), F.lit("base64"))
    text = F.replace(F.make_valid_utf8(held.cast("string")), F.lit("\ufffd"), F.lit(""))
    rest = F.concat(F.lit("http"), F.get(F.split(text, "http"), 1))
    return F.left(rest, F.length(rest) - 2)


def fenced_json(c: Column, schema: str) -> Column:
    """F-28: JSON between markdown fences."""
    return F.from_json(F.trim(F.regexp_replace(c, "```(?:json)?", "")), schema)


def quoted(term: Column) -> Column:
    """F-23: a term of several words in quotes."""
    return F.when(F.contains(F.trim(term), F.lit(" ")), F.concat(F.lit('"'), F.trim(term), F.lit('"'))).otherwise(F.trim(term))


def plain_term(c: Column) -> Column:
    """F-22: without no-break spaces at its ends, in lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "^[  ]+|[  ]+$", "")))


def topic_words(c: Column) -> Column:
    """F-29: the words of `0.012*"word" + ...`."""
    return F.regexp_extract_all(c, F.lit(r'\*"([^"]*)"'), F.lit(1))


def merge_last(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """U-08: values by key, the new row's where both have one, a null too."""
    told = new.select(*keys, F.struct(F.col(value).alias("v")).alias("_new"))
    return old.withColumnRenamed(value, "_old").join(told, keys, "full").select(*keys, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col("_old")).alias(value))


def texts_by_topic(df: DataFrame, topic: list[str], doc: str, text: str, size: int = 64) -> DataFrame:
    """A-19: a topic's texts joined by spaces in the order of their ids, with the ids, in parts of `size` ids (part), so that
    a topic of any size is many rows."""
    held = F.array_sort(F.collect_list(F.struct(F.col(doc).alias("id"), F.col(text).alias("text"))))
    by = df.groupBy(*topic, F.floor(F.col(doc) / size).alias("part")).agg(held.alias("h"))
    return by.select(*topic, "part", F.col("h.id").alias("ids"), F.array_join(F.col("h.text"), " ").alias("text"))


def closest(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """J-21: the label most like a value by similarity, the first in order where several are. labels: a short list."""
    from tallywind.functions.text import similarity

    each = F.array(*(F.struct(F.round(similarity(F.col(column), F.lit(x)), 9).alias("s"), F.lit(-i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(labels)))
    best = F.array_max(each)
    return df.withColumns({"label": best.label, "similarity": best.s})


def index_name(code: Column, names: dict[str, str]) -> Column:
    """PRJ-14: a code's label; a code without one is an error."""
    label = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)
    return F.when(label.isNotNull(), label).otherwise(F.raise_error(F.concat(F.lit("no label for "), code)).cast("string"))


def column_name(c: Column) -> Column:
    """PRJ-08: X_pred_crisis to pred-X, other names to index-X; time and country stay."""
    return F.when(c.isin("time", "country"), c).when(c.endswith("_pred_crisis"), F.concat(F.lit("pred-"), F.regexp_replace(c, "_pred_crisis$", ""))).otherwise(F.concat(F.lit("index-"), c))


def file_country(name: Column) -> Column:
    """PRJ-09: the country in `agg_<country>_month...`, `_` a space, in title case, after hyphens too."""
    from tallywind.functions.text import title_case

    return title_case(F.translate(F.regexp_extract(name, "agg_(.*?)_month", 1), "_", " "))


def one_hot_label(columns: list[str]) -> Column:
    """PRJ-16: the name of the first column that isn't 0."""
    return F.coalesce(*(F.when(F.col(c) != 0, F.lit(c)) for c in columns))


def random_words(vocabulary: DataFrame, token: str, seeds: int, n: int, within: DataFrame) -> DataFrame:
    """S-09: for each seed the first 5 n words of the vocabulary by a hash of word and seed, and of these the first n that
    `within` has: (seed, token, rank).

    Only words whose hash starts low enough are ranked: as many as make 20 n a seed on average, so that 5 n of them are there
    but for a chance under 1e-9 (n of 5 and more); a vocabulary of up to 20 n words is ranked whole."""
    h = F.md5(F.concat(token, F.lit("#"), F.col("seed").cast("string")).cast("binary"))
    words = vocabulary.select(token).distinct()
    size = words.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_v"))  # one row
    start = F.lower(F.lpad(F.hex(F.least(F.floor(F.lit(20.0 * n * (1 << 32)) / F.col("_v")), F.lit((1 << 32) - 1)).cast("long")), F.lit(8), F.lit("0")))
    every = words.crossJoin(F.broadcast(size.select(start.alias("_start")))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("h", h).where(F.left("h", F.lit(8)) <= F.col("_start"))
    drawn = every.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("h", token))).where(F.col("r") <= 5 * n)
    held = drawn.join(within.select(token).distinct(), token, "left_semi")
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("r"))).where(F.col("rank") <= n).select("seed", token, "rank")


def island_scores(df: DataFrame, entity: str, order: str, pre: str, tranquil: str, predicted: str) -> DataFrame:
    """A-28: tp, pre-crisis rows predicted as such; fp, tranquil rows predicted so; fn, runs of pre-crisis rows without
    any. One row; runs are within an entity."""
    from tallywind.operators.series import islands

    runs = islands(df, [entity], order, pre)
    hit = F.col(predicted) == 1
    by = runs.groupBy(entity, "run_id").agg(F.max(pre).alias("on"), F.count_if(hit & (F.col(pre) == 1)).alias("tp"), F.count_if(hit & (F.col(tranquil) == 1)).alias("fp"))
    return by.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count_if((F.col("on") == 1) & (F.col("tp") == 0)).alias("fn"))
