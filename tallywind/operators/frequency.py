"""Word frequencies and what is built from them: group indices, TF-IDF, phrases, coherence."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import save

#: Pairs of a level of phrases that are held by the driver and each worker; words of a block of texts, where there are more pairs.
HELD, BLOCK = 1_000_000, 2_000_000


def per_mille(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """A-01, A-02: n, total and 1000 n / total by keys and token. The shuffle is of partial counts."""
    n = tokens.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total"))  # a key's vocabulary is never gathered in one task
    return n.join(total, keys).select(*keys, token, "n", "total", (1000 * F.col("n") / F.col("total")).alias("freq"))


def group_index(freq: DataFrame, groups: DataFrame, periods: DataFrame, entity: str, period: str, token: str = "token") -> DataFrame:
    """A-03: per entity, period and group the weighted sum of word frequencies.

    freq(entity, period, token, freq), groups(grp, word, weight), periods(period): every period of the corpus. A period
    without tokens is null, an absent word counts 0, a group that an entity never uses is null throughout."""
    hit = freq.join(groups, freq[token] == groups.word, "left").groupBy(entity, period, "grp").agg(F.sum(F.col("freq") * F.col("weight")).alias("hit"))
    known = F.when(F.col("grp").isNotNull(), F.struct("grp", "hit"))
    by_period = hit.groupBy(entity, period).agg(F.map_from_entries(F.collect_list(known)).alias("hits"))
    # an entity's row holds its periods and the few groups of each; periods and group names are short lists
    held = by_period.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(period, "hits"))).alias("by"), F.array_distinct(F.flatten(F.collect_list(F.map_keys("hits")))).alias("used"))
    frame = held.crossJoin(F.broadcast(periods)).crossJoin(F.broadcast(groups.select("grp").distinct()))
    value = F.when(F.map_contains_key("by", F.col(period)) & F.array_contains("used", F.col("grp")), F.coalesce(F.try_element_at(F.try_element_at("by", F.col(period)), F.col("grp")), F.lit(0.0)))
    return frame.select(entity, "grp", period, value.alias("value"))


def tfidf(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """A-26, A-27: tf * log2(N / df), each document's vector of length 1. terms: a row per occurrence; null terms are none.

    Both counts read tf's column, so that the three plans share one shuffle of tf, by term, and texts are cut into words once.
    Where a document's terms are in one task already, tf itself needs no shuffle."""
    tf = terms.where(F.col(term).isNotNull()).groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf")).repartition(term)
    df = tf.groupBy(term).agg(F.count_if(F.col("tf") > 0).alias("df"))
    n = tf.select(F.count_distinct(F.when(F.col("tf") > 0, F.col(doc))).alias("docs"))  # one row
    w = tf.join(df, term).crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * F.log2(F.col("docs") / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.withColumn("norm", norm).select(doc, term, "tf", "df", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("tfidf"))


def doc_frequency(terms: DataFrame, doc: str, term: str, least: int, most: float, keep: int) -> DataFrame:
    """A-25, S-06: words in at least `least` and at most a share `most` of the documents, the `keep` most frequent."""
    tf = terms.where(F.col(term).isNotNull()).groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(term).agg(F.count_if(F.col("tf") > 0).alias("df")).where(F.col("df") >= least)
    if most < 1:  # else no word is in too many
        n = tf.select(F.count_distinct(F.when(F.col("tf") > 0, F.col(doc))).alias("docs"))
        df = df.crossJoin(F.broadcast(n)).where(F.col("df") <= most * F.col("docs"))
    return df.orderBy(F.desc("df"), term).limit(keep).select(term, "df")


def bigrams(tokens: DataFrame, doc: str, words: str, least: int, threshold: float) -> DataFrame:
    """M-01: (n(ab) - least) * V / (n(a) n(b)) over the threshold. tokens(doc, words array).

    Words and pairs are counted in one pass over the texts; what is kept of the counts is written, and read for each use."""
    tokens = tokens.select(F.filter(words, lambda x: x.isNotNull()).alias("_w"))
    w = F.col("_w")
    pairs = tokens.select(F.inline(F.arrays_zip(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).cast("array<struct<a:string,b:string>>")))  # a text's last word is with a null
    counted = pairs.groupingSets([["a", "b"], ["a"]], "a", "b").agg(F.count(F.lit(1)).alias("nab"), F.grouping("b").alias("single"))
    counted = save(counted.where((F.col("single") == 1) | (F.col("b").isNotNull() & (F.col("nab") >= least))), "grams")
    one = save(counted.where("single = 1").select(F.col("a").alias("w"), F.col("nab").alias("n")), "gram-words")
    two = counted.where("single = 0").drop("single")
    size = one.select(F.count(F.lit(1)).alias("v"))  # one row
    both = two.join(one.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(size))
    score = (F.col("nab") - least) * F.col("v") / (F.col("na") * F.col("nb"))
    return both.withColumn("score", score).where(F.col("score") > threshold).select("a", "b", "nab", "score")


class Phrases:
    """Accepted phrases as a trie: level by level, what may follow a word. A scan takes a level's pairs from the left, each word
    once, and what it joined is a word of the next level, so that a text costs its words times the levels. A level of too many
    pairs to hold is a table (a, b), which `join_phrases` joins."""

    def __init__(self, levels: list[list[tuple[str, str]]] = (), glue: str = "_"):
        self.glue, self.levels = glue, []
        for pairs in levels:
            self.add(pairs)

    def add(self, pairs: list[tuple[str, str]]) -> None:
        after: dict[str, set[str]] = {}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)
        self.levels.append(after)

    def of(self, levels: list[dict[str, set[str]]]) -> Phrases:
        some = Phrases(glue=self.glue)
        some.levels = levels
        return some

    def join(self, words: list[str], levels: int | None = None) -> list[str]:
        for after in self.levels[:levels]:
            out, i, n = [], 0, len(words)
            while i < n:
                if i + 1 < n and words[i + 1] in after.get(words[i], ()):
                    out.append(words[i] + self.glue + words[i + 1])
                    i += 2
                else:
                    out.append(words[i])
                    i += 1
            words = out
        return words


def join_phrases(docs: DataFrame, words: str, phrases: Phrases) -> DataFrame:
    """M-01 applied: docs with the phrases of an array of words joined. Nulls stay null; a null word is left out.

    Levels that are held are broadcast as one trie; a level that is a table is joined by blocks of texts."""
    for table, levels in groupby(phrases.levels, key=lambda x: isinstance(x, DataFrame)):
        if table:
            for pairs in levels:
                docs = _joined_by_blocks(docs, words, pairs, phrases.glue)
        else:
            docs = _joined_by_trie(docs, words, phrases.of(list(levels)))
    return docs


def _joined(column: pa.ChunkedArray | pa.Array, phrases: Phrases) -> pa.Array:
    return pa.array([None if x is None else phrases.join([w for w in x if w is not None]) for x in column.to_pylist()], pa.list_(pa.string()))


def _joined_by_trie(docs: DataFrame, words: str, phrases: Phrases) -> DataFrame:
    shared, columns = docs.sparkSession.sparkContext.broadcast(phrases), docs.columns

    def run(batches):
        for b in batches:
            joined = _joined(b.column(words), shared.value)
            yield pa.RecordBatch.from_arrays([joined if c == words else b.column(c) for c in columns], columns)

    return docs.mapInArrow(run, docs.schema)


def _joined_by_blocks(docs: DataFrame, words: str, pairs: DataFrame, glue: str) -> DataFrame:
    """Texts are dealt to blocks of about BLOCK words; a block is sent those of the pairs that its texts have."""
    columns, schema = docs.columns, docs.schema
    docs = save(docs.withColumn("_id", F.monotonically_increasing_id()), "phrase-texts")  # an id is the same in both uses
    total = docs.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    docs = docs.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    w = F.col("_w")
    near = docs.select(F.col("_block").alias("_of"), F.filter(words, lambda x: x.isNotNull()).alias("_w")).select("_of", F.inline(F.arrays_zip(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).cast("array<struct<a:string,b:string>>")))
    mine = near.where("b is not null").distinct().join(pairs.select("a", "b"), ["a", "b"]).select("_of", "a", "b")

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        phrases = Phrases([list(zip(own.column("a").to_pylist(), own.column("b").to_pylist(), strict=True))], glue)
        return pa.table([_joined(texts.column(words), phrases) if c == words else texts.column(c) for c in columns], names=columns)

    return docs.drop("_id").groupBy("_block").cogroup(mine.groupBy("_of")).applyInArrow(run, schema)


def learn_phrases(docs: DataFrame, doc: str, words: str, order: int = 2, least: int = 40, threshold: float = 10.0) -> tuple[Phrases, DataFrame]:
    """M-01: phrases of up to 2 ** (order - 1) words: the trie, and its rows (level, a, b, nab, score). Level 2 joins words,
    each next one what the level before made, at a threshold half as high again. docs(doc, words array).

    All pairs over the threshold are accepted. The trie holds a level of HELD pairs at most; a larger one stays a table."""
    found, told, current = Phrases(), None, docs.select(doc, words)
    for level in range(2, order + 1):
        pairs = bigrams(current, doc, words, least, threshold * 1.5 ** (level - 2))
        pairs = save(pairs.select(F.lit(level).alias("level"), "a", "b", "nab", "score"), "phrases")
        if pairs.count() > HELD:
            found.levels.append(pairs.select("a", "b"))
        else:
            found.add([(r.a, r.b) for r in pairs.select("a", "b").collect()])  # HELD at most
        told = pairs if told is None else told.unionByName(pairs)
        if level < order:
            current = join_phrases(docs.select(doc, words), words, found)
    return found, told


def umass(terms: DataFrame, topics: DataFrame, doc: str, term: str) -> DataFrame:
    """A-32: sum over pairs of a topic's words of ln((D(wi, wj) + 1) / D(wj)), wj the higher-ranked; 0 where no text holds wj.
    topics(topic, rank, word): short lists, which are broadcast, so that only their words are shuffled."""
    held = terms.select(doc, F.col(term).alias("word")).join(F.broadcast(topics.select("word").distinct()), "word", "left_semi").distinct().join(F.broadcast(topics), "word")
    single = held.groupBy("topic", "rank").agg(F.count(F.lit(1)).alias("d"))
    a, b = held.alias("a"), held.alias("b")
    both = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") > F.col("b.rank"))).groupBy(F.col("a.topic").alias("topic"), F.col("a.rank").alias("ri"), F.col("b.rank").alias("rj")).agg(F.count(F.lit(1)).alias("dij"))
    ranks = topics.select("topic", F.col("rank").alias("ri")).join(topics.select("topic", F.col("rank").alias("rj")), "topic").where("ri > rj")
    full = ranks.join(both, ["topic", "ri", "rj"], "left").join(single.select("topic", F.col("rank").alias("rj"), "d"), ["topic", "rj"], "left")
    return full.groupBy("topic").agg(F.sum(F.coalesce(F.log((F.coalesce("dij", F.lit(0)) + 1) / F.col("d")), F.lit(0.0))).alias("coherence"))
