"""Language by character n-grams, learnt from labelled texts (F-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.sources.shared import save

#: Letters of a piece of a word; languages at most, so that the profiles' size is bounded (kept n-grams a language times this).
PIECE, LANGUAGES = 32, 64


def pieces(text: Column) -> Column:
    """The words of a text in lower case, those over 32 letters in pieces."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}]{{1,{PIECE}}}"), F.lit(0))


def word_grams(word: Column, longest: int) -> Column:
    """The n-grams of one to `longest` letters of a word between blanks, repeats included, the blank alone left out."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    of = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.flatten(F.array(*(of(n) for n in range(1, longest + 1)))), lambda g: g != " ")


def learn(texts: DataFrame, text: str, label: str, longest: int = 3, keep: int = 2000) -> tuple[DataFrame, list[str]]:
    """((gram, w), languages): for each n-gram that is among the `keep` most frequent of any language, the natural
    logarithm, times 1000 and rounded down, of its share there with 1 added to all counts, by language in ascending order.
    Null texts and labels are left out. Over 64 languages are an error."""
    rows = texts.select(F.col(label).alias("lang"), F.explode(pieces(F.col(text))).alias("word")).where("lang is not null").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select("lang", F.explode(word_grams(F.col("word"), longest)).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = save(counts, "gram-counts")  # read four times below; texts are cut once
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= keep)
    grams = best.select("gram").distinct()
    kept = counts.join(grams, "gram")
    languages = sorted(r.lang for r in best.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not languages:
        return grams.select("gram", F.array().cast("array<bigint>").alias("w")), []
    by = kept.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, name in enumerate(languages)))
    sums = by.agg(F.count(F.lit(1)).alias("v"), *(F.sum(f"n{i}").alias(f"s{i}") for i in range(len(languages))))
    weigh = [F.floor(1000 * F.log((F.col(f"n{i}") + 1) / (F.col(f"s{i}") + F.col("v")))) for i in range(len(languages))]
    return by.crossJoin(F.broadcast(sums)).select("gram", F.array(*weigh).alias("w")), languages


def identify(texts: DataFrame, key: str, text: str, profiles: DataFrame, languages: list[str], longest: int = 3, shortest: int = 10) -> DataFrame:
    """(key, language): the one whose summed weights of a text's n-grams are highest, ties to the first by name. Texts of
    at most `shortest` characters, null ones and those without a known n-gram are 'NA'. A row for each key; repeated keys are one text.

    Words are counted by text, and each distinct word is cut and weighed once for all texts; the profiles (at most 64 languages times what is kept) are broadcast."""
    long = texts.select(F.col(key).alias("key"), F.when(F.length(text) > shortest, F.col(text)).alias("t"))
    words = long.select("key", F.explode(pieces(F.col("t"))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    every = long.select("key").distinct()
    if not languages:
        return every.select(F.col("key").alias(key), F.lit("NA").alias("language"))
    each = words.groupBy("word").agg(F.count_if(F.col("n") > 0).alias("texts"))  # reads n, so that the words' shuffle serves both
    found = each.select("word", F.explode(word_grams(F.col("word"), longest)).alias("gram")).join(F.broadcast(profiles), "gram")
    weighed = found.groupBy("word").agg(*(F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(len(languages))))
    sums = words.join(weighed, "word").groupBy("key").agg(*(F.sum(F.col(f"w{i}") * F.col("n")).alias(f"s{i}") for i in range(len(languages))))
    top = F.array_max(F.array(*(F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("i")) for i in range(len(languages)))))
    named = sums.select("key", F.get(F.array(*map(F.lit, languages)), -top.i).alias("language"))
    return every.join(named.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")), "left").select(F.col("key").alias(key), F.coalesce("language", F.lit("NA")).alias("language"))
