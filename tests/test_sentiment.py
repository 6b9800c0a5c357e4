import math
import re
import string

from pyspark.sql import functions as F

from tallywind.functions import language as L

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "crisis": -3.1, "hope": 1.9, "the": 0.4, "with": 1.9, "which": -0.9}


def sentence_score(sentence):
    """The rules once more, a token at a time over a list."""
    tokens = []
    for t in sentence.split():
        bare = t.strip(string.punctuation)
        tokens.append(t if len(bare) <= 2 else bare)
    low = [t.lower() for t in tokens]
    shout = 0 < sum(t.isupper() for t in tokens) < len(tokens)
    denies = lambda w: w in L.NEGATIONS or "n't" in w
    values = []
    for i, w in enumerate(low):
        if w not in LEXICON or w in L.STRONGER or w in L.WEAKER:
            values.append(0.0)
            continue
        v = LEXICON[w]
        if tokens[i].isupper() and shout:
            v += 0.733 if v > 0 else -0.733
        for back in (1, 2, 3):
            j = i - back
            if j < 0 or low[j] in LEXICON:
                continue
            d = 0.293 if low[j] in L.STRONGER else -0.293 if low[j] in L.WEAKER else 0
            if d:
                d = -d if v < 0 else d
                if tokens[j].isupper() and shout:
                    d += 0.733 if v > 0 else -0.733
                v += d * (1, 0.95, 0.9)[back - 1]
            between = low[j + 1 : i]
            if back > 1 and low[j] == "never" and {"so", "this"} & set(between):
                v *= 1.25
            elif back > 1 and low[j] == "without" and "doubt" in between:
                pass
            elif denies(low[j]):
                v *= -0.74
        if i and low[i - 1] == "least" and (i < 2 or low[i - 2] not in ("at", "very")):
            v *= -0.74
        values.append(v)
    if "but" in low:
        b = low.index("but")
        values = [v * (0.5 if i < b else 1.5 if i > b else 1) for i, v in enumerate(values)]
    s = sum(values)
    q = sentence.count("?")
    marks = min(sentence.count("!"), 4) * 0.292 + (0 if q < 2 else q * 0.18 if q <= 3 else 0.96)
    s += marks if s > 0 else -marks if s < 0 else 0
    return s / math.sqrt(s * s + 15)


def by_hand(text):
    parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text or "") if s.strip(" ")]
    return sum(map(sentence_score, parts)) / len(parts) if parts else None


CASES = [
    "The news is good.", "The news is not good.", "The news is VERY good!!!", "It was never so good", "It was never this very good", "GOOD news and bad news", "ALL GOOD", "good but bad", "Hope, but the crisis is slightly bad??",
    "Without doubt good. Without a doubt great!", "at least good", "the least good", "least good", "isn't really good", "barely BAD, extremely (great)", "so so so good", "good good not good", "", "   ", None, "!!!", "no words here?", "Bad????? Good!!!!!!",
    "not a very good", "hardly ever that great. But hope", "never was it so good", "x" * 5000 + " good",
]


def test_rules_equal_a_scan_by_hand(spark, sf):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", L.ruled_sentiment(F.col("t"), LEXICON).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = by_hand(t)
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9), (t and t[:200], got[i], want)
    flat = [sentence_score(t) for t in ("The news is good.", "The news is very good.", "The news is VERY good!", "The news is not good.", "The news is barely good.")]
    assert flat[3] < 0 < flat[4] < flat[0] < flat[1] < flat[2]
    assert df.select(L.ruled_sentiment(F.col("t"), {}).alias("s")).where("s <> 0").count() == 0


def test_rules_run_in_batches_with_long_lexicons(spark):
    lexicon = LEXICON | {f"word{i}": 1.0 for i in range(5000)}  # too many for a literal that is searched for each token
    texts = ["word4999 is GOOD.\x0b Not bad", "good! ", "a good day", "\t. good", "good."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.ruled_sentiment(F.col("t"), lexicon).alias("s"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.s for r in df.collect()}
    one = lambda s: s / math.sqrt(s * s + 15)
    want = [(one(1 + 1.9 + 0.733) + one(-2.5 * -0.74)) / 2, 0.0, 0.0, one(1.9) / 2, one(1.9)]  # Java's white space ends words, no other
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want)), got
