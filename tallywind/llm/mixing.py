"""Mixing by soft domain membership, by DataFrame functions alone (operator 6).

The labels table names three domains: clean (quality 1, not toxic), low (quality 0) and toxic. Each document's words are
hashed to BUCKETS; from a bounded sample of labelled ids (`sample`) a Bernoulli model learns how much more a bucket speaks
for low or for toxic text than for clean text. Two means of these log odds over all words of a text, the number of words
that speak strongly for toxic text, its size and two shares of characters are the statistics of which a Gaussian naive
Bayes classifier, trained on all labelled rows, makes posteriors over the domains. Rates r >= 0 are then fitted so
that the expected token totals of the domains, sum of r * tokens * posterior, match the targets: projected gradient
on the least squares, preconditioned by the (3 x 3) Gram matrix so that a step of 1 is safe, from r = 1. A step
aggregates three sums over a narrow table; a document's rate is a function of its row and of the steps' vectors, so
nothing but those vectors comes to the driver and nothing is shuffled by key.

Whole texts count; a text's words are an array in its row, so a very long text takes memory of its own size, and time in
proportion to it. Tokens are runs without white space; words are runs of letters and digits.

Defined results: a null text is empty and has no tokens; its rate stays 1; rows whose labels are null or not 0 or 1
aren't learnt from; of labels that repeat an id the worst counts; without labels of a domain its posterior is 0
(without any labels all is clean); repeated rows get equal rates and copies; a null doc_id gets its row; an empty
table gives no rows; other columns aren't read, and apply_mix keeps them, whatever their names.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywind.llm.common import free_name, save

DOMAINS = ("clean", "low", "toxic")
STATS = ("size", "marks", "shouts", "low", "toxic", "hits")
BUCKETS, STRONG = 1 << 16, math.log(20)
#: Target totals, as multiples of what the corpus holds: clean text a little over once, little of the rest.
TARGETS = {"clean": 1.05, "low": 0.5, "toxic": 0.1}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    worst = known.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return worst.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _buckets(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def word_odds(docs: DataFrame, known: DataFrame, sample: int) -> tuple[list[float], list[float]]:
    """For each bucket the log odds of its presence in a low and in a toxic text, against a clean one (0 without labels of
    the domain, and where under 3 texts or 1 in 100 of either have it), from the texts of at most `sample` labelled ids."""
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = _texts(docs).join(F.broadcast(few), "doc_id").select("domain", F.array_distinct(_buckets(F.col("text"))).alias("b"))  # `sample` ids at most
    rows = seen.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("b")).groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")).collect()  # domains x buckets at most
    n = np.zeros((len(DOMAINS), BUCKETS + 1))
    for r in rows:
        n[r.domain, r.b] = r.n  # -1, the last place, counts texts
    share = np.log((n[:, :-1] + 0.5) / (n[:, -1:] + 1))
    seen_often = n[:, :-1] >= np.maximum(3, 0.01 * n[:, -1:])
    return tuple(np.where(seen_often[d] | seen_often[0], share[d] - share[0], 0.0).tolist() if n[d, -1] and n[0, -1] else [0.0] * BUCKETS for d in (1, 2))


def statistics(docs: DataFrame, odds: tuple[list[float], list[float]]) -> DataFrame:
    """doc_id, tokens and STATS of whole texts."""
    low, toxic = (F.split(F.lit(",".join(f"{v:.17g}" for v in x)), ",").cast("array<double>") for x in odds)  # Catalyst folds them into literals
    rows = _texts(docs).select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("tokens"), "text", _buckets(F.col("text")).alias("b"))
    per, words = F.greatest(F.col("tokens"), F.lit(1.0)), F.greatest(F.size("b"), F.lit(1))
    count = lambda p: F.regexp_count("text", F.lit(p))
    mean = lambda odds: F.aggregate("b", F.lit(0.0), lambda a, i: a + F.get(odds, i)) / words
    return rows.select(
        "doc_id", "tokens", F.log1p(F.octet_length("text").cast("double")).alias("size"), F.log1p(20 * count(r"[#$%&*!|]+") / per).alias("marks"), F.log1p(20 * count(r"[A-ZÀ-Ý]{2,}") / per).alias("shouts"),
        mean(low).alias("low"), mean(toxic).alias("toxic"), F.log1p(F.size(F.filter("b", lambda i: F.get(toxic, i) > STRONG)).cast("double")).alias("hits"),
    )


def posteriors(stats: DataFrame, known: DataFrame) -> DataFrame:
    """stats with p_<domain>, by Gaussian naive Bayes over STATS."""
    rows = stats.join(known, "doc_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *(f(s).alias(f"{f.__name__}_{s}") for s in STATS for f in (F.avg, F.var_pop))).collect()
    if not rows:
        return stats.select("doc_id", "tokens", *(F.lit(float(d == "clean")).alias(f"p_{d}") for d in DOMAINS))
    total, logs = sum(r.n for r in rows), [F.lit(None).cast("double")] * len(DOMAINS)
    # No variance under a tenth of the labelled rows' mean one: a domain of few or equal rows isn't sure of itself.
    least = {s: max(1e-6, 0.1 * sum(r.n * r[f"var_pop_{s}"] for r in rows) / total) for s in STATS}
    for r in rows:
        spread = {s: max(r[f"var_pop_{s}"], least[s]) for s in STATS}
        logs[r.domain] = F.lit(math.log(r.n / total) - 0.5 * sum(math.log(v) for v in spread.values())) - sum(((F.col(s) - r[f"avg_{s}"]) ** 2 / (2 * v) for s, v in spread.items()), start=F.lit(0.0))
    one = stats.select("doc_id", "tokens", *(x.alias(f"l_{d}") for d, x in zip(DOMAINS, logs, strict=True)))
    one = one.withColumn("top", F.greatest(*(F.col(f"l_{d}") for d in DOMAINS)))
    odds = {d: F.coalesce(F.exp(F.col(f"l_{d}") - F.col("top")), F.lit(0.0)) for d in DOMAINS}
    one = one.select("doc_id", "tokens", *(x.alias(f"e_{d}") for d, x in odds.items()))
    every = sum((F.col(f"e_{d}") for d in DOMAINS), start=F.lit(0.0))
    return one.select("doc_id", "tokens", *((F.col(f"e_{d}") / every).alias(f"p_{d}") for d in DOMAINS))


def fit_rates(rows: DataFrame, targets: dict[str, float], steps: int = 500, close: float = 1e-6) -> Column:
    """The rate of a row of rows(tokens, p_<domain>) whose expected totals are targets times the corpus's.

    After each step the Gram matrix of the rows with a rate over 0 scales the next one. Steps go on until the totals are
    `close`, or until a step by the whole Gram matrix gets no nearer: no rates reach such targets. Then, or where `steps`
    is hit, the remaining miss is given in a warning."""
    part = [F.col("tokens") * F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    first = rows.agg(*(F.sum(x).alias(f"t{i}") for i, x in enumerate(part)), *(F.sum(part[i] * part[j]).alias(f"g{i}{j}") for i, j in pairs)).first()
    total, gram = np.array([first[f"t{i}"] or 0.0 for i in range(3)]), np.zeros((3, 3))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"g{i}{j}"] or 0.0
    goal, whole = total * [targets[d] for d in DOMAINS], np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    inverse, taken, now = whole, [], total

    def rate(ys: list[np.ndarray]) -> Column:
        if not ys:
            return F.lit(1.0)
        steps_taken = F.array(*(F.array(*(F.lit(float(v)) for v in y)) for y in ys))
        return F.aggregate(steps_taken, F.lit(1.0), lambda r, y: F.greatest(F.lit(0.0), r - sum((p * F.get(y, i) for i, p in enumerate(part)), start=F.lit(0.0))))

    miss = lambda x: float((x - goal) @ whole @ (x - goal))
    for _ in range(steps):
        if np.abs(now - goal).max() <= close * max(1.0, total.sum()):
            break
        y = inverse @ (now - goal)
        r = F.col("rate")
        active = [F.sum(F.when(r > 0, part[i] * part[j])).alias(f"g{i}{j}") for i, j in pairs]
        got = rows.withColumn("rate", rate([*taken, y])).agg(*(F.sum(r * x).alias(f"t{i}") for i, x in enumerate(part)), *active).first()
        then = np.array([got[f"t{i}"] or 0.0 for i in range(3)])
        if inverse is not whole and miss(then) > miss(now):  # the rows at 0 came back: a step by the whole Gram matrix can't fail
            inverse = whole
            continue
        stuck = inverse is whole and miss(then) >= miss(now) * (1 - 1e-6)
        taken, now = [*taken, y], then
        if stuck:
            break
        for i, j in pairs:
            gram[i, j] = gram[j, i] = got[f"g{i}{j}"] or 0.0
        inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    if np.abs(now - goal).max() > close * max(1.0, total.sum()):
        left = ", ".join(f"{d} {x:+.6g}" for d, x in zip(DOMAINS, now - goal, strict=True))
        warnings.warn(f"the rates miss their targets after {len(taken)} steps, in tokens: {left}", RuntimeWarning, stacklevel=2)
    return rate(taken)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = 5000, seed: int = 7) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate and copies (the rate, rounded up or down by a hash of the id) of every row."""
    known = save(domains(labels), "domains")
    stats = save(statistics(docs, word_odds(docs, known, sample)), "mix-stats")
    rows = save(posteriors(stats, known), "mix-posteriors")
    rated = rows.withColumn("rate", fit_rates(rows, targets or TARGETS))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return rated.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row repeated as often as its copies say; rows that repeat an id share its number."""
    of, many, nth = (free_name(docs.columns, x) for x in ("of", "many", "nth"))
    copies = mix(docs.select("doc_id", "text"), labels, targets).groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(many)).where(F.col(many) != 1)
    rows = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(copies[of]), "left")
    times = F.coalesce(F.col(many), F.lit(1)).cast("int")
    return rows.where(times > 0).select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), times)).alias(nth)).drop(nth)
