"""Personal data in texts, by DataFrame functions alone (operator 1).

Regular expressions propose spans, checksum validators (Luhn for cards, mod 97 for account numbers) and range
checks confirm them, and words near a span raise its score. Base kinds (email, ip, card, phone) stay whatever
their score; account and social-security numbers need a checksum or a context word.

Positions come without a user function: split() gives the text between matches, regexp_extract_all() the matches,
and a match starts where the lengths before it add up. The sums are taken over blocks of about the square root of
their number, so that a text with very many matches takes no quadratic time. There is no shuffle. The patterns
are the base ones, written possessively and anchored to the start of a run of their characters (or to the end of
the match before): they match the same spans, in time linear in the text and without recursion.

Defined results: a null text is empty; texts without spans get zeros and empty strings; repeated rows each get
theirs; an empty table gives no rows; other columns aren't read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# The patterns of the kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without a match of this has no span of the kind.
SIGNS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
CONTEXT = {
    "email": "mail|contact|write|correo|kontakt", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay|tarjeta|karte|carte", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social",
}
NEAR, LEAST = 40, 0.75


SPAN = "struct<start:long,end:long,score:double>"


def _if(condition: Column, value: Column, kind: str) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(f"array<{kind}>"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _block_sums(k: str) -> Column:
    width, block = F.col(f"{k}_width"), F.col(f"{k}_block")
    return F.transform(F.sequence(F.lit(0), ((F.size(width) - 1) / block).cast("int")), lambda b: _total(F.slice(width, b * block + 1, block)))


def _sum_before(sums: Column):
    return lambda _, i: _total(F.slice(sums, F.lit(1), i))


def _start(k: str):
    width, block, ahead = F.col(f"{k}_width"), F.col(f"{k}_block"), F.col(f"{k}_ahead")
    return lambda gap, i: gap + F.get(ahead, (i / block).cast("int")) + _total(F.slice(width, (i / block).cast("int") * block + 1, i % block))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 100), F.left(plain, F.lit(4)))
        letter = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), letter) == 1
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def _span(k: str):
    sure = 0.9 if k in ("card", "iban") else 0.5

    def span(m: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.right(F.get(f"{k}_gaps", i), F.lit(NEAR)), F.lit(" "), F.left(F.get(f"{k}_gaps", i + 1), F.lit(NEAR))))
        score = F.lit(sure) + F.when(near.rlike(CONTEXT[k]), F.lit(min(0.3, 1 - sure))).otherwise(F.lit(0.0))
        start = F.get(f"{k}_start", i)
        return F.struct(_valid(k, m).alias("valid"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), score.alias("score"))

    return span


def find(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id and, for each kind, an array of struct(start, end, score) in the order of the text."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumns({k: _if(F.contains("text", F.lit(SIGNS[k])) if k in SIGNS else F.lit(True), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)), "string") for k in kinds})
    df = df.withColumns({f"{k}_gaps": _if(F.size(k) > 0, F.split("text", PATTERNS[k], -1), "string") for k in kinds}).drop("text")
    # Each step is a projection of its own. A column that a lambda captures is named twice in its step: Catalyst
    # inlines columns that are named once, and would evaluate them anew for each element.
    df = df.withColumns({f"{k}_before": F.slice(F.transform(F.col(f"{k}_gaps"), F.length), F.lit(1), F.size(k)) for k in kinds})
    df = df.withColumns({f"{k}_width": F.zip_with(f"{k}_before", k, lambda g, m: g + F.length(m)) for k in kinds} | {f"{k}_block": F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(k))).cast("int")) for k in kinds})
    df = df.withColumns({f"{k}_sum": _if(F.size(f"{k}_width") > 0, _block_sums(k), "int") for k in kinds})
    df = df.withColumns({f"{k}_ahead": F.transform(F.col(f"{k}_sum"), _sum_before(F.col(f"{k}_sum"))) for k in kinds})
    df = df.withColumns({f"{k}_start": _if((F.size(f"{k}_width") > 0) & (F.size(f"{k}_ahead") > 0), F.transform(F.col(f"{k}_before"), _start(k)), "int") for k in kinds})
    df = df.withColumns({f"{k}_found": _if(F.size(k) > 0, F.transform(F.filter(F.transform(F.col(k), _span(k)), _kept(k)), lambda s: F.struct(s.start, s.end, s.score)), SPAN) for k in kinds})
    return df.select("doc_id", *(F.col(f"{k}_found").alias(k) for k in kinds))


def _kept(k: str):
    return lambda s: s.valid & (F.lit(k in BASE) | (s.score >= LEAST))


def _written(k: str):
    return lambda s: F.concat_ws(":", F.lit(k), s.start.cast("string"), s.end.cast("string"))


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and the mean score of a row's spans."""
    text = {k: F.transform(F.col(k), _written(k)) for k in kinds}
    base = F.array_join(F.concat(*(text[k] for k in BASE)), ",")
    every = F.array_join(F.concat(*(text[k] for k in kinds)), ",")
    scores = F.concat(*(F.transform(F.col(k), lambda s: s.score) for k in kinds))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), mean.alias("mean_score"))
