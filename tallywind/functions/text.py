"""Text columns: cleaning, tokens, keyword patterns. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number pattern, the punctuation string and the token limits of the cleaning rules.
NUMBERS = r"([',./]?[0-9]+[',./]?)+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[a-zà-öø-ÿ]+"
#: White space as Unicode has it, in the syntax that Java's and RE2's patterns share.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# The usual list of English stop words, in its usual order.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no
nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't
isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def squeeze(c: Column) -> Column:
    """F-01: runs of white space, Unicode's too, become one space."""
    return F.regexp_replace(c, SPACE, " ")


def no_apostrophes(c: Column) -> Column:
    """F-02."""
    return F.regexp_replace(c, "'+", " ")


def mask_numbers(c: Column, mask: str = " __NUMBER__ ") -> Column:
    """F-03, F-04."""
    return F.regexp_replace(c, NUMBERS, mask)


def normalise(c: Column) -> Column:
    """F-01, F-02, F-03, F-05 in the order of the first cleaning pass."""
    return F.lower(squeeze(mask_numbers(no_apostrophes(squeeze(c)))))


def words(c: Column) -> Column:
    """F-08: lower-case words of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def spaced(c: Column) -> Column:
    """F-09: tokens between single spaces after squeezing."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def first_words(c: Column, n: int = 50) -> Column:
    """F-13, PRJ-04: the first n tokens between spaces."""
    return F.array_join(F.slice(F.split(squeeze(c), " "), 1, n), " ")


# Fixed value: a token with any of these parts goes.
BAD_PARTS = ["!", '"', "#", "$", "%", "&", "'", "(", ")", "*", "+", ",", "-", ".", "/", ":", ";", "<", "=", ">", "?", "@", "[", "\\", "]", "^", "`", "{", "|", "}", "~", "NUMBER", "«"]


def clean_tokens(tokens: Column, stop: list[str] = STOP_WORDS, bad: list[str] = BAD_PARTS) -> Column:
    """FLT-14: over 3 and at most 20 characters, no stop word, none of the bad parts within."""
    parts = "|".join(rf"\Q{x}\E" for x in bad)
    return F.filter(tokens, lambda t: F.length(t).between(4, 20) & ~t.isin(stop) & ~t.rlike(parts))


def no_punctuation(tokens: Column, stop: list[str] = STOP_WORDS) -> Column:
    """FLT-15: a token goes if it is a stop word or a contiguous part of the punctuation string."""
    return F.filter(tokens, lambda t: ~t.isin(stop) & (F.instr(F.lit(PUNCTUATION), t) == 0))


def alpha_tokens(tokens: Column, stop: list[str] = STOP_WORDS) -> Column:
    """FLT-16."""
    return F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(stop))


def keyword_pattern(keywords: list[str], plural: bool = False, prefix: bool = False, fold: bool = True) -> str:
    """F-16 (plural), F-17 (prefix: no boundary at the end), F-18 (both boundaries)."""
    body = "|".join(re.escape(k) for k in sorted(keywords, key=lambda k: (-len(k), k)))
    return ("(?i)" if fold else "") + rf"\b(?:{body})" + (r"(?:s|es|'s)?" if plural else "") + ("" if prefix else r"\b")


def glue_lines(c: Column, keep_defect: bool = False) -> Column:
    """F-30: line breaks become spaces, or, as the original does, nothing."""
    return F.regexp_replace(c, r"[\n\r]", "" if keep_defect else " ")


def title_case(c: Column) -> Column:
    """F-24: initial capitals after spaces and hyphens."""
    return F.array_join(F.transform(F.split(c, "-"), F.initcap), "-")


def dehyphenate(c: Column) -> Column:
    """F-12."""
    return F.replace(c, F.lit("- \n"), F.lit(""))


#: What isn't text: comments, scripts and styles (to the end, where nothing closes them), tags (a quoted > doesn't end one, unless
#: the quote stays open), declarations, instructions. A < that begins none of these is text.
MARKUP = r"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|</?[a-z](?:[^"'>]+|"[^"]*"|'[^']*')*>|</?[a-z][^>]*>|<![^>]*>|<\?[^>]*>"""
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"


def entities(c: Column, bare: bool = True) -> Column:
    """F-11: every named and numbered character reference becomes its character, those that stand without a semicolon
    too (unless `bare` is false), as browsers do; others stay. The names are the published HTML 5 table, from Python's library."""
    import json
    from html.entities import html5

    def table(names: dict[str, str]) -> Column:
        return F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # one literal

    basic = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\xa0"}
    named = table(basic | html5)  # the usual ones first: a lookup goes through the names in order
    pattern = ENTITY if bare else ENTITY.replace(";?", ";")
    open_names = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    western = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}  # numbers that pages mean as Windows characters

    def numbered(e: Column) -> Column:
        digits = F.regexp_extract(e, "([0-9a-fA-F]+);?$", 1)
        n = F.when(e.rlike("^&#[xX]"), F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 6, F.conv(digits, 16, 10).try_cast("long"))).otherwise(digits.try_cast("long"))
        bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        none = n.between(1, 8) | n.isin(0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x7F) | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(65536)) >= 65534)
        character = F.decode(F.unhex(F.lpad(F.hex(n), F.lit(8), F.lit("0"))), "UTF-32")
        return F.when(bad, "\ufffd").when(n.between(0x80, 0x9F), F.try_element_at(table({str(i): x for i, x in western.items()}), n.cast("string"))).when(none, "").otherwise(character)

    def turned(e: Column) -> Column:
        name = F.substr(e, F.lit(2))
        start = F.regexp_extract(name, f"^({open_names})", 1)
        prefix = F.when(start != "", F.concat(F.try_element_at(named, start), F.substr(name, F.length(start) + 1))).otherwise(e) if bare else e
        return F.when(e.startswith("&#"), numbered(e)).otherwise(F.coalesce(F.try_element_at(named, name), prefix))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.zip_with(F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda p, e: F.concat(p, F.when(e.isNull(), "").otherwise(turned(e)))), "")).otherwise(c)


def html_text(c: Column, bare: bool = True) -> Column:
    """F-10, F-11: the text between tags, in which references have become characters. Tags become spaces."""
    return F.trim(squeeze(entities(F.regexp_replace(c, MARKUP.replace("*')*>", "*')*+>"), " "), bare)))  # never backs up: long tags need no stack


def urls(c: Column) -> Column:
    """F-25."""
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s\"'<>)]+"), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """F-27, J-21: 1 minus the edit distance over the longer length (documented as another metric)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def chunks(items: Column, size: int) -> Column:
    """F-72."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1)), lambda i: F.slice(items, i * size + 1, size))


def token_price(model: Column, tokens: Column, table: dict[str, float]) -> Column:
    """F-69: fee per thousand tokens by the longest model-name prefix."""
    fee = F.lit(None).cast("double")
    for prefix in sorted(table, key=len):
        fee = F.when(model.startswith(prefix), F.lit(table[prefix])).otherwise(fee)
    return fee * tokens / 1000
