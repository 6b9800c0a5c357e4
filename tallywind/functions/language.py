"""Stems, lemmas and sentiment of words."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published Snowball English rules: whole words, then suffixes by step.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
VOWELS = "aeiouy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    after = re.compile(rf"[{VOWELS}][^{VOWELS}]")
    start = re.match("gener|commun|arsen", word)
    m = after.search(word)
    r1 = start.end() if start else m.end() if m else len(word)
    n = after.search(word, r1)
    return r1, n.end() if n else len(word)


def _ends_short(stem: str) -> bool:
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", stem) or re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", stem))


def _plural(w: str) -> str:
    end = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return w[:-2]
    if end in ("ied", "ies"):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if end == "s" and re.search(f"[{VOWELS}]", w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not re.search(f"[{VOWELS}]", w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _ends_short(w) else w


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """F-07: the Snowball English stem of one word, in lower case."""
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) <= 2 or w in KEPT:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = re.sub(rf"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = _plural(re.sub("('s'|'s|')$", "", w))
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, (*STEP_2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end in STEP_2:
            w = w[: -len(end)] + STEP_2[end]
        elif (end == "ogi" and w[-4:-3] == "l") or (end == "li" and w[-3:-2] in tuple("cdeghkmnrt")):
            w = w[: -1 if end == "ogi" else -2]
    end = _longest(w, (*STEP_3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end in STEP_3:
            w = w[: -len(end)] + STEP_3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _longest(w, (*STEP_4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """F-07: the stems of an array of words, in Arrow batches; each worker keeps those of 65 536 words."""
    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda a: None if a is None else [None if w is None else stem(w) for w in a])

    return run(words)


def lemmas(words: Column, table: dict[str, str]) -> Column:
    """F-06: words by a dictionary (word to lemma, written by hand), blank ones left out, joined by spaces."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), lambda w: F.trim(w) != ""), " ")


def sentences(text: Column) -> Column:
    """F-08: parts that end in `.`, `!` or `?` before white space, or at the end; blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentiment(text: Column, lexicon: dict[str, float]) -> Column:
    """A-21: the mean over sentences of s / sqrt(s * s + 15), s the summed valence of a sentence's words; null without
    any sentence. The lexicon (word to valence) is the caller's; no rules for negation, case or degree."""
    weights = F.create_map(*(F.lit(x) for word, v in lexicon.items() for x in (word, float(v))))
    each = lambda s: F.aggregate(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}']+"), F.lit(0)), F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))
    scores = F.transform(F.transform(sentences(text), each), lambda v: v / F.sqrt(v * v + 15))
    return F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))


def paragraph_text(paragraphs: Column) -> Column:
    """F-31: the pieces (Value, Name) of paragraphs as one text, names in `<<` `>>`; a missing body stays null."""
    piece = lambda p: F.coalesce(p.Value, F.concat(F.lit("<<"), p.Name, F.lit(">>")))
    return F.array_join(F.transform(F.flatten(paragraphs), piece), " ")


# Fixed values of the published sentiment rules (Hutto and Gilbert 2014): words that deny, strengthen and weaken, and weights.
NEGATIONS = ["aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "neednt", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt", "rarely", "seldom", "despite"]
STRONGER = ["absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "unusually", "utterly", "very"]
WEAKER = ["almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta"]
DEGREE, CAPITALS, DENIED, NEVER_SO, FADE = 0.293, 0.733, -0.74, 1.25, (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT, EXCLAIM, ASK, ASK_MUCH = 0.5, 1.5, 0.292, 0.18, 0.96
BLANK, PUNCTUATION = r"[ \t\n\x0b\f\r]", r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _sentence_score(tokens: list[tuple], exclaims: int, asks: int) -> float:
    """Of a sentence's (word, upper, base or None, degree, deny) by token."""
    if all(base is None for _, _, base, _, _ in tokens):
        return 0.0
    shouted = 0 < sum(t[1] for t in tokens) < len(tokens)
    but = next((i for i, t in enumerate(tokens) if t[0] == "but"), None)
    total = 0.0
    for i, (_, upper, base, degree, _) in enumerate(tokens):
        if base is None or degree:
            continue
        v = base
        if upper and shouted:
            v += CAPITALS if v > 0 else -CAPITALS
        for k in range(1, min(i, 3) + 1):
            word, loud, known, step, deny = tokens[i - k]
            if known is not None:
                continue
            if step:
                step = -step if v < 0 else step
                if loud and shouted:
                    step += CAPITALS if v > 0 else -CAPITALS
                v += step * FADE[k - 1]
            between = [t[0] for t in tokens[i - k + 1 : i]]
            if word == "never" and ("so" in between or "this" in between):
                v *= NEVER_SO
            elif deny and not (word == "without" and "doubt" in between):
                v *= DENIED
        if i and tokens[i - 1][0] == "least" and tokens[i - 1][2] is None and not (i > 1 and tokens[i - 2][0] in ("at", "very")):
            v *= DENIED
        total += v if but is None or i == but else v * (BEFORE_BUT if i < but else AFTER_BUT)
    marks = min(exclaims, 4) * EXCLAIM + (ASK_MUCH if asks > 3 else asks * ASK if asks > 1 else 0.0)
    total += marks if total > 0 else -marks if total < 0 else 0.0
    return total / math.sqrt(total * total + 15)


def ruled_sentiment(text: Column, lexicon: dict[str, float], stronger: list[str] = STRONGER, weaker: list[str] = WEAKER, negations: list[str] = NEGATIONS) -> Column:
    """A-21: the mean over sentences of s / sqrt(s * s + 15), s the sum of a sentence's valences by the published rules: words
    of degree and denial among the three tokens before, capitals where not all are, `but`, `least`, marks of exclamation
    and question; null without any sentence. The lexicon (lower-case word to valence) is the caller's. Runs in Arrow
    batches; each worker keeps what 65 536 tokens are. Idioms, emoticons and `kind of` have no rule."""
    strong, weak, deny = set(stronger), set(weaker), set(negations)
    ends, blanks = rf"(?<=[.!?]){BLANK}+", rf"{BLANK}+"
    edges = rf"^{PUNCTUATION}+|{PUNCTUATION}+(?=[\x85\u2028\u2029]?\Z)"  # as Java's $, which stands before a last line break too

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        end, blank, edge = re.compile(ends), re.compile(blanks), re.compile(edges)

        @lru_cache(65_536)
        def describe(raw: str) -> tuple:
            bare = edge.sub("", raw)
            token = raw if len(bare) <= 2 else bare
            word = token.lower()
            return word, token == token.upper() and token != word, lexicon.get(word), DEGREE if word in strong else -DEGREE if word in weak else 0.0, word in deny or "n't" in word

        def score(t: str | None) -> float | None:
            parts = [s for s in (s.strip(" ") for s in end.split(t)) if s] if t is not None else []
            return sum(_sentence_score([describe(x) for x in blank.split(s) if x], s.count("!"), s.count("?")) for s in parts) / len(parts) if parts else None

        return pd.Series([score(t) for t in column], dtype=float)

    return run(text)
