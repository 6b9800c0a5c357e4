"""Rules for odd values: nulls, Unicode, broken markup, increments, phrases."""

import glob
import html
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow.parquet as pq

from tallywind.functions import text as T
from tallywind.operators import corpus, frequency, series
from tallywind.streaming import jobs

F = T.F


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.off = [], False

    def handle_starttag(self, tag, attrs):
        self.off = tag in ("script", "style")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.off = False
        self.parts.append(" ")

    def handle_comment(self, data):
        self.parts.append(" ")

    handle_decl = handle_pi = handle_comment

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return " ".join("".join(p.parts).split())


def test_html_as_the_library_parses_it(spark, sf):
    pages = [x for x in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist() if x]
    broken = [
        "1 < 2 and 3 > 2 <b>x</b>", "<p title='a>b'>q</p><!-- c > d --> e<script>if(a<b)</script> f<style>p{}</style>g", '<a href="x>y">z</a> t <br/> u <!DOCTYPE html> v', "x <script> never", "a<>b", "<p>a<p>b</div> &amp;lt; &eacute;", "", "a & b &; &#;",
        "<P CLASS=x>A</P>  b\u0085c", "<b " + "x" * 50000 + ">long</b>", "<br>" * 20000 + "deep", "&#8364;&euro; &notit; &copy2020",
    ]
    rows = spark.createDataFrame(list(enumerate(broken + pages)), "i int, x string")
    got = [r.t for r in rows.select("i", T.html_text(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [plain(x) for x in broken + pages]
    odd = ["&euro; &#8364; &#x20AC; &amp;amp; &notit; &copy2020 &unknown; &#0; &#150; &#xD800; &#99999999999999; & &; &#; &lt;b&gt; &nbsp;&NotEqualTilde;", "none", "&#11;&#1;&#13;&#65534;&#1114111;&#x10FFFF;", "&ampx &amp", None]
    turned = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", T.entities(F.col("x")).alias("e")).orderBy("i").collect()
    assert [r.e for r in turned] == [x and html.unescape(x) for x in odd]


def test_white_space_as_unicode_has_it(spark):
    import re

    every = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000 and c)
    texts = [every, "a \x0bb  c", "", None, "​﻿"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.squeeze(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [t if t is None else re.sub(r"\s+", " ", t) for t in texts]


def test_mean_with_gaps_as_pandas(spark):
    cases = {"a": [None, None, 1, None, 3, 4, None], "b": [1, float("nan"), 3], "c": [None], "d": [2.0] + [None] * 300 + [5.0, None]}
    rows = spark.createDataFrame([(k, i, None if v is None else float(v)) for k, x in cases.items() for i, v in enumerate(x)], "k string, t int, v double")
    for span in (1, 3, 10):
        got = {k: [] for k in cases}
        for r in series.ewma(rows, ["k"], "t", "v", span).orderBy("k", "t").collect():
            got[r.k].append(np.nan if r.ewma is None else r.ewma)
        for k, x in cases.items():
            assert np.allclose(got[k], pd.Series(x, dtype=float).ewm(span=span).mean(), equal_nan=True), (k, span)


def test_runs_merges_and_coherence_with_nulls(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, None, None, 1, 2, None])] + [("j", 0, None), ("j", 1, None), ("j", 2, 0)], "k string, t int, v int")
    got = series.islands(rows, ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r.run_id for r in got] == [1, 1, 2, 1, 2, 2, 3, 4, 5]
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 10), (2, 20), (3, None)], [(2, None), (3, 30), (4, None)]))
    assert sorted(map(tuple, corpus.merge_last(old, new, ["k"], "v").collect()), key=str) == [(1, 10), (2, None), (3, 30), (4, None)]
    terms = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "doc int, term string")
    known = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "zzz"), (1, 1, "a")], "topic int, rank int, word string")
    assert {r.topic: round(r.coherence, 9) for r in frequency.umass(terms, known, "doc", "term").collect()} == {0: 0.0, 1: 0.0}


def test_links_without_an_address(spark):
    import base64

    hide = lambda u: "https://n.example/a/" + base64.urlsafe_b64encode(b"\x08\x13\xff" + u.encode() + b"\x01\x01").decode().rstrip("=")
    links = [hide("http://x.example/ü?é=中"), "https://n.example/a/", "https://n.example/a/!!!?oc=5", hide("no address"), None, "plain"]
    got = [r.u for r in spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string").select("i", corpus.google_url(F.col("x")).alias("u")).orderBy("i").collect()]
    assert got == ["http://x.example/ü?é=中", None, None, None, None, None]
    names = spark.createDataFrame([("agg_guinea-bissau_month_z2.1.csv",), ("agg_south_korea_month.csv",)], "f string").select(corpus.file_country(F.col("f")).alias("c"))
    assert [r.c for r in names.collect()] == ["Guinea-Bissau", "South Korea"]


def test_an_increment_of_one_country_keeps_the_others(spark, tmp_path):
    rows = [(c, f"{2000 + m // 12}-{m % 12 + 1:02d}-01", float(m + len(c))) for c in ("a", "bb") for m in range(20)]
    frame = lambda r: spark.createDataFrame(r, "country string, d string, n double").select("country", F.to_date("d").alias("period"), "n")
    run = lambda: {(r.country, str(r.period)): r.n for r in jobs.upsert_series(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), ["country"], "period", "n", 12).collect()}
    frame(rows).write.parquet(str(tmp_path / "in"))
    want = {(c, d): n for c, d, n in rows}
    assert run() == want
    frame([("a", "2001-06-01", -1.0), ("a", "2000-02-01", None)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want | {("a", "2001-06-01"): -1.0, ("a", "2000-02-01"): 0.0}
    frame([("bb", "2001-06-01", -2.0)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == want | {("a", "2001-06-01"): -1.0, ("a", "2000-02-01"): 0.0, ("bb", "2001-06-01"): -2.0}
    assert len(glob.glob(str(tmp_path / "out/history/batch=*"))) == 3


def test_phrases_of_three_levels(spark):
    rng = np.random.default_rng(0)
    docs = [[f"w{i}" for i in rng.integers(0, 300, 60)] + ["bank", "of", "new", "york"] * int(rng.integers(1, 4)) for _ in range(200)]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(docs)] + [(900, None), (901, []), (902, ["alone"])], "doc int, words array<string>")
    found, rows = frequency.learn_phrases(table, "doc", "words", 3, 10, 0.2)
    told = {(r.level, r.a, r.b): (r.nab, r.score) for r in rows.collect()}
    current, levels = [list(d) for d in docs] + [["alone"]], {}
    for level, threshold in ((2, 0.2), (3, 0.2 * 1.5)):
        one, two = {}, {}
        for d in current:
            for w in d:
                one[w] = one.get(w, 0) + 1
            for p in zip(d, d[1:], strict=False):
                two[p] = two.get(p, 0) + 1
        good = {p: (n, (n - 10) * len(one) / (one[p[0]] * one[p[1]])) for p, n in two.items() if n >= 10}
        good = {p: s for p, s in good.items() if s[1] > threshold}
        levels |= {(level, *p): s for p, s in good.items()}
        current = [frequency.Phrases([list(good)]).join(d) for d in current]
    assert set(told) == set(levels) and all(abs(told[k][1] - levels[k][1]) < 1e-9 and told[k][0] == levels[k][0] for k in told)
    assert any(k[0] == 3 for k in told)
    got = {r.doc: r.words for r in frequency.join_phrases(table, "words", found).collect()}
    assert [got[i] for i in range(200)] == current[:200] and got[900] is None and got[901] == [] and "bank_of_new_york" in got[0]


def test_phrases_beyond_those_held_are_joined_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [[f"w{i}" for i in rng.integers(0, 30, 40)] + ["bank", "of", "new", "york"] * 2 for _ in range(60)]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(docs)] + [(900, None), (901, []), (902, ["bank", None, "of"])], "doc int, words array<string>")

    def learnt():
        found, rows = frequency.learn_phrases(table, "doc", "words", 3, 2, 0.005)
        return found, sorted(rows.collect()), sorted(frequency.join_phrases(table, "words", found).collect())

    held, rows, joined = learnt()
    for most in (0, len([r for r in rows if r.level == 3])):  # both levels are tables, or one
        monkeypatch.setattr(frequency, "HELD", most)
        monkeypatch.setattr(frequency, "BLOCK", 500)
        found, again, too = learnt()
        assert [isinstance(x, dict) for x in held.levels + found.levels] == [True, True, False, most > 0]
        assert len(rows) > 100 and again == rows and too == joined  # none is dropped
    got = {r.doc: r.words for r in too}
    assert got[900] is None and got[901] == [] and got[902] == ["bank_of"]


def test_many_phrases_over_long_texts():
    import time

    many = frequency.Phrases([[(f"a{i}", f"b{i}") for i in range(10_000)], [(f"a{i}_b{i}", f"a{i + 1}_b{i + 1}") for i in range(0, 9_999, 2)]])
    took = []
    for n in (25_000, 200_000):  # the longer is over a megabyte
        words = [x for i in range(n // 2) for x in (f"a{i % 10_000}", f"b{i % 10_000}")]
        start = time.process_time()
        assert len(many.join(words)) == n // 4
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.01)  # 8 times the words
