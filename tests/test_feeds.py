"""Feeds, office files and sinks on small made inputs."""

import datetime
import json
import zipfile

from tallywind.operators import topics
from tallywind.sources import feeds

ARTICLES = {f"a{i}": json.dumps({"id": f"http://x/thing/id{i}", "firstPublishedDate": f"2020-01-0{i + 1}T03:04:05Z"}) for i in range(5)}


def feed(pages):
    def fetch(url):
        if url in pages:
            links, following = pages[url]
            return 200, json.dumps({"notifications": [{"apiUrl": x} for x in links], "links": [{"href": following}]})
        return (200, ARTICLES[url]) if url in ARTICLES else (200, "{") if url == "broken" else (403, "")

    return fetch


def test_articles_of_a_feed():
    fetch = feed({})
    assert feeds.article_of(fetch, "a0") == ("id0_2020-01-01.json", ARTICLES["a0"])
    assert feeds.article_of(fetch, "gone") is None and feeds.article_of(fetch, "broken") is None
    assert feeds.feed_start(" http://x/next \n", None, None) == "http://x/next"
    assert feeds.feed_start(None, None, datetime.date(2021, 3, 17)) == "notifications?since=2021-03-01T02:00:00.000Z" and feeds.feed_start("", "2020-05-06", None).endswith("2020-05-06T02:00:00.000Z")


def test_feed_reader_goes_on_where_it_stopped():
    pages = {"p0": (["a0", "gone"], "p1"), "p1": (["a1", "broken", "a2"], "p2"), "p2": (["a3"], "p2")}
    reader = feeds.feed_source(feed(pages), "p0")({}).simpleStreamReader(None)
    at, names, seen = reader.initialOffset(), [], []
    while at not in seen:
        seen.append(at)
        rows, at = reader.read(at)
        names += [r[1] for r in rows]
    assert names == [f"id{i}_2020-01-0{i + 1}.json" for i in range(4)] and at == {"url": "p2", "seen": 1}
    pages["p2"] = (["a3", "a4"], "p2")
    rows, grown = reader.read(at)
    assert [r[0] for r in rows] == ["a4"] and grown == {"url": "p2", "seen": 2}
    assert [r[0] for r in reader.readBetweenOffsets(seen[0], at)] == ["a0", "a1", "a2", "a3"] and [r[0] for r in reader.readBetweenOffsets(at, grown)] == ["a4"]


def test_feed_as_a_stream(spark):
    spark.dataSource.register(feeds.feed_source(feed({"p0": (["a0"], "p1"), "p1": (["a1", "gone", "a2"], "p1")}), "p0"))
    stream = spark.readStream.format("article_feed").load().writeStream.format("memory").queryName("feed_rows").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert sorted(r.link for r in spark.table("feed_rows").collect()) == ["a0", "a1", "a2"]


def test_rss(spark, tmp_path):
    summary = '&lt;ol&gt;&lt;li&gt;&lt;a href="http://n/1"&gt;One &lt;b&gt;two&lt;/b&gt;&lt;/a&gt;&lt;font color="x"&gt;Paper&lt;/font&gt;&lt;/li&gt;&lt;li&gt;&lt;a href="u"&gt;t&lt;/a&gt;&lt;/li&gt;&lt;/ol&gt;'
    (tmp_path / "f.xml").write_text(f"<rss><channel><title>c</title><item><title>T</title><link>http://n/1</link><description>{summary}</description></item><item><title>U</title></item></channel></rss>")
    got = {r.title: r for r in feeds.rss(spark, str(tmp_path)).collect()}
    assert set(got) == {"T", "U"} and [tuple(s) for s in got["T"].sub_articles] == [("http://n/1", "One two", "Paper")] and got["U"].sub_articles is None


def test_office_files(spark, tmp_path):
    w, s = feeds.W.strip("{}"), feeds.S.strip("{}")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>A paragraph </w:t></w:r><w:r><w:t>of words</w:t></w:r></w:p><w:p><w:r><w:t>short</w:t></w:r></w:p></w:body></w:document>')
    assert [tuple(r)[1:] for r in feeds.docx_paragraphs(spark, str(tmp_path / "d.docx")).collect()] == [(0, "A paragraph of words", 4)]
    rel = feeds.R.strip("{").split("}")[0]
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{rel}"><sheets><sheet name="one" r:id="r1"/><sheet name="two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>country</t></si><si><r><t>sta</t></r><r><t>rt</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="AA3"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    rows = {(r.sheet, r.row): r.cells for r in feeds.xlsx_rows(spark, str(tmp_path / "b.xlsx")).collect()}
    assert rows == {("one", 1): ["country", None, "start"], ("one", 3): [None] * 26 + ["7"], ("two", 1): ["in"]}
    assert feeds.xlsx_rows(spark, str(tmp_path / "b.xlsx"), "two").count() == 1


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,name\n1,b\n1,a\n2,c\n")
    assert {tuple(r) for r in feeds.concepts(spark, str(tmp_path / "c.csv"), "id", "name").collect()} == {("1", "a"), ("2", "c")}
    (tmp_path / "w.csv").write_text("word,2020-01,2020-02\nx,1.5,\ny,2,3\n")
    assert {tuple(r) for r in feeds.wide_series(spark, str(tmp_path / "w.csv"), "word").collect()} == {("x", "2020-01", 1.5), ("x", "2020-02", None), ("y", "2020-01", 2.0), ("y", "2020-02", 3.0)}
    for day, n in (("2020-01-01", 3), ("2020-01-02", 5)):
        feeds.write_snapshot(spark.range(n), str(tmp_path), day, "s")
    assert [spark.read.parquet(str(tmp_path / f)).count() for f in ("s_2020-01-01", "s_2020-01-02", "s")] == [3, 5, 5]
    feeds.write_by_topic(spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "topic int, word string"), str(tmp_path / "t"), "topic")
    assert {(r.topic, r.word) for r in spark.read.json(str(tmp_path / "t")).collect()} == {(0, "a"), (1, "b"), (1, "c")}


def test_sampled_share_is_the_same_for_every_layout(spark):
    ids = lambda parts: {r.id for r in spark.range(0, 20_000, 1, parts).where(topics.sampled(topics.F.col("id"), 0.2)).collect()}
    assert ids(1) == ids(7) and 3700 < len(ids(3)) < 4300
