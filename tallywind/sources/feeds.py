"""Feeds and office files. Nothing here opens a connection: what fetches an address is the caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Fetch = Callable[[str], tuple[int, str]]


def feed_start(saved: str | None, since: str | None, today) -> str:
    """SRC-18: the last saved link, or the base link from a day on (the month's first unless stated)."""
    if saved and saved.strip():
        return saved.strip()
    return f"notifications?since={since or today.strftime('%Y-%m-01')}T02:00:00.000Z"


def article_of(fetch: Fetch, link: str) -> tuple[str, str] | None:
    """SRC-19, FLT-25: (file name, text) of an article; None where the status isn't 200 or the answer isn't one."""
    import json

    status, text = fetch(link)
    if status != 200:
        return None
    try:
        a = json.loads(text)
        return f"{a['id'].split('thing/')[1]}_{a['firstPublishedDate'].split('T')[0]}.json", text
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None


def feed_source(fetch: Fetch, start: str, name: str = "article_feed") -> type[DataSource]:
    """SRC-17..SRC-19: a streaming source of (link, name, text), a page of notifications a batch. Each page names the
    next one; the last names itself and is read again from where it ended. Offsets are a page's link and the
    notifications read of it, so that a query that restarts goes on where it stopped, and reads the same rows again
    after a failure. A page that can't be fetched raises; an article that can't be is left out."""
    import json

    def page(url: str, seen: int, stop: int | None = None) -> tuple[list[tuple], dict]:
        status, text = fetch(url)
        if status != 200:
            raise OSError(f"{url}: status {status}")
        load = json.loads(text)
        every, following = load["notifications"], load["links"][0]["href"]
        found = ((n["apiUrl"], article_of(fetch, n["apiUrl"])) for n in every[seen:stop])
        return [(link, *a) for link, a in found if a], {"url": following, "seen": 0} if following != url else {"url": url, "seen": len(every)}

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"url": start, "seen": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, following = page(start["url"], start["seen"])
            return iter(rows), following

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            at = dict(start)
            while at["url"] != end["url"]:
                rows, following = page(at["url"], at["seen"])
                if following["url"] == at["url"]:
                    raise ValueError(f"{at['url']} no longer leads to {end['url']}")
                at = following
                yield from rows
            if at["seen"] < end["seen"]:
                yield from page(at["url"], at["seen"], end["seen"])[0]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "link string, name string, text string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader()

    return Source


def rss(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: the items of saved RSS files, with the articles (url, title, publisher) that a summary lists; what a list
    item lacks one of the three is left out."""
    raw = spark.read.option("rowTag", "item").schema("title string, link string, pubDate string, description string, source string").xml(path)
    return raw.withColumn("sub_articles", sub_articles(F.col("description"))).withColumn("path", F.input_file_name())


def sub_articles(html: Column) -> Column:
    """SRC-20: the list items of a summary as an array of (url, title, publisher)."""
    part = lambda c, p: F.regexp_extract(c, p, 1)
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    each = lambda i: F.struct(part(i, r'(?is)<a\b[^>]*\bhref="([^"]*)"').alias("url"), plain(part(i, r"(?is)<a\b[^>]*>(.*?)</a>")).alias("title"), plain(part(i, r"(?is)<font\b[^>]*>(.*?)</font>")).alias("publisher"))
    return F.filter(F.transform(items, each), lambda s: (s.url != "") & (s.title != "") & (s.publisher != ""))


def chunk_queries(keywords: Column, size: int, site: str | None = None) -> Column:
    """SRC-21: search texts of `size` keywords each, joined by OR, bound to a site where one is named."""
    from tallywind.functions.text import chunks

    return F.transform(chunks(keywords, size), lambda c: F.concat(F.array_join(c, " OR "), F.lit(f" site:{site}" if site else "")))


def concepts(spark: SparkSession, path: str, code: str, label: str) -> DataFrame:
    """SRC-27: (code, label) of a CSV, a code's first label in order."""
    return spark.read.option("header", True).csv(path).groupBy(F.col(code).alias("code")).agg(F.min(label).alias("label"))


def wide_series(spark: SparkSession, path: str, index: str) -> DataFrame:
    """SRC-12, SRC-14: (index, period, value) of a CSV with a row per word and a column per period."""
    wide = spark.read.option("header", True).csv(path)
    return wide.unpivot([index], [c for c in wide.columns if c != index], "period", "value").withColumn("value", F.col("value").try_cast("double"))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_paragraphs(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """SRC-25: (path, pos, para, count) of the paragraphs with over `least` characters, with their words."""

    def run(frames):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        for pdf in frames:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{W}p")]
                rows = [(name, i, p, len(p.split())) for i, p in enumerate(paragraphs) if len(p) > least]
                yield pd.DataFrame(rows, columns=["path", "pos", "para", "count"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos int, para string, count int")


def xlsx_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """SRC-13: (path, sheet, row, cells) of the sheets of workbooks, or of the sheet named; cells are texts by column
    from A on, null where empty, and a row's end is its last cell. A workbook is read by one task."""

    def run(frames):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        def column(ref: str) -> int:
            n = 0
            for letter in re.match("[A-Z]+", ref).group():
                n = n * 26 + ord(letter) - 64
            return n - 1

        for pdf in frames:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    tree = lambda member: ElementTree.fromstring(z.read(member))  # noqa: B023, E731
                    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
                    target = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
                    for s in tree("xl/workbook.xml").iter(f"{S}sheet"):
                        if sheet not in (None, s.get("name")):
                            continue
                        out = []
                        for row in tree("xl/" + target[s.get(R)].removeprefix("/xl/")).iter(f"{S}row"):
                            cells: list = []
                            for c in row.iter(f"{S}c"):
                                value = c.findtext(f"{S}v") if c.get("t") != "inlineStr" else "".join(t.text or "" for t in c.iter(f"{S}t"))
                                cells += [None] * (column(c.get("r")) + 1 - len(cells))
                                cells[-1] = shared[int(value)] if c.get("t") == "s" else value
                            out.append((name, s.get("name"), int(row.get("r")), cells))
                        yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def write_snapshot(df: DataFrame, path: str, day: str, name: str) -> None:
    """SNK-14: a dated copy and a stable one; the stable one is written from the dated one, so that both agree."""
    df.write.mode("overwrite").parquet(f"{path}/{name}_{day}")
    df.sparkSession.read.parquet(f"{path}/{name}_{day}").write.mode("overwrite").parquet(f"{path}/{name}")


def write_by_topic(df: DataFrame, path: str, topic: str) -> None:
    """SNK-18: JSON files by topic."""
    df.write.mode("overwrite").partitionBy(topic).json(path)
