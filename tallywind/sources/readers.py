"""Readers of the corpus's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "an string, title string, snippet string, body string, publication_date string, language_code string, region_codes string, source_name string, weburl string"


def articles(spark: SparkSession, path: str, glob: str = "*.[jJ][sS][oO][nN]", schema: str = ARTICLE, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-01..SRC-05, SRC-16, SNK-15: (articles, dead letters) of a tree of JSON files: one object in each, or with
    `lines` one in each line. glob filters base names, by prefix or suffix. Articles have their file's path and name;
    what can't be parsed, or is blank, is a dead letter with its text. Files without a byte are skipped, by Spark."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=not lines)
    one = read.where("trim(value) != ''") if lines else read
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = one.select(parsed.alias("a"), "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    bad = F.col("a").isNull() | F.col("a._bad").isNotNull() | (F.trim("value") == "")
    return rows.where(~bad).select("a.*", "path", "name").drop("_bad"), rows.where(bad).select(F.lit("corrupt").alias("error_type"), "path", F.col("value").alias("text"))


def twice_encoded(df: DataFrame, column: str, schema: str) -> DataFrame:
    """SRC-06: a JSON string that holds JSON."""
    return df.select(F.from_json(F.get_json_object(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "$.v"), schema).alias("v")).select("v.*")


def issues(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07, PRJ-05: an article per element of an issue's `articles`, its id the file's name and position."""
    schema = "issue string, articles array<struct<title:string,paras:array<string>>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select("issue", F.col("_metadata.file_name").alias("file"), F.posexplode("articles").alias("pos", "a"))
    clean = F.transform(F.col("a.paras"), lambda p: F.replace(p, F.lit("- \n"), F.lit("")))
    return one.select(F.concat_ws("-", "file", F.col("pos").cast("string")).alias("an"), F.col("a.title").alias("title"), F.array_join(F.slice(clean, 1, 2), " ").alias("snippet"), F.array_join(clean, " ").alias("body"), "issue")


def zipped_json(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """SRC-08: (archive, member, content) of the JSON members of zip files, without the members in known(member)."""
    import io
    import zipfile

    def run(frames):
        for pdf in frames:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.namelist():
                        if m.lower().endswith(".json"):
                            yield pdf.iloc[:1][[]].assign(archive=name, member=m, content=z.read(m).decode("utf-8", "replace"))

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content string")
    return out.join(known, "member", "left_anti").select("archive", "member", "content") if known is not None else out


def keyword_groups(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10, SRC-11: (grp, term array) of a CSV whose columns are groups; cells split at `&`."""
    wide = spark.read.option("header", True).csv(path)
    long = wide.unpivot([], wide.columns, "grp", "cell").where("cell is not null and trim(cell) != ''")
    return long.select("grp", F.split(F.trim("cell"), "&").alias("term")).distinct()


def country_aliases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: (country, alias) of a country XML: name, nationality, capital and cities, a field's lines apart, in lower
    case, `_` a space. The country is its name's lines joined."""
    rows = spark.read.option("rowTag", "Country").schema("countryname string, nationality string, capital string, majorcities string").xml(path)
    lines = lambda c: F.filter(F.transform(F.split(F.trim(F.lower(F.coalesce(F.col(c), F.lit("")))), "\n"), lambda a: F.trim(F.translate(a, "_", " "))), lambda a: a != "")
    every = F.concat(*map(lines, ("countryname", "nationality", "capital", "majorcities")))
    return rows.select(F.array_join(lines("countryname"), "").alias("country"), F.explode(every).alias("alias")).distinct()


def crisis_dates(df: DataFrame) -> DataFrame:
    """SRC-28: (country, seq, start, peak) of rows (country, start, end) whose dates are `&` lists."""
    from tallywind.functions.dates import crisis_token

    pairs = F.arrays_zip(F.split("start", "&").alias("s"), F.split("end", "&").alias("e"))
    one = df.select("country", F.posexplode(pairs).alias("seq", "p"))
    return one.select("country", "seq", crisis_token(F.trim(F.col("p.s")), 1).alias("start"), crisis_token(F.trim(F.col("p.e")), 12).alias("peak"))


def scraped_news(spark: SparkSession, path: str) -> DataFrame:
    """SRC-30, PRJ-25: flat rows of `<site>_<start>_<end>.json` files of entries."""
    schema = "title string, link string, published_parsed array<int>, extracted_content struct<bodyXML:string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("parts", F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "_"))
    body = F.col("extracted_content.bodyXML")
    return raw.select(
        F.get("parts", F.lit(0)).alias("newspaper_name"), F.get("parts", F.lit(1)).alias("time_start"), F.get("parts", F.lit(2)).alias("time_end"),
        *(F.get("published_parsed", F.lit(i)).alias(n) for i, n in enumerate(("year", "month", "day"))), "title", "link", body.alias("body"), F.size(F.regexp_extract_all(body, F.lit(r"\S+"), F.lit(0))).alias("body_length"),
    )


def write_partitioned(df: DataFrame, path: str, by: str, form: str = "parquet", **options) -> None:
    """SNK-02, SNK-05..SNK-07, SNK-13: files by the values of a column; only the partitions that df has are replaced."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(by).format(form).save(path)
