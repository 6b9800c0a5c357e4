from oracle import compare, connect
from pyspark.sql import functions as F

from tallywind.functions import text as T
from tallywind.plans import catalogue


def test_references_cut_short_stay_as_in_the_sql(spark, tmp_path):
    pages = ["<title>a&amp;&amp</title><p>b", "<p>x&ampy;z &copy</p>", "<b>&quot;&amp;copy;&middot;</b>&amp", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    next((tmp_path / "pages").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    sf = str(tmp_path)
    assert compare(catalogue.queries()["html_to_text"](spark, sf), connect(sf), catalogue.oracle_sql()["html_to_text"]) == ""


def test_references_as_browsers_read_them(spark):
    row = spark.createDataFrame([("<p>a&amp &ampb &#38 &amp;",)], "h string").select(T.html_text(F.col("h")).alias("all"), T.html_text(F.col("h"), bare=False).alias("closed")).first()
    assert (row["all"], row["closed"]) == ("a& &b & &", "a&amp &ampb &#38 &")
