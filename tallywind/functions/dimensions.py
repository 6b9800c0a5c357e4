"""The fixed dimensions that series are judged by (SRC-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# By country its region code, and the months in which its banking crises start, in which they peak, and of its crises of the balance of payments.
COUNTRIES = """
argentina | arg | 1980-03 1985-05 1994-12 2001-12 | 1982-07 1989-06 1995-03 2001-12 | 1981-02 1986-09 1990-02
bolivia | bol | 1987-10 | 1988-06 | 1985-09
brazil | braz | 1985-11 1994-12 1999-01 | 1985-11 1996-03 1999-01 | 1986-11 1991-10
chile | chil | 1981-09 | 1983-03 | 1982-08
colombia | col | 1982-07 | 1985-06 | 1983-03
denmark | den | 1987-03 | 1990-06 | 1983-08
finland | fin | 1991-09 | 1992-06 | 1991-11
indonesia | infon | 1992-11 | 1992-11 | 1986-09
israel | israel | 1983-10 | 1984-06 | 1983-10
malaysia | malay | 1985-07 | 1986-08 | 1975-07
mexico | mex | 1982-09 1992-10 | 1984-06 1996-03 | 1982-12 1994-12
norway | norw | 1988-11 | 1991-10 | 1986-05
peru | peru | 1983-03 | 1983-04 | 1987-04
philippines | phlns | 1981-01 | 1985-06 | 1983-10
spain | spain | 1978-11 | 1983-01 |
sweden | swed | 1991-11 | 1992-09 | 1992-11
thailand | thail | 1979-03 1983-10 | 1979-03 1985-06 | 1978-11 1984-11
turkey | turk | 1991-01 | 1991-03 | 1994-03
uruguay | uru | 1981-03 | 1985-06 | 1982-10
venezuela | ven | 1993-10 | 1994-08 | 1994-05
"""


def countries() -> list[tuple[str, str, list[str], list[str], list[str]]]:
    """(country, region code, starts, peaks, months of payment crises) as written above; months end in the day 01."""
    out = []
    for line in COUNTRIES.strip().splitlines():
        name, code, *months = (p.strip() for p in line.split("|"))
        starts, peaks, payments = ([f"{m}-01" for m in part.split()] for part in months)
        out.append((name, code, starts, peaks, payments))
    return out


def _table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(countries(), "country string, region string, starts array<string>, peaks array<string>, payments array<string>")


def regions(spark: SparkSession) -> DataFrame:
    """(country, region)."""
    return _table(spark).select("country", "region")


def crises(spark: SparkSession) -> DataFrame:
    """(country, seq from 1, start, peak)."""
    pairs = F.arrays_zip(F.col("starts").alias("s"), F.col("peaks").alias("p"))
    one = _table(spark).select("country", F.posexplode(pairs).alias("seq", "c"))
    return one.select("country", (F.col("seq") + 1).alias("seq"), F.to_date("c.s").alias("start"), F.to_date("c.p").alias("peak"))


def payment_crises(spark: SparkSession) -> DataFrame:
    """(country, period)."""
    return _table(spark).select("country", F.explode("payments").alias("m")).select("country", F.to_date("m").alias("period"))
