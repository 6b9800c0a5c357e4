"""Table functions: a document to none or many rows, called from SQL (UD-03).

    register(spark)
    SELECT * FROM text_units(TABLE(SELECT doc_id, text FROM documents), 'sentence')
    SELECT * FROM sessions(TABLE(SELECT user, at FROM log) PARTITION BY user ORDER BY (at), 1800)
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

UNITS = {"sentence": [("position", IntegerType()), ("sentence", StringType())], "document": [("words", ArrayType(StringType()))], "word": [("position", IntegerType()), ("word", StringType())]}
NUMBERS = (IntegerType, LongType, DoubleType)


def constant(arg: AnalyzeArgument, name: str):
    if arg.isTable or not arg.isConstantExpression or arg.value is None:
        raise ValueError(f"{name} has to be a constant")
    return arg.value


@udtf
class TextUnits:
    """Of a table with a key and a text: its sentences, its words by position, or one row with its words. The key's name and
    type are the table's. Null and blank texts give no row."""

    @staticmethod
    def analyze(texts: AnalyzeArgument, unit: AnalyzeArgument) -> AnalyzeResult:
        if not texts.isTable or len(texts.dataType.fields) != 2 or not isinstance(texts.dataType.fields[1].dataType, StringType):
            raise ValueError("text_units takes a table of a key and a text")
        if constant(unit, "the unit") not in UNITS:
            raise ValueError(f"the unit is one of {', '.join(UNITS)}")
        key = texts.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(key.name, key.dataType), *(StructField(n, t) for n, t in UNITS[unit.value])]))

    def eval(self, row, unit):
        key, text = row[0], row[1]
        if text is None:
            return
        if unit == "sentence":
            parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text)]
            yield from ((key, i, s) for i, s in enumerate(s for s in parts if s))
            return
        words = re.findall(r"[a-z]+", text.lower())
        if unit == "word":
            yield from ((key, i, w) for i, w in enumerate(words))
        elif words:
            yield key, words


@udtf
class Sessions:
    """Of a table with a key and a time in seconds, PARTITION BY the key ORDER BY the time: a row for each run of times no
    more than `gap` apart. Only the run at hand is held. Rows with a null time are left out."""

    @staticmethod
    def analyze(times: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not times.isTable or len(times.dataType.fields) != 2 or not isinstance(times.dataType.fields[1].dataType, NUMBERS):
            raise ValueError("sessions takes a table of a key and a time as a number")
        if constant(gap, "the gap") < 0:
            raise ValueError("the gap can't be negative")
        key, at = times.dataType.fields
        return AnalyzeResult(StructType([StructField(key.name, key.dataType), StructField("session", LongType()), StructField("first", at.dataType), StructField("last", at.dataType), StructField("n", LongType())]))

    def __init__(self):
        self.key, self.session, self.first, self.last, self.n = None, 0, None, None, 0

    def eval(self, row, gap):
        if row[1] is None:
            return
        if self.n and row[1] - self.last > gap:
            yield self.key, self.session, self.first, self.last, self.n
            self.session, self.n = self.session + 1, 0
        if not self.n:
            self.key, self.first = row[0], row[1]
        self.last, self.n = row[1], self.n + 1

    def terminate(self):
        if self.n:
            yield self.key, self.session, self.first, self.last, self.n


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_units", TextUnits)
    spark.udtf.register("sessions", Sessions)
