import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallywind.sources import avro as A

# Fixed values of a delivery record: 29 texts and codes, 5 dates as milliseconds, a count of words.
DATES = ["modification_datetime", "ingestion_datetime", "publication_date", "publication_datetime", "modification_date"]


def container(path, schema, blocks, codec="null", marker=b"0123456789abcdef"):
    import zlib

    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    data = A.MAGIC + A.number(len(meta)) + b"".join(A.number(len(k)) + k.encode() + A.number(len(v)) + v for k, v in meta.items()) + b"\x00" + marker
    for n, body in blocks:
        if codec == "deflate":
            z = zlib.compressobj(9, zlib.DEFLATED, -15)
            body = z.compress(body) + z.flush()
        data += A.number(n) + A.number(len(body)) + body + marker
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(A.Avro)
    return spark


def test_numbers_by_the_published_examples():
    assert [A.number(n) for n in (0, -1, 1, -2, 2, -64, 64)] == [b"\x00", b"\x01", b"\x02", b"\x03", b"\x04", b"\x7f", b"\x80\x01"]
    for n in (0, 1, -1, 2**31, -(2**31), 2**63 - 1, -(2**63)):
        assert A.Cursor(A.number(n)).number() == n


def test_a_record_written_by_hand(source, tmp_path):
    """Bytes from the format's own rules: unions, enums, fixed, arrays in sized blocks, maps, nested and named types, longs for dates."""
    schema = {"type": "record", "name": "r", "namespace": "n", "fields": [
        {"name": "an", "type": ["null", "string"]}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "kind", "type": {"type": "enum", "name": "k", "symbols": ["a", "b"]}},
        {"name": "codes", "type": {"type": "array", "items": "string"}}, {"name": "extra", "type": {"type": "map", "values": "int"}}, {"name": "id", "type": {"type": "fixed", "name": "four", "size": 4}},
        {"name": "inner", "type": {"type": "record", "name": "i", "fields": [{"name": "x", "type": "double"}, {"name": "k", "type": "n.k"}]}}, {"name": "word_count", "type": "int"}]}
    one = b"\x02\x06foo" + A.number(1500) + b"\x02" + b"\x03\x06\x02x\x02y\x00" + b"\x02\x02q\x0e\x00" + b"abcd" + b"\x00\x00\x00\x00\x00\x00\xf8\x3f\x00" + b"\x54"
    two = b"\x00" + A.number(0) + b"\x00" + b"\x00" + b"\x00" + b"\x00\x00\x00\x00" + b"\x00" * 8 + b"\x02" + b"\x01"
    container(tmp_path / "a.avro", schema, [(2, one + two)], "deflate")
    got = sorted(source.read.format("tallywind_avro").load(str(tmp_path)).select("*", F.unix_millis("at").alias("ms")).collect(), key=lambda r: -r.ms)
    assert (got[0].an, got[0].ms, got[0].kind, got[0].codes, got[0].extra, bytes(got[0].id), got[0].inner.x, got[0].inner.k, got[0].word_count) == ("foo", 1500, "b", ["x", "y"], {"q": 7}, b"abcd", 1.5, "a", 42)
    assert (got[1].an, got[1].codes, got[1].extra, got[1].inner.k, got[1].word_count) == (None, [], {}, "b", -1)


def test_delivery_records_in_any_ranges(source, tmp_path):
    names = [f"field_{i}" for i in range(29)]
    cols = [F.when(F.col("id") % (i + 2) != 0, F.concat(F.lit(f"é{i}-"), F.col("id").cast("string"))).alias(n) for i, n in enumerate(names)]
    df = source.range(0, 700, 1, 3).select(*cols, *((F.col("id") * 1000 + i).alias(n) for i, n in enumerate(DATES)), F.when(F.col("id") % 5 > 0, F.col("id")).cast("int").alias("word_count"))
    want = sorted(map(tuple, df.collect()), key=str)
    for codec in ("null", "deflate"):
        path = str(tmp_path / codec)
        df.write.format("tallywind_avro").mode("append").option("codec", codec).option("blockbytes", 3000).save(path)
        assert len(os.listdir(path)) == 3
        for size in (1 << 30, 20_000, 777):
            read = source.read.format("tallywind_avro").option("rangebytes", size).load(path)
            assert read.columns == df.columns and len(read.columns) == 35
            assert sorted(map(tuple, read.collect()), key=str) == want
            assert (read.rdd.getNumPartitions() > 3) == (size < 1 << 30)


def test_schemas_are_resolved_by_name(source, tmp_path):
    path = str(tmp_path / "t")
    df = source.createDataFrame([(1, "a", dt.date(1969, 12, 31), dt.datetime(2001, 2, 3, 4, 5, 6, 7), [1.5, None], {"k": None}, b"\x00")], "n int, s string, d date, t timestamp, l array<double>, m map<string,int>, b binary")
    df.write.format("tallywind_avro").mode("append").save(path)
    assert source.read.format("tallywind_avro").load(path).collect() == df.collect()
    got = source.read.format("tallywind_avro").schema("s string, gone string, n long").load(path).collect()
    assert [tuple(r) for r in got] == [("a", None, 1)]
    df.limit(0).write.format("tallywind_avro").mode("overwrite").save(path)
    assert source.read.format("tallywind_avro").load(path).count() == 0


def test_damage_and_failure(source, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "x", "type": "long"}]}
    container(tmp_path / "a.avro", schema, [(1, A.number(5)), (1, A.number(6))])
    data = (tmp_path / "a.avro").read_bytes()
    (tmp_path / "a.avro").write_bytes(data[:-3])
    with pytest.raises(Exception, match="cut short"):
        source.read.format("tallywind_avro").load(str(tmp_path)).collect()
    (tmp_path / "a.avro").write_bytes(b"text")
    with pytest.raises(Exception, match="not an Avro"):
        source.read.format("tallywind_avro").load(str(tmp_path)).collect()
    path = str(tmp_path / "out")
    bad = source.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("tallywind_avro").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
