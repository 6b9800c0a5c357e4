import os
import random

import pytest
from pyspark.sql import functions as F

from tallywind.operators import panel
from tallywind.sources import matrices as M
from tallywind.sources.shared import numbered


def joined(path):
    return "".join(open(f"{path}/{p}").read() for p in sorted(os.listdir(path)) if p.startswith("part-"))


def test_numbers_have_no_gaps(spark):
    rng = random.Random(1)
    values = [rng.randrange(10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:500], None]], "k long").repartition(7)
    got = {r.k: r.number for r in numbered(df, "k", 1).collect()}
    assert got == {k: i + 1 for i, k in enumerate([None, *sorted(set(values))])}
    assert numbered(df.where("k < 0"), "k").count() == 0
    assert {r.k: r.label_id for r in panel.encode_labels(df.where("k is not null"), "k").collect()} == {k: i for i, k in enumerate(sorted(set(values)))}


def test_a_bag_goes_round(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(40) * 3, f"w{int(rng.paretovariate(1)) % 60}") for _ in range(3000)] + [(None, "w1"), (4, None)]
    df = spark.createDataFrame(rows, "d long, t string")
    M.write_bag(df, "d", "t", str(tmp_path / "bag"))
    bag = {}
    for d, t in rows[:-2]:
        bag[d, t] = bag.get((d, t), 0) + 1
    docs, tokens = sorted({d for d, _ in bag}), sorted({t for _, t in bag})
    text = joined(tmp_path / "bag" / "corpus").splitlines()
    assert text[0] == M.BANNER and text[1] == f"{len(docs)} {len(tokens)} {len(bag)}"
    want = sorted((docs.index(d) + 1, tokens.index(t) + 1, float(n)) for (d, t), n in bag.items())
    assert [(int(a), int(b), float(c)) for a, b, c in map(str.split, text[2:])] == want
    read, size = M.read_matrix(spark, str(tmp_path / "bag" / "corpus"))
    assert sorted(map(tuple, read.collect())) == want and size == (len(docs), len(tokens), len(bag))
    terms, n = M.read_dictionary(spark, str(tmp_path / "bag" / "dictionary"))
    assert n == len(docs) and sorted(map(tuple, terms.collect())) == [(i, t, sum(1 for _, u in bag if u == t)) for i, t in enumerate(tokens)]
    with pytest.raises(Exception, match="isn't empty"):
        M.write_bag(df, "d", "t", str(tmp_path / "bag"))
    M.write_bag(df.where("d = 0"), "d", "t", str(tmp_path / "bag"), overwrite=True)
    assert M.read_matrix(spark, str(tmp_path / "bag" / "corpus"))[1][0] == 1
    M.write_bag(df.where("d = -1"), "d", "t", str(tmp_path / "none"))
    read, size = M.read_matrix(spark, str(tmp_path / "none" / "corpus"))
    assert read.count() == 0 and size == (0, 0, 0)


def test_files_of_others(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate integer symmetric\n% a note\n\n3 3 3\n1 1 5\n3 3 3\n3 1  -2\n")
    read, size = M.read_matrix(spark, str(tmp_path / "a.mtx"))
    assert sorted(map(tuple, read.collect())) == [(1, 1, 5.0), (1, 3, -2.0), (3, 1, -2.0), (3, 3, 3.0)] and size == (3, 3, 3)
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n" + "% " + "x" * 200_000 + "\n2 2 1\n2 1")
    assert M.read_matrix(spark, str(tmp_path / "b.mtx"))[0].collect() == [(2, 1, 1.0)]
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
    with pytest.raises(ValueError, match="can be read"):
        M.read_matrix(spark, str(tmp_path / "c.mtx"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(1, 101, 1, 4).select(F.col("id").alias("i"), F.when(F.col("id") != 60, 1).alias("j"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="null or outside"):
        M.write_matrix(df, str(tmp_path / "m"), "i", "j", "v", 100, 1)
    assert not os.path.exists(tmp_path / "m") or os.listdir(tmp_path / "m") == []
