"""What a query shuffled is removed while it goes on, so that its disk doesn't grow with its steps."""

import glob
import time

import numpy as np

from tallywind.operators import wordvectors
from tallywind.sources import matrices, shared


def files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def less(spark, most):
    """Whether at most so many files of shuffles are left in the end; they are removed in the background."""
    end = time.time() + 10
    while files(spark) > most and time.time() < end:
        time.sleep(0.1)
    return files(spark) <= most


def test_saved_tables_leave_no_shuffle(spark):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files(spark)
    rows = spark.range(1000).selectExpr("id % 7 as a", "id").repartition("a")
    saved = shared.save(rows, "kept")
    assert less(spark, before) and saved.count() == 1000 and rows.count() == 1000 and spark.conf.get(key) == "false"


def test_passes_over_word_vectors_leave_no_shuffle(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([([f"w{i}" for i in rng.integers(0, 20, 50)],) for _ in range(40)], "words array<string>")
    before = files(spark)
    assert wordvectors.train(docs, "words", size=8, least=5, passes=12).count() == 20
    assert less(spark, before + 24)  # of the count above and of a sum


def test_a_bag_leaves_its_parts_only(spark, tmp_path):
    tokens = spark.createDataFrame([(d, f"t{(d * i) % 11}") for d in range(20) for i in range(10)], "doc int, token string")
    root = shared.shared_root(spark).removeprefix("file://")
    before, bags = files(spark), set(glob.glob(f"{root}/tallywind-core/bag-*"))
    matrices.write_bag(tokens, "doc", "token", str(tmp_path / "bag"))
    left = {x for x in glob.glob(f"{root}/tallywind-core/bag-*")} - bags
    assert len(left) == 2 and all("bag-documents" in x or "bag-tokens" in x for x in left)
    assert less(spark, before + 40)
