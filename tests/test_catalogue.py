import pytest
from oracle import compare, connect

from tallywind.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, name):
    assert compare(catalogue.queries()[name](spark, sf), connect(sf), catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_known_scores(spark):
    got = {r.country: r for r in catalogue.early_warning_scores(spark, "/root/testdata/sf0.01").collect()}["aggregate"]
    assert (got.tp, got.fp, got.fn, got.recall, got.precision, got.fscore) == (34, 18, 23, 0.596491, 0.653846, 0.607143)


def test_models_have_the_reference_parameters(spark, sf):
    vectors = catalogue.queries()["word2vec"](spark, sf).collect()
    assert vectors and {len(r.vector) for r in vectors} == {200}
    topics = catalogue.queries()["lda"](spark, sf).collect()
    assert {r.topic for r in topics} == set(range(100)) and all(r.term for r in topics)
