"""The classes' shares do not depend on how many rows are sampled."""

import pytest

from quillon.llm import quality


def test_prior_of_a_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    whole, part = quality.fit(docs, labels), quality.fit(docs, labels, most=20)
    assert abs(whole.base) > 0.5 and part.base == pytest.approx(whole.base)
