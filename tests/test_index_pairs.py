"""Index pairs come in squares whose written form is small, all of them once."""

import pytest
from pyspark.sql import functions as F

from marginwise.operators import pairs


@pytest.mark.parametrize("n", [0, 1, 2, 504, 505, 1009, 2500])
def test_every_pair_once(spark, n):
    found = pairs.upper_triangle(spark, n).distinct().agg(F.count("*"), F.count_if(F.expr(f"0 <= i AND i < j AND j < {n}"))).first()
    assert tuple(found) == (n * (n - 1) // 2,) * 2


def test_written_pairs_are_small(spark, tmp_path):
    pairs.upper_triangle(spark, 4000).write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.5 * (4000 * 3999 // 2)
