"""The grid of the fingerprint join: how many pairs it compares, wide groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossbook.llm import simhash
from crossbook.llm.components import connected_components
from test_text_ops import brute_components


def _frame(spark, prints):
    return spark.createDataFrame([(int(p),) for p in np.asarray(prints, np.uint64).view(np.int64)], "fp bigint")


def _work(spark, n):
    """(grid rows, pairs that share a group) of n random fingerprints."""
    draws = spark.range(n).select(F.xxhash64("id").alias("fp"))
    size = simhash.grid_rows(draws).groupBy("cell", "pattern").count()
    return size.agg(F.sum("count"), F.sum(F.expr("count * (count - 1) div 2"))).first()


def test_compared_pairs_stay_below_the_rows(spark):
    """Four times the fingerprints: four times the rows, and the pairs stay a
    small share of them."""
    rows, pairs = _work(spark, 20_000)
    more_rows, more_pairs = _work(spark, 80_000)
    assert more_rows == 4 * rows == 4 * 66 * 20_000
    assert 3.9 < (more_rows + more_pairs) / (rows + pairs) < 4.1
    assert more_pairs < 0.001 * more_rows


@pytest.mark.parametrize("wide, held", [(8, 60), (8, 1 << 20), (1 << 20, 1 << 20)])
def test_wide_groups_keep_all_links(spark, monkeypatch, wide, held):
    """Fingerprints that agree in one half almost wholly and spread in the other."""
    monkeypatch.setattr(simhash, "SMALL_CELL", 4)
    monkeypatch.setattr(simhash, "WIDE_CELL", wide)
    monkeypatch.setattr(simhash, "QUARTER_ROWS", held)
    rng = np.random.default_rng(9)
    prints = set()
    for half in (0, 32):
        for centre in rng.integers(0, 1 << 63, 2, dtype=np.uint64).tolist():
            for _ in range(150):
                bits = [(half + int(b)) % 64 for b in rng.integers(0, 32, int(rng.integers(0, 7)))]
                bits += [(half + 32 + int(b)) % 64 for b in rng.integers(0, 32, int(rng.integers(0, 3)))]
                prints.add(centre ^ sum(1 << b for b in set(bits)))
    prints = sorted(prints)
    found = {r.node % (1 << 64): r.component for r in connected_components(simhash.links(_frame(spark, prints))).collect()}
    want = brute_components(list(range(len(prints))), prints)
    got = [found.get(p, p) for p in prints]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
