"""Sorted suffixes: runs that no pair of neighbours shows, range borders, random texts."""

import numpy as np
import pytest

from crossbook.llm import suffix_dedup
from test_text_ops import brute_passages

SCHEMA = "doc_id bigint, text string"


def _covered(rows):
    return {(r.doc_id, p) for r in rows for p in range(r.start, r.start + r.length)}


def _small_batches(spark, docs):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        return suffix_dedup.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffixes_of_random_edits(spark, seed):
    """One passage behind and before random cuts of others, edited at random
    places: the longest matches to the left and to the right lie in different
    texts, and some stand twice in one text only."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        lo, n = int(rng.integers(0, 220)), int(rng.integers(30, 120))
        words = list(base[lo:lo + n])
        for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
            words[at] = f"x{rng.integers(0, 3)}"
        texts.append(" ".join([f"a{rng.integers(0, 9)}"] * int(rng.integers(0, 3)) + words + [f"b{rng.integers(0, 9)}"]))
    texts += [" ".join(f"s{i}" for i in range(60)) + " t " + " ".join(f"s{i}" for i in range(60)), texts[0], "", None]
    got = _small_batches(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5))
    assert _covered(got) == brute_passages(list(enumerate(texts)))


def test_match_split_between_rows(spark):
    """A and B agree far to the right only, A and C further to the left but
    less far to the right: the neighbour of A in the order is B, its passage is C's."""
    core = [f"w{i}" for i in range(25)]
    a, right = [f"l{i}" for i in range(25)], [f"r{i}" for i in range(25)]
    texts = []
    for cut in range(0, 26, 5):
        texts += [a + core + right, [f"n{cut}_{i}" for i in range(25 - cut)] + a[25 - cut:] + core + right[:24 - cut] + ["z"] * 30,
                  ["m"] * 25 + core + right[:24] + [f"k{cut}"] * 9, a[25 - cut:] + core + right[:25 - cut] + [f"y{cut}"]]
    texts = [" ".join(t) for t in texts]
    got = _small_batches(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert _covered(got) == brute_passages(list(enumerate(texts)))


@pytest.mark.parametrize("held", [1, 4])
def test_common_grams_are_told_in_pieces(spark, monkeypatch, held):
    """A gram that most texts hold, with its whole context, in copies, and amid
    words of their own, where no more than a few of its rows may wait."""
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", held)
    rng = np.random.default_rng(11)
    core = [f"w{i}" for i in range(25)]
    texts = [" ".join([f"p{n}_{i}" for i in range(30)] + core + [f"q{n}_{i}" for i in range(30)]) for n in range(30)]
    texts += [" ".join([f"p{n}_{i}" for i in range(30)] + core + [f"q0_{i}" for i in range(24)] + ["z"] * n)
              for n in range(1, 12)]
    common = [f"c{i}" for i in range(80)]
    texts += [" ".join([f"h{n}"] + common + [f"t{n}"] + common[:int(rng.integers(20, 60))]) for n in range(25)]
    texts += [texts[0], texts[45]] * 12
    got = _small_batches(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4))
    assert _covered(got) == brute_passages(list(enumerate(texts)))


def test_neighbours_bound_what_a_row_can_share():
    words = np.zeros((3, suffix_dedup.REACH), np.uint64)
    words[:, :4] = [[1, 2, 3, 4], [1, 2, 3, 0], [1, 2, 5, 0]]
    assert suffix_dedup.agreement(words).tolist() == [3, 2]
    assert suffix_dedup._words(suffix_dedup._bytes(words)).tolist() == words.tolist()
