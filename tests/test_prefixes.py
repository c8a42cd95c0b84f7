"""Prefix joins against a plain loop, with intervals that cross partitions."""

import random

import pytest

from slidegrid.operators.prefixes import prefix_join


def frames(spark, keys, prefixes):
    return (spark.createDataFrame(list(enumerate(keys)), "id int, k string"), spark.createDataFrame(list(enumerate(prefixes)), "n int, p string"))


def plain(keys, prefixes):
    return sorted((i, n) for i, k in enumerate(keys) for n, p in enumerate(prefixes) if k is not None and p and k.startswith(p))


def got(spark, keys, prefixes):
    a, b = frames(spark, keys, prefixes)
    return sorted((r["id"], r["n"]) for r in prefix_join(a, "k", b, "p").collect())


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_pairs_equal_a_plain_loop(spark, parts):
    rng = random.Random(int(parts))
    word = lambda n: "".join(rng.choice("abé\U0001F600") for _ in range(rng.randrange(n)))
    keys = [word(9) for _ in range(300)] + ["a" * 40] * 30 + [None, ""]
    prefixes = [word(5) for _ in range(60)] + ["a", "a", "aa", "a" * 39, "", None, "zz", "\U0001F600" * 3]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, keys, prefixes) == plain(keys, prefixes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nothing_on_a_side(spark):
    assert got(spark, [], ["a"]) == got(spark, ["a"], []) == got(spark, [None], [""]) == []
    a, b = frames(spark, ["a"], ["a"])
    with pytest.raises(ValueError, match="both sides"):
        prefix_join(a, "k", b.withColumnRenamed("n", "id"), "p")
