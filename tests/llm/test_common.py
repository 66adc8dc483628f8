import random

import pytest

from pyspark.sql import functions as F

from postmill.llm.common import Scratch, components, let, shared_dir, temporary, words


def test_components(spark):
    dice, edges = random.Random(8), []
    edges += [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(120)]  # a path
    edges += [("hub", f"s{k}") for k in range(200)]
    edges += [(f"r{dice.randint(0, 150)}", f"r{dice.randint(0, 150)}") for _ in range(140)]
    edges += [("same", "same"), ("hub", "s1"), ("s1", "hub")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    frame = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    found = {bytes(r.node).decode(): bytes(r.root).decode() for r in components(Scratch(spark), frame).collect()}
    assert found == {x: root(x) for x in up}
    assert components(Scratch(spark), frame.limit(0)).count() == 0


def test_tables_go_to_the_shared_folder(spark):
    scratch = Scratch(spark)
    frame = scratch.write(spark.range(5), "five")
    assert scratch.root.startswith(shared_dir(spark)) and frame.count() == 5
    scratch.drop("five")
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_scratch_is_cleaned(spark):
    import os

    outer = Scratch(spark)
    outer.write(spark.range(3), "x")
    with temporary():
        inner = Scratch(spark)
        inner.write(spark.range(3), "x")
        assert os.path.isdir(inner.root.removeprefix("file://"))
    assert not os.path.isdir(inner.root.removeprefix("file://")) and os.path.isdir(outer.root.removeprefix("file://"))
    outer.clean()
    assert not os.path.isdir(outer.root.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_words_and_let(spark):
    rows = [(" a\tb\x0b c ",), ("",), (None,), (" \n",)]
    frame = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in frame.select(words(F.col("t"))).collect()] == [["a", "b", " c"], [], [], []]
    assert frame.select(let(F.lit(3), lambda x: x * x)).first()[0] == 9
