import random

import pytest

from anonframe.llm import common


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("size", [0, 300, 1500])
def test_components(spark, size, monkeypatch):
    rng = random.Random(size)
    links = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(size)] + [(i, i + 1) for i in range(2000, 2000 + size // 5)]
    rng.shuffle(links)
    monkeypatch.setattr(common, "CHUNK_LINKS", 64)
    found = common.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["id"]: r["comp"] for r in found.collect()} == brute(links) and found.count() == len(brute(links))
    common.release(found)


def test_materialize_and_release(spark):
    import os

    held = common.materialize(spark.range(10).repartition(3), "held")
    path = held._anon_path.removeprefix("file://").removeprefix("file:")
    assert held.count() == 10 and os.path.isdir(path)
    common.release(held, spark.range(1))
    assert not os.path.exists(path)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
