"""Written intermediates, and components of long chains."""

import gc
import random

import pytest

from semblance.llm import common
from semblance.llm.components import components


def test_paths_are_used_once(spark, scratch):
    """However many frames come and go, each table has a path of its own."""
    held = scratch.keep(spark.range(3).toDF("k"))
    for n in range(30):
        df = scratch.keep(spark.range(n).toDF("k"))
        if n % 3:
            scratch.drop(df)
        del df
        gc.collect()
    assert scratch.written == 31 and len({p for _, p in scratch.kept}) == len(scratch.kept) == 11
    assert held.count() == 3


def test_components_of_chains(spark, scratch):
    """Many calls on one folder; the roots are the least ids, by hand."""
    rng = random.Random(6)
    for _ in range(4):
        ids, links = rng.sample(range(10**6), 90), []
        want = {}
        for part in (ids[:60], ids[60:88], ids[88:]):
            links += [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(part, part[1:], strict=False)]
            want |= dict.fromkeys(part, min(part))
        rng.shuffle(links)
        got = components(spark.createDataFrame([*links, links[0], (links[0][0], links[0][0])], "a bigint, b bigint"), scratch)
        assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), scratch).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Away:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Away)
