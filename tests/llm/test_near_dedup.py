"""Near copies in very large groups, and audits that always have something to find."""

import resource

import numpy as np
import pandas as pd
import pytest

from polyadic.llm import near_dedup
from polyadic.llm.hnsw import Graph


def brute(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(u[at : at + 512] @ u.T >= threshold).sum(axis=1) - 1 for at in range(0, len(u), 512)])


def test_one_group_of_near_copies_over_several_shards(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16) + rng.normal(size=(20_000, 16)) * 0.02
    chain = np.stack([np.cos(np.arange(20) * 0.25), np.sin(np.arange(20) * 0.25)] + [np.zeros(20)] * 14, axis=1) * 3
    x = np.concatenate([hot, chain, rng.normal(size=(2_000, 16))])
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": [v.tolist() for v in x], "shard": "clash"}))
    got = near_dedup.near_duplicates(frame).toPandas().sort_values("vec_id")
    found, want = got["n_links"].to_numpy(), brute(x)
    assert found[:20_000].tolist() == want[:20_000].tolist() and set(got["component_id"][:20_000]) == {0}
    assert (found <= want).all() and found[20_000:].sum() >= 0.98 * want[20_000:].sum()
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 2_000_000


def index_of(x, blob):
    return pd.DataFrame({"shard": [0], "reps": [np.arange(len(x)).tobytes()], "copies": [np.ones(len(x), np.int64).tobytes()], "exact": [x.tobytes()], "graph": [blob]})


@pytest.mark.parametrize("beam_that_works", [None, 128])
def test_probes_measure_recall_where_audited_queries_have_no_links(monkeypatch, beam_that_works):
    """A graph that finds nothing (or too little at small beams) fails its audit although no audited query has a link."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1_000, 32))
    x[501] = x[500] + 0.01  # the only link; the audit's queries are every eighth or so
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    beams = []

    class Poor:
        @classmethod
        def load(cls, _):
            return cls()

        def within(self, q, threshold, beam):
            beams.append(beam)
            works = beam_that_works and beam >= beam_that_works
            return [np.flatnonzero(x @ v >= threshold) if works else np.zeros(0, np.int64) for v in q.astype(np.float64)]

    monkeypatch.setattr(near_dedup, "Graph", Poor)
    some = np.unique(np.linspace(0, 999, 128).astype(int))
    assert not {500, 501} & set(some.tolist())
    got = near_dedup._search(0.95)(pd.DataFrame({"rep": range(1_000), "embedding": list(x)}), index_of(x, b""))
    assert sorted(got["node"]) == [500, 501] and got["links"].tolist() == [1, 1] and got["root"].nunique() == 1
    assert max(beams) == (beam_that_works or near_dedup.LAST_BEAM) and min(beams) == near_dedup.FIRST_BEAM


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_walked_and_scanned_queries_agree(monkeypatch, crowd):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(50, 8)) * s for c, s in zip(rng.normal(size=(30, 8)) * 3, [0.05, 0.3, 0.8] * 10, strict=True)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    within = Graph.within
    monkeypatch.setattr(Graph, "within", lambda self, q, least, beam: within(self, q, least, beam, crowd))
    got = near_dedup._search(0.95)(pd.DataFrame({"rep": range(len(x)), "embedding": list(x)}), index_of(u, Graph(u).dump())).set_index("node")["links"]
    want = brute(x)
    found = np.array([got.get(i, 0) for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    if not crowd:
        assert found.tolist() == want.tolist()


def test_probes_of_one_dimension_are_the_vectors():
    x = np.array([[1.0], [-1.0]])
    assert np.array_equal(near_dedup._probes(x, 0.95), x)
