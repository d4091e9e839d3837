import numpy as np

from leafmesh.llm import abuse
from leafmesh.llm.recurrent import Network


def test_units_have_one_spelling():
    assert abuse.units("w0rthl355 MOROOOON b r a i n l e s s p.a.t.h.e.t.i.c") == ["worthless", "moron", "brainless", "pathetic"]
    assert abuse.units("废·物 ab 12") == ["废物", "物", "ab", "0"]
    assert abuse.units("") == [] and abuse.units("—!") == []


def test_windows_hold_every_unit():
    for n in (0, 1, abuse.WINDOW, abuse.WINDOW + 1, 100):
        wins, of = abuse.windows([list(range(1, n + 1))])
        assert set(wins.ravel()) - {0} == set(range(1, n + 1)) and len(of) == len(wins)


def test_gradients_are_those_of_differences():
    draw = np.random.default_rng(0)
    net = Network(3)
    rows = np.array([[1, 2, 3, 0], [2, 4, 0, 0], [3, 3, 1, 4]])
    words, chars, owner = np.array([0, 5, 6, 7, 8]), np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 2, 2, 3, 4])
    y, weight = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64) if k != "word" else net.weights[k]
    _, g = net.gradients(rows, words, chars, owner, y, weight)
    for k in ("u0", "u1", "x", "a", "v", "o"):
        at = tuple(draw.integers(0, d) for d in net.weights[k].shape)
        old, eps = net.weights[k][at], 1e-3
        net.weights[k][at] = old + eps
        hi = net.gradients(rows, words, chars, owner, y, weight)[0]
        net.weights[k][at] = old - eps
        lo = net.gradients(rows, words, chars, owner, y, weight)[0]
        net.weights[k][at] = old
        assert abs((hi - lo) / (2 * eps) - g[k][at]) < 2e-3


def test_scores_of_small_and_dirty_tables(spark):
    clean = "The parser reads the sequence of the operator and writes the result to the cache in every run of the experiment. " * 3
    docs = [(1, clean + "You are a w0rthl355 idiot and a pathetic moron. " + clean, "a", 1), (2, clean, "a", 2), (3, None, None, 3), (4, "", "b", 4), (None, clean, "b", 5), (2, clean, "a", 6)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(2, "clean"), (2, "clean"), (None, "abusive"), (1, None)], "doc_id bigint, label string")
    rows = abuse.scored(d, labels).collect()
    assert len(rows) == 6 and {r.doc_id for r in rows if r.score >= abuse.THRESHOLD} == {1}
    assert [r.score for r in rows if r.doc_id in (3, 4)] == [0, 0]
    assert [tuple(r) for r in abuse.found(d, labels).collect()] == [(1,)]
    got = {r.source: (r.documents, r.flagged, r.rate) for r in abuse.rates(d, labels).collect()}
    assert got == {"a": (3, 1, 1 / 3), "b": (2, 0, 0.0), None: (1, 0, 0.0)}
    assert abuse.scored(d.where("false"), labels.where("false")).count() == 0
