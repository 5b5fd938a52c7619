"""What workers remember, and pairs that are dropped before they are written."""

import numpy as np
import pandas as pd

from prismal.llm import common, jaccard_join, substring_dedup


def test_a_worker_remembers_one_kind():
    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [common.remembered(k, make(k)) for k in ("a", "a", "b", "a")] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]
    common.word_hashes(["x"])
    assert list(common._remembered) == ["word hashes"]
    common.forget()
    assert not common._remembered


def test_long_sketches_of_many_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 900).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[: rng.integers(30, len(base))], rng.integers(0, 1 << 60, rng.integers(0, 90)).astype(np.uint64)])) for _ in range(40)]
    bits, n = [jaccard_join.long_sketch(s).tobytes() for s in sets], np.array([len(s) for s in sets])
    i, j = map(np.ravel, np.meshgrid(np.arange(40), np.arange(40)))
    distance = [jaccard_join.sketch_distance(*[np.frombuffer(bits[k], np.uint64) for k in p]) for p in zip(i, j, strict=True)]
    wanted = [max(n[a], n[b]) <= jaccard_join.SHORT_BITS or d <= jaccard_join.most_different(n[a], n[b], 80) for a, b, d in zip(i, j, distance, strict=True)]
    assert jaccard_join.sketches_near(bits, bits, n, n, i, j, 80).tolist() == wanted
    assert 0 < sum(wanted) < len(wanted)


def test_pairs_left_apart_are_found_once(spark):
    """Three sets that share 20 hot segments, in which one of them is the middle: their pairs come once, not once a segment."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[20 * k :], rng.integers(0, 1 << 60, 20 * k).astype(np.uint64)])) for k in range(3)]
    rows = [(*jaccard_join.set_id(s), len(s), *jaccard_join._fold_sketch(s), jaccard_join.long_sketch(s).tobytes()) for s in sets]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=[*jaccard_join._SELF, "bits"]))
    hot = nodes.drop("bits").crossJoin(spark.range(20).withColumnRenamed("id", "key")).selectExpr("key", *jaccard_join._SELF, "1L n_hot")
    s0, s1, n, *f = rows[0][:-1]
    middles = spark.createDataFrame([(k, s0, s1, n, *f) for k in range(20)], "key long, " + ", ".join(f"m_{c} long" for c in jaccard_join._SELF))
    named = spark.createDataFrame([(r[0], r[1], k) for k, r in enumerate(rows)], "s0 long, s1 long, c long")
    with common.Scratch() as scratch:
        search = jaccard_join._Search(spark.createDataFrame([], "doc_id long, text string"), 5, 80, scratch)
        found = search._apart(hot, middles, named, nodes).select("a0", "a1", "b0", "b1").collect()
    assert len({frozenset([(r.a0, r.a1), (r.b0, r.b1)]) for r in found}) == 3
    assert len(found) <= 4  # two sets apart from the middle meet from either side


def test_repeated_places_of_an_automaton_and_cuts():
    a = substring_dedup.SuffixAutomaton()
    texts = [[1, 2, 3, 4, 1, 2, 3], [9, 2, 3, 4, 9], [5, 5, 5, 5]]
    for t in texts:
        a.add(t)
    a.finish()
    for t in texts:
        assert a.repeated(t, 3) == [end for end, (matched, n) in enumerate(a.matching(t, 3)) if matched == 3 and n > 1]
    text = "\xa0é " + " ".join(f"w{i}" for i in range(40)) + "\x0b\tz\x85z"
    assert substring_dedup.cut_spans(text, [{"first": 1, "last": 2}]) == ("\xa0é w36 w37 w38 w39\x0b\tz\x85z", 36)


def rows_of_joins(spark, run):
    """What run() returns, and the most rows that a join of it made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    executions = lambda: {(x := store.executionsList().apply(k)).executionId() for k in range(store.executionsList().size())}
    before, out, most = executions(), run(), 0
    bus.waitUntilEmpty()
    for k in executions() - before:
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for metric in (node.metrics().apply(m) for m in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return out, most


def test_joins_of_a_group_make_no_row_for_each_segment(spark):
    """200 sets share 30 hot segments: joins make a few rows for a segment and one for a set, and find all pairs left apart."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[3 * (k % 8) :], rng.integers(0, 1 << 60, 2 + 3 * (k % 8)).astype(np.uint64)])) for k in range(200)]
    rows = [(*jaccard_join.set_id(s), len(s), *jaccard_join._fold_sketch(s), jaccard_join.long_sketch(s).tobytes()) for s in sets]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=[*jaccard_join._SELF, "bits"]))
    hot = nodes.drop("bits").crossJoin(spark.range(30).withColumnRenamed("id", "key")).selectExpr("key", *jaccard_join._SELF, "1L n_hot")
    middles = spark.createDataFrame([(k, *rows[0][:-1]) for k in range(30)], "key long, " + ", ".join(f"m_{c} long" for c in jaccard_join._SELF))
    label = [0 if k % 8 < 5 else k for k in range(200)]  # those that differ more from the middle are apart from it
    named = spark.createDataFrame([(r[0], r[1], c) for r, c in zip(rows, label, strict=True)], "s0 long, s1 long, c long")
    columns = list(np.array([r[:-1] for r in rows]).T)
    may = jaccard_join._may_link([x[:, None] for x in columns], [x[None] for x in columns], 80)
    wanted = {frozenset([rows[i][:2], rows[j][:2]]) for i, j in zip(*np.nonzero(may), strict=True) if label[i] != label[j]}
    with common.Scratch() as scratch:
        # Written first, so that the rows are those of the search alone.
        hot, nodes = common.materialize(hot, "hot"), common.materialize(nodes, "nodes")
        search = jaccard_join._Search(spark.createDataFrame([], "doc_id long, text string"), 5, 80, scratch)
        found, most = rows_of_joins(spark, lambda: search._apart(hot, middles, named, nodes).select("a0", "a1", "b0", "b1").collect())
    assert {frozenset([(r.a0, r.a1), (r.b0, r.b1)]) for r in found} == wanted and wanted
    assert 200 <= most <= 30 * 16 + 200 < 30 * 200
