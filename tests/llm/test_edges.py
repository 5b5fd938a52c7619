"""Odd columns, ids, tables and sizes."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.llm import common, exact_dedup, jaccard_join, license_scan, line_dedup, packing, quality_rules, substring_dedup, toxicity, wavelet

#: Names that the operators use within themselves.
NAMES = "h maybe m stratum spans cut row_id _host _left _boilerplate row id sha part key spread flag block bits cell host lines left gone boilerplate t0 t1 whole _gone hot_id n _salt _hot".split()
BIG = 2**60 + 1


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every odd name as a column, of ids beyond 2**53 beside nulls."""
    rng = random.Random(3)
    line, passage = "a line of every page", sentence(rng, 60)
    texts = [line + "\n" + sentence(rng, 70) + "\n" + passage for _ in range(6)] + [None, "", "x", sentence(rng, 50)]
    texts += [texts[-1], texts[0] + " end"]
    rows = [(BIG + i if i != 3 else None, t, "s", "en") for i, t in enumerate(texts)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    return df.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES]).cache()


def carried(df, docs):
    """Every row still has its own values in the odd columns."""
    rows = df.collect()
    assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    return rows


def test_columns_of_any_name_are_carried(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(BIG, 1), (None, 0)], "doc_id long, quality int")
    assert sum(r.kept for r in carried(exact_dedup.mark_exact_copies(odd), odd)) == 11
    for limit in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        assert sum(r.n_dropped for r in carried(line_dedup.drop_boilerplate(odd), odd)) > 8
    assert sum(r.n_removed for r in carried(substring_dedup.remove_repeats(odd), odd)) > 600
    for limit in (10_000, -1):
        monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", limit)
        assert sum(r.base_failed for r in carried(quality_rules.apply_rules(odd, labels), odd)) == 3
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and all(r.h == f"h-{'none' if r.doc_id is None else r.doc_id}" for r in kept.collect())
    toxic = spark.createDataFrame([(BIG, 0), (BIG + 1, 1)], "doc_id long, toxic int")
    carried(toxicity.score(odd, toxic), odd)


def test_large_ids_beside_nulls(spark, odd):
    ids = Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert Counter(r.doc_id for r in packing.pack(odd).collect()) == ids
    near = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(odd).collect()}
    assert set(near) == set(ids) and near[BIG + 10] == BIG + 9 and near[BIG + 11] == BIG and near[None] is None
    lowest = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (None, None), (5, "five")], "doc_id long, text string")
    rows = wavelet.digests(wavelet.write_shards(odd.select("doc_id", "text").unionByName(lowest))).orderBy("start").collect()
    assert [r.doc_id for r in rows][:4] == [None, None, None, -(2**63)] and Counter(r.doc_id for r in rows) == ids + Counter({None: 2, -(2**63): 1, 5: 1})


def test_settings_and_tables_are_left_as_they_were(spark, odd, tmp_path, monkeypatch):
    settings = lambda: [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", common._CLEANUP)]
    was = settings()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    jaccard_join.near_duplicates(odd).count()
    substring_dedup.remove_repeats(odd).count()
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["blocks", "near", "spans"]
    assert settings() == was


def test_exact_copies_in_parts(spark, odd, monkeypatch):
    want = sorted(map(repr, exact_dedup.mark_exact_copies(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 32)
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 32)
    assert -(-13 * exact_dedup.BITS_A_ROW // 32) > 2
    assert sorted(map(repr, exact_dedup.mark_exact_copies(odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_templates_of_any_number_and_length(spark, monkeypatch):
    rng = random.Random(8)
    templates = {f"t{i}": sentence(rng, rng.randrange(5, 40), 50_000) for i in range(60)} | {"long": sentence(rng, 5000, 50_000), "short": "MIT License", "none": " .. "}
    rows = [(i, f"{sentence(rng, 30)} {templates[name].upper()} {sentence(rng, 20)}") for i, name in enumerate(templates)]
    monkeypatch.setattr(license_scan, "ROUND_SHINGLES", 400)
    assert len(license_scan.rounds(templates)) > 3
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, r.license_id) for r in found if r.containment == 1.0} == {(i, name) for i, name in enumerate(templates) if name != "none"}
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0


def upper_bound(failures, trials, level):
    """Clopper-Pearson by exact sums and halving."""
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    for _ in range(50):
        p = (low + high) / 2
        tail = math.fsum(math.exp(math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(p) + (trials - i) * math.log1p(-p)) for i in range(failures + 1))
        low, high = (p, high) if tail > level else (low, p)
    return high


def test_quality_verdicts_from_the_definition(spark):
    """Cutoffs and verdicts on the driver's tables, computed again without the operator's tables."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    values, failed = {}, {}
    for r in rows:
        w, chars, symbols, dup, repeat, lines = quality_rules.metrics(r.text)
        values[r.doc_id] = {"symbol_ratio": symbols / chars if chars else 0, "dup_line_ratio": dup / lines if lines else 0, "repeat_ratio": repeat / w if w else 0, "mean_word_chars": chars / w if w else 0}
        failed[r.doc_id] = w < 50 or 100 * repeat > 50 * w
    held = defaultdict(list)
    for r in rows:
        if r.doc_id in good and not failed[r.doc_id]:
            held[r.lang].append(r.doc_id)
    rate, candidates = quality_rules.ALPHA / 4, sum(len(c) for _, c in quality_rules.RULES.values())
    enough = {s: ids for s, ids in held.items() if (1 - rate) ** len(ids) <= quality_rules.DELTA / candidates}
    level = quality_rules.DELTA / (candidates * max(1, len(enough)))
    cut = {s: {rule: next((c for c in cs if upper_bound(sum(values[i][rule] > c for i in ids), len(ids), level) <= rate), None) for rule, (_, cs) in quality_rules.RULES.items()} for s, ids in enough.items()}
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    for r in rows:
        over = any(c is not None and values[r.doc_id][rule] > c for rule, c in cut.get(r.lang, {}).items())
        assert got[r.doc_id] == (not failed[r.doc_id] and not over), r.doc_id


def test_toxic_texts_of_every_language(spark):
    """Held-out rows of the driver's labels."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hits, clean = defaultdict(list), []
    for r in scored:
        (hits[r.lang] if r.toxic else clean).append(r.predicted)
    print({k: (sum(v), len(v)) for k, v in hits.items()}, sum(clean), len(clean))
    every = [x for v in hits.values() for x in v]
    assert sum(every) / len(every) >= 0.9 and all(sum(v) / len(v) >= 0.8 for v in hits.values())
    assert sum(clean) / len(clean) <= 0.02


def test_candidates_grow_with_the_sets():
    """Unrelated sets that share common shingles: pairs by dense segments, twice as many sets give about twice as many."""
    rng = np.random.default_rng(4)
    common_shingles = rng.integers(0, 2**63, 3000).astype(np.uint64)

    def pairs(n):
        keys = Counter()
        for _ in range(n):
            own = rng.integers(0, 2**63, 300).astype(np.uint64)
            shared = rng.choice(common_shingles, 40, replace=False)
            for spare, found, counts in jaccard_join.segment_keys(np.unique(np.concatenate([own, shared]))):
                gone = jaccard_join.left_out(counts, np.zeros(len(counts), bool), np.zeros(1, np.int64), np.array([spare]))
                assert gone.sum() <= spare
                keys.update(found[~gone].tolist())
        return sum(k * (k - 1) // 2 for k in keys.values())

    assert pairs(1500) <= 30 and pairs(3000) <= 60


def test_left_out_keeps_a_shared_segment():
    rng = np.random.default_rng(6)
    for n in (30, 300, 2000):
        for percent in (80, 90):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(20):
                d = jaccard_join.most_different(n, n, percent) // 2
                b = np.unique(np.concatenate([a[rng.permutation(n)[d:]], rng.integers(0, 2**63, d).astype(np.uint64)]))
                kept = []
                for s in (a, b):
                    keys = {}
                    for spare, found, counts in jaccard_join.segment_keys(s, percent):
                        hot = found % np.uint64(11) == 0  # a property of the key alone
                        gone = jaccard_join.left_out(counts, hot, np.zeros(1, np.int64), np.array([spare]))
                        keys |= dict.fromkeys(found[~gone].tolist())
                    kept.append(set(keys))
                assert kept[0] & kept[1], (n, percent)


def test_long_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    for n, m in ((100, 90), (1000, 1100), (1020, 1030), (5000, 4000)):
        a, b = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        c = np.unique(np.concatenate([a[: n // 2], b[: m // 2]]))
        for x, y in ((a, b), (a, c), (b, c)):
            different = len(np.setxor1d(x, y))
            assert jaccard_join.sketch_distance(jaccard_join.long_sketch(x), jaccard_join.long_sketch(y)) <= different
    a, b = (np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2))
    assert jaccard_join.sketch_distance(jaccard_join.long_sketch(a), jaccard_join.long_sketch(b)) > jaccard_join.most_different(3000, 3000, 80)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, h string"
    passage = " ".join(f"p{i}" for i in range(50))
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None, None), (1, None, None, None, None, "a"), (2, "", "en", None, 0, "b"), (BIG, f"{passage} tail", "en", "s", 1, "c"), (None, f"head {passage}", None, "s", 1, None)])):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, kinds).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)


def test_hosts_of_pages(spark):
    rows = [("http://A.example/x", "a.example"), ("https://b.example:80/?q=1", "b.example"), ("no url", None), (None, None)]
    got = spark.createDataFrame(rows, "url string, host string").select("host", line_dedup.host_of(F.col("url")).alias("found")).collect()
    assert all(r.host == r.found for r in got)
