import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.llm import exact_dedup, jaccard_join, license_scan, line_dedup, quality_rules, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, source string, n_lines string, kept string"


def upper_fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Nulls, empties, long texts, copies, near copies, shared lines and passages, repeated rows."""
    rng = random.Random(7)
    long, passage, line = sentence(rng, 9000), sentence(rng, 60), "The Same Line Of Every Page"
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "One"), (4, "one"), (5, "Straße É one"), (6, "straße É one"), (7, long), (8, long + " end"), (9, None), (10, "two words"), (11, "TWO words"), (None, "two words"), (12, "x\x85y x\x1cz a")]
    rows += [(20 + i, line + "\n" + sentence(rng, 30 + i) + ("\n" + passage if i % 3 == 0 else "")) for i in range(30)]
    base = sentence(rng, 300).split()
    for i in range(45):  # over HOT near copies, some too far from the middle
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, "copy of " + passage.upper() if i % 2 else "copy of " + passage) for i in range(12)]
    rows += [rows[-1], rows[25], rows[25]]
    return [(d, t, f"s{(d or 0) % 2}" if d != 21 else None, "x", "y") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(5).cache()


def test_exact_copies(docs):
    rows = exact_dedup.mark_exact_copies(docs).collect()
    groups = defaultdict(list)
    for r in corpus():
        groups[upper_fold(r[1])].append(r[0])
    assert len(rows) == len(corpus())
    for r in rows:
        ids = groups[upper_fold(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(upper_fold(r.text).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert exact_dedup.mark_exact_copies(docs.limit(0)).count() == 0


def test_small_filters_lose_nothing(spark, docs, monkeypatch):
    want = sorted(exact_dedup.mark_exact_copies(docs).select("text_sha256", "group_size").collect())
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 32768)
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    assert sorted(exact_dedup.mark_exact_copies(docs).select("text_sha256", "group_size").collect()) == want


def lines_by_hand(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, text, host, *_ in rows:
        if host is not None:
            pages[host] += 1
            seen.update({(host, x) for x in (text or "").split("\n") if WORD.search(x)})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for d, text, host, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if (host, x) not in bad]
        out.append((d, "\n".join(left) if len(left) < len(lines) else text, len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_lines(docs, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    got = line_dedup.drop_boilerplate(docs, ratio=0.1, min_pages=5)
    assert got.columns == ["doc_id", "text", "source", "kept", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == lines_by_hand(corpus(), 0.1, 5)
    assert got.agg(F.sum("n_dropped")).first()[0] > 20
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def repeats_by_hand(rows, n=35):
    seen, found = Counter(), [WORD.findall(t or "") for _, t, *_ in rows]
    for w in found:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for w in found:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append(([x for i, x in enumerate(w) if i not in gone], len(gone)))
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_substrings(docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    want = sorted(((d, " ".join(k), n) for (d, *_), (k, n) in zip(corpus(), repeats_by_hand(corpus()), strict=True)), key=repr)
    assert sorted(((r.doc_id, " ".join(WORD.findall(r.text or "")), r.n_removed) for r in got.collect()), key=repr) == want
    assert sum(n for *_, n in want) > 1000
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_automaton():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        weights = [rng.randrange(1, 4) for _ in texts]
        a = substring_dedup.SuffixAutomaton()
        for t, w in zip(texts, weights, strict=True):
            a.add(t, w)
        a.finish()
        for t in texts:
            for end, (matched, n) in enumerate(a.matching(t, 3)):
                assert matched == min(3, end + 1)
                part = t[end + 1 - matched : end + 1]
                assert n == sum(w * sum(x[i : i + matched] == part for i in range(len(x))) for x, w in zip(texts, weights, strict=True))


def sets_by_hand(text, k=3):
    w = WORD.findall(upper_fold(text))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components_by_hand(rows, k=3, percent=90):
    nodes = defaultdict(list)
    for d, t, *_ in rows:
        if d is not None:
            nodes[d].append(sets_by_hand(t, k))
    root = {d: d for d in nodes}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in nodes[a] for y in nodes[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in nodes}


@pytest.mark.parametrize("hot", [32, 4])
def test_near_copies(docs, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == len(corpus())
    want = components_by_hand(corpus())
    assert len(set(want.values())) < len(want) - 30
    sizes = Counter((d, len(sets_by_hand(t))) for d, t, *_ in corpus())
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == sizes
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_other_shingles(spark):
    """Five words and 0.8 link what three words and 0.9 leave apart, by brute force."""
    rng, rows = random.Random(17), [(900, "one two three four"), (901, "One two three four"), (902, "one two"), (903, None)]
    for g in range(6):
        base = sentence(rng, rng.randrange(60, 400)).split()
        for i in range(9):
            w = list(base)
            for _ in range(len(base) * i // 200):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))

    def components(k, percent):
        sets, root = {}, {d: d for d, _ in rows}
        for d, t in rows:
            w = WORD.findall(upper_fold(t))
            sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
        for a in sorted(sets):
            for b in sorted(sets):
                if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
        return root

    want = components(5, 80)
    assert want != components(3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, 5, 80).collect()} == want
    assert {r.doc_id for r in jaccard_join.keep_one(docs, shingle=5, percent=80).collect()} == {d for d, c in want.items() if d == c}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 40, 300, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for d in (0, 1, n // 12, n // 3):
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**63, d).astype(np.uint64)]))
            union = len(np.union1d(a, b))
            both = len(np.intersect1d(a, b))
            differ = sum(int(x).bit_count() for x in (jaccard_join.sketch(a, 4) ^ jaccard_join.sketch(b, 4)))
            assert differ <= union - both
            if 100 * both >= 90 * union:
                x, y = (np.concatenate([k for _, k, _ in jaccard_join.segment_keys(s)]) for s in (a, b))
                assert len(np.intersect1d(x, y))


def shingles_of(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def test_licenses(spark):
    rng = random.Random(11)
    templates = license_scan.TEMPLATES
    rows = [(0, None), (1, ""), (2, "MIT License"), (3, sentence(rng, 400))]
    exact = {}
    for i, (name, notice) in enumerate(templates.items()):
        rows.append((10 + i, f"{sentence(rng, 70)}. {notice.upper()}!\n{sentence(rng, 3 + i)}"))
        exact[10 + i] = name
    long = templates["gpl-header"].split()
    rows.append((900, sentence(rng, 50) + " " + " ".join(long[:20] + ["really"] + long[20:]) + " " + sentence(rng, 9)))
    rows.append((901, " ".join(long[:20]) + " " + sentence(rng, 80)))
    rows += [rows[-2]]
    found = {(r.doc_id, r.license_id): r for r in license_scan.scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license_id string")).collect()}
    for doc_id, name in exact.items():
        assert found[doc_id, name].containment == 1.0
    assert 0.8 <= found[900, "gpl-header"].containment < 1 and (901, "gpl-header") not in found
    want = {(d, k) for d, t in rows for k, v in templates.items() if len(set(shingles_of(v)) & set(shingles_of(t))) >= 0.8 * len(set(shingles_of(v)))}
    assert set(found) == want
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert license_scan.collision_probability(0.25) > 0.998
    short = license_scan.scan(spark.createDataFrame([*rows, (902, "of Two, words!")], "doc_id long, text string"), {"short": "two words"}).collect()
    assert [(r.doc_id, r.license_id, r.containment, r.n_shingles) for r in short] == [(902, "short", 1.0, 1)]


def metrics_by_hand(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_metrics():
    rng = random.Random(2)
    texts = [t for _, t, *_ in corpus()] + [" ".join(rng.choice("ab#") for _ in range(n)) for n in range(60)] + ["a b c\na b c\n\na b c", "a a a a", "##\n##\n$|<>"]
    for t in texts:
        assert quality_rules.metrics(t) == metrics_by_hand(t), t


def test_binomial_bound():
    for k, n, level in ((0, 50, 0.01), (3, 200, 0.05), (40, 90, 0.001)):
        p = quality_rules.binomial_upper(k, n, level)
        from math import comb

        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level, rel=1e-6)
    assert quality_rules.binomial_upper(5, 5, 0.1) == 1.0


def test_quality_cutoffs(spark):
    rng = random.Random(4)
    good = [(i, sentence(rng, 60), "en") for i in range(2500)]
    bad = [(5000 + i, " ".join(w + "%%%" for w in sentence(rng, 60).split()), "en") for i in range(50)]
    rows = [*good, *bad, (9000, None, None), (9001, "a # b " * 40, "rare"), (9002, "", "en"), good[0]]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    labels = spark.createDataFrame([(r[0], 1 if r[0] < 5000 else 0) for r in [*good, *bad]] + [(None, 1), (77777, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert len(out) == len(rows) - 1
    assert all(out[r[0]].kept for r in good) and not any(out[r[0]].kept for r in bad)
    assert out[9000].base_failed and not out[9002].kept
    measured = quality_rules.measure(docs)
    cut = quality_rules.select_cutoffs(measured, labels)
    assert set(cut.of) == {"en"} and all(b <= quality_rules.ALPHA / 4 for b in cut.bounds["en"].values())
    assert quality_rules.select_cutoffs(measured, labels.limit(50)).of == {}
    assert quality_rules.apply_rules(docs.limit(0), labels).count() == 0


def toxic_rows():
    rng = random.Random(6)
    rows = [(i, sentence(rng, 80)) for i in range(600)]
    insults = ["idiot", "moron", "scum", "l0ser", "st*pid", "pathetic"]
    for i in range(600, 900):
        w = sentence(rng, 80).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "you " + rng.choice(insults[:4]))
        rows.append((i, " ".join(w)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, (5000, None), (5001, ""), (None, "you idiot"), rows[0]]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, int(d >= 600)) for d, _ in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows) + 4
    import zlib

    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in [*rows, (5000, 0), (5001, 0)] if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [r.predicted == int(r.doc_id >= 600) for r in held if r.doc_id < 5000]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    # The labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in out)
    assert toxicity.score(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == ["doc_id", "text", "score"]


def test_signs_for_letters_at_the_edges():
    at = dict(zip(toxicity.FEATURES, range(len(toxicity.FEATURES)), strict=True))
    for word, kind in (("$tupid", "insult_density"), ("!diot", "insult_density"), ("@sshole", "profanity_density"), ("$cum,", "insult_density"), ("$hit", "profanity_density"), ("fuck|ng", "profanity_density"), ("asSshole", "profanity_density")):
        x = toxicity.features(f"well you {word}")
        assert x[at[kind]] == x[at["obfuscated"]] == 1 / 3, word
    assert toxicity.features("you !diot")[at["near_you"]] == 0.5
    assert not toxicity.features("wow! $5 @home |x| tupid")[at["obfuscated"]]


def test_isotonic():
    f = toxicity.Isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert f(np.array([0.0, 1, 2, 3, 4, 9])).tolist() == [0, 0, 0.5, 0.5, 1, 1]


def check_packing(rows, texts):
    """Every id of every text stands in one place, sequences have no gaps and at most 2048 ids; ids are the library's."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, s, min(2048, len(ids) - s)) for i, s in enumerate(range(0, len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
        total += len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert -(-total // 2048) <= len(sequences) <= 1.1 * total / 2048 + 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:3] for r in corpus() if r[0] is not None and not (r[0] == 25 or r[0] == 211)] + [(d + 10_000, t, "s9") for d, t in toxic_rows()]
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in dict((r[0], r) for r in rows).values()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d + 10_000, int(d >= 600)) for d, _ in toxic_rows()], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, columns = None, None
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        columns = columns or docs.columns
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "toxicity":
            kept = [tuple(r) for r in docs.collect()]
            toxic = {d + 10_000 for d, _ in toxic_rows() if d >= 600}
            assert len(toxic & {r[0] for r in kept}) < 10 and len({r[0] for r in kept} - toxic) >= 0.98 * (len(rows) - len(toxic))
    # By hand, from what the classifier kept.
    hand = [(d, t, s) for (d, t, _, _), (_, _, _, s, _) in zip(lines_by_hand([(d, t, s) for d, t, _, s, _ in kept], line_dedup.RATIO, line_dedup.MIN_PAGES), sorted(kept, key=lambda r: repr(r[:1])), strict=True)]
    component = components_by_hand(hand, 5, 80)
    hand = [(d, t) for d, t, _ in hand if component[d] == d]
    hand = sorted((d, " ".join(k)) for (d, _), (k, _) in zip(hand, repeats_by_hand(hand), strict=True))
    assert sorted((r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in docs.collect()) == hand
    final = corpus_pipeline.run(spark, str(tmp_path))
    check_packing(final.collect(), dict(hand))
