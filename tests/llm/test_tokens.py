import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prismal.llm import packing, piece_bpe, wavelet, word_bpe

TEXT = st.text(st.one_of(st.sampled_from("abcAB  \n\t'.,!1é ñÇ▁</s>|"), st.characters(exclude_categories=["Cs"])), max_size=60)
ODD = [None, "", " ", "   ", "\n\n", "a  b   c", "▁", "▁▁ a", "it's DON'T", "<|endoftext|> a<|startoftext|>b", "ÀÉî œuvre", "é á", "x\x85y\xa0z\x1cw", "naïve café", "ΑΣ ΟΔΟΣ", "İstanbul", "漢字 かな 🜁🜁", "\x00\x01", "</s>", "<0x41>", "aaaaaaaaaaaa", "!!!! ... ????", "  \n  indented\n\tx"]


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.default_path())


@pytest.fixture(scope="module")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]


def word_ids(text):
    return np.frombuffer(word_bpe.encoder(word_bpe.default_path()).encode(text), "<u4").tolist()


def test_words_are_encoded_as_the_library_does(spark, word_library):
    for text in ODD + corpus(spark):
        assert word_ids(text) == word_library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_any_words(text):
    from tokenizers import Tokenizer

    library = test_any_words.__dict__.setdefault("library", Tokenizer.from_file(word_bpe.default_path()))
    assert word_ids(text) == library.encode(text, add_special_tokens=False).ids


def same_pieces(library, text):
    own, ids = piece_bpe.encoder(piece_bpe.default_path()), library.encode(text or "")
    assert own.encode(text) == ids, text
    assert own.decode(ids) == library.decode(ids), text
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert own.digest(text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_are_encoded_and_decoded_as_the_library_does(spark, piece_library):
    for text in ODD + corpus(spark):
        same_pieces(piece_library, text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_pieces(text):
    import sentencepiece

    library = test_any_pieces.__dict__.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path()))
    same_pieces(library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=20))
def test_any_ids_decode(ids):
    import sentencepiece

    library = test_any_ids_decode.__dict__.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path()))
    assert piece_bpe.encoder(piece_bpe.default_path()).decode(ids) == library.decode(ids)


def test_pieces_of_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "y")], "doc_id long, text string, piece_ids string")
    rows = piece_bpe.decode(piece_bpe.encode(docs.drop("piece_ids"))).collect()
    assert sorted(r.decoded for r in rows) == ["", "", "a b", "a b"]
    assert piece_bpe.digests(docs).count() == 4
    assert piece_bpe.digests(docs.limit(0)).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 49408, 5000).astype(np.uint32)
    ids[::7] = 5
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.array([3, 9]), np.array([2000, 3000])))
    assert m.ids().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for token in (5, int(ids[1]), 49407, 70000):
        where = np.flatnonzero(ids == token).tolist()
        assert m.count(token) == len(where)
        assert m.locate(token)[:50] == where[:50] if len(where) < 60 else [m.select(token, k) for k in (0, 1, len(where) - 1)] == [where[0], where[1], where[-1]]
    assert m.count(5, 700) == int((ids[:700] == 5).sum())
    many = np.arange(600_000, dtype=np.uint32) % 11
    m = wavelet.WaveletMatrix(wavelet.build(many, np.array([1]), np.array([len(many)])))
    assert (m.ids() == many).all() and m.access(599_999) == many[-1] and m.select(3, 50_000) == 3 + 11 * 50_000
    empty = wavelet.WaveletMatrix(wavelet.build(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)))
    assert empty.n == 0 and not len(empty.ids())


def test_shards_give_back_every_document(spark, word_library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "same"), (10**6 + 2, "same"), (-5, "word " * 9000)], docs.schema)
    docs = docs.unionByName(more)
    shards = wavelet.write_shards(docs, shard_ids=5000)
    rows = sorted(wavelet.digests(shards).collect())
    start = 0
    for row, doc in zip(rows, sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")), strict=True):
        ids = [*word_library.encode(doc.text or "", add_special_tokens=False).ids, 1]
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert shards.count() > 10
    assert wavelet.digests(wavelet.write_shards(docs.limit(0))).count() == 0


def fits(packed, capacity):
    for rows in packed.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing(spark, word_library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("lang", "length")
    more = spark.createDataFrame([(10**6, None, "x", "y", 0), (10**6, None, "x", "y", 0), (10**6 + 1, "", "x", "y", 0)], docs.schema)
    docs = docs.unionByName(more)
    packed = packing.pack(docs)
    rows = packed.collect()
    by, placed = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    fits(placed, 2048)
    for d in docs.collect():
        ids = np.array([*word_library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = sorted(by[d.doc_id], key=lambda r: r.piece)
        if d.doc_id != 10**6:
            assert b"".join(bytes(r.ids) for r in got) == ids
            assert [r.start for r in got] == [2048 * i for i in range(len(got))]
    total = sum(r.length for r in rows)
    assert len(placed) <= 1.02 * -(-total // 2048) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * total
    assert packing.pack(docs.limit(0)).count() == 0


def optimum(sizes, capacity):
    best, order = len(sizes), sorted(sizes, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= order[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - order[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - order[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    counts = np.bincount(sizes, minlength=21)
    fixed = packing.reduce_instance(counts, 20)
    rest = np.repeat(np.arange(21), counts).tolist()
    assert sum(b.count for b in fixed) + optimum(rest, 20) == optimum(sizes, 20)
    plan = packing.plan(dict(zip(*map(list, np.unique(sizes, return_counts=True)), strict=True)), 20)
    placed = {}
    for r in plan.itertuples():
        for k in range(r.high - r.low):
            placed.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    fits(placed, 20)
    assert sorted(x for rows in placed.values() for _, x in rows) == sorted(sizes)


def test_words_with_added_tokens_and_batches_are_encoded_as_the_library_does(word_library, monkeypatch):
    texts = ["a <|endoftext|>, b", "x<|startoftext|>y", None, "", " \t", "(Über) it's 12 \x85 é", "<|EndOfText|>", "word " * 50]
    wanted = [word_library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(word_bpe, "BATCH_BYTES", size)
        found = word_bpe.encoder(word_bpe.default_path()).encode_all(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == wanted
