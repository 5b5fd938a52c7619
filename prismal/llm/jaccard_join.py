"""N-gram Jaccard join: parity sketches, pigeonhole joins of their segments in each size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, Scratch, arrow_slices, bitmap, fold, forget, hot_rows, in_bitmap, materialize, mixed, run_hashes, salted_join, skew_join, slices, word_hashes, words

#: Words in a shingle; two sets link if 100 * intersection >= PERCENT * union. Those of op9; other callers may give their own.
SHINGLE, PERCENT = 3, 90
#: A segment that more rows than this have is hot; rows of a block of a hot segment that are compared with another block.
HOT, BLOCK_ROWS = 32, 512
#: Lists over which a hot segment's sets are dealt.
LISTS = 16
#: A band's largest set is this many times its smallest. Bits of the short sketch, which is enough for sets of as many elements.
BAND_RATIO, SHORT_BITS = 1.5, 256
_SELF = ["s0", "s1", "n", "f0", "f1", "f2", "f3"]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    found = words(fold(text)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(found), min(shingle, len(found))))


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of two sets of these sizes that link: it is at most (1 - J) / (1 + J) of the sizes' sum."""
    return (100 - percent) * (a + b) // (100 + percent)


def band_of(n: int) -> tuple[int, int, int]:
    """(number, smallest, largest) of the size band; bands follow each other without gaps from size 1."""
    low, i = 1, 0
    while True:
        high = max(low, int(low * BAND_RATIO) - 1)
        if n <= high:
            return i, low, high
        low, i = high + 1, i + 1


def segments_of(largest: int, percent: int = PERCENT) -> tuple[int, int]:
    """Most elements in which linked sets differ whose lesser one is in the band, and segments of its sketches: more than that, and a quarter more."""
    d = most_different(largest, largest * 100 // percent, percent)
    return d, d + 1 + (d + 1) // 4


def sketch(shingles: np.ndarray, segments: int) -> np.ndarray:
    """Parity sketch of `segments` 64-bit words: each element flips one bit, so sketches differ in at most as many bits as sets in elements."""
    h = mixed(shingles + np.uint64(segments))
    out = np.zeros(segments, np.uint64)
    np.bitwise_xor.at(out, (h % np.uint64(segments)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58)))
    return out


def long_sketch(shingles: np.ndarray) -> np.ndarray:
    """A parity sketch of about as many bits as elements, a power of two of 64-bit words.

    The word is a hash's lowest bits, so a longer sketch folded in half, by xor, is the sketch of half the length.
    """
    size = 1 << (len(shingles) // 64).bit_length()
    h = mixed(shingles + np.uint64(1))
    out = np.zeros(size, np.uint64)
    np.bitwise_xor.at(out, (h & np.uint64(size - 1)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58)))
    return out


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Hamming distance of two long sketches, the longer one folded to the other's length."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _folded_rows(sketches: list[bytes], size: int) -> np.ndarray:
    """Long sketches of one length as the rows of a matrix, folded to `size` words."""
    rows = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while rows.shape[1] > size:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def sketches_near(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the long sketches of the pairs a[i], b[j], sets of na[i] and nb[j] elements, allow a link: see near_enough()."""
    out = np.maximum(na[i], nb[j]) <= SHORT_BITS
    lengths = [np.array([len(x) // 8 for x in side], np.int64) for side in (a, b)]
    for x in np.unique(lengths[0]):
        for y in np.unique(lengths[1]):
            at = np.flatnonzero((lengths[0][i] == x) & (lengths[1][j] == y) & ~out)
            if not len(at):
                continue
            of = [np.flatnonzero(own == z) for own, z in zip(lengths, (x, y), strict=True)]
            left, right = [_folded_rows([side[k] for k in rows], min(x, y)) for side, rows in zip((a, b), of, strict=True)]
            step = max(1, (1 << 18) // min(x, y))
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                differing = np.bitwise_count(left[np.searchsorted(of[0], i[part])] ^ right[np.searchsorted(of[1], j[part])]).sum(1, dtype=np.int64)
                out[part] = differing <= (100 - percent) * (na[i[part]] + nb[j[part]]) // (100 + percent)
    return out


def parities(shingles: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the parities of 64 bits of its elements' hashes, which is their xor, and how many elements it has."""
    h = mixed(shingles + np.uint64(segments))
    at = (h % np.uint64(segments)).astype(np.int64)
    out = np.zeros(segments, np.uint64)
    np.bitwise_xor.at(out, at, mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return out, np.bincount(at, minlength=segments)


def segment_keys(shingles: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(segments that may be left out, keys, elements in each) of the set's own band, and of the one below if a set there can link with it.

    A key is a hash of band, segment and its parities. Of two linked sets the lesser one's band has keys of both. They
    differ in at most d elements, so of k > d segments k - d at least hold none of these and are equal in both. Hence
    k - d - 1 may be left out of a set.
    """
    n, out = len(shingles), []
    own, low, high = band_of(n)
    bands = [(own, high)]
    while own and most_different(n, low - 1, percent) >= n - (low - 1) and 100 * (low - 1) >= percent * n:
        own, low, high = band_of(low - 1)
        bands.append((own, high))
    for band, largest in bands:
        d, k = segments_of(largest, percent)
        at = np.arange(k, dtype=np.uint64)
        found, counts = parities(shingles, k)
        out.append((k - d - 1, mixed(mixed(found + np.uint64(band << 32) + at) ^ at), counts))
    return out


def left_out(counts: np.ndarray, hot: np.ndarray, first: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Which segments sets leave out, by columns: elements, whether hot, where each band of a set starts, and how many it may leave out.

    All hot ones go, then those of the fewest elements, t at most, with the largest t for which there aren't more than
    `spare`; if there are more hot ones, nothing goes. Two linked sets that both leave some out still share one: the
    set with the larger t keeps a segment that is equal in both, which isn't hot and has more than t elements, so the
    other keeps it too. A set that leaves out nothing shares what the other keeps.
    """
    lengths = np.diff(np.append(first, len(counts)))
    out = np.zeros(len(counts), bool)
    for t in range(-1, int(counts.max(initial=0))):
        gone = hot | (counts <= t)
        fits = np.add.reduceat(gone.astype(np.int64), first) <= spare if len(first) else np.zeros(0, bool)
        if not fits.any():
            break
        out |= gone & np.repeat(fits, lengths)
    return out


def _fold_sketch(shingles: np.ndarray) -> list[int]:
    """A parity sketch of SHORT_BITS, to drop pairs by where they are found."""
    return sketch(shingles, SHORT_BITS // 64).astype(np.int64).tolist()


def _may_link(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether rows, by columns (set ids, size, fold sketch), may link: sizes, and bits that differ, allow it."""
    na, nb = a[2], b[2]
    differing = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.uint16) for x, y in zip(a[3:], b[3:], strict=True))
    fits = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (differing <= (100 - percent) * (na + nb) // (100 + percent))
    return fits & ((a[0] != b[0]) | (a[1] != b[1]))


_PAIR = "a0 long, a1 long, b0 long, b1 long, star long, n long"
_PAIR_COLUMNS = ["a0", "a1", "b0", "b1", "star", "n"]


def _ordered(a: np.ndarray, b: np.ndarray, star) -> np.ndarray:
    """Rows of _PAIR of rows of _SELF: the lesser set first; n is the larger size."""
    swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
    low, high = np.where(swap[:, None], b[:, :2], a[:, :2]), np.where(swap[:, None], a[:, :2], b[:, :2])
    star = np.broadcast_to(np.asarray(star, np.int64), len(a))
    return np.concatenate([low, high, star[:, None], np.maximum(a[:, 2], b[:, 2])[:, None]], 1)


def _cold_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a segment which isn't hot: HOT rows at most have it, which are compared with each other where they meet.

    star is 1 if one of the pair has the least set id there; most groups of near copies have the same one in most segments.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = pd.DataFrame()
        for batch in batches:
            held = pd.concat([rest, batch]) if len(rest) else batch
            cut = int(np.searchsorted(held.key.to_numpy(), held.key.iloc[-1])) if len(held) else 0
            rest, held = held.iloc[cut:], held.iloc[:cut]
            yield compare(held)
        yield compare(rest)

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 6), np.int64)]
        keys, values = (held.key.to_numpy(), held[_SELF].to_numpy(np.int64)) if len(held) else (np.zeros(0, np.int64), np.zeros((0, 7), np.int64))
        first, columns = np.concatenate([[True], keys[1:] != keys[:-1]]), list(np.ascontiguousarray(values.T))
        for step in range(1, len(keys)):  # rows of a key stand side by side, so at most HOT steps
            at = np.flatnonzero(keys[step:] == keys[:-step])
            if not len(at):
                break
            at = at[_may_link([c[at] for c in columns], [c[at + step] for c in columns], percent)]
            found.append(_ordered(values[at], values[at + step], first[at]))
        pairs = pd.DataFrame(np.concatenate(found), columns=_PAIR_COLUMNS)
        return pairs.groupby(["a0", "a1", "b0", "b1", "n"], as_index=False).star.max()[_PAIR_COLUMNS] if len(pairs) else pairs

    return rows.repartition("key").sortWithinPartitions("key", "s0", "s1").mapInPandas(run, _PAIR)


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a0", "a1", "b0", "b1").agg(F.max("star").alias("star"), F.max("n").alias("n"))


def _with_ends(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs with `column` of their two sets (s0, s1), as x and y. A set in very many pairs, as the middle of a group is, is dealt over several keys."""
    keyed = pairs.withColumn("a", F.struct("a0", "a1")).withColumn("b", F.struct("b0", "b1")).withColumn("_spread", F.xxhash64("a0", "b0"))
    end = lambda side, name: values.select(F.struct(F.col("s0").alias(f"{side}0"), F.col("s1").alias(f"{side}1")).alias(side), F.col(column).alias(name))
    hot = {side: hot_rows(keyed, side) for side in "ab"}  # of both ends, while rows are narrow
    out = salted_join(keyed, end("a", "x"), "a", "_spread", hot["a"])
    return salted_join(out, end("b", "y"), "b", "_spread", hot["b"]).drop("a", "b", "_spread")


def near_enough(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose parity sketches, of about as many bits as the sets have elements, don't differ in too many of them.

    The short sketch, a column where pairs are found, has told already for sets of up to SHORT_BITS elements; longer
    ones that have nothing in common differ in about half of its bits, which is within their limit. `nodes` has s0, s1,
    n and bits, an eighth of a byte for each element, so that few sets are read and sent to be verified.
    """

    @F.pandas_udf("boolean")
    def near(m: pd.Series, x: pd.Series, n: pd.Series, y: pd.Series) -> pd.Series:
        rows = zip(m, x, n, y, strict=True)
        return pd.Series([sketch_distance(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) <= most_different(p, q, percent) for p, a, q, b in rows], dtype=bool)

    large = pairs.filter(F.col("n") > SHORT_BITS)
    near_ones = _with_ends(large, nodes.select("s0", "s1", F.struct("n", "bits").alias("v")), "v").filter(near("x.n", "x.bits", "y.n", "y.bits"))
    return pairs.filter(F.col("n") <= SHORT_BITS).unionByName(near_ones.select(*pairs.columns))


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a0, a1, b0, b1) that link, by their sets (s0, s1, shingles)."""

    @F.pandas_udf("boolean")
    def links(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return _with_ends(pairs, sets, "shingles").filter(links("x", "y")).select("a0", "a1", "b0", "b1")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) reach.

    Labels spread to neighbours, and from the second round on jump to their labels' labels; each round is written. A
    node of a third of all edges, and a label that a whole group shares, are dealt over several keys.
    """
    with Scratch() as scratch:
        both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
        hot = hot_rows(both, "b")
        labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
        first = True
        while True:
            near = salted_join(both, labels.select(F.col("a").alias("b"), "label"), "b", "a", hot).groupBy("a").agg(F.min("label").alias("near"))
            step = materialize(labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
            scratch.discard(labels)
            if step.filter("label <> was").isEmpty():
                return materialize(step.select(F.col("a").alias("node"), F.col("label").alias("component")), "components", keep=True)
            if first:
                labels, first = step, False
                continue
            jumped = skew_join(step.drop("was"), step.select(F.col("a").alias("label"), F.col("label").alias("next")), "label", "a", "left")
            labels = materialize(jumped.select("a", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
            scratch.discard(step)


_MEMBERS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("s0", "s1", "f0", "f1", "f2", "f3")]]
    + [("bits", pa.binary()), ("keys", pa.list_(pa.int64())), ("elements", pa.list_(pa.int8())), ("lengths", pa.list_(pa.int32())), ("spare", pa.list_(pa.int32()))]
)
_MEMBER_KINDS = "doc_id long, n long, s0 long, s1 long, f0 long, f1 long, f2 long, f3 long, bits binary, keys array<long>, elements array<tinyint>, lengths array<int>, spare array<int>"


def _member(text: str | None, shingle: int, percent: int) -> tuple:
    """A row of _MEMBERS without its doc_id."""
    s = shingle_set(text, shingle)
    if not len(s):
        return 0, *[None] * 7, [], [], [], []
    bands = segment_keys(s, percent)
    keys, elements = np.concatenate([k for _, k, _ in bands]).astype(np.int64), np.concatenate([c for *_, c in bands])
    return len(s), *set_id(s), *_fold_sketch(s), long_sketch(s).tobytes(), keys, np.minimum(elements, 127).astype(np.int8), [len(k) for _, k, _ in bands], [spare for spare, *_ in bands]


class _Search:
    def __init__(self, docs: DataFrame, shingle: int, percent: int, scratch: Scratch):
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.shingle, self.percent, self.scratch = shingle, percent, scratch

    def members(self) -> DataFrame:
        """What the search needs of every document, in one pass over the texts: set id and size, sketches, and the segment keys of each band."""
        shingle, percent = self.shingle, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in arrow_slices(batches):
                columns = zip(*[_member(t, shingle, percent) for t in b.column("text").to_pylist()], strict=True)
                arrays = [pa.array(list(c), f.type) for c, f in zip(columns, list(_MEMBERS)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], schema=_MEMBERS)
            forget()  # workers live on, and the joins need the memory

        return materialize(self.docs.mapInArrow(run, _MEMBER_KINDS).withColumn("uid", F.monotonically_increasing_id()), "members", batch=TEXTS)

    def segments(self, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of segments that two sets have at least, and of hot ones."""
        counts = materialize(nodes.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1"), "segments")
        often = counts.filter(F.col("count") > HOT)
        found = bitmap(counts, "key", counts.count(), 8), bitmap(often, "key", often.count())
        self.scratch.discard(counts)
        return found

    def rows(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cold, hot) rows of segments that others may have and that the set doesn't leave out, see left_out().

        A set with more hot segments than it may leave out keeps them all, and the others too: it meets the sets that
        leave theirs out in cold segments, and those that don't in either.
        """
        sent = self.spark.sparkContext.broadcast(self.segments(nodes))
        names = ["key", *_SELF, "hot", "n_hot"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repeated, often = sent.value
            for b in arrow_slices(batches, 1024):
                flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
                keys, elements, lengths, spare = flat("keys"), flat("elements"), flat("lengths").astype(np.int64), flat("spare")
                twice = in_bitmap(repeated, keys)
                is_hot = in_bitmap(often, keys) & twice
                first = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[:-1]
                gone = left_out(elements, is_hot, first, spare)
                n_hot = np.add.reduceat(is_hot.astype(np.int64), first) if len(first) else first
                chosen = np.flatnonzero(twice & ~gone)
                band = np.repeat(np.arange(len(lengths)), lengths)[chosen]
                bands = np.array([len(x) for x in b.column("lengths").to_pylist()], np.int64)
                row = np.repeat(np.arange(b.num_rows), bands)[band]
                about = [b.column(c).to_numpy(zero_copy_only=False)[row] for c in _SELF]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys[chosen], *about, is_hot[chosen].astype(np.int64), n_hot[band])], names)

        once = materialize(nodes.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "rows", batch=TEXTS)  # a row has hundreds of keys
        return once.filter("hot = 0").select("key", *_SELF), once.filter("hot = 1").select("key", *_SELF, "n_hot")

    def sets(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(s0, s1, shingles) of the sets in pairs, from one document each."""
        wanted = pairs.select(F.col("a0").alias("s0"), F.col("a1").alias("s1")).unionByName(pairs.select(F.col("b0").alias("s0"), F.col("b1").alias("s1"))).distinct()
        wanted = materialize(wanted.join(classes, ["s0", "s1"]).select("s0", "s1", F.xxhash64("node").alias("h")), "wanted")
        sent, shingle = self.spark.sparkContext.broadcast(bitmap(wanted, "h", wanted.count())), self.shingle

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part in slices([b[in_bitmap(sent.value, b.h.to_numpy())]]):
                    sets = [s for t in part.text if len(s := shingle_set(t, shingle))]
                    yield pd.DataFrame([(*set_id(s), s.tobytes()) for s in sets], columns=["s0", "s1", "shingles"])
            forget()

        found = self.docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text").mapInPandas(run, "s0 long, s1 long, shingles binary")
        return materialize(found.join(wanted.select("s0", "s1"), ["s0", "s1"], "left_semi").dropDuplicates(["s0", "s1"]), "sets", batch=TEXTS)

    def linked(self, pairs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges (a, b) between the nodes of sets that link."""
        pairs = materialize(near_enough(pairs, nodes, self.percent), "near")
        sets = self.sets(pairs, classes)
        edges = materialize(verify(pairs, sets, self.percent), "verified", batch=TEXTS)
        self.scratch.discard(sets, pairs)
        return materialize(_with_ends(edges, classes, "node").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(members, classes, components)."""
        members, percent = self.members(), self.percent
        grouped = members.filter("s0 is not null and doc_id is not null").groupBy("s0", "s1")
        grouped = grouped.agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("size"))
        classes = materialize(grouped.select("s0", "s1", F.col("first.doc_id").alias("node"), F.col("first.uid").alias("uid"), "size"), "classes")
        # Copies go no further: the first row of a class stands for them.
        nodes = materialize(members.join(classes.select("uid"), "uid", "left_semi"), "nodes")
        wide, members = members, materialize(members.select("doc_id", "n", "s0", "s1"), "members")
        self.scratch.discard(wide)
        cold, hot = self.rows(nodes)
        # First one set of each group with all of it: in hot segments the middle, the set with most hot segments.
        me, middle = F.struct("n_hot", *_SELF), [F.col(f"m.{c}").alias(f"m_{c}") for c in _SELF]
        middles = materialize(hot.groupBy("key").agg(F.max(me).alias("m")).select("key", *middle), "middles")
        groups = self._groups(hot, middles)
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"m_{c}"))) for c in _SELF[3:]), F.lit(0))
        star = groups.filter("s0 <> m_s0 or s1 <> m_s1").filter(F.lit(100) * F.least("n", "m_n") >= F.lit(percent) * F.greatest("n", "m_n"))
        star = star.filter(bits <= F.floor((100 - percent) * (F.col("n") + F.col("m_n")) / (100 + percent)))
        swap = (F.col("s0") > F.col("m_s0")) | ((F.col("s0") == F.col("m_s0")) & (F.col("s1") > F.col("m_s1")))
        ends = [F.when(swap, F.col(f"m_{c}")).otherwise(F.col(c)).alias(f"a{c[1]}") for c in ("s0", "s1")] + [F.when(swap, F.col(c)).otherwise(F.col(f"m_{c}")).alias(f"b{c[1]}") for c in ("s0", "s1")]
        star = star.select(*ends, F.lit(1).cast("long").alias("star"), F.greatest("n", "m_n").alias("n"))
        pairs = materialize(_distinct_pairs(star.unionByName(_cold_pairs(cold, percent))), "pairs")
        links = self.linked(pairs.filter("star = 1"), classes, nodes)
        found = components(links)
        # Then all pairs that this leaves apart; in hot segments, sets apart from the middle with all that are apart from them.
        named = materialize(classes.join(found, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("c")), "named")
        rest = _with_ends(pairs.filter("star = 0"), named, "c").filter("x <> y").select(*_PAIR_COLUMNS)
        rest = materialize(_distinct_pairs(rest.unionByName(self._apart(hot, middles, named, nodes, groups))), "pairs")
        if not rest.isEmpty():
            found = components(links.unionByName(self.linked(rest, classes, nodes)))
        return members, classes, found

    def _groups(self, hot: DataFrame, middles: DataFrame) -> DataFrame:
        """(m_*, *_SELF): a middle and each set that shares a hot segment of its own with it, itself included, once.

        Most segments of a middle hold the same sets. A segment's sets meet the middle as LISTS lists at most, dealt by
        their ids, so that the join has a few rows for a segment, and nothing after it a row for each segment of a set.
        """
        lists = hot.groupBy("key", F.pmod(F.xxhash64("s0"), F.lit(LISTS)).cast("int").alias("list")).agg(F.collect_list(F.struct(*_SELF)).alias("sets"))
        ends = middles.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1))))
        met = lists.join(ends, ["key", "list"]).select(*[f"m_{c}" for c in _SELF], F.explode("sets").alias("s"))
        return materialize(met.select(*[f"m_{c}" for c in _SELF], "s.*").distinct(), "groups")

    def _apart(self, hot: DataFrame, middles: DataFrame, named: DataFrame, nodes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """Pairs of hot segments that star pairs leave apart, as far as their long sketches, which go along, allow a link.

        Segments of one middle are one group, see _groups(): most hold the same sets, whose pairs would be found in each of them.
        """
        percent, groups = self.percent, self._groups(hot, middles) if groups is None else groups
        names, middle = named.select(F.struct("s0", "s1").alias("s"), "c"), F.struct(F.col("m_s0").alias("s0"), F.col("m_s1").alias("s1"))
        ends = materialize(middles.select(middle.alias("s")).distinct().join(names, "s").select(F.col("s").alias("m"), F.col("c").alias("m_c")), "middle")
        groups = materialize(groups.select(middle.alias("m"), F.struct("s0", "s1").alias("s")).join(names, "s"), "groups")
        hot_middles = hot_rows(groups, "m")
        groups = salted_join(groups, ends, "m", "s", hot_middles).withColumn("apart", F.col("c") != F.col("m_c"))
        groups = materialize(groups.select("m", "s", "c", "apart"), "apart")
        # Only groups where a set is apart from the middle go on, so those that link as a whole end here, as narrow rows.
        counts = groups.groupBy("m").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("apart").cast("int")).alias("some")).filter("some > 0")
        blocks = materialize(counts.select("m", *[F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(c) for c in ("all", "some")]), "blocks")
        about = nodes.select(F.struct("s0", "s1").alias("s"), *_SELF, "bits")
        rows = materialize(salted_join(groups, blocks, "m", "s", hot_middles).join(about, "s"), "hot")
        at = lambda n: F.pmod(F.xxhash64("s1", "s0"), F.col(n)).cast("int")
        # Block i of all rows meets block j of those apart.
        left = rows.select("*", at("all").alias("i"), F.explode(F.sequence(F.lit(0), F.col("some") - 1)).alias("j")).withColumn("side", F.lit(0))
        right = rows.filter("apart").select("*", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("i"), at("some").alias("j")).withColumn("side", F.lit(1))
        met = left.unionByName(right).select("m", "i", "j", "side", "c", "bits", *_SELF)

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            values, c, side = rows[_SELF].to_numpy(np.int64), rows.c.to_numpy(), rows.side.to_numpy()
            a, b = values[side == 0], values[side == 1]
            bits = [rows.bits[side == k].tolist() for k in (0, 1)]
            i, j = np.nonzero(_may_link([x[:, None] for x in a.T], [x[None] for x in b.T], percent) & (c[side == 0][:, None] != c[side == 1][None]))
            near = sketches_near(*bits, a[:, 2], b[:, 2], i, j, percent)
            return pd.DataFrame(_ordered(a[i[near]], b[j[near]], 0), columns=_PAIR_COLUMNS)

        return met.groupBy("m", "i", "j").applyInPandas(compare, _PAIR)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    A set is the distinct shingles (of `shingle` words) of the text in lower case (A-Z); a text with fewer words is one
    shingle, one without words has none and links with nothing, and its component is itself. Sets link if their Jaccard
    index is `percent` / 100 at least. component_id is the smallest
    doc_id that links reach. Rows with the same doc_id are one node with the links of each; a null id links with
    nothing and has a null component. Repeated rows repeat; an empty table gives an empty one; extra columns are dropped.

    Equal sets are one class from the start (by a 128-bit hash; shingles are 64-bit hashes), so copies cost a row.
    Of classes that share a segment, at most HOT are compared in one place; larger groups first go by their
    middle, and only what that leaves apart is compared with the rest, in blocks of bounded size.
    """
    with Scratch() as scratch:
        members, classes, found = _Search(docs, shingle, percent, scratch).run()
        named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = materialize(named.filter("size > 1 or component <> node").select(F.struct("s0", "s1").alias("s"), "component"), "named")
        # A row without a set has a key of its own, which nothing matches.
        own = F.struct(F.coalesce("s0", F.xxhash64("doc_id")).alias("s0"), F.coalesce("s1", F.lit(0).cast("long")).alias("s1"))
        keyed = members.withColumn("s", own).withColumn("_spread", F.xxhash64("doc_id"))
        out = skew_join(keyed, named, "s", "_spread", "left")
        mine = F.when(F.col("doc_id").isNotNull() & F.col("s0").isNotNull(), F.col("component"))
        return materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(mine, "doc_id").alias("component_id")), "near", keep=True)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; null ids stay, and so do all columns."""
    with Scratch():
        gone = near_duplicates(docs, shingle, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
        gone = materialize(gone, "gone", keep=True)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.a GROUP BY d.doc_id
"""
