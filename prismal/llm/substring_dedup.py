"""Substring dedup: suffix automata of reference shards give matching statistics; repeated spans are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, TEXTS, Scratch, arrow_slices, bitmap, flagged, in_bitmap, materialize, run_hashes, salted_join, skew_join, slices, word_hashes, words

#: Words of a window, and of an anchor in it. Anchors in more places than HOT are not kept together. Words of a shard's automaton.
LENGTH, ANCHOR, HOT, SHARD_WORDS = 35, 12, 1000, 50_000


class SuffixAutomaton:
    """Of several weighted sequences; a state's count is the weight of all places where its words end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, state: int, word: int, old: int) -> int:
        """A state of its own for what `state` and `word` spell, taken from the longer `old`."""
        following, length = self.next, self.length[state] + 1
        if self.length[old] == length:
            return old
        new = self._new(length, self.link[old], following[old].copy())
        self.link[old] = new
        while state >= 0 and following[state].get(word) == old:
            following[state][word] = new
            state = self.link[state]
        return new

    def add(self, sequence: list[int], weight: int = 1) -> None:
        following, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for word in sequence:
            old = following[last].get(word)
            if old is not None:
                last = old if length[old] == length[last] + 1 else self._split(last, word, old)
            else:
                new = len(link)
                following.append({})
                length.append(length[last] + 1)
                count.append(0)
                link.append(0)
                while last >= 0:
                    after = following[last]
                    if word in after:
                        link[new] = self._split(last, word, after[word])
                        break
                    after[word] = new
                    last = link[last]
                last = new
            count[last] += weight

    def finish(self) -> None:
        """Adds each state's count to the state of its longest shorter ending."""
        count, link = self.count, self.link
        for state in np.argsort(np.array(self.length))[:0:-1].tolist():  # but the first, which alone has length 0
            count[link[state]] += count[state]

    def matching(self, sequence: list[int], length: int) -> list[tuple[int, int]]:
        """For each place: how many words before its end match, up to length, and how often those occur."""
        following, link, lengths, count, out = self.next, self.link, self.length, self.count, []
        state = matched = 0
        for word in sequence:
            after = following[state].get(word)
            while after is None and state:
                state = link[state]
                matched = lengths[state]
                after = following[state].get(word)
            if after is not None:
                state = after
                if matched < length:
                    matched += 1
            if matched == length:
                while lengths[link[state]] >= length:
                    state = link[state]
            out.append((matched, count[state]))
        return out

    def repeated(self, sequence: list[int], length: int) -> list[int]:
        """The places of matching() where `length` words match that occur twice at least."""
        following, link, lengths, count, out = self.next, self.link, self.length, self.count, []
        state = matched = 0
        for end, word in enumerate(sequence):
            after = following[state].get(word)
            while after is None and state:
                state = link[state]
                matched = lengths[state]
                after = following[state].get(word)
            if after is not None:
                state = after
                if matched < length:
                    matched += 1
                if matched == length:
                    while lengths[link[state]] >= length:
                        state = link[state]
                    if count[state] > 1:
                        out.append(end)
        return out


def anchors(hashes: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words, where its anchor is: the run of `anchor` words with the least hash, leftmost. And the hashes of all runs.

    It depends on the window's words alone, so equal windows have equal anchors; it never moves back.
    """
    grams = run_hashes(hashes, anchor)
    if len(hashes) < length:
        return np.zeros(0, np.int64), grams
    # The least of 1, 2, 4 ... runs from each on, and where it is; of equal ones the left one.
    least, at, runs, size = grams, np.arange(len(grams)), length - anchor + 1, 1
    while size < runs:
        step = min(size, runs - size)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        size += step
    return at, grams


def _fragments(found: list[str], keys: np.ndarray, first: np.ndarray, chosen: np.ndarray, is_hot: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(key, first word, words) of the parts of a text that may hold a repeated window.

    The windows of one anchor stand side by side; the words they cover are a fragment, whose key is the anchor.
    Where an anchor is hot, each window is a fragment, and its own hash the key.
    """
    last = np.append(first[1:], len(found) - LENGTH + 1) - 1
    whole = run_hashes(word_hashes(found), LENGTH).astype(np.int64) if is_hot[chosen].any() else None
    for j in chosen:
        if is_hot[j]:
            for at in range(first[j], last[j] + 1):
                yield int(whole[at]), at, " ".join(found[at : at + LENGTH])
        else:
            yield int(keys[j]), int(first[j]), " ".join(found[first[j] : last[j] + LENGTH])


def repeated_windows(shard: list[tuple[bytes, str, int]]) -> Iterator[tuple[bytes, list[dict[str, int]]]]:
    """For (id, words, how often it stands in the input): runs of first words of windows that occur twice or more in all."""
    codes: dict[str, int] = {}
    sequences = [[codes.setdefault(w, len(codes)) for w in text.split(" ")] for _, text, _ in shard]
    automaton = SuffixAutomaton()
    for sequence, (_, _, n) in zip(sequences, shard, strict=True):
        automaton.add(sequence, n)
    automaton.finish()
    for sequence, (fid, _, _) in zip(sequences, shard, strict=True):
        runs: list[dict[str, int]] = []
        for end in automaton.repeated(sequence, LENGTH):
            at = end - LENGTH + 1
            if runs and runs[-1]["last"] == at - 1:
                runs[-1]["last"] = at
            else:
                runs.append({"first": at, "last": at})
        if runs:
            yield fid, runs


def text_id(text: Column) -> Column:
    """128 bits of a text's SHA-256, as two longs; null counts as empty."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return F.struct(part(1).alias("t0"), part(17).alias("t1"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, whole, spans) of texts that hold a repeated window, by the text_id() of docs' `text`; and ids that hold a large share of the rows.

    whole: another row has the same text, so all of it goes. Else a span's first and last are the first words of windows.

    Spreading whole automata over all documents would take time with the square of the input. A window's
    anchor says which shard can hold it, so fragments go to the shard of their anchor, and only there:

    1. One pass over the texts writes those of a window at least, with their anchors. Anchors that stand in two different
       texts, or twice in one, are counted; those of exact copies alone need no more. What may be repeated, and
       what occurs more than HOT times, is sent round as bitmaps of bounded size; a false hit only costs work.
    2. Fragments around repeated anchors are written, and equal ones counted together before they shuffle.
    3. A task builds the automata of its shards one after the other, each of whole anchors' fragments, at most
       HOT of them for an anchor, and streams the same fragments through it.
    4. Spans go back to every text of their fragment; fragments in very many texts are dealt over several keys.
    """
    spark = docs.sparkSession

    def with_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_slices(batches):
            rows, keep = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                where, grams = anchors(word_hashes(words(text)))
                if len(where):
                    first = np.flatnonzero(np.diff(where, prepend=-1))
                    keys = grams[where[first]].astype(np.int64)
                    once, n = np.unique(keys, return_counts=True)
                    keep.append(i)
                    rows.append((text, keys, first.astype(np.int32), once, once[n > 1]))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            ids = [b.column(c).take(pa.array(keep, pa.int64())) for c in ("t0", "t1")]
            yield pa.RecordBatch.from_arrays([*ids, *columns], ["t0", "t1", "text", "anchors", "firsts", "once", "doubled"])

    texts = docs.select(text_id(F.col("text")).alias("t"), "text").select("t.*", "text")
    texts = texts.mapInArrow(with_anchors, "t0 long, t1 long, text string, anchors array<long>, firsts array<int>, once array<long>, doubled array<long>")
    with Scratch() as scratch:
        texts = materialize(texts, "texts", codec="zstd", batch=TEXTS)
        # An anchor that stands twice in one text counts as if in two.
        places = texts.select(F.explode("once").alias("anchor"), F.col("t0").alias("t")).unionByName(texts.select(F.explode("doubled").alias("anchor"), F.col("t0").bitwiseXOR(F.lit(1)).alias("t")))
        counts = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).filter("low <> high")
        counts = materialize(counts.select("anchor", "n"), "anchors")
        often = counts.filter(F.col("n") > HOT)
        sent = spark.sparkContext.broadcast((bitmap(counts, "anchor", counts.count()), bitmap(often, "anchor", often.count())))
        scratch.discard(counts)

        def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            repeated, hot = sent.value
            names, seen = ["key", "fid", "t0", "t1", "at", "part"], set()
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            for b in arrow_slices(batches):
                rows: list[tuple] = []
                keys, lists = b.column("anchors").flatten().to_numpy(), b.column("anchors")
                may, is_hot, at = in_bitmap(repeated, keys), in_bitmap(hot, keys), 0
                firsts = b.column("firsts").flatten().to_numpy()
                ids = list(zip(b.column("t0").to_pylist(), b.column("t1").to_pylist(), strict=True))
                for i, n in enumerate(lists.value_lengths().to_pylist()):
                    own = slice(at, at + n)
                    at += n
                    if not len(chosen := np.flatnonzero(may[own])):
                        continue
                    for key, first, part in _fragments(words(b.column("text")[i].as_py()), keys[own], firsts[own], chosen, is_hot[own]):
                        fid = xxhash.xxh3_128_digest(part)
                        # A task sends the words of a fragment once, as far as it remembers.
                        rows.append((key, fid, *ids[i], first, None if fid in seen else part))
                        seen.add(fid)
                    if len(seen) > 200_000:
                        seen.clear()
                    if len(rows) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        parts = texts.select("t0", "t1", "text", "anchors", "firsts").mapInArrow(fragments, "key long, fid binary, t0 long, t1 long, at int, part string")
        parts = materialize(parts, "fragments", batch=TEXTS)
        copies = materialize(texts.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t0", "t1", F.lit(True).alias("whole"), "n"), "copies")
        # Under HOT_SHARE of these can exist, so they may be collected.
        often = copies.filter(F.col("n") > max(HOT_ROWS, texts.count() // HOT_SHARE)).select(F.struct("t0", "t1").alias("id"))
        hot_ids = spark.createDataFrame(rows, often.schema) if (rows := often.collect()) else None
        scratch.discard(texts)
        distinct = parts.groupBy("key", "fid").agg(F.max("part").alias("part"), F.count(F.lit(1)).alias("n"))

        def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple[bytes, str, int]] = []
            size, key = 0, None
            for batch in slices(batches, 4096):
                out: list[tuple[bytes, list[dict[str, int]]]] = []
                for k, fid, part, n in zip(batch.key, batch.fid, batch.part, batch.n, strict=True):
                    if k != key and size >= SHARD_WORDS:
                        out += repeated_windows(held)
                        held, size = [], 0
                    held.append((fid, part, n))
                    size += part.count(" ") + 1
                    key = k
                yield pd.DataFrame(out, columns=["fid", "runs"])
            yield pd.DataFrame(list(repeated_windows(held)), columns=["fid", "runs"])

        found = distinct.repartition("key").sortWithinPartitions("key").mapInPandas(shards, "fid binary, runs array<struct<first:int,last:int>>")
        found = materialize(found, "runs")
        # Copies of a text have the same places; one of each is enough. A window's hash may be the key of a hot anchor and a fragment's too.
        places = materialize(parts.select("fid", "t0", "t1", "at").distinct(), "places")
        scratch.discard(parts)
        placed = skew_join(places, found, "fid", "t0")
        placed = placed.select("t0", "t1", F.transform("runs", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), (r["last"] + F.col("at")).alias("last"))).alias("runs"))
        spans = placed.groupBy("t0", "t1").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("spans"))
        return materialize(spans.join(copies, ["t0", "t1"], "full").select(F.struct("t0", "t1").alias("id"), F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), "spans", keep=True), hot_ids


def cut_spans(text: str, spans: list[dict[str, int]] | None, whole: bool = False) -> tuple[str, int]:
    """The text without the words of its spans, and how many these are. What is kept side by side keeps its white space."""
    if whole:
        return "", len(words(text))
    if spans is None or not len(spans):
        return text, 0
    raw = text.encode()  # no byte of a longer character is ASCII white space
    signs = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(np.diff(((signs != 32) & ((signs < 9) | (signs > 13))).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    gone = np.zeros(len(at) + 1, np.int32)
    for s in spans:
        gone[s["first"]] += 1
        gone[min(s["last"] + LENGTH, len(at))] -= 1
    keep = gone.cumsum()[:-1] == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return " ".join(raw[at[a, 0] : at[b - 1, 1]].decode() for a, b in zip(edges[::2], edges[1::2], strict=True)), int((~keep).sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with every word taken out of its text that a window covers whose words start anywhere else too; adds n_removed.

    A window is LENGTH consecutive words, compared unchanged; windows are judged on the input, in the same
    document as well. The first place of a passage goes like the others. A null text stays null; texts without a
    repeated window stay as they are. Rows that repeat an id are rows of their own, so equal rows remove each other's
    windows. An empty table gives an empty one. Other columns are carried along under whatever name; one named
    n_removed is replaced. Equal texts are told by 128 bits of their SHA-256.

    Only texts that may hold a repeated window, by a filter of their ids, shuffle to meet their spans.
    """
    kept = [c for c in docs.columns if c != "n_removed"]
    spans, hot = repeated_spans(docs.select("text"))
    # The caller's columns travel in one, so that no name of theirs clashes.
    rows = docs.select(F.struct(*kept).alias("row"), text_id(F.col("text")).alias("id"), F.xxhash64(*[c for c in kept if c != "text"], F.lit(0)).alias("spread"))
    rows = flagged(rows.withColumn("h", F.col("id.t0")), "h", spans.select(F.col("id.t0").alias("h")))

    @F.arrow_udf("text string, n_removed long")
    def removed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch[0]), 256):  # what is made of a piece stays small
                columns = zip(*[c.slice(at, 256).to_pylist() for c in batch], strict=True)
                found = [(None, 0) if t is None else cut_spans(t, s, bool(w)) for t, s, w in columns]
                parts.append(pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["text", "n_removed"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("n_removed", pa.int64())]))

    cut = salted_join(rows.filter("flag"), spans, "id", "spread", hot, "left").withColumn("cut", removed("row.text", "spans", "whole"))
    column = lambda c: F.col("row").getField(c)
    cut = cut.select(*[F.col("cut.text").alias(c) if c == "text" else column(c).alias(c) for c in kept], F.col("cut.n_removed").alias("n_removed"))
    plain = rows.filter("not flag").select(*[column(c).alias(c) for c in kept], F.lit(0).cast("long").alias("n_removed"))
    return plain.unionByName(cut)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + {LENGTH - 1}], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - {LENGTH - 2}, 1))) AS t(p)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS pos FROM rep, range({LENGTH}) AS r(k)),
ws AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
j AS (SELECT ws.doc_id, ws.pos, word, gone.pos IS NOT NULL AS gone FROM ws LEFT JOIN gone ON ws.doc_id = gone.doc_id AND ws.pos = gone.pos)
SELECT d.doc_id, any_value(len(w)) AS n_words, count(j.pos) FILTER (WHERE j.gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j.pos) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
