"""Toxicity: gradient-boosted trees over dense features, some of a learned lexicon, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, Scratch, materialize, remembered, slices, words

# General insults, threats and profanity, and words for "you", in four languages.
INSULTS = """idiot idiots moron morons stupid dumb loser losers trash garbage scum worthless pathetic disgusting clown clowns fool fools
jerk freak creep pig pigs rat rats ugly imbecile cretin dimwit halfwit nitwit coward liar vermin filth filthy degenerate subhuman lowlife
dummkopf trottel abschaum idioten versager widerlich erbärmlich imbécile crétin ordure minable dégoûtant débile
imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso""".split()
THREATS = "kill murder hurt beat destroy hang burn shoot stab töten sterben stirb tuer crève matar muere".split()
PROFANITY = "damn hell crap shit shitty fuck fucking fucker bastard bitch ass asshole arschloch scheiße merde putain connard mierda puta cabrón".split()
YOU = "you your yours yourself youre ur u du dich dir dein deine euch tu toi te ton ta vous votre usted tú ti tus vosotros".split()
#: Letters that digits and signs stand for.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

FEATURES = ("insult_density", "insult_count", "threat_density", "profanity_density", "near_you", "you_density", "obfuscated", "capitals", "shouted_words", "punctuation", "exclamations", "symbols", "stretched", "length", "lexicon_density", "lexicon_sum", "lexicon_count", "lexicon_max")
#: Labelled rows that fit the trees and the calibration, words between an insult and "you", words kept in a worker's memory.
SAMPLE, NEAR, CACHE = 20_000, 5, 200_000
BINS, DEPTH, TREES, RATE, LEAST = 32, 3, 60, 0.2, 20
#: Letters of word beginnings in the learned lexicon; toxic texts that must have an entry, and how many times likelier it is in them.
BEGINNINGS, LEAST_TOXIC, LIKELIER = (4, 5, 6, 7), 4, 4.0
#: Those of doc_id that are learned from; 0 is held out, the last one calibrates.
FOLDS = (1, 2, 3, 4)

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…"
_STRETCHED, _SYMBOLS = re.compile(r"(.)\1\1+"), re.compile(r"[#*$%&|<>]")
#: Signs of LEET at a word's edges are letters too, though they are stripped from its core.
_LETTER_SIGNS = frozenset(map(chr, LEET))
_KINDS = {w: k for k, ws in enumerate((INSULTS, THREATS, PROFANITY, YOU)) for w in ws}


def _spelled(word: str) -> str:
    """The letters of a word, where digits and signs stand for some."""
    return "".join([c for c in word.lower().translate(LEET) if c.isalpha()])


def entries(word: str) -> list[str]:
    """What a lexicon may know a word by: itself (with =), and its beginnings, longest first."""
    core = word.strip(_EDGE).lower()
    form = core if core.isalpha() else _spelled(word)
    return [f"={form}", *[form[:k] for k in reversed(BEGINNINGS) if len(form) >= k]] if len(form) > 1 else []


class Words(dict):
    """word -> its row of counts: four kinds, obfuscated, capitals, shouted, letters, other signs, exclamations, symbols, stretched; and its weight in a lexicon."""

    def __init__(self, lexicon: dict[str, float], size: int = CACHE):
        super().__init__()
        self.lexicon, self.size = lexicon, size
        self.rows, self.weights = np.zeros((size, 12), np.int32), np.zeros(size)

    def __missing__(self, word: str) -> int:
        row = self.rows[len(self)]
        row[:] = 0
        core = word.strip(_EDGE)
        lower, stretched, plain = core.lower(), _STRETCHED.search(word) is not None, core.isalpha()
        kind = _KINDS.get(lower)
        # Of other words the letters are the core, which isn't known.
        if kind is None and len(word) > 2 and (not lower.isalpha() or not _LETTER_SIGNS.isdisjoint(word) or _STRETCHED.search(lower)):
            spelled = _spelled(word)
            for form in (spelled, _STRETCHED.sub(r"\1\1", spelled)):
                if len(form) > 3 and (kind := _KINDS.get(form)) in (0, 1, 2):
                    row[4] = 1
                    break
                kind = None
        if kind is not None:
            row[kind] = 1
        row[5] = 0 if plain and core == lower else sum(map(str.isupper, core))
        row[7] = len(core) if plain else sum(map(str.isalpha, core))
        row[6] = row[5] > 1 and row[5] == row[7]
        row[8] = len(word) - row[7]
        if row[8]:
            row[9] = word.count("!")
            row[10] = len(_SYMBOLS.findall(word))
        row[11] = stretched
        self.weights[len(self)] = max([self.lexicon.get(e, 0.0) for e in entries(word)], default=0.0) if self.lexicon else 0.0
        self[word] = at = len(self)
        return at

    def features(self, text: str | None) -> np.ndarray:
        """FEATURES of a whole text; null counts as empty, which is all zeros."""
        found = words(text)
        out = np.zeros(len(FEATURES))
        if not found:
            return out
        total, sums, insults, yous, learned, done = len(found), np.zeros(12), [], [], np.zeros(3), 0
        while done < total:  # in blocks, so that a very long text fits the cache
            if len(self) > self.size // 2:
                self.clear()
            block = found[done : done + self.size // 2 - 1]
            at = np.fromiter(map(self.__getitem__, block), np.int64, len(block))
            rows, weights = self.rows[at], self.weights[at]
            sums += rows.sum(0)
            learned += weights.sum(), np.count_nonzero(weights), 0.0
            learned[2] = max(learned[2], weights.max())
            insults.append(np.flatnonzero(rows[:, 0]) + done)
            yous.append(np.flatnonzero(rows[:, 3]) + done)
            done += len(block)
        at, you = np.concatenate(insults), np.concatenate(yous)
        near = 0
        if len(at) and len(you):
            right = np.searchsorted(you, at)
            after = np.where(right < len(you), you[np.minimum(right, len(you) - 1)] - at, NEAR + 1)
            before = np.where(right > 0, at - you[np.maximum(right - 1, 0)], NEAR + 1)
            near = int((np.minimum(after, before) <= NEAR).sum())
        letters = max(1.0, sums[7])
        out[:] = (
            sums[0] / total, math.log1p(sums[0]), sums[1] / total, sums[2] / total, near / total, sums[3] / total, sums[4] / total,
            sums[5] / letters, sums[6] / total, sums[8] / letters, sums[9] / total, sums[10] / letters, sums[11] / total, math.log1p(total),
            learned[1] / total, learned[0], learned[1], learned[2],
        )
        return out


def features(text: str | None, lexicon: dict[str, float] | None = None, name: str = "") -> np.ndarray:
    """FEATURES of a text, by a lexicon whose words a worker remembers under its name."""
    return remembered(f"toxicity {name}", lambda: Words(lexicon or {})).features(text)


class BoostedTrees:
    """Logistic boosting of small trees over binned features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        rate = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
        self.base, self.trees = math.log(rate / (1 - rate)), []
        if not len(y) or y.min() == y.max():
            return
        binned, raw = self._bin(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            raw += self._run(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int16)

    def _grow(self, binned, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best, leaf = (1e-6, None, None), -RATE * g / (h + 1.0)
        if depth and len(rows) >= 2 * LEAST:
            for j in range(binned.shape[1]):
                b = binned[rows, j]
                n, gs, hs = (np.bincount(b, w, BINS + 1)[:-1].cumsum() for w in (None, grad[rows], hess[rows]))
                gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                if gain.max() > best[0]:
                    best = gain.max(), j, int(gain.argmax())
        if best[1] is None:
            return leaf
        left = binned[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(binned, grad, hess, rows[left], depth - 1), self._grow(binned, grad, hess, rows[~left], depth - 1))

    def _run(self, tree, binned) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(binned), tree)
        j, cut, left, right = tree
        return np.where(binned[:, j] <= cut, self._run(left, binned), self._run(right, binned))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum((self._run(t, binned) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Least-squares non-decreasing fit by pooling neighbours that are out of order."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        at, inverse = np.unique(x, return_inverse=True)
        blocks: list[list[float]] = []
        for v, n, lo in zip(np.bincount(inverse, y), np.bincount(inverse), at, strict=True):
            blocks.append([v, n, lo, lo])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                v2, n2, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
        self.x = np.array([p for b in blocks for p in b[2:]])
        self.y = np.array([b[0] / b[1] for b in blocks for _ in range(2)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.zeros(len(x))


class ToxicityModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: dict[str, float]):
        """fold 4 calibrates, the others fit the trees. Texts with the same features, as copies have, count once, by their majority."""
        self.lexicon, self.name = lexicon, uuid.uuid4().hex
        x, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        y, fold = (np.bincount(same, y) / np.bincount(same) >= 0.5).astype(float) if len(y) else y, fold[first]
        fit = fold != 4
        if fit.all() or not fit.any():
            fit = np.arange(len(y)) % 4 != 3
        self.trees = BoostedTrees(x[fit], y[fit])
        self.scale = Isotonic(self.trees.margin(x[~fit]), y[~fit])

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t, self.lexicon, self.name) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(self.scale(self.trees.margin(x)), 0.0, 1.0)


def _fold(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def lexicon_of(toxic: dict[str, float], clean: dict[str, float], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries in LEAST_TOXIC toxic texts or more and LIKELIER times likelier in them, with their log-odds; counts are of texts."""
    out = {}
    for e, n in toxic.items():
        weight = math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1))
        if n >= LEAST_TOXIC and weight >= math.log(LIKELIER):
            out[e] = weight
    return out


def _count_entries(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """entry and the number of texts that have it, by fold (f1 to f4); of `wanted` entries, or of all that are in LEAST_TOXIC texts at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 1024):
            found: dict[tuple[str, int], int] = {}
            for text, fold in zip(b.text, b.fold, strict=True):
                own = {e for w in set(words(text)) for e in entries(w)}
                for e in own if wanted is None else own & wanted:
                    found[e, fold] = found.get((e, fold), 0) + 1
            yield pd.DataFrame([(e, f, n) for (e, f), n in found.items()], columns=["entry", "fold", "n"])

    found = rows.select("text", "fold").mapInPandas(run, "entry string, fold long, n long").groupBy("entry")
    found = found.agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"f{f}") for f in FOLDS])
    return found if wanted is not None else found.filter("f1 + f2 + f3 + f4 >= " + str(LEAST_TOXIC))


def learn_lexicons(rows: DataFrame) -> dict[int, dict[str, float]]:
    """The lexicon of all labelled texts, under 0, and of those outside each fold, from rows (text, y, fold) of a bounded sample.

    Equal texts count once, by their majority. What is collected is bounded by the sample.
    """
    texts = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.first("text").alias("text"), F.avg("y").alias("y"), F.min("fold").alias("fold"))
    toxic, clean = texts.filter("y >= 0.5"), texts.filter("y < 0.5")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in texts.groupBy((F.col("y") >= 0.5).alias("toxic"), "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {r["entry"]: r for r in _count_entries(toxic, None).collect()}
    other = {r["entry"]: r for r in _count_entries(clean, set(found)).collect()}
    out = {}
    for left_out in (0, *FOLDS):
        folds = [f for f in FOLDS if f != left_out]
        counts = [{e: sum(r[f"f{f}"] for f in folds) for e, r in rows.items()} for rows in (found, other)]
        out[left_out] = lexicon_of(*counts, *[sum(sizes.get((kind, f), 0) for f in folds) for kind in (True, False)])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fits on at most `sample` labelled rows outside fold 0, those with the least hashed ids.

    The sample's ids are broadcast, and its texts written once: their number is bounded by the parameter. Labels of a
    repeated id count as their maximum; null labels and ids count as none. Without labelled rows every score is 0.

    The lexicon is learned from the sample too. It is cross-fitted: the trees and the calibration see each
    text by the lexicon of the other folds, so that what they learn of it holds for texts it hasn't seen.
    """
    rows = labels.filter("doc_id is not null and toxic is not null").filter(_fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("fold", _fold())
    with Scratch():
        chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("y"), F.col("fold").cast("long").alias("fold"))
        chosen = materialize(chosen, "sample", batch=TEXTS)
        lexicons = learn_lexicons(chosen)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = {fold: Words(lexicons[fold], CACHE // 2) for fold in FOLDS}
            for b in slices(batches, 1024):
                yield pd.DataFrame({"doc_id": b.doc_id, "x": [of[f].features(t) for t, f in zip(b.text, b.fold, strict=True)], "y": b.y, "fold": b.fold})

        found = chosen.mapInPandas(run, "doc_id long, x array<double>, y double, fold long").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found.x.tolist(), dtype=float).reshape(-1, len(FEATURES))
    return ToxicityModel(x, found.y.to_numpy(float), found.fold.to_numpy(), lexicons[0])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (with doc_id and text) with held_out, score and predicted added.

    Only the text makes a score. Null and empty texts have the features of a text without words. Rows with the
    same text have the same score; an empty table gives an empty one. held_out is false for a null id. Columns
    of docs that have the names of those added are replaced.
    """
    added = ["held_out", "score", "predicted"]
    docs = docs.drop(*added)
    model = fit(docs, labels, sample)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(texts.slice(at, 256).to_pylist()) for at in range(0, len(texts), 256)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    out = docs.withColumn("held_out", _fold() == 0).withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*docs.columns, *added)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score() doesn't predict to be toxic."""
    return score(docs, labels, sample).filter("predicted = 0").select(*docs.columns)
