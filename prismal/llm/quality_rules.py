"""Quality rules whose cutoffs limit the false rejections of each stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, Scratch, materialize, skew_join, words

#: Larger is worse; each with its candidate cutoffs, strictest first. A text is rejected if it is above the chosen one.
RULES = {
    "symbol_ratio": ("n_symbols / word_chars", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_line_ratio": ("n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeat_ratio": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "mean_word_chars": ("word_chars / n_words", (9.0, 10.0, 12.0, 15.0, 20.0)),
}
#: A good text of a stratum is rejected with at most this probability, all rules together; the chance that any cutoff breaks this is at most DELTA.
ALPHA, DELTA = 0.04, 0.05
#: Strata whose cutoffs are broadcast, by their measured number; of more, rows meet theirs in a join that deals out hot strata.
BROADCAST_STRATA = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = " \t\n\v\f\r"


def metrics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of a whole text."""
    found = words(text)
    if not found:
        return 0, 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), repeated_words(found), len(lines)


def repeated_words(found: list[str]) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(found) < 4:
        return 0
    codes: dict[str, int] = {}
    at = np.fromiter((codes.setdefault(w, len(codes)) for w in found), np.int64, len(found))
    pairs = np.unique(at[:-1] * len(codes) + at[1:], return_inverse=True)[1]
    keys = pairs[:-1] * len(codes) + at[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    covered = np.zeros(len(found) + 1, np.int32)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 3, -1)
    return int((covered.cumsum()[:-1] > 0).sum())


def binomial_upper(failures: int, trials: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate: the rate at which so few failures have probability `level`."""
    if failures >= trials:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) for i in range(failures + 1)]
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        a, b = math.log(p) if p else -math.inf, math.log1p(-p) if p < 1 else -math.inf
        terms = [c + (i * a if i else 0.0) + (trials - i) * b for i, c in enumerate(logs)]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms) if top > -math.inf else 0.0
        low, high = (p, high) if tail > level else (low, p)
    return high


@dataclass
class Cutoffs:
    """stratum -> rule -> cutoff; a rule without one rejects nothing there. bounds has the bound of each."""

    of: dict[str, dict[str, float]]
    bounds: dict[str, dict[str, float]]


def needed(level: float, rate: float) -> int:
    """Trials below which even no failure can't show the rate."""
    return math.ceil(math.log(level) / math.log1p(-rate))


def cutoff_table(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, and a cutoff and its bound for each rule (null: it rejects nothing there): the strictest whose bound on false rejections holds.

    Bonferroni-corrected over all candidates of all strata with enough good rows for any bound; of other strata there is no row.
    Every labelled row counts: sums by stratum are partial before they shuffle. The thresholds are fixed in
    advance, so that every labelled row is a holdout.
    """
    rate = alpha / len(RULES)
    candidates = sum(len(c) for _, c in RULES.values())
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    sums = [F.sum(F.when(F.col(rule) > c, 1).otherwise(0)).alias(f"{rule}_{i}") for rule, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    # Texts that fail the base rules are rejected anyway: no cutoff makes or saves those.
    tested = measured.filter("not base_failed").select(F.col("row.doc_id").alias("id"), "stratum", *RULES).join(good, "id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    tested = materialize(tested.filter(F.col("n") >= needed(delta / candidates, rate)), "strata")
    level = delta / (candidates * max(1, tested.count()))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                found = []
                for rule, (_, cs) in RULES.items():
                    bounds = ((c, row[f"{rule}_{i}"]) for i, c in enumerate(cs) if row[f"{rule}_{i}"] <= rate * row["n"])
                    bounds = ((c, binomial_upper(k, row["n"], level)) for c, k in bounds)
                    found += next(([c, upper] for c, upper in bounds if upper <= rate), [None, None])
                rows.append((row["stratum"], *found))
            yield pd.DataFrame(rows, columns=names).astype({n: "float64" for n in names[1:]})

    names = ["stratum", *[f"{rule}_{x}" for rule in RULES for x in ("cutoff", "bound")]]
    return tested.mapInPandas(choose, "stratum string, " + ", ".join(f"{n} double" for n in names[1:]))


def select_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> Cutoffs:
    """cutoff_table() as an object, for few strata."""
    found = Cutoffs({}, {})
    for row in cutoff_table(measured, labels, alpha, delta).collect():
        chosen = {rule: (row[f"{rule}_cutoff"], row[f"{rule}_bound"]) for rule in RULES if row[f"{rule}_cutoff"] is not None and row[f"{rule}_cutoff"] == row[f"{rule}_cutoff"]}
        found.of[row.stratum], found.bounds[row.stratum] = ({rule: x[i] for rule, x in chosen.items()} for i in (0, 1))
    return found


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """row (docs' columns but the text, in a struct), stratum (null: empty), metrics(), the rules' values and base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([metrics(t) for t in texts], columns=names, dtype="int64")

    row = F.struct(*[c for c in docs.columns if c != "text"])
    out = docs.select(row.alias("row"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), measured("text").alias("m")).select("row", "stratum", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    for rule, (ratio, _) in RULES.items():
        over, under = ratio.split(" / ")
        out = out.withColumn(rule, F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0))
    return out.withColumn("base_failed", failed)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each row of docs: its columns but the text, metrics(), the rules' values, base_failed and kept.

    A null or empty text has no words and so fails the base rules. A null stratum is one of its own. Repeated
    rows get the same verdict; ids that repeat count as often among the labelled rows. Labels that are null or of
    unknown ids count for nothing. An empty table gives an empty one. Other columns are carried along under whatever
    name; those that have the names of those added are replaced. There may be any number of strata.
    """
    with Scratch():
        measured = materialize(measure(docs, stratum).withColumn("spread", F.xxhash64("row.doc_id")), "quality", keep=True, batch=TEXTS)
        cutoffs = materialize(cutoff_table(measured, labels, alpha, delta), "cutoffs", keep=True)
    if cutoffs.count() <= BROADCAST_STRATA:
        judged = measured.join(F.broadcast(cutoffs), "stratum", "left")
    else:
        judged = skew_join(measured, cutoffs, "stratum", "spread", "left")
    rejected = [F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False)) for rule in RULES]
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, rejected))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *RULES, "base_failed", "kept"]
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text" and c not in added], *added)
