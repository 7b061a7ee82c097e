"""Quality rules whose cutoffs carry a guarantee (risk-controlled thresholds).

Each rule rejects a document whose feature exceeds a cutoff. Labelled documents of quality 1
are the holdout: for a rule and a stratum the cutoffs are tested from the mildest to the
strictest, and testing stops at the first whose false rejections are too many, judged by the
exact (Clopper-Pearson) upper bound of the binomial. The error probability ``delta`` is divided
by the number of rules and strata (Bonferroni); within a sequence the fixed order needs no
further share. Each rule may reject ``alpha`` divided by the number of rules, so by the union of the
rules: with probability 1 - delta, of no stratum are more than ``alpha`` of the good documents
rejected. That holds among the documents that pass the base rule, which has no cutoff to choose. A rule without enough labels in
a stratum gets no cutoff there, and rejects nothing. A document whose feature equals the cutoff is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SEPARATOR, map_arrow, materialize, read_table, slices, text_buffers, word_spans

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Settings:
    """alpha: bound on the share of a stratum's good documents that the rules reject together. delta: chance that the
    bound fails for any stratum. grid: cutoffs of every rule, mildest first; a document is rejected if its feature is above."""

    alpha: float = 0.04
    delta: float = 0.05
    grid: tuple[float, ...] = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)


#: The rules' features, each between 0 and 1, from the columns of ``text_statistics``.
RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_words": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "shouting": lambda: F.col("n_exclaims") / F.greatest(F.col("n_words"), F.lit(1)),
}

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


def _repeat_words(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words inside windows of WINDOW words that occur at least twice, windows compared exactly."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
    if len(ids) == len(words):
        return 0
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, WINDOW)).view(np.dtype((np.void, 4 * WINDOW))).ravel()
    _, group, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[group] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _maybe_repeats(words: list[bytes]) -> bool:
    return len(words) > WINDOW


def _statistics(part: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = word_spans(part, offsets)
    lead = np.zeros(len(part) + 1, np.int64)
    np.cumsum(((part & 0xC0) != 0x80) & ~IS_SEPARATOR[part], out=lead[1:])
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    symbols, exclaims = np.zeros(len(part) + 1, np.int64), np.zeros(len(part) + 1, np.int64)
    np.cumsum(is_symbol[part], out=symbols[1:])
    np.cumsum(part == ord("!"), out=exclaims[1:])
    between = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    blob = part.tobytes()
    dup, rep, lines = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = blob[a:b]
        told = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[k], dup[k] = len(told), len(told) - len(set(told))
        words = text.split()  # bytes split on exactly the separators of the contract
        rep[k] = _repeat_words(words, {}) if _maybe_repeats(words) else 0
    return [np.diff(first), between(lead), between(symbols), dup, rep, lines, between(exclaims)]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, and STATISTICS of the whole text (null: empty), which replace same names."""
    kept = docs.drop(*(c for c in STATISTICS if c != text))
    others = [c for c in kept.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text] + [f"{c} long" for c in STATISTICS])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            parts = [_statistics(part, off) for _, _, part, off in slices(data, offsets)]
            found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.array(x) for x in found], names=[*others, *STATISTICS])

    return map_arrow(kept, run, schema)


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return -math.inf
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a proportion after k hits in n trials."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if log_binomial_tail(k, n, mid) > math.log(delta) else (lo, mid)
    return hi


def select_cutoffs(good: DataFrame, stratum: str, settings: Settings = Settings(), rules=None) -> dict[tuple[str, str], float]:
    """(rule, stratum) -> cutoff, from statistics of good documents. Only counts reach the driver:
    one row a stratum with one number for each rule and cutoff."""
    rules = rules or RULES
    counts = {f"{r}:{k}": F.count_if(f() > F.lit(c)) for r, f in rules.items() for k, c in enumerate(settings.grid)}
    rows = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in counts.items())).collect()
    share, most = settings.delta / max(1, len(rules) * len(rows)), settings.alpha / max(1, len(rules))
    out = {}
    for row in rows:
        for rule in rules:
            for k, cutoff in enumerate(settings.grid):
                if row["n"] == 0 or row[f"{rule}:{k}"] > most * row["n"] or upper_bound(row[f"{rule}:{k}"], row["n"], share) > most:
                    break
                out[rule, row[stratum]] = cutoff
    return out


def passes(cutoffs: dict[tuple[str, str], float], stratum: Column, rules=None) -> Column:
    """True unless a rule's feature exceeds its cutoff for the stratum; strata without cutoffs pass."""
    out = F.lit(True)
    for rule, feature in (rules or RULES).items():
        cut = F.lit(None).cast("double")
        for (name, value), cutoff in sorted(cutoffs.items(), key=str):
            if name == rule:
                cut = F.when(stratum == value, F.lit(cutoff)).otherwise(cut)
        out = out & F.coalesce(feature() <= cut, F.lit(True))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, cutoffs by language from the good ones among the labels.

    Null and empty texts have no words and fail the base rule; long texts are taken whole; a null language is the
    stratum ``und``; rows that repeat are judged alike, each with a row; a doc_id that is labelled more than once is
    good if any label says so. Without labels no rule rejects; an empty table gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("stratum"), "text")
    stats = materialize(text_statistics(docs), "op6-statistics")
    labels = read_table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()
    cutoffs = select_cutoffs(stats.join(labels, "doc_id").where(~base_failed()), "stratum")
    verdict = ~base_failed() & passes(cutoffs, F.col("stratum"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("kept"))
