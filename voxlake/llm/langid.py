"""Language ID by prediction by partial matching (PPM) with frozen statistics.

For each language a variable-order byte context tree is learned: contexts of up to three
bytes with their followers' counts. A byte costs its exact PPM code length: in the longest
known context, ``-log2(count / (total + distinct))`` if it was seen there, else the escape
``-log2(distinct / (total + distinct))`` plus its cost in the next shorter context; below
order 0 all 256 bytes cost 8 bits. Statistics don't change while a text is scored.

Each language's tree is compiled into an automaton of its own, over the bytes that it has: a state is the
longest context that it knows, and three small tables lead from the last three bytes to the state and
from state and byte to the code length. All that is kept is sparse, by contexts that occur, and ``cells``
bounds the code lengths of all languages together; beyond it the rarest contexts are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, give_back, read_table, slices, text_buffers

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
PIECE = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` whole texts at most (and those within ``sample_bytes``) are learned from per
    language, chosen by a hash of doc_id among labelled documents of ``text_bytes`` at most; a language
    without such a text has its shortest ones, one at least; ``min_context`` is how often a
    3-byte context must occur to become a node of the tree; ``cells`` bounds the code lengths (4 bytes each) of all trees."""

    sample_docs: int = 300
    sample_bytes: int = 2_000_000
    text_bytes: int = 250_000
    min_context: int = 12
    cells: int = 16_000_000
    score_bytes: int = 16


NONE = 256  # stands before a text's start


@dataclass
class Tree:
    """Tables of a language. ``symbol``: of every byte (and NONE), those it doesn't have being the last; ``row``: of the third and second last
    symbol; ``state``: of that row and the last symbol; ``bits``: of that state and the byte."""

    symbol: np.ndarray
    row: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    @staticmethod
    def grow(texts: list[np.ndarray], min_context: int, cells: int) -> Tree:
        seen = np.zeros(256, bool)
        for t in texts:
            seen[t] = True
        own = np.flatnonzero(seen)
        size = len(own) + 1
        symbol = np.full(257, size - 1, np.int32)
        symbol[own] = np.arange(size - 1)
        coded = [symbol[t].astype(np.int64) for t in texts]
        # Sparse counts by order: contexts and their followers, each pair once.
        pairs = []
        for order in range(4):
            codes = [np.zeros(0, np.int64)]
            for s in coded:
                if len(s) > order:
                    code = s[: len(s) - order]
                    for k in range(1, order + 1):
                        code = code * size + s[k : len(s) - order + k]
                    codes.append(code)
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            pairs.append((code // size, code % size, n))

        def often(order, least, most):
            """Contexts that occur ``least`` times, the ``most`` frequent ones of them, ascending."""
            context, _, n = pairs[order]
            known, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, n, minlength=len(known)).astype(np.int64)
            best = np.lexsort((known, -total))[: max(most, 0)]
            return np.sort(known[best[total[best] >= least]])

        room = cells // size - size
        two = often(2, 1, room // 2)
        three = often(3, min_context, room - len(two))
        three = three[np.isin(three // size, two)]

        def counts(order, known):
            context, sym, n = pairs[order]
            at = np.minimum(np.searchsorted(known, context), max(len(known) - 1, 0))
            hit = known[at] == context if len(known) else np.zeros(len(context), bool)
            return np.bincount(at[hit] * size + sym[hit], n[hit], minlength=len(known) * size).reshape(len(known), size)

        zero = _refine(counts(0, np.zeros(1, np.int64)), np.full((1, size), 8.0))
        one = _refine(counts(1, np.arange(size)), np.repeat(zero, size, 0))
        # States: one of each last symbol, then the known contexts of two and of three.
        of_two = np.tile(np.arange(size), (size, 1))
        of_two[two // size, two % size] = size + np.arange(len(two))
        second = _refine(counts(2, two), one[two % size])
        shorter = np.concatenate([one, second])
        third = _refine(counts(3, three), shorter[of_two[three // size % size, three % size]])
        # Rows: the known contexts of two, then one of each symbol for all others that end in it.
        row = np.tile(len(two) + np.arange(size), (size, 1))
        row[two // size, two % size] = np.arange(len(two))
        state = of_two[np.concatenate([two % size, np.arange(size)])]
        state[np.searchsorted(two, three // size), three % size] = size + len(two) + np.arange(len(three))
        return Tree(symbol, row.ravel().astype(np.int32), state.ravel().astype(np.int32), np.concatenate([shorter, third]).ravel().astype(np.float32))

    def cost(self, own: np.ndarray, last: list[np.ndarray]) -> np.ndarray:
        """Bits of each byte ``own``; ``last``: the bytes one, two and three before it."""
        s, size = self.symbol, np.int32(self.symbol.max() + 1)
        at = self.row[s[last[2]] * size + s[last[1]]]
        at = self.state[at * size + s[last[0]]]
        return self.bits[at * size + s[own]]


class Model:
    """Context trees of the languages in ``langs``."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees

    @staticmethod
    def learn(texts: dict[str, list[bytes]], min_context: int = 12, cells: int = Settings.cells) -> Model:
        langs = sorted(texts)
        return Model(langs, [Tree.grow([np.frombuffer(t, np.uint8) for t in texts[k] if t], min_context, cells // len(langs)) for k in langs])

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row under every language, added up over pieces of PIECE bytes, so a long text needs no more memory."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.langs)))
        if not len(data):
            return out
        for lo in range(0, len(data), PIECE):
            hi, lead = min(lo + PIECE, len(data)), min(lo, 3)
            s = data[lo - lead : hi]
            first, last = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
            begin = offsets[first:last]
            some = np.flatnonzero(np.minimum(offsets[first + 1 : last + 1], hi) > np.maximum(begin, lo))
            before = []
            for back in (1, 2, 3):
                past = np.full(hi - lo, NONE, np.int16)
                past[max(back - lead, 0) :] = s[max(lead - back, 0) : len(s) - back]
                for k in range(back):  # the first bytes of a text that begins here
                    at = begin[some] + k
                    past[at[(at >= lo) & (at < hi)] - lo] = NONE
                before.append(past)
            cuts = np.maximum(begin[some], lo) - lo
            for k, tree in enumerate(self.trees):
                out[first + some, k] += np.add.reduceat(tree.cost(s[lead:], before), cuts, dtype=np.float64)
        return out


def _refine(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths in contexts with the given follower counts, from those one order lower."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = -np.log2(counts / (total + distinct))
        away = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0) + shorter
    return np.where(counts > 0, own, away)


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Trees from ``docs`` (doc_id, text, lang); rows of null lang or text don't count.

    A count per language sets the sampling rate of a hash of doc_id. Only ids and sizes of candidates reach
    the driver at first; texts follow for those that fit into the language's bytes, so what is gathered is
    ``sample_bytes`` a language (or one text, if it is larger) at any input size.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    at = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40))
    rows = labelled.select("lang", at.alias("at"), F.octet_length("text").alias("n"), "text")
    short = F.col("n") <= settings.text_bytes
    limits = {r["lang"]: r["count"] for r in rows.groupBy("lang").agg(F.count_if(short).alias("count")).collect()}
    # Twice the bound is admitted by hash, the bound itself is applied in hash order.
    rate = F.lit(0)
    for lang, count in limits.items():
        if count:
            rate = F.when(F.col("lang") == lang, F.lit(min(1 << 40, int((1 << 40) * 2 * settings.sample_docs / count)))).otherwise(rate)
    found = sorted(map(tuple, rows.where((F.col("at") < rate) & short).select("lang", "at", "n").collect()))
    for lang in (k for k, count in limits.items() if not count):
        # More of them than this don't fit into sample_bytes.
        most = max(1, min(settings.sample_docs, settings.sample_bytes // (settings.text_bytes + 1)))
        own = rows.where(F.col("lang") == lang).orderBy("n", "at").limit(most)
        found += [tuple(r) for r in own.select("lang", "at", "n").collect()]
    chosen: dict[str, list[int]] = {lang: [] for lang in limits}
    spent = dict.fromkeys(chosen, 0)
    for lang, at, n in found:
        if not chosen[lang] or (len(chosen[lang]) < settings.sample_docs and spent[lang] + n <= settings.sample_bytes):
            chosen[lang].append(at)
            spent[lang] += n
    wanted = F.lit(False)
    for lang, ats in chosen.items():
        wanted = wanted | (F.col("lang") == lang) & F.col("at").isin(ats)
    texts: dict[str, list[bytes]] = {}
    # Rows that repeat a doc_id share its hash: of those one is learned from.
    for row in rows.where(wanted).groupBy("lang", "at").agg(F.min("text").alias("text")).orderBy("lang", "at").collect():
        texts.setdefault(row["lang"], []).append(row["text"].encode())
    model = Model.learn(texts, settings.min_context, settings.cells)
    give_back()  # counts of contexts, several times the model
    return model


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def predict(docs: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to ``docs``, replacing columns of those names.

    The score is the posterior of the best language over ``score_bytes`` average bytes of the text.
    Null texts, texts without a letter, and a model without languages give ``und`` with score 0.
    Equal code lengths go to the language that sorts first. Rows that repeat are judged alike, texts of any
    length whole, other columns and null ids don't matter; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*(c for c in PREDICTED.names if c != text))

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            data, offsets = text_buffers(column)
            best, score, rate = [], [], []
            for _, _, part, off in slices(data, offsets):
                cost = m.code_lengths(part, off)
                blob = part.tobytes()
                for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if a == b or not m.langs or not _has_letter(blob, a, b):
                        best.append(UNDETERMINED), score.append(0.0), rate.append(None)
                        continue
                    mean = cost[row] / (b - a)
                    k = int(mean.argmin())
                    best.append(m.langs[k])
                    score.append(float(1 / np.exp2(-settings.score_bytes * (mean - mean[k])).sum()))
                    rate.append(float(mean[k]))
            yield pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip((best, score, rate), PREDICTED, strict=True)], names=PREDICTED.names)
        give_back()

    # Only the text goes to Python, and only the verdict comes back. Said to vary, so that it runs once for filter and output.
    judged = F.arrow_udf(judge, "lang_pred string, score double, bits_per_byte double").asNondeterministic()
    rows = kept.select(F.struct(*kept.columns).alias("_row"), judged(F.col(text)).alias("_is"))
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept.columns), "_is.lang_pred", "_is.score", "_is.bits_per_byte")


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(blob: bytes, a: int, b: int) -> bool:
    return bool(_ASCII_LETTER.search(blob, a, b)) or bool(LETTER.search(blob[a:b].decode("utf-8", "replace")))


def op8_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold; awkward rows as in ``predict``.

    A row without a doc_id is in no fold: it is not held out (false), and not learned from.
    """
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = learn(docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text", "bits_per_byte")


def identify_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language go; the columns stay as they are.

    Null texts and texts without a letter go; the rest as in ``predict``. Without any labelled document nothing
    can be recognised, and all go. Columns named like the verdict's are kept as they are. Rows that repeat stay or go together, null ids
    don't matter, and an empty table stays empty.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    scored = predict(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), model)
    del model  # the executors have it
    give_back()
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5)).select(*(F.col(f"_doc.`{n}`").alias(n) for n in docs.columns))
