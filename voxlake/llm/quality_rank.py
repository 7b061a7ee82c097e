"""A quality classifier by Bradley-Terry pairwise ranking.

Every pair of a good and a bad labelled document is a comparison that the good one won. The
model's score is linear in text features, ``P(a beats b) = sigmoid(w . (f(a) - f(b)))``, and w
minimises the logistic loss on the feature differences of sampled pairs with a ridge penalty
(Newton steps). The decision threshold is the quantile of the training scores that leaves as
large a share below as there are bad documents, over all labelled training documents, sampled or
not; a logistic link maps it to score 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, give_back, map_arrow, materialize, read_table, slices, text_buffers, word_spans


@dataclass(frozen=True)
class Settings:
    """The fit uses ``sample_docs`` labelled documents of each class at most, chosen by a hash of
    doc_id, and ``pairs`` random pairs of them; ``threshold`` is where the quantile is mapped to."""

    sample_docs: int = 2500
    pairs: int = 20_000
    ridge: float = 1e-3
    steps: int = 12
    threshold: float = 0.7
    seed: int = 17


N_FEATURES = 256 + 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte frequencies and the shape of words and lines, one row a text; an empty text gives zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES))
    starts, ends, first = word_spans(data, offsets)
    length = ends - starts
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        part, words = data[a:b], length[first[k] : first[k + 1]]
        count = np.bincount(part, minlength=256)
        out[k, :256] = np.sqrt(count / (b - a))
        n = max(len(words), 1)
        upper, lower = count[65:91].sum(), count[97:123].sum()
        lines = data[a:b].tobytes().split(b"\n")
        out[k, 256:] = (
            np.log1p(len(words)),
            words.mean() if len(words) else 0.0,
            words.std() if len(words) else 0.0,
            upper / max(upper + lower, 1),
            len(lines) / n,
            1 - len(set(lines)) / len(lines),
            count[[33, 35, 36, 37, 38, 42, 60, 62, 124]].sum() / n,
        )
    return out


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Each row is summed by itself: a matrix product adds up in an order that depends on how many rows there are."""
        parts = ((x - self.center) / self.scale).clip(-8, 8) * self.weights
        return np.array([row.sum() for row in parts])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-z.clip(-40, 40)))

    @staticmethod
    def fit(good: np.ndarray, bad: np.ndarray, settings: Settings = Settings()) -> Model:
        """Without documents of both classes every score is 0.5."""
        n = N_FEATURES
        if not len(good) or not len(bad):
            return Model(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0, 0.5)
        both = np.concatenate([good, bad])
        center, scale = both.mean(0), both.std(0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        g, b = ((x - center) / scale for x in (good, bad))
        g, b = g.clip(-8, 8), b.clip(-8, 8)
        rng = np.random.default_rng(settings.seed)
        d = g[rng.integers(0, len(g), settings.pairs)] - b[rng.integers(0, len(b), settings.pairs)]
        w = np.zeros(n)
        for _ in range(settings.steps):
            p = 1 / (1 + np.exp(-(d @ w).clip(-40, 40)))
            grad = d.T @ (p - 1) / len(d) + settings.ridge * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + settings.ridge * np.eye(n)
            w -= np.linalg.solve(hess, grad)
        raw = np.concatenate([g, b]) @ w
        share = len(b) / (len(g) + len(b))
        # Between the scores on either side of the quantile, so a clean separation gets its middle.
        lo, hi = np.quantile(raw, max(share - 0.01, 0)), np.quantile(raw, min(share + 0.01, 1))
        return Model(center, scale, w, float((lo + hi) / 2), float(max(raw.std() / 4, 1e-6)), settings.threshold)


ADDED = ("score", "predicted")


def learn(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """From (doc_id, text, quality) with quality 1 or 0. The sampling rate follows from a count of each class."""
    at = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(1 << 40))
    counts = {r["quality"]: r["count"] for r in labelled.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    share = {q: min(1 << 40, int((1 << 40) * settings.sample_docs / n)) for q, n in counts.items()}
    wanted = (F.col("quality") == 1) & (at < share.get(1, 0)) | (F.col("quality") == 0) & (at < share.get(0, 0))
    found = labelled.where(wanted).select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi, part, off in slices(data, offsets):
                x = features(part, off).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(map_arrow(found, run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["quality"], r["x"]))
    x = {q: np.array([np.frombuffer(r["x"], np.float32) for r in rows if r["quality"] == q], np.float64).reshape(-1, N_FEATURES) for q in (1, 0)}
    model = Model.fit(x[1], x[0], settings)
    give_back()
    return model


def raw_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, score and predicted, with _raw, the score before the link."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*(c for c in ADDED if c != text))
    others = [c for c in kept.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text] + ["_raw double"])

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            parts = [m.raw(features(part, off)) for _, _, part, off in slices(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*others, "_raw"])

    return map_arrow(kept, run, schema)


def order_statistics(values: DataFrame, ranks: set[int], most: int = 50_000, buckets: int = 1024) -> dict[int, float]:
    """The values of ``values`` (_raw) at ranks from 0, exactly: buckets that hold a rank are split until few rows are left."""
    lo, hi, n = values.agg(F.min("_raw"), F.max("_raw"), F.count("_raw")).first()
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    if n <= most:
        found = np.sort([r["_raw"] for r in values.select("_raw").collect()])
        return {k: float(found[k]) for k in ranks}
    bucket = F.least(F.floor((F.col("_raw") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
    below, out = 0, {}
    for b, count in sorted(map(tuple, values.groupBy(bucket.alias("b")).count().collect())):
        here = {k - below for k in ranks if below <= k < below + count}
        if here:
            out |= {k + below: v for k, v in order_statistics(values.where(bucket == b), here, most, buckets).items()}
        below += count
    return out


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """``model`` with cut and spread from all rows of ``labelled`` (quality, _raw), at the share of bad ones among them."""
    n, bad, std = labelled.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 0), F.stddev_pop("_raw")).first()
    if bad in (0, n) or not model.weights.any():
        return model
    share = bad / n
    # Between the scores on either side of the quantile, so a clean separation gets its middle.
    at = [q * (n - 1) for q in (max(share - 0.01, 0), min(share + 0.01, 1))]
    got = order_statistics(labelled, {k for p in at for k in (int(p), min(int(p) + 1, n - 1))})
    sides = [got[int(p)] + (got[min(int(p) + 1, n - 1)] - got[int(p)]) * (p - int(p)) for p in at]
    return replace(model, cut=sum(sides) / 2, spread=max(std / 4, 1e-6))


def linked(raw: DataFrame, model: Model) -> DataFrame:
    """score and predicted (score at or above the threshold) in place of _raw."""
    z = (F.col("_raw") - model.cut) / model.spread + float(np.log(model.threshold / (1 - model.threshold)))
    scored = raw.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)))))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int")).drop("_raw")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, with score and predicted (score at or above the threshold).

    Null texts count as empty; an empty text has zero features and the score that follows.
    """
    return linked(raw_scores(docs, model, text), model)


def op10_quality_rank(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned outside the held-out fold.

    Null and empty texts have zero features and the score that follows; long texts are taken whole; rows that
    repeat are scored alike, each with a row, whatever they are read together with. A doc_id with several labels counts
    by its least, one with several texts by each. A row without a doc_id is in no fold: it is not held out (false), and no
    label meets it. Without labels of both classes every score is 0.5. An empty table gives an empty result.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    settings = Settings()
    labels = read_table(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1) & ~(fold_bucket(F.col("doc_id"), 4) == 2))
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    at = F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 40))
    # The sample_docs rows of each class that come first by hash: a bounded broadcast, so no text is shuffled.
    good, bad = (labels.where(F.col("quality") == q).orderBy(at, "doc_id").limit(settings.sample_docs) for q in (1, 0))
    chosen = good.unionByName(bad)
    model = learn(docs.join(F.broadcast(chosen), "doc_id"), settings)
    # Every document is scored once; the labels meet the scores, not the texts.
    raw = materialize(raw_scores(docs.select("doc_id", "text", held_out.alias("held_out")), model), "op10-raw")
    return linked(raw, calibrate(model, raw.join(labels, "doc_id").select("quality", "_raw")))
