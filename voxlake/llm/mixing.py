"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Tokens are counted by cell (source, language, topic). The cells' weights are raked until their
sums meet a target share for every source, every language and every topic: one that is given, or the
present share flattened by a power. What is left between sums and targets is a column, the residual. A document is then kept
with the probability of its cell, the fitted share over the present share, scaled so that the
largest is 1. Only the cells' table is iterated on: its size is the product of the numbers of
sources, languages and topics, not of documents.

Nulls in source or lang are a value of their own (``?``); null and empty texts have no tokens. Documents
without tokens carry no weight and are never kept. Long texts count whole. Rows that repeat are drawn by their doc_id, so
together; those without a doc_id draw one number. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize, read_table

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Settings:
    """A target share that isn't given is proportional to the present share to the given power: below 1 it flattens.
    ``rounds`` of raking are made, and as many again, ``most_rounds`` at most, while the residual is above ``tolerance``.
    ``broadcast_cells`` is the checked size up to which the cells' table is broadcast."""

    powers: tuple[float, float, float] = (0.8, 0.85, 0.95)
    rounds: int = 10
    most_rounds: int = 200
    tolerance: float = 1e-7
    seed: str = "mix-1"
    broadcast_cells: int = 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The topic of a text: tables, else by length. Any expression with few values can stand here."""
    return F.when(F.coalesce(F.contains(text, F.lit(" | ")), F.lit(False)), "table").when(tokens < 100, "note").when(tokens < 500, "article").otherwise("book")


def described(docs: DataFrame) -> DataFrame:
    """doc_id with the three dimensions and n_tokens."""
    tokens = token_count(F.col("text"))
    return docs.select("doc_id", F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"), topic_of(F.col("text"), tokens).alias("topic"), tokens.alias("n_tokens"))


def cell_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where(F.col("tokens") > 0)


def target_table(spark, shares: dict[str, dict[str, float]]) -> DataFrame:
    """(dimension, value, share) from shares by dimension and value, for ``rake``."""
    rows = [(d, v, float(x)) for d, of in shares.items() for v, x in of.items()]
    return spark.createDataFrame(rows, "dimension string, value string, share double")


def rake(cells: DataFrame, settings: Settings = Settings(), targets: DataFrame | None = None) -> DataFrame:
    """Adds weight (sums to 1), residual and probability to cells (source, lang, topic, tokens).

    ``targets`` (dimension, value, share) sets the shares of a dimension; they are scaled to 1 over the values that occur,
    and a value that it doesn't name gets none of that dimension. Dimensions that it lacks have powers of
    their present shares. The residual is the greatest distance of a share from its target. Targets that no weights of
    the present cells can meet leave one.
    """
    everything = Window.partitionBy(F.lit(0))
    given = {r["dimension"] for r in targets.select("dimension").distinct().collect()} if targets is not None else set()
    if given - set(DIMENSIONS):
        raise ValueError(f"unknown dimensions: {sorted(given - set(DIMENSIONS))}")
    out = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything))
    for name, power in zip(DIMENSIONS, settings.powers, strict=True):
        own = F.sum("tokens").over(Window.partitionBy(name))
        if name in given:
            want = targets.where(F.col("dimension") == name).groupBy(F.col("value").alias(name)).agg(F.sum("share").alias("_want"))
            out = out.join(want, name, "left").withColumn("_want", F.coalesce("_want", F.lit(0.0)))
        else:
            out = out.withColumn("_want", F.pow(own, F.lit(power)))
        # Each value's wanted size once: its cells add up to it.
        out = out.withColumn("_own", own).withColumn(f"_to_{name}", F.col("_want") / F.sum(F.col("_want") * F.col("tokens") / F.col("_own")).over(everything)).drop("_own", "_want")
    done = 0
    while True:
        for k in range(settings.rounds):
            for name in DIMENSIONS:
                sums = F.sum("weight").over(Window.partitionBy(name))
                out = out.withColumn("weight", F.when(sums > 0, F.col("weight") * F.col(f"_to_{name}") / sums).otherwise(0.0))
            if k % 3 == 2:
                out = materialize(out, "op5-rake")
        done += settings.rounds
        off = F.greatest(*(F.abs(F.sum("weight").over(Window.partitionBy(n)) - F.col(f"_to_{n}")) for n in DIMENSIONS))
        out = materialize(out.withColumn("residual", F.max(off).over(everything)), "op5-rake")
        left = out.agg(F.max("residual")).first()[0]
        if left is None or left <= settings.tolerance or done >= settings.most_rounds:
            break
        out = out.drop("residual")
    ratio = F.col("weight") / F.col("tokens")
    out = out.withColumn("probability", ratio / F.max(ratio).over(everything))
    return out.select(*DIMENSIONS, "tokens", "weight", "residual", "probability")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("?"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def assign(rows: DataFrame, cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds weight, residual, probability and sampled to rows that carry the dimensions."""
    fitted = cells.select(*DIMENSIONS, "weight", "residual", "probability")
    if cells.count() <= settings.broadcast_cells:
        fitted = F.broadcast(fitted)
    joined = rows.join(fitted, list(DIMENSIONS), "left")
    p = F.coalesce(F.when(F.col("n_tokens") > 0, F.col("probability")), F.lit(0.0))
    return joined.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": p, "sampled": uniform(F.col("doc_id"), settings.seed) < p})


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Weight, probability and draw of every document; awkward rows as in the module's header."""
    rows = materialize(described(read_table(spark, sf_dir, "documents")), "op5-rows")
    cells = materialize(rake(materialize(cell_sizes(rows), "op5-cells")), "op5-weights")
    out = assign(rows, cells)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("residual", 5).alias("residual"), F.round("probability", 6).alias("probability"), "sampled")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with their columns as they are; awkward rows as in the module's header.

    Columns named like the operator's own (topic, weight, probability, ...) are carried in a struct and don't matter. Documents draw by a
    hash of their id, so rows alike in it are taken or left together, and a draw equal to the probability is left.
    """
    cells = materialize(rake(materialize(cell_sizes(described(docs)), "mix-cells")), "mix-weights")
    names = docs.columns
    tokens = token_count(F.col("text"))
    keys = {"source": F.coalesce("source", F.lit("?")), "lang": F.coalesce("lang", F.lit("?")), "topic": topic_of(F.col("text"), tokens)}
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id"), *(c.alias(n) for n, c in keys.items()), tokens.alias("n_tokens"))
    return assign(rows, cells).where("sampled").select("_row.*")


def _op5_sql(settings: Settings = Settings()) -> str:
    to = []
    for name, power in zip(DIMENSIONS, settings.powers, strict=True):
        own = f"sum(tokens) OVER (PARTITION BY {name})"
        to.append(f"pow({own}, {power}) AS want_{name}, tokens / {own} AS part_{name}")
    steps, last = [], "c2"
    for k in range(settings.rounds):
        for name in DIMENSIONS:
            step = f"r{k}_{name}"
            steps.append(f"{step} AS (SELECT * REPLACE (weight * to_{name} / sum(weight) OVER (PARTITION BY {name}) AS weight) FROM {last})")
            last = step
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, text,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD_CLASS}+')), 0) AS BIGINT) AS n_tokens FROM documents),
rows_ AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN coalesce(contains(text, ' | '), false) THEN 'table' WHEN n_tokens < 100 THEN 'note'
         WHEN n_tokens < 500 THEN 'article' ELSE 'book' END AS topic FROM counted),
c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS (SELECT *, tokens / sum(tokens) OVER () AS weight, {", ".join(to)} FROM c0),
c2 AS (SELECT source, lang, topic, tokens, weight, {", ".join(f"want_{n} / sum(want_{n} * part_{n}) OVER () AS to_{n}" for n in DIMENSIONS)} FROM c1),
{", ".join(steps)},
ended AS (SELECT *, {", ".join(f"abs(sum(weight) OVER (PARTITION BY {n}) - to_{n}) AS off_{n}" for n in DIMENSIONS)} FROM {last}),
fitted AS (SELECT source, lang, topic, weight, max(greatest({", ".join(f"off_{n}" for n in DIMENSIONS)})) OVER () AS residual, (weight / tokens) / max(weight / tokens) OVER () AS probability FROM ended),
joined AS (
  SELECT r.*, coalesce(f.weight, 0.0) AS weight, f.residual, CASE WHEN r.n_tokens > 0 THEN coalesce(f.probability, 0.0) ELSE 0.0 END AS probability
  FROM rows_ r LEFT JOIN fitted f USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(CAST(weight AS DOUBLE), 6) AS weight, round(CAST(residual AS DOUBLE), 5) AS residual, round(CAST(probability AS DOUBLE), 6) AS probability,
       CAST('0x' || substr(md5('{settings.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '?')), 1, 13) AS BIGINT) / {float(1 << 52)} < probability AS sampled
FROM joined
"""


OP5_SQL = _op5_sql()
