"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Tokens are counted by cell (source, language, topic). Raking rescales the cells in turn until their weights have the
target marginals of every dimension; then one factor makes the expected number of sampled tokens the wanted share, and
each document is kept with its cell's probability by a uniform number that depends on its id alone.

Only the table of cells takes part in the rounds. Marginals are summed with partial sums first, so a source with a third
of all documents is a row like any other; two numbers a round reach the driver. A table of cells of up to SMALL bytes is
one partition, where sums need no exchange: each exchange costs the driver a thread, which it keeps for a minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Bytes up to which a table of cells is one partition.
SMALL = 4 << 20


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """Form of a text by shares of its characters: empty, table, figures, symbols or prose."""
    n = F.length(text)
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / F.greatest(n, F.lit(1))
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(share("|\t") >= 0.02, "table")
        .when(share("0123456789") >= 0.1, "figures")
        .when(share("#$%&*!") >= 0.05, "symbols")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """docs (text) with columns topic and n_tokens added."""
    return docs.withColumns({"topic": topic_of(F.col("text")), "n_tokens": token_count(F.col("text"))})


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): shares of each value, its token share to the power, normalised."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("t"))
    return sums.join(F.broadcast(sums.agg(F.sum("t").alias("all")))).select(dim, (F.col("t") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """cells (dimensions, tokens) with column w, shares of all tokens that have each target (dim, target) as marginal.

    Values that a target lacks get no weight; targets are rescaled to the values that occur. Ends when no marginal was
    off by more than the tolerance before its turn, or after `rounds`.
    """
    now = cells.join(F.broadcast(cells.agg(F.sum("tokens").alias("all")))).withColumn("w", F.col("tokens") / F.col("all")).drop("all")
    for dim, target in targets.items():
        goal = target.select(F.col(dim).alias("key"), F.col("target").alias(f"goal_{dim}"))
        now = now.join(goal, F.col(dim) == F.col("key"), "left").drop("key").fillna(0.0, [f"goal_{dim}"])
    now = materialise(now.withColumn("off", F.lit(0.0)), "cells")
    small = fits(now, SMALL)
    together = lambda df: df.coalesce(1) if small else df
    now = together(now)
    for _ in range(rounds):
        step = now
        for k, dim in enumerate(targets):
            if small:
                step = step.where(F.col(dim).isNotNull()).withColumn("is", F.sum("w").over(Window.partitionBy(dim)))
            else:
                sums = step.groupBy(F.col(dim).alias("key")).agg(F.sum("w").alias("is"))
                step = step.join(sums, F.col(dim) == F.col("key")).drop("key")
            step = step.withColumn("f", F.when(F.col("is") > 0, F.col(f"goal_{dim}") / F.col("is")).otherwise(0.0))
            off = F.when(F.col("w") > 0, F.abs(F.col("f") - 1)).otherwise(0.0)
            step = step.withColumns({"off": off if k == 0 else F.greatest("off", off), "w": F.col("w") * F.col("f")}).drop("is", "f")
        now = together(materialise(step, "cells"))  # a table a round: plans stay small
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    now = now.drop("off", *(f"goal_{dim}" for dim in targets))
    scale = F.broadcast(now.agg(F.sum("w").alias("sum")))
    return together(materialise(now.join(scale).withColumn("w", F.when(F.col("sum") > 0, F.col("w") / F.col("sum")).otherwise(0.0)).drop("sum"), "cells"))


def calibrate(cells: DataFrame, share: float, rounds: int = 60) -> DataFrame:
    """cells with column probability = min(1, s * w / tokens), s such that the expected tokens are `share` of all (or all that have weight)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted, s = share * total, 0.0
    rate = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    for _ in range(rounds):
        full = rate * s >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not r.open:
            break
        new = max(wanted - r.full, 0) / r.open
        if s and abs(new - s) <= 1e-12 * s:
            break
        s = new
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * s)).otherwise(F.lit(0.0)))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, share: float = 0.5, power: float = 0.5, targets: dict[str, DataFrame] | None = None, seed: str = "mix", counted: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, source, lang, topic, n_tokens) with weight, probability and sampled added.

    weight is the raked share of tokens of the document's cell over the share it had; probability the chance to be
    kept; sampled the decision. Targets default to each marginal to the power `power`. A null source, language or topic
    is the empty one. Documents without tokens have weight and probability 0. Rows with the same id fall alike; a null
    id counts as the empty text. An empty table gives an empty one. counted: a cheaper table of the same rows to count.
    """
    key = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS}
    cells = (docs if counted is None else counted).groupBy(*(e.alias(d) for d, e in key.items())).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    cells = materialise(cells, "cells")
    cells = cells.coalesce(1) if fits(cells, SMALL) else cells
    made = {d: materialise((targets or {}).get(d) or tempered_targets(cells, d, power), "target") for d in DIMENSIONS}
    every = F.broadcast(cells.agg(F.sum("tokens").alias("all")))
    done = calibrate(rake(cells, made), share).join(every)
    cell = "cell_"  # before names of the cells' columns; docs must have none that starts so
    while any(c.lower().startswith(cell) for c in docs.columns):
        cell += "_"
    done = done.select(*(F.col(d).alias(f"{cell}{d}") for d in DIMENSIONS), (F.col("w") * F.col("all") / F.col("tokens")).alias("weight"), "probability")
    done = materialise(done, "cells")
    clash = [c for c in ("weight", "probability", "sampled") if c in docs.columns]
    joined = docs.drop(*clash).join(done, [key[d] == F.col(f"{cell}{d}") for d in DIMENSIONS], "left").drop(*(f"{cell}{d}" for d in DIMENSIONS))
    some = F.col("n_tokens") > 0
    joined = joined.withColumns({c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("weight", "probability")})
    return joined.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


def mixing_query(spark, sf_dir: str) -> DataFrame:
    """op8: weight, probability and decision for every document."""
    docs = described(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "lang", "topic", "n_tokens")
    return mix(materialise(docs, "described"))
