"""Mixing sources to target weights (problem 8).

Entropy balancing: among all document weights between nothing and the source's cap that give each source its tokens,
those nearest to one copy each, in relative entropy, are exponentially tilted: min(cap, exp(b * length)), with b by
source. A source that has to give less than it holds therefore favours its short documents, one that has to give more
its long ones. Newton iterations solve the convex dual; each takes two sums by source over all documents and a step in
the one unknown of each source, inside the bracket that the signs of former steps leave. The total is the largest that no source's cap forbids, unless a smaller one is given.
Weights become copies by rounding that carries the tokens still due from document to document, in buckets of bounded
size.

Shares are those of ``mix_targets`` among the sources that have documents with tokens; a source without documents gets
nothing and its share goes to the others in proportion. Documents whose source is null or has no target are left out.
Defined results: null and empty texts have no tokens and are never used; targets that are null or not positive, and
caps under 1, leave their source out. Equal documents may get copies that differ by one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged
from .tokens import with_tokens

MAX_SOURCES = 10_000
BUCKET_ROWS = 100_000
#: Rounds at most, how near the tokens due are enough, and the steepest tilt for a document of mean length.
ROUNDS, EXACT, LARGEST = 60, 1e-7, 1e6


def targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    rows = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows if r["source"] is not None}


def totals(sized: DataFrame) -> dict[str, tuple[int, float]]:
    """Documents and tokens of each source."""
    rows = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: (r["n"], float(r["t"])) for r in rows}


def plan(have: dict[str, tuple[int, float]], want: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """The tokens that each usable source shall give."""
    use = {s: (w, cap) for s, (w, cap) in want.items() if s in have and have[s][1] > 0 and w and w > 0 and cap and cap >= 1}
    if not use:
        return {}
    every = sum(w for w, _ in use.values())
    most = min(cap * have[s][1] * every / w for s, (w, cap) in use.items())
    total = most if total is None else min(total, most)
    return {s: total * w / every for s, (w, _) in use.items()}


def balance(sized: DataFrame, have: dict[str, tuple[int, float]], goal: dict[str, float], cap: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """b of each source, for lengths in tokens. Inside, lengths count in means of their source."""
    spark = sized.sparkSession
    mean = {s: have[s][1] / have[s][0] for s in goal}
    found = dict.fromkeys(goal, 0.0)
    low, high = dict.fromkeys(goal, -LARGEST), dict.fromkeys(goal, LARGEST)
    for _ in range(rounds):
        table = spark.createDataFrame([(s, b, mean[s], math.log(cap[s])) for s, b in found.items()], "source string, b double, m double, most double")
        x = F.col("n_tokens") / F.col("m")
        w = F.exp(F.least(F.col("most"), F.col("b") * x))
        sums = sized.join(F.broadcast(table), "source").groupBy("source").agg(F.sum(w * x).alias("w1"), F.sum(F.when(F.col("b") * x < F.col("most"), w * x * x).otherwise(0.0)).alias("w2")).collect()
        worst = 0.0
        for r in sums:
            s = r["source"]
            wanted = goal[s] / mean[s]
            off = r["w1"] - wanted
            worst = max(worst, abs(off) / wanted)
            low[s], high[s] = (low[s], found[s]) if off > 0 else (found[s], high[s])
            step = found[s] - off / r["w2"] if r["w2"] > 0 else math.inf
            found[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if worst < EXACT:
            break
    return {s: b / mean[s] for s, b in found.items()}


def mix(sized: DataFrame, want: dict[str, tuple[float, int]], total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies of every document of a source with a target."""
    spark = sized.sparkSession
    usable = sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull())
    have = totals(usable)
    goal = plan(have, want, total)
    tilt = balance(usable, have, goal, {s: want[s][1] for s in goal}) if goal else {}
    table = spark.createDataFrame([(s, b, want[s][1], max(1, -(-have[s][0] // BUCKET_ROWS))) for s, b in tilt.items()], "source string, b double, cap int, buckets long")
    rows = usable.join(F.broadcast(table), "source")
    h = F.xxhash64("doc_id", F.lit(8))
    rows = rows.withColumn("rate", F.least(F.col("cap").cast("double"), F.exp(F.least(F.lit(700.0), F.col("b") * F.col("n_tokens"))))).withColumn("bucket", F.pmod(h, F.col("buckets"))).withColumn("h", h)
    ship(spark)
    return rows.select("doc_id", "source", "n_tokens", "rate", "bucket", "h").groupBy("source", "bucket").applyInPandas(_copies, "doc_id long, source string, n_tokens long, rate double, copies long")


def _copies(rows: pd.DataFrame) -> pd.DataFrame:
    """Each document gets its rate rounded down or up, whichever keeps the tokens so far nearer to those due; the
    longest come first, so that the shortest settle what is left."""
    rows = rows.sort_values(["n_tokens", "h", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    due = 0.0
    copies = np.empty(len(rows), np.int64)
    for i, (t, w) in enumerate(zip(rows["n_tokens"].tolist(), rows["rate"].tolist())):
        low = int(w + 1e-6)  # a rate that should be whole may fall just under it
        due += (w - low) * t
        more = w - low > 1e-6 and due >= t / 2
        due -= t * more
        copies[i] = low + more
    rows["copies"] = copies
    return rows[["doc_id", "source", "n_tokens", "rate", "copies"]]


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return staged(with_tokens(docs).select("doc_id", "source", "n_tokens"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies of the documents in the mix."""
    return mix(sizes(spark, sf_dir), targets(spark, sf_dir)).where("copies > 0")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: for every source with documents or a target, its target, the achieved share of the tokens, how many
    documents it has and gives, and how often one is used at most."""
    sized, want = sizes(spark, sf_dir), targets(spark, sf_dir)
    mixed = mix(sized, want).groupBy("source").agg(F.sum((F.col("copies") > 0).cast("long")).alias("used_documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("available_tokens"))
    wanted = spark.createDataFrame([(s, w, c) for s, (w, c) in want.items()], "source string, target_share double, max_repeats int")
    every = mixed.agg(F.sum("tokens").alias("every"))
    out = have.join(wanted, "source", "full_outer").join(mixed, "source", "left").join(F.broadcast(every), F.lit(True))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "available_tokens", "used_documents", "copies", "tokens", "most_copies")}
    return out.withColumns(zero).select("source", "target_share", F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("achieved_share"), "max_repeats", *zero)
