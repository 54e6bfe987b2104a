"""Filling containers of fixed capacity with documents (problem 7).

Sum-of-squares packing: each document goes where the sum of the squares of the numbers of open containers by remaining
gap becomes smallest, which keeps gaps of all sizes at hand. Only a document larger than the capacity is split, into
full containers and a rest that is packed like any other. The documents are dealt into shards of about SHARD_ROWS by
the hash of their id, and each shard is packed by one task; a shard leaves some containers open, so its size, not that
of the input, bounds both a task's work and the share of space that sharding costs.

Defined results: documents without tokens (null or empty text) take no space and are put into their shard's first
container, as piece 0 of 0 tokens. Rows that repeat an id are packed each on its own. An empty table gives no rows.
Profiles of null or non-positive capacity are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged
from .tokens import with_tokens

SHARD_ROWS = 50_000
MAX_PROFILES = 1_000
SCHEMA = "profile string, container_id long, doc_id long, piece int, start_token long, n_tokens long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, items taken in order; sizes lie between 1 and capacity."""
    n = np.zeros(capacity + 1, np.int64)  # open containers by gap; index capacity stands for a new one
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    big = np.iinfo(np.int64).max // 4
    for i, s in enumerate(sizes.tolist()):
        own = n[s:]
        # change of the sum, halved: one more container of the gap that is left, one less of the gap that is used
        cost = np.where(own > 0, n[: capacity - s + 1] - own + 1, big)
        cost[-1] = n[capacity - s]  # a new container
        if own[0] > 0:
            cost[0] = 1 - own[0]  # filled to the brim: nothing is left open
        elif s == capacity:
            cost[0] = 0
        gap = int(cost.argmin()) + s
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        left = gap - s
        if left:
            open_bins[left].append(b)
            n[left] += 1
        out[i] = b
    return out


def pack(df: DataFrame, profiles: dict[str, int], key: str = "doc_id", size: str = "n_tokens", shards: int | None = None) -> DataFrame:
    """profile, container_id, key, piece, start_token, n_tokens: the pieces of every document for every profile."""
    ship(df.sparkSession)
    shards = shards or max(1, -(-df.count() // SHARD_ROWS))

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        profile, shard = keys
        capacity = profiles[profile]
        rows = rows.sort_values(["h", "doc_id", "n_tokens"], kind="stable", ignore_index=True)
        sizes = rows["n_tokens"].to_numpy()
        full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
        rest = sizes - full * capacity
        some = rest > 0
        bins = np.zeros(len(rows), np.int64)
        bins[some] = sum_of_squares(rest[some], capacity)
        made = int(bins.max()) + 1 if len(rows) else 0
        of = np.repeat(np.arange(len(rows)), full)
        number = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
        whole = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[of], "piece": number, "start_token": number * capacity, "n_tokens": capacity, "bin": made + np.arange(len(of))})
        last = pd.DataFrame({"doc_id": rows["doc_id"], "piece": full, "start_token": full * capacity, "n_tokens": rest, "bin": bins})
        out = pd.concat([last, whole], ignore_index=True)
        out["profile"], out["container_id"] = profile, (np.int64(shard) << np.int64(40)) + out["bin"]
        return out[["profile", "container_id", "doc_id", "piece", "start_token", "n_tokens"]]

    names = [p for p, c in sorted(profiles.items()) if c and c > 0]
    h = F.xxhash64(F.col(key), F.lit(7))
    items = df.select(F.col(key).alias("doc_id"), F.col(size).alias("n_tokens"), h.alias("h"), F.pmod(h, F.lit(shards)).alias("shard"), F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("profile"))
    return items.groupBy("profile", "shard").applyInPandas(run, SCHEMA)


def profiles(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    rows = spark.read.parquet(f"{sf_dir}/pack_profiles.parquet").dropna().limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return {r["profile"]: r["capacity_tokens"] for r in rows}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, container_id, doc_id, piece, start_token, n_tokens: every document's place for each capacity."""
    sizes = staged(with_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens"))
    return pack(sizes, profiles(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, containers, tokens, fill: how full the containers of each profile are, all of them counted."""
    capacity = profiles(spark, sf_dir)
    of = F.create_map(*(x for p, c in capacity.items() for x in (F.lit(p), F.lit(c)))) if capacity else F.lit(None).cast("map<string,int>")
    used = p7_packed(spark, sf_dir).groupBy("profile", "container_id").agg(F.sum("n_tokens").alias("n"))
    totals = used.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return totals.withColumn("fill", F.col("tokens") / (F.col("containers") * of[F.col("profile")]))
