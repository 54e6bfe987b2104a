"""Rules on the order of sentences and paragraphs. Each text's units are numbered and windows run within the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import STOP_WORDS
from ..functions.text import n_words, paragraphs, sentences, words


def paragraph_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, p, text, n: the paragraphs with their words."""
    return df.select(key, F.posexplode(paragraphs(F.col(text))).alias("p", "text")).withColumn("n", n_words(F.col("text")))


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, p, s, text, n: the sentences, numbered through the paragraph."""
    rows = paragraph_rows(df, key, text).select(key, "p", F.posexplode(sentences(F.col("text"))).alias("s", "text"))
    return rows.withColumn("n", n_words(F.col("text")))


def once(df: DataFrame, key: str, c: Column, name: str) -> DataFrame:
    """key and the column, computed once for each row: behind a generator the optimizer doesn't repeat it at each use."""
    return df.select(key, F.explode(F.array(c)).alias(name))


def even_runs(df: DataFrame, key: str, counts: Column, least: int, length: int, tolerance) -> DataFrame:
    """key, first_ord, low, high: the first stretch of ``length`` units of at least ``least`` words whose lengths differ
    by no more than tolerance(low); shorter units are passed over. The counts are an array of the row, so windows never
    leave it and nothing is shuffled."""
    kept = once(df, key, F.filter(counts, lambda n: n >= least), "_n")
    starts = F.when(F.size("_n") >= length, F.sequence(F.lit(1), F.size("_n") - (length - 1))).otherwise(F.array().cast("array<int>"))
    ahead = F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("ord"), F.array_min(F.slice("_n", i, length)).alias("low"), F.array_max(F.slice("_n", i, length)).alias("high")))
    first = kept.select(key, F.get(F.filter(ahead, lambda w: w["high"] - w["low"] <= tolerance(w["low"])), F.lit(0)).alias("f")).where("f is not null")
    return first.select(key, F.col("f.ord").alias("first_ord"), F.col("f.low").alias("low"), F.col("f.high").alias("high"))


def rhythm(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE010: eight sentences in a row of nearly the same length."""
    return even_runs(df, key, F.flatten(F.transform(paragraphs(F.col(text)), lambda p: F.transform(sentences(p), n_words))), 8, 8, lambda low: F.lit(3))


def symmetry(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE018: five paragraphs in a row of nearly the same length."""
    return even_runs(df, key, F.transform(paragraphs(F.col(text)), n_words), 20, 5, lambda low: F.greatest(F.floor(low / 5), F.lit(4)))


def restated(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE017: neighbouring sentences with nearly the same words. key, p, s, common, together. Neighbours are compared
    within the row of their paragraph."""
    content = lambda c: F.array_distinct(F.filter(words(c), lambda w: ~w.isin(*STOP_WORDS)))
    rows = df.select(key, F.posexplode(paragraphs(F.col(text))).alias("p", "t"))
    rows = rows.select(key, "p", F.explode(F.array(F.transform(sentences(F.col("t")), content))).alias("w")).where(F.size("w") > 1)
    both = lambda i, f: F.size(f(F.get("w", i - 1), F.get("w", i))).cast("bigint")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.when((F.size(F.get("w", i)) >= 7) & (F.size(F.get("w", i - 1)) >= 7), F.struct(i.cast("bigint").alias("s"), both(i, F.array_intersect).alias("common"), both(i, F.array_union).alias("together"))))
    out = rows.select(key, F.col("p").cast("bigint").alias("p"), F.explode(F.array_compact(pairs)).alias("x")).select(key, "p", "x.*")
    return out.where((F.col("common") >= 7) & (F.col("common") * 4 >= F.col("together") * 3))


def openings(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE009: the most frequent first two words of the sentences of at least four words, where they open half of
    them; ties go to the earliest, then the smaller. key, opening, n, sentences."""
    two = F.array_join(F.slice(words(F.col("text")), 1, 2), " ")
    rows = sentence_rows(df, key, text).where("n >= 4").select(key, two.alias("opening"), F.struct("p", "s").alias("at"))
    groups = rows.groupBy(key, "opening").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    scope = Window.partitionBy(key)
    ranked = groups.withColumn("sentences", F.sum("n").over(scope)).withColumn("r", F.row_number().over(scope.orderBy(F.desc("n"), "at", "opening")))
    return ranked.where((F.col("r") == 1) & (F.col("n") >= 4) & (F.col("sentences") >= 6) & (F.col("n") * 2 >= F.col("sentences"))).select(key, "opening", "n", "sentences")


def dashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE007: at least five em dashes, one in each hundred words."""
    n = (F.length(text) - F.length(F.replace(F.col(text), F.lit("—")))).cast("bigint")
    rows = df.select(key, n.alias("dashes"), n_words(F.col(text)).alias("words"))
    return rows.where((F.col("dashes") >= 5) & (F.col("dashes") * 100 >= F.col("words")) & (F.col("words") > 0))


def duplicate_lines(df: DataFrame, key: str, text: str, block: int = 10, least_bytes: int = 180) -> DataFrame:
    """DEAD011's candidates: stretches of ``block`` non-blank lines that stand twice in a text, compared without white
    space. key, first_line, repeat_line (one-based); overlapping copies are left out."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "raw"))
    squeezed = lines.select(key, (F.col("i") + 1).cast("bigint").alias("line"), F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("t"))
    ahead = Window.partitionBy(key).orderBy("line").rowsBetween(0, block - 1)
    run = squeezed.select(key, "line", F.array_join(F.collect_list("t").over(ahead), "\n").alias("body"), F.sum((F.col("t") != "").cast("int")).over(ahead).alias("full"))
    run = run.where((F.col("full") == block) & (F.octet_length("body") >= least_bytes)).select(key, "line", F.xxhash64("body").alias("h"))
    first = Window.partitionBy(key, "h")
    pairs = run.withColumn("first_line", F.min("line").over(first)).where(F.col("line") >= F.col("first_line") + block)
    return pairs.groupBy(key, "first_line").agg(F.min("line").alias("repeat_line"))
