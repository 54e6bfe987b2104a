"""Rules that count expressions and fire where they stand densely: hits, distinct forms, and words for each hit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import EXPRESSIONS
from ..functions.phrases import Phrases
from ..functions.text import folded, n_words, phrase_hits
from ..session import ship


class Density(NamedTuple):
    """A rule fires from so many hits on, in so many forms, if there is a hit in each so many words (0: any number)."""

    least: int
    forms: int
    words_per_hit: int
    quoted: bool = False


#: The limits of each rule.
LIMITS = {
    "VIBE002": Density(2, 2, 300),
    "VIBE003": Density(6, 1, 80, quoted=True),
    "VIBE004": Density(7, 1, 70),
    "VIBE006": Density(5, 1, 100),
    "VIBE012": Density(8, 1, 80),
    "VIBE013": Density(5, 4, 120),
    "VIBE014": Density(4, 3, 150),
    "VIBE015": Density(4, 1, 0),
    "VIBE019": Density(1, 1, 0),
    "VIBE022": Density(6, 4, 100),
    "VIBE023": Density(5, 3, 120),
    "VIBE024": Density(2, 2, 400),
    "VIBE025": Density(2, 2, 300),
    "VIBE026": Density(1, 1, 0),
    "VIBE028": Density(3, 2, 200),
    "VIBE030": Density(5, 3, 150),
    "VIBE031": Density(5, 3, 120),
    "VIBE034": Density(2, 2, 400),
}


def fires(rule: str, hits: Column, forms: Column, n: Column, limits: dict[str, Density] = LIMITS) -> Column:
    x = limits[rule]
    dense = hits * x.words_per_hit >= n if x.words_per_hit else F.lit(True)
    return (hits >= x.least) & (forms >= x.forms) & dense & (n > 0)


HITS = "array<struct<rule_id: string, hits: bigint, forms: bigint>>"


def measure(df: DataFrame, key: str, text: str, rules: list[str], lexicons: dict[str, tuple[str, ...]] = EXPRESSIONS) -> DataFrame:
    """key, rule_id, hits, forms, words, fires: a row for each rule that has a hit. One automaton finds the expressions of
    all rules in one pass over each text, in Arrow batches; rules become an array of the row, so nothing is shuffled.
    Null text has no row."""
    ship(df.sparkSession)
    find = Phrases({r: lexicons[r] for r in rules if not LIMITS[r].quoted}, {r: lexicons[r] for r in rules if LIMITS[r].quoted})
    kind = pa.list_(pa.struct([("rule_id", pa.string()), ("hits", pa.int64()), ("forms", pa.int64())]))

    @F.arrow_udf(HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t is None else [{"rule_id": r, "hits": len(h), "forms": len(set(h))} for r, h in find(t).items()] for t in b.to_pylist()], type=kind)

    once = df.select(F.col(key), F.col(text).alias("_t"), run.asNondeterministic()(F.col(text)).alias("_h")).where(F.size("_h") > 0)
    each = once.select(F.col(key), n_words(F.col("_t")).alias("words"), F.explode("_h").alias("x"))
    fire = F.coalesce(*(F.when(F.col("x.rule_id") == r, fires(r, F.col("x.hits"), F.col("x.forms"), F.col("words"))) for r in rules))
    return each.select(key, "x.rule_id", "x.hits", "x.forms", "words", fire.alias("fires"))


ONE_HAND, OTHER_HAND = ("on the one hand",), ("on the other hand",)


def balance(df: DataFrame, key: str, text: str) -> DataFrame:
    """VIBE005: key, pairs, stock of texts where complete pairs of hands and stock phrases of balance make two or more."""
    once = df.select(F.col(key), folded(F.col(text)).alias("_folded"))
    n = lambda phrases: F.size(phrase_hits(F.col("_folded"), phrases)).cast("bigint")
    rows = once.select(key, F.least(n(ONE_HAND), n(OTHER_HAND)).alias("pairs"), n(EXPRESSIONS["VIBE005"]).alias("stock"))
    return rows.where(F.col("pairs") + F.col("stock") >= 2)
