"""Repetition inside a single text (problem 2).

``repeat_stats`` measures four statistics of each text: letters in repeated sentences or lines, weight of the most
frequent word trigram, words that stand there more than once, and what compression saves. ``mcd`` then estimates, for
each language and source, the minimum-covariance-determinant centre and scatter of the transformed statistics: C-steps
over all rows from several starts, each keeping the part ``KEEP`` of a group's rows nearest the current centre and
taking their mean and covariance until the determinant settles; the start with the least determinant wins, and a factor
makes it consistent for normal data. Rows beyond the chi-square limit of the Mahalanobis distance, on the side of more
repetition, are outliers. ``p2_found`` takes the outliers; an exact check on each follows: at least half of its letters
have to lie in second or later copies of a letter run (``copy_share``, which is no part of the vector).

A letter run has 2 + 2/3 * log2(letters) letters, so that chance repeats it about as rarely in a text of any length.
Groups are shrunk towards the estimate of all rows together by SHRINK rows' weight, so a small group has a scatter, too.

Letters are compared without case, spacing and punctuation; figures and rulings don't count. Defined results: null,
empty or letterless texts have all shares 0 and are never outliers. Redelivered rows are found once. A text of any
length is read whole; runs are kept in a set, so time and memory grow with its length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, staged
from .lang import DENSE_OR_THAI, NOT_LETTER, WORD, Voter, function_words
from .prose import documentation
from .rows import with_struct

SHARES = ("unit_share", "trigram_share", "word_share", "saved_share")
STATS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_letters", T.LongType())] + [T.StructField(k, T.DoubleType()) for k in ("copy_share", *SHARES)])
#: The share of a group's rows nearest the centre that a C-step keeps, the most steps, and when the determinant settles.
KEEP, STEPS, SETTLED = 0.75, 12, 0.02
#: Bins of a histogram of distances for each factor of e.
BINS = 32
#: The smallest variance, since most statistics of ordinary texts are exactly zero; the weight of all rows in a group.
LEAST_VARIANCE, SHRINK = 1e-3, 50.0
#: Fixed value: the 0.975 quantile of the chi-square distribution with four degrees of freedom.
LIMIT = 11.143
#: Languages times sources; more groups than this are a mistake in the input.
MAX_GROUPS = 2_000
#: At least this share of the letters in copies makes a case.
LEAST_SHARE = 0.5

UNIT = re.compile(r"(?<=[.!?।؟;。！？…])\s*|\n+")


def run_length(n: int) -> int:
    """The letters of a run in a text of n letters."""
    return 2 + math.ceil(2 * math.log2(max(2, n)) / 3)


def copy_share(s: str) -> float:
    """The share of the letters s that lie in second or later copies of a run of letters."""
    n = run_length(len(s))
    m = len(s) - n + 1
    if m < 2:
        return 0.0
    seen = {s[i : i + n] for i in range(m)}
    if len(seen) == m:
        return 0.0
    seen = set()
    until = total = 0
    for i in range(m):
        g = s[i : i + n]
        if g in seen:
            total += i + n - (until if until > i else i)
            until = i + n
        else:
            seen.add(g)
    return total / len(s)


def measure(text: str | None, vote: Voter) -> dict:
    out = dict.fromkeys(("copy_share", *SHARES), 0.0) | {"lang": None, "n_letters": 0}
    low = (text or "").casefold()
    s = NOT_LETTER.sub("", low)
    if not s:
        return out
    out["lang"], out["n_letters"], out["copy_share"] = vote(text), len(s), copy_share(s)
    units = Counter(x for x in (NOT_LETTER.sub("", u) for u in UNIT.split(low)) if x)
    out["unit_share"] = sum(len(u) * (k - 1) for u, k in units.items()) / len(s)
    # in scripts without spaces each sign counts as a word
    words = WORD.findall(DENSE_OR_THAI.sub(r" \g<0> ", low) if DENSE_OR_THAI.search(low) else low)
    if words:
        out["word_share"] = 1 - len(set(words)) / len(words)
    if len(words) > 3:
        k = Counter(zip(words, words[1:], words[2:])).most_common(1)[0][1]
        out["trigram_share"] = min(1.0, 3 * (k - 1) / (len(words) - 2))
    raw = s.encode()
    out["saved_share"] = max(0.0, 1 - (len(zlib.compress(raw, 1)) - 8) / len(raw))
    return out


def repeat_stats(df: DataFrame, words: dict[str, list[str]], text: str = "text", into: str = "stats") -> DataFrame:
    """df with the struct ``into`` (see STATS) of the column ``text``."""
    vote = Voter(words)
    return with_struct(df, text, into, STATS, lambda t: measure(t, vote))


def chi_square(x: float, half: int) -> float:
    """The distribution function with 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))


def consistency(keep: float, p: int) -> float:
    """What the scatter of the nearest part of normal rows has to be multiplied by; p is even."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if chi_square(x, p // 2) < keep else (low, x)
    return keep / chi_square(low, p // 2 + 1)


Fit = dict[str, tuple[np.ndarray, np.ndarray]]
FITS = "_g string, _f array<struct<s: int, m: array<double>, w: array<double>, cut: double>>"


def mcd(df: DataFrame, group: list[str], columns: list[str], keep: float = KEEP, steps: int = STEPS) -> DataFrame:
    """df with ``distance``, the squared Mahalanobis distance of the columns (arcsine of the root, for shares; an even
    number of them) from the robust centre of the row's group, and ``above``, whether the columns lie above that centre
    in sum. Only sums and histograms of groups leave the executors."""
    x = [F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))))) for c in columns]
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group))
    p = len(columns)
    rows = df.withColumn("_g", key).withColumns({f"_x{i}": c for i, c in enumerate(x)})
    work = staged(rows.select("_g", *(f"_x{i}" for i in range(p))))
    own = [F.col(f"_x{i}") for i in range(p)]
    spark = df.sparkSession
    ship(spark)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = sum(((own[i] - F.col("f.m")[i]) * (own[j] - F.col("f.m")[j]) * F.col("f.w")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))

    def floor(s: np.ndarray) -> np.ndarray:
        return s + np.eye(p) * LEAST_VARIANCE

    def bounded(found: DataFrame, each: int) -> list:
        got = found.limit(MAX_GROUPS * each + 1).collect()
        if len(got) > MAX_GROUPS * each:
            raise ValueError(f"more than {MAX_GROUPS} groups")
        return got

    def against(to: DataFrame, fits: list[Fit], cuts: list[dict[str, float]] | None = None) -> DataFrame:
        """Each row beside the centre and inverse scatter of its group, for each start: a table of at most MAX_GROUPS rows."""
        table = [(g, [(k, f[g][0].tolist(), np.linalg.inv(f[g][1]).ravel().tolist(), cuts[k][g] if cuts else 0.0) for k, f in enumerate(fits)]) for g in fits[0]]
        return to.join(F.broadcast(spark.createDataFrame(table, FITS)), "_g")

    names = [f"m{i}" for i in range(p)] + [f"s{i}_{j}" for i, j in pairs]
    kind = pa.schema([("_g", pa.string()), ("_s", pa.int32()), ("n", pa.int64()), *((k, pa.float64()) for k in names)])

    def partial(fits: list[Fit] | None, cuts: list[dict[str, float]] | None) -> DataFrame:
        """Sums over the rows of each group, for each start over those within its cut; a few rows for each batch."""
        inverse = [{g: (m, np.linalg.inv(s)) for g, (m, s) in f.items()} for f in fits or []]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = b["_g"].dictionary_encode()
                code, v = of.indices.to_numpy(), np.column_stack([b[f"_x{i}"].to_numpy() for i in range(p)])
                out = []
                for k, g in enumerate(of.dictionary.to_pylist()):
                    mine = v[code == k]
                    for start in range(len(inverse) or 1):
                        near = mine
                        if inverse:
                            m, w = inverse[start][g]
                            near = mine[np.einsum("ni,ij,nj->n", mine - m, w, mine - m) <= cuts[start][g]]
                        second = near.T @ near
                        out.append((g, start, len(near), *near.sum(0).tolist(), *(float(second[i, j]) for i, j in pairs)))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*out)))), schema=kind)

        return work.mapInArrow(run, "_g string, _s int, n long, " + ", ".join(f"{k} double" for k in names))

    def moments(sums: DataFrame, starts: int) -> tuple[list[Fit], dict[str, int]]:
        """Mean and covariance of each group and start."""
        out: list[Fit] = [{} for _ in range(starts)]
        got = bounded(sums.groupBy("_g", "_s").agg(*(F.sum(k).alias(k) for k in ("n", *names))), starts)
        for r in got:
            if r["n"]:
                m = np.array([r[f"m{i}"] for i in range(p)]) / r["n"]
                out[r["_s"]][r["_g"]] = (m, floor(np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r["n"] - np.outer(m, m)))
        return out, {r["_g"]: r["n"] for r in got}

    def nearest(fits: list[Fit]) -> list[dict[str, float]]:
        """The distance within which the part ``keep`` of each group lies, from a histogram with bins of three per cent."""
        bins = against(work, fits).select("_g", F.explode("_f").alias("f"), *own).select("_g", F.col("f.s").alias("_s"), F.floor(F.log(F.least(F.greatest(d, F.lit(1e-6)), F.lit(1e9))) * BINS).cast("int").alias("b"))
        of: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for r in bounded(bins.groupBy("_g", "_s", "b").count(), len(fits) * 36 * BINS):
            of.setdefault((r["_s"], r["_g"]), []).append((r["b"], r["count"]))
        out: list[dict[str, float]] = [{} for _ in fits]
        for (k, g), counts in of.items():
            due = keep * sum(n for _, n in counts)
            for b, n in sorted(counts):
                due -= n
                if due <= 0:
                    out[k][g] = math.exp((b + 1) / BINS)
                    break
        return out

    (whole,), sizes = moments(partial(None, None), 1)
    if not sizes:
        return df.withColumn("distance", F.lit(0.0)).withColumn("above", F.lit(False))
    quartiles = work.groupBy("_g").agg(*(F.percentile_approx(own[i], [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(p))).collect()
    at = {r["_g"]: np.array([r[f"q{i}"] for i in range(p)]) for r in quartiles}
    spread = {g: floor(np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2)) for g, q in at.items()}
    # around the medians; around them with the shape of all rows; around the lower quartiles, where the plainest texts are
    fits: list[Fit] = [{g: (q[:, 1], spread[g]) for g, q in at.items()}, {g: (q[:, 1], whole[g][1]) for g, q in at.items()}, {g: (q[:, 0], spread[g]) for g, q in at.items()}]
    before: list[dict[str, float]] = []
    for _ in range(steps):
        cuts = nearest(fits)
        fits, _n = moments(partial(fits, cuts), len(fits))
        now = [{g: float(np.linalg.det(s)) for g, (_, s) in f.items()} for f in fits]
        if before and all(abs(now[k][g] - before[k][g]) <= SETTLED * before[k][g] for k in range(len(fits)) for g in now[k]):
            break
        before = now
    best = {g: min((f[g] for f in fits), key=lambda v: float(np.linalg.det(v[1]))) for g in sizes}
    factor = consistency(keep, p)
    n = sum(sizes.values())
    centre = sum(sizes[g] * m for g, (m, _) in best.items()) / n
    scatter = sum(sizes[g] * s for g, (_, s) in best.items()) / n
    best = {g: ((sizes[g] * m + SHRINK * centre) / (sizes[g] + SHRINK), factor * (sizes[g] * s + SHRINK * scatter) / (sizes[g] + SHRINK)) for g, (m, s) in best.items()}
    out = against(rows, [best]).withColumn("f", F.col("_f")[0]).withColumn("distance", d).withColumn("above", sum((own[i] - F.col("f.m")[i] for i in range(p)), F.lit(0.0)) > 0)
    return out.select(*df.columns, "distance", "above")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, source, rec_id, text: the prose of documentation and text, and the findings' evidence."""
    contexts = documentation(spark, sf_dir).select(F.lit("context").alias("rec_kind"), F.coalesce("kind", F.lit("docs")).alias("source"), F.col("ctx_id").alias("rec_id"), F.col("prose").alias("text"))
    findings = spark.read.parquet(f"{sf_dir}/findings.parquet").select(F.lit("finding").alias("rec_kind"), F.lit("evidence").alias("source"), F.col("finding_id").alias("rec_id"), F.col("evidence").alias("text"))
    return contexts.unionByName(findings)


def p2_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repetition statistics of every record, with the distance from its group's robust centre."""
    stats = repeat_stats(records(spark, sf_dir), function_words(spark, sf_dir)).select("rec_kind", "source", "rec_id", "stats.*")
    return mcd(staged(stats), ["lang", "source"], list(SHARES)).drop("source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id: robust outliers; the exact check leaves those of whose letters at least half lie in copies."""
    rows = p2_stats(spark, sf_dir).where((F.col("distance") > LIMIT) & F.col("above") & (F.col("copy_share") >= LEAST_SHARE))
    return rows.select("rec_kind", "rec_id").distinct()
