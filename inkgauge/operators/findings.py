"""Relational operators on findings: delivery, policy, changed lines, suppression, counts, facets, differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in order, and the spelling that means one of them.
SEVERITIES = ("info", "warning", "error")
RULE_ID = r"^(?:DEAD|VIBE)\d{3}$"
DIRECTIVE = r"inkgauge: ignore ([^\n]*?)--([^\n]*)"


def severity(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "warn", F.lit("warning")).when(s.isin(*SEVERITIES), s)


def severity_rank(c: Column) -> Column:
    return F.coalesce(*(F.when(severity(c) == s, F.lit(i)) for i, s in enumerate(SEVERITIES)))


def latest(findings: DataFrame, *columns: str) -> DataFrame:
    """Each finding once, as delivered last; among rows that arrived together the greatest counts. Only the columns asked
    for (all, if none are) are read, moved and compared."""
    columns = [c for c in columns or findings.columns if c not in ("finding_id", "ingested_at")]
    order = F.struct("ingested_at", *columns)
    kept = [c for c in findings.columns if c in (*columns, "ingested_at")]
    return findings.groupBy("finding_id").agg(F.max(order).alias("r")).select("finding_id", *(F.col(f"r.{c}").alias(c) for c in kept))


def overridden(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """findings with the severity that the policy sets for their rule; confidence stays."""
    if not overrides:
        return findings
    table = F.create_map(*(F.lit(x) for kv in sorted(overrides.items()) for x in kv))
    return findings.withColumn("severity", F.coalesce(table[F.col("rule_id")], F.col("severity")))


def suppressions(sources: DataFrame, path: str = "path", text: str = "source") -> DataFrame:
    """path, line, rule_id of every directive that gives a reason; ids that are none are dropped one by one."""
    lines = sources.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "t")).where(F.col("t").rlike(DIRECTIVE))
    reason = F.trim(F.regexp_replace(F.trim(F.regexp_extract("t", DIRECTIVE, 2)), r"(?:-->|\*/)\s*\z", ""))
    ids = F.explode(F.split(F.regexp_extract("t", DIRECTIVE, 1), ",")).alias("id")
    rows = lines.where(reason != "").select("path", (F.col("i") + 1).alias("line"), ids)
    return rows.select("path", "line", F.trim("id").alias("rule_id")).where(F.col("rule_id").rlike(RULE_ID)).distinct()


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings without those whose rule a directive names on their line or the line before."""
    reach = directives.select("path", "rule_id", F.explode(F.array("line", F.col("line") + 1)).alias("line_no")).distinct()
    return findings.join(reach, ["path", "rule_id", "line_no"], "left_anti")


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """findings whose line lies in a changed range (path, start_line, end_line) of their path; the path is the key of
    the join, so ranges are compared within files only."""
    r = changed.select(F.col("path").alias("_p"), "start_line", "end_line")
    return findings.join(r, (F.col("path") == F.col("_p")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left_semi")


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"))


def facets(findings: DataFrame) -> DataFrame:
    """facet, value, n: counts by severity, module, rule and path in one pass (grouping sets)."""
    f = findings.select(severity(F.col("severity")).alias("severity"), F.col("module_name").alias("module"), F.col("rule_id").alias("rule"), "path")
    sets = f.groupingSets([[F.col(c)] for c in f.columns], *(F.col(c) for c in f.columns)).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in f.columns))
    facet = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in f.columns))
    value = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.col(c)) for c in f.columns))
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def with_occurrences(findings: DataFrame) -> DataFrame:
    """findings with ``occurrence``: the number of each among those of its rule, path and evidence, by place."""
    w = Window.partitionBy("rule_id", "path", F.trim(F.coalesce("evidence", F.lit("")))).orderBy("line_no", "col_no", "finding_id")
    return findings.withColumn("occurrence", F.row_number().over(w).cast("bigint"))


def fnv1a_128(values) -> list[str | None]:
    """The 128-bit FNV-1a hash of each string, as 32 hexadecimal figures. All strings of a batch advance byte by byte
    together, in four limbs of 32 bits."""
    raw = [(v or "").encode() for v in values]
    if not raw:
        return []
    size = np.array([len(r) for r in raw])
    order = np.argsort(-size, kind="stable")
    h = np.tile(np.array([0x6295C58D, 0x62B82175, 0x07BB0142, 0x6C62272E], np.uint64), (len(raw), 1))
    low32 = np.uint64(0xFFFFFFFF)
    lengths = size[order]
    width = 256
    for at in range(0, int(lengths[0]), width):  # blocks of bytes, so that one long string doesn't pad all others
        rows = int(np.searchsorted(-lengths, -at, side="left"))
        block = np.zeros((rows, width), np.uint8)
        for k in range(rows):
            part = raw[order[k]][at : at + width]
            block[k, : len(part)] = np.frombuffer(part, np.uint8)
        for j in range(min(width, int(lengths[0]) - at)):
            n = int(np.searchsorted(-lengths, -(at + j), side="left"))
            x = h[:n]
            a = x[:, 0] ^ block[:n, j]
            b, c, d = x[:, 1], x[:, 2], x[:, 3]
            # times 2**88 + 0x13b: the second product, and the first shifted by two limbs and 24 bits
            p0 = a * np.uint64(0x13B)
            p1 = b * np.uint64(0x13B) + (p0 >> np.uint64(32))
            p2 = c * np.uint64(0x13B) + (p1 >> np.uint64(32)) + ((a << np.uint64(24)) & low32)
            p3 = d * np.uint64(0x13B) + (p2 >> np.uint64(32)) + (a >> np.uint64(8)) + ((b << np.uint64(24)) & low32)
            h[:n] = np.stack([p0 & low32, p1 & low32, p2 & low32, p3 & low32], axis=1)
    out: list[str | None] = [None] * len(raw)
    for k, (a, b, c, d) in zip(order.tolist(), h.tolist()):
        out[k] = f"{d:08x}{c:08x}{b:08x}{a:08x}"
    return [None if v is None else o for v, o in zip(values, out)]


def digests(findings: DataFrame) -> DataFrame:
    """project, digest, n: a hash over the sorted places of a project's findings. Places are hashed in buckets of a
    bounded number first, so that no task holds a whole project's list: the digest is that of the buckets' digests."""
    place = F.concat_ws(":", "path", F.col("line_no").cast("string"), "rule_id")
    each = findings.select("project", place.alias("k")).groupBy("project", "k").agg(F.count("*").alias("c"))
    bucket = F.substring(F.sha2("k", 256), 1, 3)
    parts = each.groupBy("project", bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("#", "k", F.col("c").cast("string")))), "\n"), 256).alias("d"), F.sum("c").alias("n"))
    return parts.groupBy("project").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "d"))), "\n"), 256), 1, 16).alias("digest"), F.sum("n").alias("n"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, rule_id, before, after of what isn't alike in two sets of findings."""
    count = lambda df, name: df.groupBy("project", "rule_id").agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), ["project", "rule_id"], "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("before", "after")}
    return both.withColumns(zero).where("before <> after")


def failing(findings: DataFrame, level: str) -> bool:
    """Whether a finding reaches the level; stops at the first."""
    return not findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(level)).limit(1).isEmpty()


def in_order(findings: DataFrame) -> DataFrame:
    """By path, part by part, then line, column and rule."""
    return findings.orderBy(F.split("path", "/"), "line_no", "col_no", "rule_id", "finding_id")
