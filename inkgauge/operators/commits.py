"""Commit messages: the subject, placeholder subjects, autosquash commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subjects that say nothing, and marks of commits that wait to be folded.
PLACEHOLDERS = ("wip", "work in progress", "fix", "update", "changes", "misc", "tmp", "temp", "checkpoint")
AUTOSQUASH = ("fixup!", "squash!", "amend!")


def subject(message: Column) -> Column:
    """The first line that is neither blank nor a comment; empty if there is none."""
    lines = F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    return F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))


def plain(text: Column) -> Column:
    """Lowercase, white space collapsed, marks at either end removed."""
    bare = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    return F.lower(F.regexp_replace(bare, r"\s+", " "))


def commit_findings(commits: DataFrame) -> DataFrame:
    """path, rule_id, evidence of commits (path, source, from_history). Null messages have no row; a message without a
    subject is a placeholder."""
    s = subject(F.col("source"))
    rows = commits.where(F.col("source").isNotNull()).withColumn("subject", s).withColumn("p", plain(F.col("subject")))
    squash = F.exists(F.array(*map(F.lit, AUTOSQUASH)), lambda m: (F.col("subject") == m) | F.col("subject").startswith(F.concat(m, F.lit(" "))))
    placeholder = F.when((F.col("p") == "") | F.col("p").isin(*PLACEHOLDERS), F.lit("TRAIL001"))
    left = F.when(F.col("from_history") & squash, F.lit("TRAIL002"))
    found = rows.select("path", F.explode(F.array_compact(F.array(placeholder, left))).alias("rule_id"), "subject")
    return found.select("path", "rule_id", F.when(F.col("subject") == "", F.lit("<empty subject>")).otherwise(F.col("subject")).alias("evidence"))
