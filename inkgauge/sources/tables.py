"""Inputs as DataFrames: parquet tables, folders of files, commit logs, diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folder(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 1_000_000) -> DataFrame:
    """path, bytes, length of the files below a folder; the reader prunes by length before it reads contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.where(F.col("length") <= max_bytes).select("path", F.col("content").alias("bytes"), "length")


def history(log: DataFrame, column: str = "value") -> DataFrame:
    """path, sha, source, from_history, ord of a log of pairs (hash, message) separated by NUL characters; a hash that
    isn't one, or half a pair, is an error."""
    parts = F.split(F.regexp_replace(F.col(column), r"\x00\z", ""), r"\x00")
    odd = (F.length(column) > 0) & (F.size(parts) % 2 == 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(parts[i * 2].alias("sha"), parts[i * 2 + 1].alias("source")))
    rows = log.where(F.length(column) > 0).select(F.posexplode(F.when(odd, F.raise_error(F.lit("half a pair in the log"))).otherwise(pairs)).alias("ord", "c"))
    sha = F.when(F.trim("c.sha").rlike("^[0-9a-f]{40}$"), F.trim("c.sha")).otherwise(F.raise_error(F.concat(F.lit("no commit hash: "), F.col("c.sha"))))
    return rows.select(F.concat(F.lit("commit/"), sha).alias("path"), sha.alias("sha"), F.col("c.source").alias("source"), F.lit(True).alias("from_history"), "ord")


def hunks(patches: DataFrame) -> DataFrame:
    """path, start_line, end_line of the added lines of patches (path, patch) without context; a missing count is 1."""
    heads = F.regexp_extract_all(F.col("patch"), F.lit(r"(?m)^(@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"), F.lit(1))
    rows = patches.select("path", F.explode(heads).alias("h"))
    start = F.regexp_extract("h", r"\+(\d+)", 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("h", r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return rows.select("path", start.alias("start_line"), (start + count - 1).alias("end_line"), count.alias("n")).where("n > 0").drop("n")


def git_log(spark: SparkSession, repository: str, revisions: str, most: int = 50) -> DataFrame:
    """The newest messages of a range of a local repository, read on the driver."""
    out = subprocess.run(["git", "-C", repository, "log", "-z", "--format=%H%x00%B", "--max-count", str(most), revisions], check=True, capture_output=True, text=True).stdout
    return history(spark.createDataFrame([(out,)], "value string"))


def one_file(spark: SparkSession, path: str, text: str) -> DataFrame:
    """path, bytes of a buffer that is scanned under a file's name."""
    return spark.createDataFrame([(path, bytearray(text.encode()))], "path string, bytes binary")


def commit_message(spark: SparkSession, path: str) -> DataFrame:
    """path, source, from_history of the message in a file, as a commit hook gets it."""
    with open(path, encoding="utf-8", errors="replace") as f:
        return spark.createDataFrame([(path, f.read(), False)], "path string, source string, from_history boolean")


def _git(repository: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True).stdout


def git_staged(spark: SparkSession, repository: str) -> DataFrame:
    """path, bytes of what is staged in a local repository: files added, copied, changed or renamed, as the index has them."""
    names = [n for n in _git(repository, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR").decode().split("\0") if n]
    return spark.createDataFrame([(n, bytearray(_git(repository, "show", f":{n}"))) for n in names], "path string, bytes binary")


def git_changed(spark: SparkSession, repository: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """path, bytes of the files that differ from the index, or from where the head left ``base``, and path, start_line,
    end_line of their added lines."""
    span = [f"{base}...HEAD"] if base else []
    names = [n for n in _git(repository, "diff", "--name-only", "-z", "--diff-filter=ACMR", *span).decode().split("\0") if n]

    def content(n: str) -> bytes:
        if base:
            return _git(repository, "show", f"HEAD:{n}")
        with open(f"{repository}/{n}", "rb") as f:
            return f.read()

    patches = [(n, _git(repository, "diff", "--unified=0", *span, "--", n).decode(errors="replace")) for n in names]
    files = spark.createDataFrame([(n, bytearray(content(n))) for n in names], "path string, bytes binary")
    return files, hunks(spark.createDataFrame(patches, "path string, patch string"))


def displayed(path: Column, folder: str) -> Column:
    """The path relative to a folder, if it lies below it."""
    head = folder.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 2**31 - 1)).otherwise(path)


def attributes(files: DataFrame) -> DataFrame:
    """dir, ord, pattern, attribute, value of the attribute files among files (path, text): whether a path is vendored or
    generated. A minus sign or ``=false`` takes an attribute back."""
    lines = files.where(F.element_at(F.split("path", "/"), -1) == ".gitattributes").select(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("dir"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    parts = lines.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')").select("dir", "ord", F.split("line", r"\s+").alias("p"))
    each = parts.select("dir", "ord", F.col("p")[0].alias("pattern"), F.explode(F.slice("p", 2, 100_000)).alias("a"))
    out = each.select("dir", "ord", "pattern", F.regexp_extract("a", r"^-?linguist-(vendored|generated)(?:=\w+)?$", 1).alias("attribute"), (~F.col("a").startswith("-") & ~F.lower("a").endswith("=false")).alias("value"))
    return out.where("attribute <> ''")


def attributed(paths: DataFrame, rows: list) -> DataFrame:
    """paths with the columns vendored and generated, by attribute rows collected from the project's few attribute files;
    the deeper file and the later line win."""
    for name in ("vendored", "generated"):
        hits = [F.when(F.col("path").startswith(r["dir"]) & F.substring("path", len(r["dir"]) + 1, 2**31 - 1).rlike(glob_pattern(r["pattern"])), F.lit(r["value"])) for r in sorted((r for r in rows if r["attribute"] == name), key=lambda r: (-r["dir"].count("/"), -r["ord"]))]
        paths = paths.withColumn(name, F.coalesce(*hits, F.lit(False)))
    return paths


def path_matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether globs include a path (an empty list includes all) and none excludes it; ** spans folders. Of a list, the
    last glob that matches counts, and one with an exclamation mark takes back what earlier ones took."""

    def last(globs: list[str]) -> Column:
        return F.coalesce(*(F.when(path.rlike(glob_pattern(g.removeprefix("!"))), F.lit(not g.startswith("!"))) for g in reversed(globs)), F.lit(False))

    return (last(include) if include else F.lit(True)) & ~(last(exclude) if exclude else F.lit(False))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: anchored if it has a slash before its end, else of any folder."""
    body, i, out = glob.strip("/"), 0, ""
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}()|[]\\" else c), i + 1
    head = "^" if "/" in glob.rstrip("/") else "^(?:.*/)?"
    return head + out + ("/.*$" if glob.endswith("/") else "(?:/.*)?$")
