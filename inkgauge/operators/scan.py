"""The scan: files through views and all rules to findings with places and evidence, then directives, severities, order
and summary. A file is read by one pass of an Arrow batch; only findings leave it, so nothing is shuffled before the
directives are matched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.views import views
from ..session import ship
from .code_rules import code_findings
from .findings import suppressed, suppressions
from .prose_rules import prose_findings

FOUND = T.ArrayType(
    T.StructType([T.StructField(k, T.StringType()) for k in ("rule_id", "evidence", "observation")] + [T.StructField(k, T.IntegerType()) for k in ("line_no", "col_no", "end_line_no", "end_col_no")])
)
#: The rules whose severity isn't warning, and whose confidence isn't medium.
ERRORS = ("DEAD001", "DEAD003", "DEAD010", "DEAD016", "TRAIL002")
INFOS = ("VIBE007", "VIBE008", "VIBE010", "VIBE011", "VIBE018", "VIBE030", "VIBE035", "DEAD008", "DEAD013")
HIGH = ("VIBE002", "VIBE009", "VIBE016", "VIBE017", "VIBE019", "VIBE027", "DEAD001", "DEAD002", "DEAD003", "DEAD004", "DEAD007", "DEAD009", "DEAD010", "DEAD014", "DEAD016", "TRAIL001", "TRAIL002")
LOW = ("VIBE010", "VIBE018", "VIBE035")


def place(source: str, at: int) -> tuple[int, int, int, int, str]:
    """One-based line and column of a place, those of the end of its line's text, and that line without white space."""
    begin, end = source.rfind("\n", 0, at) + 1, source.find("\n", at)
    line = source[begin : end if end >= 0 else len(source)].rstrip()
    n = source.count("\n", 0, at) + 1
    return n, at - begin + 1, n, max(len(line), at - begin) + 1, line.strip()


def scan_file(path: str, source: str, kind: str, language: str | None) -> list[dict]:
    source = source.replace("\r\n", "\n")
    lines = [0]
    for x in source.split("\n"):
        lines.append(lines[-1] + len(x) + 1)
    found = [(rule, at, said) for rule, at, _, said in prose_findings(path, views(source, kind, language, path)["prose"], source, kind)]
    for rule, n in code_findings(path, source, kind, language):
        at = lines[n - 1]
        found.append((rule, at + len(source[at : lines[n] - 1]) - len(source[at : lines[n] - 1].lstrip()), None))
    out = []
    for rule, at, said in found:
        n, col, end, end_col, evidence = place(source, at)
        out.append({"rule_id": rule, "evidence": evidence, "observation": said, "line_no": n, "col_no": col, "end_line_no": end, "end_col_no": end_col})
    return out


def scan(df: DataFrame, key: str, overrides: dict[str, str] | None = None, off: tuple[str, ...] = ()) -> DataFrame:
    """key, path and the findings of df (key, path, source, kind, code_lang): those that no directive on their line or
    the one before leaves out, with the policy's severities; rules that are switched off are dropped where they arise.
    An unknown kind is read as documentation. Null sources have none."""
    ship(df.sparkSession)
    kind = to_arrow_type(FOUND)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[f for f in scan_file(x["path"] or "", x["source"], x["kind"] or "docs", x["code_lang"]) if f["rule_id"] not in off] if x["source"] else [] for x in b.to_pylist()], type=kind)

    packed = F.struct("path", "source", "kind", "code_lang")
    found = df.select(F.col(key), F.col("path"), F.explode(run.asNondeterministic()(packed)).alias("x")).select(key, "path", "x.*")
    # a path may occur in several rows, so directives are matched by the row's key
    keyed = F.col(key).cast("string")
    directives = suppressions(df.select(keyed.alias("path"), "source"))
    left = suppressed(found.withColumn("_path", F.col("path")).withColumn("path", keyed), directives).withColumn("path", F.col("_path")).drop("_path")
    usual = F.when(F.col("rule_id").isin(*ERRORS), "error").when(F.col("rule_id").isin(*INFOS), "info").otherwise("warning")
    table = F.create_map(*(F.lit(x) for kv in sorted((overrides or {}).items()) for x in kv)) if overrides else None
    level = F.coalesce(table[F.col("rule_id")], usual) if overrides else usual
    confidence = F.when(F.col("rule_id").isin(*HIGH), "high").when(F.col("rule_id").isin(*LOW), "low").otherwise("medium")
    return left.withColumn("severity", level).withColumn("confidence", confidence).withColumn("module_name", F.regexp_extract("rule_id", "^[A-Z]+", 0))


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row: scanned files, findings, and findings by severity."""
    n = files.agg(F.count("*").alias("scanned_files"))
    by = findings.agg(F.count("*").alias("findings"), *(F.count(F.when(F.col("severity") == s, 1)).alias(f"{s}s") for s in ("error", "warning", "info")))
    return n.withColumn("_", F.lit(1)).join(by.withColumn("_", F.lit(1)), "_").drop("_")
