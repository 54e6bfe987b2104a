"""Findings as lines of reports (plain text, workflow commands, JSON, code quality, SARIF results, markup, editor messages)
and, for reports of a bounded size, as whole documents."""

from __future__ import annotations

import json
from html import escape
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .findings import fnv1a_128, severity, with_occurrences


def text_lines(findings: DataFrame) -> DataFrame:
    s = F.upper(severity(F.col("severity")))
    place = F.concat_ws(":", "path", F.col("line_no").cast("string"), F.col("col_no").cast("string"))
    return findings.select("finding_id", F.concat_ws("  ", place, "rule_id", s).alias("line"))


def _escaped(c: Column, more: bool = False) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *((":", "%3A"), (",", "%2C")) * more):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def workflow_commands(findings: DataFrame) -> DataFrame:
    """A workflow command for each finding; info is a notice."""
    level = F.when(severity(F.col("severity")) == "info", F.lit("notice")).otherwise(severity(F.col("severity")))
    head = F.concat(F.lit("::"), level, F.lit(" file="), _escaped(F.col("path"), True), F.lit(",line="), F.col("line_no").cast("string"), F.lit(",col="), F.col("col_no").cast("string"), F.lit(",title="), F.col("rule_id"))
    return findings.select("finding_id", F.concat(head, F.lit("::"), _escaped(F.coalesce("observation", F.lit("")))).alias("line"))


def json_lines(findings: DataFrame) -> DataFrame:
    place = F.struct(F.col("line_no").alias("line"), F.col("col_no").alias("column"), F.col("end_line_no").alias("end_line"), F.col("end_col_no").alias("end_column"))
    body = F.struct("path", place.alias("location"), "rule_id", F.col("module_name").alias("module"), severity(F.col("severity")).alias("severity"), "confidence", "evidence", "observation")
    return findings.select("finding_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def sarif_lines(findings: DataFrame) -> DataFrame:
    level = F.when(severity(F.col("severity")) == "info", F.lit("note")).otherwise(severity(F.col("severity")))
    region = F.struct(F.col("line_no").alias("startLine"), F.col("col_no").alias("startColumn"), F.col("end_line_no").alias("endLine"), F.col("end_col_no").alias("endColumn"))
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("observation", F.lit("")).alias("text")).alias("message"), where.alias("locations"))
    return findings.select("finding_id", F.to_json(body).alias("line"))


def code_quality(findings: DataFrame) -> DataFrame:
    """finding_id, severity, fingerprint: the fingerprint of rule, path, evidence and the number of its occurrence."""
    ship(findings.sparkSession)
    level = F.when(severity(F.col("severity")) == "info", F.lit("info")).when(severity(F.col("severity")) == "error", F.lit("major")).otherwise(F.lit("minor"))
    text = F.concat_ws("\0", "rule_id", "path", F.trim(F.coalesce("evidence", F.lit(""))), F.col("occurrence").cast("string"))

    @F.pandas_udf(T.StringType())
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_128(values))

    return with_occurrences(findings).select("finding_id", level.alias("severity"), hashed(text).alias("fingerprint"))


def summary(findings: DataFrame) -> DataFrame:
    s = severity(F.col("severity"))
    return findings.agg(F.count("*").alias("findings"), F.count_distinct("path").alias("paths"), F.count_distinct("rule_id").alias("rules"), *(F.sum((s == x).cast("long")).alias(x) for x in ("error", "warning", "info")))


#: Version and schema of the exchange format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
MAX_REPORT = 100_000


def _bounded(findings: DataFrame, most: int) -> list:
    """The findings of a report, in order. A document is one value, so it has a bound, which is refused when passed."""
    rows = findings.orderBy(F.split("path", "/"), "line_no", "col_no", "rule_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings are no single document; write their lines instead")
    return rows


def json_document(findings: DataFrame, counts: dict[str, int], version: str = "1", most: int = MAX_REPORT) -> str:
    """The report of a scan as one JSON document: version, summary, findings in order."""
    keys = ("path", "rule_id", "module_name", "severity", "confidence", "evidence", "observation")
    rows = [{k.removesuffix("_name"): r[k] for k in keys} | {"location": {"line": r["line_no"], "column": r["col_no"], "end_line": r["end_line_no"], "end_column": r["end_col_no"]}} for r in _bounded(findings, most)]
    return json.dumps({"version": version, "summary": counts | {"findings": len(rows)}, "findings": rows}, ensure_ascii=False)


def sarif_document(findings: DataFrame, tool: str = "inkgauge", most: int = MAX_REPORT) -> str:
    """The report as one document of the exchange format, with a descriptor for each rule."""
    rows = _bounded(findings, most)
    rules = sorted({r["rule_id"] for r in rows})
    level = lambda s: "note" if s == "info" else s
    results = [
        {
            "ruleId": r["rule_id"],
            "ruleIndex": rules.index(r["rule_id"]),
            "level": level(r["severity"]),
            "message": {"text": r["observation"] or r["evidence"] or r["rule_id"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": quote(r["path"])}, "region": {"startLine": r["line_no"], "startColumn": r["col_no"], "endLine": r["end_line_no"], "endColumn": r["end_col_no"]}}}],
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "columnKind": "unicodeCodePoints", "results": results}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [run]}, ensure_ascii=False)


def html_rows(findings: DataFrame) -> DataFrame:
    """path, row: a table row of markup for each finding, all text escaped."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    cells = [F.concat_ws(":", "path", F.col("line_no").cast("string"), F.col("col_no").cast("string")), F.col("rule_id"), severity(F.col("severity")), F.coalesce("evidence", F.lit("")), F.coalesce("observation", F.lit(""))]
    return findings.select("path", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in cells), F.lit("</tr>")).alias("row"))


def html_page(findings: DataFrame, title: str = "Findings", most: int = MAX_REPORT) -> str:
    """The rows of a bounded report as one page, in order."""
    rows = html_rows(findings).orderBy("path", "row").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings are no single page")
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><table>" + "".join(r["row"] for r in rows) + "</table>"


def utf16_column(line: Column, column: Column) -> Column:
    """The zero-based column in UTF-16 units of a one-based column in characters of a line."""
    head = F.substring(line, F.lit(1), column - 1)
    return (F.length(F.encode(head, "UTF-16BE")) / 2).cast("int")


def diagnostics(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """path, diagnostic: an editor's message for each finding, zero-based and in UTF-16 units; sources are (path, source)."""
    text = F.element_at(F.split("source", "\n"), F.col("line_no"))
    at = F.struct((F.col("line_no") - 1).alias("line"), utf16_column(text, F.col("col_no")).alias("character"))
    to = F.struct((F.col("end_line_no") - 1).alias("line"), utf16_column(text, F.col("end_col_no")).alias("character"))
    level = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    body = F.struct(F.struct(at.alias("start"), to.alias("end")).alias("range"), level.alias("severity"), F.col("rule_id").alias("code"), F.lit("inkgauge").alias("source"), F.coalesce("observation", "evidence", "rule_id").alias("message"))
    return findings.join(sources, "path").select("path", F.to_json(body).alias("diagnostic"))
