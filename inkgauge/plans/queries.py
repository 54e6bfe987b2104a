"""The queries of the core operators over the parquet tables, and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import EXPRESSIONS, STOP_WORDS
from ..functions.text import n_words, paragraphs, sentences
from ..operators import code_rules, commits, density, files, findings, report, scan, sequences
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# --- seeded texts
# The tables hold next to none of the expressions that the prose rules look for, so their queries run over all documents
# with a passage behind each: one for every rule, by the document's id. Long documents dilute it, which gives near misses.

_LINES = "\n".join(f"setting_{w} = read_value(source, '{w}')" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
PASSAGES = (
    *(". ".join(EXPRESSIONS[r][i % len(EXPRESSIONS[r])] for i in range(max(x.least, x.forms))).replace("'", "’") + "." for r, x in density.LIMITS.items()),
    f"On the one hand it is small, on the other hand it is slow. {EXPRESSIONS['VIBE005'][0]}.",
    "One — two — three — four — five — six.",
    "The nightly importer copies changed records into central storage before morning reports start. Before morning reports start, the nightly importer copies changed records into central storage.",
    f"{_LINES}\nnothing here\n{_LINES}",
    " ".join(f"The reader keeps {w} value until the next run." for w in ("one", "any", "each", "that", "this", "some", "every", "no")),
    "\n\n".join(" ".join([w] * 24) + "." for w in ("red", "sea", "oak", "ice", "elm")),
)


def passage(key: str, n: int = len(PASSAGES)) -> Column:
    return F.element_at(F.array(*map(F.lit, PASSAGES)), (F.pmod(F.col(key), F.lit(n)) + 1).cast("int"))


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text: every document, with a passage behind it."""
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n\n"), passage("doc_id")).alias("text"))


def seeded_contexts(spark: SparkSession, d: str) -> DataFrame:
    """ctx_id, text: the prose of every context, and the sources, with a passage behind each."""
    return table(spark, d, "contexts").select("ctx_id", F.concat("prose", F.lit("\n\n"), passage("ctx_id")).alias("prose"), F.concat("source", F.lit("\n\n"), passage("ctx_id")).alias("source"))


_PYTHON = (
    "try:\n    run()\nexcept ValueError:\n    pass\n",
    "# todo handle the empty case\nx = 1\n",
    "def part(x):\n    raise NotImplementedError\n",
    "try:\n    run()\nexcept ValueError:\n    return None\n",
    "def part(x):\n    pass\n",
    "# read the whole file\n# read the whole file\nx = 1\n",
    "def load(a, b):\n    return store.load(a, b)\n",
    "if a:\n    return True\nelse:\n    return False\n",
    "try:\n    run()\nexcept ValueError:\n    raise\n",
    "try:\n    run()\nexcept ValueError as e:\n    print(e)\n",
    "# Step 1: read\nx = 1\n# Step 2: write\ny = 2\n",
    "try:\n    run()\nexcept ImportError:\n    pass\n",
)
_SCRIPT = (
    "try { run(); } catch (e) {}\n",
    "function part() { throw new Error(\"not implemented\"); }\n",
    "try { run(); } catch (e) { return null; }\n",
    "function part() {}\n",
    "function load(a, b) { return store.load(a, b); }\n",
    "if (a) { return true; } else { return false; }\n",
    "try { run(); } catch (e) { throw e; }\n",
    "try { run(); } catch (e) { console.log(e); }\n",
    "async function save(a) { return { ok: true }; }\n",
    "const x = <a onClick={() => {}} />;\n",
    "// FIXME later\nlet x = 1;\n",
    "try { run(); } catch (ignored) {}\n",
)
_OTHER = ("// TODO handle the empty case\n", "func part() {}\n")
_DOCUMENT = ("## Empty\n\n## Next\n\nIt contains 32 rules.\n", "## Full\n\nIt contains rules.\n")


def snippet(key: str) -> Column:
    """A piece of code or of a document, by the kind, the language and the key of a context."""
    of = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.pmod(F.col(key), F.lit(len(texts))) + 1).cast("int"))
    code = F.when(F.col("code_lang") == "python", of(_PYTHON)).when(F.col("code_lang").isin("javascript", "typescript"), of(_SCRIPT)).otherwise(of(_OTHER))
    return F.when(F.col("kind") == "code", code).otherwise(of(_DOCUMENT))


def _passage_sql(key: str) -> str:
    return f"CASE {key} % {len(PASSAGES)} " + " ".join(f"WHEN {i} THEN " + "'" + p.replace("'", "''") + "'" for i, p in enumerate(PASSAGES)) + " END"


SEEDED_SQL = f"(SELECT doc_id, text || chr(10) || chr(10) || {_passage_sql('doc_id')} AS text FROM documents)"
CONTEXTS_SQL = f"(SELECT ctx_id, prose || chr(10) || chr(10) || {_passage_sql('ctx_id')} AS prose, source || chr(10) || chr(10) || {_passage_sql('ctx_id')} AS source FROM contexts)"


# --- densities

#: In SQL without look-around, every character that is no letter, figure or underline is doubled, so that neighbouring
#: phrases can each take one of it as their boundary.
UNQUOTED_SQL = r"""regexp_replace(text, '"[^"\n]*"?|“[^”\n]*”?', '"', 'g')"""
WORDS_SQL = r"""len(regexp_extract_all(text, '[\p{L}\p{N}'']+'))"""


def phrases_sql(rule: str) -> str:
    """The list of a text's hits, in SQL."""
    if density.LIMITS[rule].quoted:
        listed = ", ".join("'" + p.replace("'", "''") + "'" for p in EXPRESSIONS[rule])
        return rf"""list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+'), lambda w: w IN ({listed}))"""
    return hits_sql(EXPRESSIONS[rule])


def hits_sql(phrases: tuple[str, ...]) -> str:
    """The list of a text's hits of phrases, in SQL."""
    doubled = lambda p: "".join(c if c.isalnum() or c == "_" else "(?:''''|’’)" if c == "'" else 2 * re.escape(c) for c in p)
    alternatives = "|".join(doubled(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return rf"""regexp_extract_all(regexp_replace(lower({UNQUOTED_SQL}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])({alternatives})(?:[^\p{{L}}\p{{N}}_]|$)', 1)"""


def density_sql(rule: str) -> str:
    x = density.LIMITS[rule]
    dense = f" AND hits * {x.words_per_hit} >= words" if x.words_per_hit else ""
    return f"""WITH h AS (SELECT doc_id, {phrases_sql(rule)} AS h, CAST({WORDS_SQL} AS BIGINT) AS words FROM {SEEDED_SQL} WHERE text IS NOT NULL),
    n AS (SELECT doc_id, CAST(len(h) AS BIGINT) AS hits, CAST(len(list_distinct(list_transform(h, lambda p: replace(p, '’', '''')))) AS BIGINT) AS forms, words FROM h)
    SELECT doc_id, '{rule}' AS rule_id, hits, forms, words, hits >= {x.least} AND forms >= {x.forms}{dense} AND words > 0 AS fires FROM n WHERE hits > 0"""


def _density(rule: str) -> Query:
    return lambda spark, d: density.measure(seeded(spark, d), "doc_id", "text", [rule])


for _rule in density.LIMITS:
    query(f"density_{_rule.lower()}", density_sql(_rule))(_density(_rule))


@query("prose_density", " UNION ALL ".join(f"SELECT * FROM ({density_sql(r)})" for r in density.LIMITS))
def prose_density(spark: SparkSession, d: str) -> DataFrame:
    """All density rules by one scan."""
    return density.measure(seeded(spark, d), "doc_id", "text", list(density.LIMITS))


@query(
    "balance",
    f"""WITH n AS (SELECT doc_id, least(len({hits_sql(density.ONE_HAND)}), len({hits_sql(density.OTHER_HAND)})) AS pairs, len({hits_sql(EXPRESSIONS["VIBE005"])}) AS stock FROM {SEEDED_SQL} WHERE text IS NOT NULL)
    SELECT doc_id, CAST(pairs AS BIGINT) AS pairs, CAST(stock AS BIGINT) AS stock FROM n WHERE pairs + stock >= 2""",
)
def balance(spark: SparkSession, d: str) -> DataFrame:
    return density.balance(seeded(spark, d), "doc_id", "text")


# --- segmentation and order

PARAGRAPHS_SQL = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[^\p{L}\p{N}\n]*$', chr(10), 'g'), '\n{2,}'), lambda p: regexp_replace(p, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z', '', 'g')), lambda p: regexp_matches(p, '[\p{L}\p{N}]'))"""
SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])([ \t\n\f\r]+|\z)', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z', '', 'g')), lambda s: s <> '')"""
COUNT_SQL = r"""CAST(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}'']+')) AS BIGINT)"""
PARAGRAPH_ROWS = f"p AS (SELECT doc_id, unnest({PARAGRAPHS_SQL}) AS text, generate_subscripts({PARAGRAPHS_SQL}, 1) AS p FROM {SEEDED_SQL} WHERE text IS NOT NULL)"
SENTENCE_ROWS = f"{PARAGRAPH_ROWS}, s AS (SELECT doc_id, p, unnest({SENTENCES_SQL.format('text')}) AS text, generate_subscripts({SENTENCES_SQL.format('text')}, 1) AS s FROM p)"


@query("segment_paragraphs", f"SELECT doc_id, CAST(len({PARAGRAPHS_SQL}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def segment_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(paragraphs(F.col("text"))).cast("bigint").alias("n"))


@query("segment_sentences", f"SELECT doc_id, CAST(len({SENTENCES_SQL.format('text')}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def segment_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(sentences(F.col("text"))).cast("bigint").alias("n"))


@query("tokenize_words", f"SELECT doc_id, {COUNT_SQL.format('text')} AS n FROM documents WHERE text IS NOT NULL")
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", n_words(F.col("text")).alias("n"))


def _even_sql(rows: str, source: str, order: str, least: int, length: int, tolerance: str) -> str:
    return f"""WITH {rows}, k AS (SELECT *, {COUNT_SQL.format('text')} AS n FROM {source}), f AS (SELECT * FROM k WHERE n >= {least}),
    w AS (SELECT doc_id, row_number() OVER a AS ord, min(n) OVER b AS low, max(n) OVER b AS high, count(*) OVER b AS c FROM f
          WINDOW a AS (PARTITION BY doc_id ORDER BY {order}), b AS (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)),
    e AS (SELECT * FROM w WHERE c = {length} AND high - low <= {tolerance})
    SELECT doc_id, ord AS first_ord, low, high FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1"""


@query("rhythm_runs", _even_sql(SENTENCE_ROWS, "s", "p, s", 8, 8, "3"))
def rhythm_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rhythm(seeded(spark, d), "doc_id", "text")


@query("paragraph_symmetry", _even_sql(PARAGRAPH_ROWS, "p", "p", 20, 5, "greatest(low // 5, 4)"))
def paragraph_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return sequences.symmetry(seeded(spark, d), "doc_id", "text")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "restated_pairs",
    rf"""WITH {SENTENCE_ROWS}, c AS (SELECT doc_id, p, s, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+'), lambda w: w NOT IN ({_STOP}))) AS w FROM s),
    l AS (SELECT *, lag(w) OVER (PARTITION BY doc_id, p ORDER BY s) AS b FROM c),
    j AS (SELECT doc_id, p, s, len(list_intersect(b, w)) AS common, len(w) + len(b) - len(list_intersect(b, w)) AS together FROM l WHERE len(w) >= 7 AND len(b) >= 7)
    SELECT doc_id, CAST(p - 1 AS BIGINT) AS p, CAST(s - 1 AS BIGINT) AS s, CAST(common AS BIGINT) AS common, CAST(together AS BIGINT) AS together FROM j WHERE common >= 7 AND common * 4 >= together * 3""",
)
def restated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.restated(seeded(spark, d), "doc_id", "text")


@query(
    "openings_top",
    rf"""WITH {SENTENCE_ROWS}, k AS (SELECT doc_id, p, s, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']+') AS w FROM s),
    g AS (SELECT doc_id, array_to_string(w[1:2], ' ') AS opening, count(*) AS n, min(p * 1000000000 + s) AS place FROM k WHERE len(w) >= 4 GROUP BY ALL),
    r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS sentences, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place, opening) AS r FROM g)
    SELECT doc_id, opening, n, sentences FROM r WHERE r = 1 AND n >= 4 AND sentences >= 6 AND n * 2 >= sentences""",
)
def openings_top(spark: SparkSession, d: str) -> DataFrame:
    return sequences.openings(seeded(spark, d), "doc_id", "text")


@query("em_dashes", f"SELECT ctx_id, dashes, words FROM (SELECT ctx_id, CAST(length(text) - length(replace(text, '—', '')) AS BIGINT) AS dashes, CAST({WORDS_SQL} AS BIGINT) AS words FROM (SELECT ctx_id, prose AS text FROM {CONTEXTS_SQL})) WHERE dashes >= 5 AND dashes * 100 >= words AND words > 0")
def em_dashes(spark: SparkSession, d: str) -> DataFrame:
    return sequences.dashes(seeded_contexts(spark, d), "ctx_id", "prose")


@query(
    "duplicate_blocks",
    rf"""WITH l AS (SELECT ctx_id, unnest(string_split(source, chr(10))) AS raw, generate_subscripts(string_split(source, chr(10)), 1) AS line FROM {CONTEXTS_SQL} WHERE source IS NOT NULL),
    t AS (SELECT ctx_id, line, trim(regexp_replace(raw, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS t FROM l),
    w AS (SELECT ctx_id, line, array_to_string(list(t) OVER b, chr(10)) AS body, count(*) FILTER (t <> '') OVER b AS f FROM t WINDOW b AS (PARTITION BY ctx_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    m AS (SELECT ctx_id, line, min(line) OVER (PARTITION BY ctx_id, body) AS first_line FROM w WHERE f = 10 AND strlen(body) >= 180)
    SELECT ctx_id, CAST(first_line AS BIGINT) AS first_line, CAST(min(line) AS BIGINT) AS repeat_line FROM m WHERE line >= first_line + 10 GROUP BY ctx_id, first_line""",
)
def duplicate_blocks(spark: SparkSession, d: str) -> DataFrame:
    return sequences.duplicate_lines(seeded_contexts(spark, d), "ctx_id", "source")


# --- files and code

_NAME, _EXT = "regexp_extract(path, '[^/]*$')", "CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+\\.[^.]+$') THEN lower(regexp_extract(path, '[^.]*$')) ELSE '' END"
_LANG_SQL = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in files.LANGUAGES.items()) + " END"
_KIND_SQL = f"CASE WHEN lower({_NAME}) = 'readme' THEN 'docs' " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in files.KINDS.items()) + f" WHEN {_LANG_SQL} IS NOT NULL THEN 'code' ELSE 'unknown' END"


@query("classify_paths", f"SELECT {_KIND_SQL} AS kind, {_LANG_SQL} AS language, count(*) AS n FROM files GROUP BY ALL")
def classify_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "files").select(files.kind(p).alias("kind"), files.language(p).alias("language")).groupBy("kind", "language").agg(F.count("*").alias("n"))


@query("skip_reasons")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """skip, n: why files are left out."""
    return files.with_skips(table(spark, d, "files").dropDuplicates(["file_id"])).groupBy("skip").agg(F.count("*").alias("n"))


@query("code_findings")
def code_findings(spark: SparkSession, d: str) -> DataFrame:
    """ctx_id, rule_id, line of all rules on code and documents, with a snippet behind every context."""
    rows = table(spark, d, "contexts").select("ctx_id", "path", F.concat("source", F.lit("\n\n"), snippet("ctx_id")).alias("source"), "kind", "code_lang")
    return code_rules.findings(rows, "ctx_id")


@query("scan_files")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """All findings of all contexts, with passages that every rule has something to find in."""
    rows = table(spark, d, "contexts").select("ctx_id", "path", F.concat("source", F.lit("\n\n"), F.when(F.col("kind") == "code", snippet("ctx_id")).otherwise(passage("ctx_id"))).alias("source"), "kind", "code_lang")
    return scan.scan(rows, "ctx_id", POLICY)


_SUBJECT = r"""coalesce(list_filter(list_transform(string_split(source, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '')"""


@query(
    "commit_findings",
    rf"""WITH s AS (SELECT commit_id, from_history, {_SUBJECT} AS subject FROM commits WHERE source IS NOT NULL),
    p AS (SELECT *, lower(regexp_replace(regexp_replace(subject, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+\z', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS plain FROM s)
    SELECT commit_id, 'TRAIL001' AS rule_id, CASE WHEN subject = '' THEN '<empty subject>' ELSE subject END AS evidence FROM p WHERE plain = '' OR plain IN ({', '.join(repr(x) for x in commits.PLACEHOLDERS)})
    UNION ALL SELECT commit_id, 'TRAIL002', subject FROM p WHERE from_history AND regexp_matches(subject, '^(?:fixup!|squash!|amend!)(?: |\z)')""",
)
def commit_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commits").withColumn("path", F.col("commit_id").cast("string"))
    return commits.commit_findings(rows).select(F.col("path").cast("bigint").alias("commit_id"), "rule_id", "evidence")


# --- findings

_SEVERITY = "CASE WHEN lower(trim(severity)) = 'warn' THEN 'warning' WHEN lower(trim(severity)) IN ('info', 'warning', 'error') THEN lower(trim(severity)) END"
_LATEST = "f AS (SELECT DISTINCT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC NULLS LAST, ctx_id DESC NULLS LAST, path DESC) = 1)"


def delivered(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return findings.latest(table(spark, d, "findings"), *columns)


@query("latest_findings", f"WITH {_LATEST} SELECT finding_id, rule_id, path, line_no, CAST(epoch_us(ingested_at) AS BIGINT) AS at FROM f")
def latest_findings(spark: SparkSession, d: str) -> DataFrame:
    return delivered(spark, d, "rule_id", "path", "line_no").select("finding_id", "rule_id", "path", "line_no", F.unix_micros("ingested_at").alias("at"))


@query("rule_counts", f"WITH {_LATEST} SELECT rule_id, count(*) AS n FROM f GROUP BY rule_id")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.rule_counts(delivered(spark, d, "rule_id"))


@query("facet_counts", f"WITH {_LATEST}, g AS (SELECT {_SEVERITY} AS severity, module_name AS module, rule_id AS rule, path FROM f) SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM g GROUP BY severity UNION ALL SELECT 'module', module, count(*) FROM g GROUP BY module UNION ALL SELECT 'rule', rule, count(*) FROM g GROUP BY rule UNION ALL SELECT 'path', path, count(*) FROM g GROUP BY path")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.facets(delivered(spark, d, "severity", "module_name", "rule_id", "path"))


@query("occurrence_rank", f"WITH {_LATEST} SELECT finding_id, row_number() OVER (PARTITION BY rule_id, path, trim(coalesce(evidence, '')) ORDER BY line_no, col_no, finding_id) AS occurrence FROM f")
def occurrence_rank(spark: SparkSession, d: str) -> DataFrame:
    return findings.with_occurrences(delivered(spark, d, "rule_id", "path", "evidence", "line_no", "col_no")).select("finding_id", "occurrence")


POLICY = {"VIBE031": "error", "DEAD002": "info"}


@query("severity_policy", f"WITH {_LATEST} SELECT CASE rule_id WHEN 'VIBE031' THEN 'error' WHEN 'DEAD002' THEN 'info' ELSE {_SEVERITY} END AS severity, confidence, count(*) AS n FROM f GROUP BY ALL")
def severity_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.overridden(delivered(spark, d, "rule_id", "severity", "confidence"), POLICY).withColumn("severity", findings.severity(F.col("severity")))
    return rows.groupBy("severity", "confidence").agg(F.count("*").alias("n"))


@query("suppressed_findings", f"WITH {_LATEST}, s AS (SELECT DISTINCT path, CAST(1 + ctx_id % 40 AS INT) AS line, unnest(['DEAD002', 'VIBE031']) AS rule_id FROM contexts) SELECT finding_id, rule_id, path, line_no FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = f.path AND s.rule_id = f.rule_id AND f.line_no IN (s.line, s.line + 1))")
def suppressed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings left by directives that stand in every context's file on a line that follows from its id."""
    rows = table(spark, d, "contexts").select("path", (1 + F.col("ctx_id") % 40).cast("int").alias("line"), F.explode(F.array(F.lit("DEAD002"), F.lit("VIBE031"))).alias("rule_id")).distinct()
    return findings.suppressed(delivered(spark, d, "rule_id", "path", "line_no"), rows).select("finding_id", "rule_id", "path", "line_no")


@query("changed_line_findings", f"WITH {_LATEST}, r AS (SELECT path, CAST(1 + ctx_id % 50 AS INT) AS a, CAST(21 + ctx_id % 50 AS INT) AS b FROM contexts) SELECT finding_id, rule_id, path, line_no FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.path = f.path AND f.line_no BETWEEN a AND b)")
def changed_line_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on changed lines; each context's file has a changed range that follows from its id."""
    changed = table(spark, d, "contexts").select("path", (1 + F.col("ctx_id") % 50).cast("int").alias("start_line"), (21 + F.col("ctx_id") % 50).cast("int").alias("end_line"))
    return findings.on_changed_lines(delivered(spark, d, "rule_id", "path", "line_no"), changed).select("finding_id", "rule_id", "path", "line_no")


@query("baseline_diff", f"WITH {_LATEST}, x AS (SELECT project, rule_id, count(*) FILTER (confidence = 'high') AS before, count(*) FILTER (confidence = 'medium') AS after FROM f GROUP BY ALL) SELECT project, rule_id, before, after FROM x WHERE before <> after")
def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts by project and rule that differ between findings of high and of medium confidence."""
    f = delivered(spark, d, "project", "rule_id", "confidence")
    return findings.differences(f.where("confidence = 'high'"), f.where("confidence = 'medium'"))


@query("scan_summary", f"WITH {_LATEST} SELECT count(*) AS findings, count(DISTINCT path) AS paths, count(DISTINCT rule_id) AS rules, CAST(sum(CASE WHEN {_SEVERITY} = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN {_SEVERITY} = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN {_SEVERITY} = 'info' THEN 1 ELSE 0 END) AS BIGINT) AS info FROM f")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(delivered(spark, d, "path", "rule_id", "severity"))


@query("project_digests")
def project_digests(spark: SparkSession, d: str) -> DataFrame:
    return findings.digests(delivered(spark, d, "project", "path", "line_no", "rule_id"))


@query("report_text", f"WITH {_LATEST} SELECT finding_id, concat_ws('  ', concat_ws(':', path, line_no, col_no), rule_id, upper({_SEVERITY})) AS line FROM f")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    return report.text_lines(delivered(spark, d, "path", "line_no", "col_no", "rule_id", "severity"))


_ESC = "replace(replace(replace({0}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"


@query("report_commands", f"WITH {_LATEST} SELECT finding_id, '::' || CASE WHEN {_SEVERITY} = 'info' THEN 'notice' ELSE {_SEVERITY} END || ' file=' || replace(replace({_ESC.format('path')}, ':', '%3A'), ',', '%2C') || ',line=' || line_no || ',col=' || col_no || ',title=' || rule_id || '::' || {_ESC.format(chr(34) + 'o' + chr(34))} AS line FROM (SELECT *, coalesce(observation, '') AS o FROM f)")
def report_commands(spark: SparkSession, d: str) -> DataFrame:
    return report.workflow_commands(delivered(spark, d, "path", "line_no", "col_no", "rule_id", "severity", "observation"))


@query("report_json")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return report.json_lines(delivered(spark, d))


@query("report_sarif")
def report_sarif(spark: SparkSession, d: str) -> DataFrame:
    return report.sarif_lines(delivered(spark, d, "rule_id", "severity", "path", "observation", "line_no", "col_no", "end_line_no", "end_col_no"))


@query("report_code_quality")
def report_code_quality(spark: SparkSession, d: str) -> DataFrame:
    return report.code_quality(delivered(spark, d, "rule_id", "path", "evidence", "severity", "line_no", "col_no"))
