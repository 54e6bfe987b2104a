"""The core operators, by small cases and against SQL on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from inkgauge.functions.lexicons import EXPRESSIONS
from inkgauge.functions.text import folded, paragraphs, phrase_hits, sentences
from inkgauge.functions.views import views
from inkgauge.operators import code_rules, commits, density, files, findings, report, scan
from inkgauge.plans.queries import QUERIES, SQL
from inkgauge.sources.tables import glob_pattern, hunks, history, path_matches

SMALL = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")


@there
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert mine == sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())


@there
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_the_rest_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_lexicons_have_no_duplicates():
    for rule, listed in EXPRESSIONS.items():
        assert listed and len(set(listed)) == len(listed), rule


@pytest.mark.parametrize("rule", sorted(density.LIMITS))
def test_each_density_rule_fires(spark, rule):
    listed, x = EXPRESSIONS[rule], density.LIMITS[rule]
    n = max(x.least, x.forms)
    dense = ". ".join(listed[i % len(listed)] for i in range(n))
    rows = [(1, dense), (2, dense + " plain" * 100_000), (3, None), (4, ""), (5, "none of these"), (6, '"' + dense.replace('"', "") + '"')]
    got = {r["id"]: r for r in density.measure(spark.createDataFrame(rows, "id long, text string"), "id", "text", [rule]).collect()}
    assert got[1]["fires"] and got[1]["hits"] >= x.least
    assert 3 not in got and 4 not in got and 5 not in got
    assert got[2]["fires"] == (x.words_per_hit == 0)
    assert (6 in got) == x.quoted


def test_balance(spark):
    stock = EXPRESSIONS["VIBE005"][0]
    rows = [(1, f"On the one hand x, on the other hand y. {stock}."), (2, "On the one hand. On the one hand."), (3, None), (4, f"{stock} and {stock}")]
    got = {r["id"]: (r["pairs"], r["stock"]) for r in density.balance(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {1: (1, 1), 4: (0, 2)}


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]


def test_segments(spark):
    assert one(spark, paragraphs, "One\ntwo.\n\n---\nThree\n \nfour") == ["One\ntwo.", "Three", "four"]
    assert one(spark, sentences, "One. Two! 3.5 is it? e") == ["One.", "Two!", "3.5 is it?", "e"]
    assert one(spark, lambda c: phrase_hits(folded(c), ("deep dive", "dive", "don't")), "Deep dive, “dive” and DON’T dive_in") == ["deep dive", "don't"]


@pytest.mark.parametrize("kind, language", [("code", "python"), ("code", "rust"), ("code", "java"), ("docs", None), ("text", None), ("config", None)])
def test_views_keep_every_place(kind, language):
    source = "---\na: b\n---\n# note `x`\nx = 'it''s' // text \"q\"\n/* é\n 😀 */ r#\"raw\"#\n```\ncode\n```\n<!-- c\nd --> e\nlead:\n    block\n"
    for v in views(source, kind, language).values():
        assert len(v) == len(source) and [i for i, c in enumerate(v) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]


def test_restructured_text():
    source = "Title\n=====\n\nSee :ref:`this part` and ``code``::\n\n    literal block\n\nKept line.\n\n.. note:: Mind it.\n   :class: x\n\n   Body stays.\n\n.. code-block:: python\n\n   x = 1\n\n>>> run()\n1\n\n:author: someone\n"
    prose = views(source, "docs", None, "a.rst")["prose"]
    assert len(prose) == len(source)
    for word in ("Title", "See", "Kept line.", "Mind it.", "Body stays.", "someone"):
        assert word in prose
    for word in ("this part", "code", "literal", "class", "x = 1", "run()", "author"):
        assert word not in prose


CODE = [
    ("DEAD001", "a.py", "python", "try:\n    run()\nexcept ValueError:\n    pass\n", "try:\n    run()\nexcept ImportError:\n    pass\n"),
    ("DEAD001", "a.js", "javascript", "try { a() } catch (e) {}\n", "try { a() } catch (e) { log(e) }\n"),
    ("DEAD002", "a.py", "python", "# TODO handle the case\nx = 1\n", "# TODO(ann) handle the case\nx = 1\n"),
    ("DEAD003", "a.rs", "rust", "fn a() { todo!() }\n", "fn a() { done() }\n"),
    ("DEAD004", "a.py", "python", "try:\n    a()\nexcept E:\n    return None\n", "try:\n    a()\nexcept E:\n    return a\n"),
    ("DEAD005", "a.go", "go", "func empty() {}\n", "func full() { a() }\n"),
    ("DEAD007", "a.py", "python", "# read the whole file\n# read the whole file\nx = 1\n", "# read the whole file\nx = 1\n"),
    ("DEAD008", "a.py", "python", "def load(a, b):\n    return store.load(a, b)\n", "def load(a, b):\n    return store.read(a, b)\n"),
    ("DEAD009", "a.py", "python", "if a:\n    return True\nelse:\n    return False\n", "if a:\n    return True\nelse:\n    return None\n"),
    ("DEAD010", "tests/a.py", "python", "assert True\n", "assert a\n"),
    ("DEAD014", "a.js", "javascript", "try { a() } catch (e) { throw e; }\n", "try { a() } catch (e) { throw f; }\n"),
    ("DEAD015", "a.js", "javascript", "try { a() } catch (e) { console.log(e); }\n", "try { a() } catch (e) { b(e); }\n"),
    ("DEAD016", "a.tsx", "typescript", "<a onClick={() => {}} />\n", "<a onClick={() => { b() }} />\n"),
    ("DEAD017", "a.ts", "typescript", "async function save(a) { return { ok: true }; }\n", "async function save(a) { return b(a); }\n"),
    ("DEAD018", "a.py", "python", "# Step 1: a\nx = 1\n# Step 2: b\ny = 2\n", "# Step 1: a\nx = 1\n"),
]


CODE += [
    ("DEAD001", "a.py", "python", "try:\n    run()\nexcept (A, B) as e: pass\n", "try:\n    run()\n    raise E\nexcept A:\n    pass\n"),
    ("DEAD001", "a.java", "java", "try { a(); } catch (E e) { }\n", "try { a(); } catch (E ignored) { }\n"),
    ("DEAD001", "a.py", "python", "try:\n    run()\nexcept A:\n    pass\n", "try:\n    run()\nexcept A:\n    pass  # the caller has closed it already\n"),
    ("DEAD002", "a.py", "python", "# todo handle the case\nx = 1\n", '# The "TODO" label\nx = 1\n'),
    ("DEAD002", "a.py", "python", "# FIXME: later\nx = 1\n", "# TODO see https://x.example/1\nx = 1\n"),
    ("DEAD002", "a.py", "python", "# XXX wrong\nx = 1\n", "# replace the XXX with a number\nx = 1\n"),
    ("DEAD003", "a.js", "javascript", 'function a() { throw new Error("not implemented"); }\n', 'function a() { throw new Error("no such row"); }\n'),
    ("DEAD003", "a.py", "python", "def a(x):\n    raise NotImplementedError\n", "class A:\n    def a(self):\n        raise NotImplementedError\n"),
    ("DEAD003", "a.py", "python", "def a(x):\n    b()\n    raise NotImplementedError()\n", "def a(x):\n    if x:\n        raise NotImplementedError()\n"),
    ("DEAD004", "a.swift", "swift", "do { try a() } catch { return nil }\n", "do { try a() } catch { return b }\n"),
    ("DEAD004", "a.py", "python", "try:\n    a()\nexcept E:\n    return False\n", "try:\n    a()\n    return True\nexcept E:\n    return False\n"),
    ("DEAD005", "a.py", "python", "def a(x):\n    pass\n", "@b\ndef a(x):\n    pass\n"),
    ("DEAD008", "a.py", "python", "class A:\n    def load(self, a, b=1):\n        return store.load(a, b)\n", "@cached\ndef load(a, b):\n    return store.load(a, b)\n"),
    ("DEAD008", "a.py", "python", "def load(a):\n    return store.load(a)\n", "def load(a):\n    return store.load(a)\n    done()\n"),
    ("DEAD008", "a.ts", "typescript", "function load(a: A, b) { return store.load(a, b); }\n", "function load(a) { return this.store.load(a); }\n"),
    ("DEAD009", "a.ts", "typescript", "if (a > (b)) { return false; } else { return true; }\n", "if (a) { return true; } else { return true; }\n"),
    ("DEAD010", "a.test.ts", "typescript", "expect(true).toBe(true)\n", "expect(a).toBe(true)\n"),
    ("DEAD014", "a.py", "python", "try:\n    a()\nexcept A:\n    raise\n", "try:\n    a()\nexcept A:\n    raise\nexcept B:\n    b()\n"),
    ("DEAD015", "a.py", "python", "try:\n    a()\nexcept A as e:\n    print(e)\n", "try:\n    a()\nexcept A as e:\n    print(e)\n    b()\n"),
]


@pytest.mark.parametrize("rule, path, language, bad, good", CODE)
def test_code_rules(rule, path, language, bad, good):
    found = lambda s: {r for r, _ in code_rules.code_findings(path, s, "code", language)}
    assert rule in found(bad) and rule not in found(good)
    assert sorted(code_rules.code_findings(path, bad.replace("\n", "\r\n"), "code", language)) == sorted(code_rules.code_findings(path, bad, "code", language))


PROSE = [
    ("VIBE008", "The result: it works. There is one catch: it is slow. Here is why: it waits.", "The list: one, two."),
    ("VIBE008", " ".join(f"The {w} part holds: it has a value." for w in "one two six ten red sea oak elm".split()), "\n".join(f"Value: it is {w} here." for w in "one two six ten red sea oak elm".split())),
    ("VIBE020", "It's not a cache. It's a table. It's fast, not cheap. Rather than wait, it reads.", "It is not a cache. The table is fast."),
    ("VIBE027", "See turn0search3 for the source.", "See turn 0 for the source."),
    ("VIBE001", "Ultimately, it works. That said, moreover, it is fine. In essence, more broadly, it is done.", "Ultimately it works in the end."),
    ("VIBE002", "Absolutely! Great question, here it is. Certainly.", "Absolutely the best way."),
    ("VIBE016", "Some text first, long enough to be half. " * 4 + ". ".join(EXPRESSIONS["VIBE016"][:3]) + ".", EXPRESSIONS["VIBE016"][0]),
    ("VIBE021", "It is not only fast but also small. Everything from logs to tables is read.", "It is both fast and small."),
    ("VIBE029", "It grew, highlighting the need, thereby underscoring the cost, and ended, fostering trust.", "It grew, highlighting the need."),
    ("VIBE032", f"Text.\n\n{EXPRESSIONS['VIBE032'][0]} of tools, it is used.", f"Text with {EXPRESSIONS['VIBE032'][0]} inside."),
    ("VIBE033", f"{EXPRESSIONS['VIBE033'][0]} it works. {EXPRESSIONS['VIBE033'][1]} it does.", f"{EXPRESSIONS['VIBE033'][0]} it works [1]. {EXPRESSIONS['VIBE033'][1]} it does (Lee 2020)."),
    ("VIBE035", "# 🚀 A\n- 🎉 b\n- 🔥 c\n- 💡 d\n", "# ✅ A\n- ✅ b\n- ❌ c\n- ⚠ d\n"),
    ("VIBE009", " ".join(f"The reader keeps value {w}." for w in "one two six ten red sea".split()), "The reader keeps it. A row is lost."),
]


@pytest.mark.parametrize("rule, bad, good", PROSE)
def test_prose_rules(rule, bad, good):
    found = lambda s: {x["rule_id"] for x in scan.scan_file("docs/a.md", s, "docs", None)}
    assert rule in found(bad) and rule not in found(good)
    assert scan.scan_file("docs/a.md", bad.replace("\n", "\r\n"), "docs", None) == scan.scan_file("docs/a.md", bad, "docs", None)


def test_scan(spark):
    bad = "é = 1\ntry:\n    run()\nexcept ValueError:\n    pass\n"
    rows = [(1, "b.py", bad, "code", "python"), (2, "b.py", bad.replace("except", "# inkgauge: ignore DEAD001 -- known\nexcept"), "code", "python"), (3, "a.md", next(x[1] for x in PROSE if x[0] == "VIBE001"), "docs", None), (4, "c.py", None, "code", "python"), (5, "d.md", "", None, None)]
    df = spark.createDataFrame(rows, "id long, path string, source string, kind string, code_lang string")
    got = {r["id"]: r for r in scan.scan(df, "id", {"VIBE001": "error"}, ("VIBE002",)).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["rule_id"], got[1]["line_no"], got[1]["col_no"], got[1]["end_col_no"], got[1]["evidence"], got[1]["severity"]) == ("DEAD001", 4, 1, 19, "except ValueError:", "error")
    assert got[3]["severity"] == "error" and got[3]["observation"].startswith("5 transitions") and got[3]["module_name"] == "VIBE"
    assert scan.summary(scan.scan(df, "id"), df).first().asDict() == {"scanned_files": 5, "findings": 2, "errors": 1, "warnings": 1, "infos": 0}


def test_config():
    from inkgauge.sources.config import ConfigError, find, parse

    c = parse('[inkgauge]\nfail-level = "error"\n[inkgauge.papertrail]\nenabled = false\n[inkgauge.rules]\nVIBE003 = "off"\nDEAD002 = "warn"\n[inkgauge.files]\nexclude = ["gen/"]\n')
    assert (c.fail_level, c.off, c.overrides, c.exclude) == ("error", ("TRAIL001", "TRAIL002", "VIBE003"), {"DEAD002": "warning"}, ("gen/",))
    for bad in ("[inkgauge]\nx = 1", '[inkgauge.rules]\nVIBE099 = "off"', '[inkgauge.rules]\nVIBE001 = "loud"', "[inkgauge", "".join(f"[inkgauge.{m}]\nenabled = false\n" for m in ("deadweight", "vibecheck", "papertrail"))):
        with pytest.raises(ConfigError):
            parse(bad)
    assert find("/").fail_level == "warning"


def test_git_sources(spark, tmp_path):
    import subprocess

    from inkgauge.sources import tables

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.test", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "a.py")
    assert [(r["path"], bytes(r["bytes"])) for r in tables.git_staged(spark, str(tmp_path)).collect()] == [("a.py", b"x = 1\n")]
    git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\nz = 3\n")
    files, changed = tables.git_changed(spark, str(tmp_path))
    assert bytes(files.first()["bytes"]).endswith(b"z = 3\n") and [tuple(r) for r in changed.collect()] == [("a.py", 2, 3)]
    assert tables.git_log(spark, str(tmp_path), "HEAD").first()["source"].strip() == "first"
    listed = spark.createDataFrame([(".gitattributes", "lib/** linguist-vendored\n*.pb.py linguist-generated=true\n"), ("lib/own/.gitattributes", "*.py -linguist-vendored\n")], "path string, text string")
    paths = spark.createDataFrame([("lib/x.py",), ("lib/own/y.py",), ("src/z.pb.py",)], "path string")
    got = {r["path"]: (r["vendored"], r["generated"]) for r in tables.attributed(paths, tables.attributes(listed).collect()).collect()}
    assert got == {"lib/x.py": (True, False), "lib/own/y.py": (False, False), "src/z.pb.py": (False, True)}


def test_reports(spark):
    import json

    rows = [(1, "b/a.py", 2, 3, 2, 9, "DEAD001", "DEAD", "error", "high", "é😀x <b>", None), (2, "a.md", 1, 1, 1, 4, "VIBE001", "VIBE", "warning", "medium", "t", "5 hits")]
    f = spark.createDataFrame(rows, "finding_id long, path string, line_no int, col_no int, end_line_no int, end_col_no int, rule_id string, module_name string, severity string, confidence string, evidence string, observation string")
    doc = json.loads(report.json_document(f, {"scanned_files": 2}))
    assert [x["path"] for x in doc["findings"]] == ["a.md", "b/a.py"] and doc["summary"] == {"scanned_files": 2, "findings": 2}
    sarif = json.loads(report.sarif_document(f))
    assert sarif["runs"][0]["results"][1]["ruleId"] == "DEAD001" and len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert "&lt;b&gt;" in report.html_page(f) and "<b>" not in report.html_page(f)
    with pytest.raises(ValueError, match="more than 1 findings"):
        report.json_document(f, {}, most=1)
    sources = spark.createDataFrame([("b/a.py", "x\né😀x\n")], "path string, source string")
    assert json.loads(report.diagnostics(f, sources).first()["diagnostic"])["range"]["start"] == {"line": 1, "character": 3}


def test_documents():
    found = dict((r, n) for r, n in code_rules.code_findings("a.md", "# Title\n\nIt contains 32 rules.\n\n## Empty\n\n## Next\n\nText.\n", "docs", None))
    assert found == {"DEAD013": 3, "DEAD012": 5}


def test_repeated_blocks():
    block = "\n".join(f"value_{i} = compute(first_{i}, second_{i})" for i in range(10))
    rest = "\n".join(f"other_{i} = {i} + base" for i in range(4))
    assert ("DEAD011", 15) in code_rules.code_findings("a.py", f"{block}\n{rest}\n{block}\n", "code", "python")


def test_files(spark):
    rows = [("a/x.PY", b"x"), ("README", b"r"), ("b/vendor/x.js", b"1"), ("n.bin", b"a\0b"), ("u.txt", b"\xff\xfe\xfd"), ("g.py", b"# Generated file, do not edit\nx = 1"), ("m.js", b"a" * 2500), ("big.md", b"a" * 20), ("e.py", b""), ("z.py", None)]
    df = spark.createDataFrame(rows, "path string, bytes binary")
    got = {r["path"]: r for r in files.with_skips(df, 3000).withColumn("f", files.skipped_folder(F.col("path"))).collect()}
    assert got["a/x.PY"]["language"] == "python" and got["README"]["kind"] == "docs" and got["b/vendor/x.js"]["f"]
    assert {p: got[p]["skip"] for p in ("n.bin", "g.py", "m.js", "e.py")} == {"n.bin": "binary", "g.py": "generated", "m.js": "minified", "e.py": None}
    assert got["u.txt"]["skip"] == "encoding"


def test_commits(spark):
    rows = [("a", "WIP\n", True), ("b", "# c\n\n  Update.\n", False), ("c", "# only\n", True), ("d", "fixup! x", True), ("e", "fixup! x", False), ("f", "Handle input", True), ("g", None, True)]
    got = {(r["path"], r["rule_id"]) for r in commits.commit_findings(spark.createDataFrame(rows, "path string, source string, from_history boolean")).collect()}
    assert got == {("a", "TRAIL001"), ("b", "TRAIL001"), ("c", "TRAIL001"), ("d", "TRAIL002")}


def test_policy(spark):
    f = spark.createDataFrame([(1, "p", 3, "DEAD002"), (2, "p", 4, "DEAD002"), (3, "p", 5, "DEAD002"), (4, "q", 3, "DEAD002")], "finding_id long, path string, line_no int, rule_id string")
    text = "a\nb\n# inkgauge: ignore DEAD002, nonsense -- known\nc\nd\n# inkgauge: ignore DEAD002 -- */\n"
    d = findings.suppressions(spark.createDataFrame([("p", text)], "path string, source string"))
    assert [tuple(r) for r in d.collect()] == [("p", 3, "DEAD002")]
    assert {r["finding_id"] for r in findings.suppressed(f, d).collect()} == {3, 4}
    patch = "@@ -1 +4 @@\n+x\n@@ -9,2 +9,0 @@\n-y\n"
    changed = hunks(spark.createDataFrame([("p", patch)], "path string, patch string"))
    assert [tuple(r) for r in changed.collect()] == [("p", 4, 4)]
    assert {r["finding_id"] for r in findings.on_changed_lines(f, changed).collect()} == {2}
    levelled = f.withColumn("severity", F.lit("warn"))
    assert findings.failing(levelled, "warning") and not findings.failing(levelled, "error")
    assert {r["severity"] for r in findings.overridden(levelled, {"DEAD002": "error"}).collect()} == {"error"}


def test_history_and_globs(spark):
    log = "a" * 40 + "\0one\0" + "b" * 40 + "\0two\nmore\0"
    assert [(r["path"][:8], r["source"]) for r in history(spark.createDataFrame([(log,)], "value string")).orderBy("ord").collect()] == [("commit/a", "one"), ("commit/b", "two\nmore")]
    with pytest.raises(Exception, match="half a pair"):
        history(spark.createDataFrame([("a" * 40,)], "value string")).collect()
    paths = spark.createDataFrame([("docs/a.md",), ("src/x/b.py",), ("src/gen/c.py",)], "p string")
    assert [r["p"] for r in paths.where(path_matches(F.col("p"), ["src/**"], ["gen/"])).collect()] == ["src/x/b.py"]
    assert glob_pattern("*.py") == "^(?:.*/)?[^/]*\\.py(?:/.*)?$"


def test_fingerprints():
    assert findings.fnv1a_128(["", None, "a"]) == ["6c62272e07bb014262b821756295c58d", None, "d228cb696f1a8caf78912b704e4a8964"]
    texts = ["é" * 300, "plain", "", "x" * 257, "a b"]

    def plain(v):
        h = 0x6C62272E07BB014262B821756295C58D
        for b in v.encode():
            h = (h ^ b) * ((1 << 88) + 0x13B) % (1 << 128)
        return f"{h:032x}"

    assert findings.fnv1a_128(texts) == [plain(t) for t in texts]


def test_relint_agrees_with_a_scan(spark, tmp_path):
    from inkgauge.streaming.relint import current, relint

    bad = "try:\n    run()\nexcept ValueError:\n    pass\n"
    rows = [("u1", "open", 1, "a.py", "x = 1\n", "code", "python"), ("u1", "change", 2, "a.py", bad, "code", "python"), ("u2", "open", 1, "b.py", bad, "code", "python"), ("u2", "close", 2, None, None, None, None)]
    schema = "uri string, event string, seq long, path string, source string, kind string, code_lang string"
    for i, batch in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
        q = relint(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {(r["uri"], r["rule_id"], r["line"]) for r in current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {("u1", "DEAD001", 3)}
