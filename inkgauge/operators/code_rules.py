"""Rules on the structure of source files. A file's views are made once, in an Arrow batch, and all rules read them;
each finding is a row (key, rule_id, line)."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.blocks import Block, Code, Statement, arguments, call, indented, logical_lines
from ..functions.views import views
from ..session import ship

FOUND = T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("line", T.LongType())]))

#: Languages whose handlers stand in braces behind ``catch``.
BRACED = ("javascript", "typescript", "java", "kotlin", "csharp", "cpp", "php", "swift")
SCRIPT = ("javascript", "typescript")
#: Words of each language for nothing, for an empty value, for true and false, and for output.
NOTHING = (["pass"], ["..."])
EMPTY = (["None"], ["False"], ["[", "]"], ["{", "}"], ["null"], ["nullptr"], ["nil"], ["false"], ["[", ":", "]"])
BOOLEANS = {"True": True, "False": False, "true": True, "false": False}
CONSOLE = (["console", ".", "log"], ["console", ".", "warn"], ["console", ".", "error"])
#: What optional dependencies and ends of iteration raise; names of errors that are left alone.
EXPECTED = frozenset(("ImportError", "ModuleNotFoundError", "StopIteration", "StopAsyncIteration"))
IGNORED = frozenset(("ignored", "ignore", "_"))
#: What declares without a body.
DECLARING = re.compile(r"\b(?:abstract|trait|protocol|interface)\b")
#: Names of actions, beside those that begin with handle.
ACTIONS = frozenset(("save", "submit", "create", "update", "remove", "send", "publish", "process", "execute"))
#: What documents count, and how they say so.
HAS = ("contain", "contains", "include", "includes", "provide", "provides", "offer", "offers", "support", "supports", "ships with", "has")
KINDS_OF = ("stable", "built-in", "default", "supported", "available", "bundled", "deterministic", "official", "first-party")
COUNTED = ("rule", "command", "integration", "plugin", "template", "example", "check", "detector", "module", "provider", "adapter", "workflow", "feature")
INVENTORY = re.compile(rf"\b(?:{'|'.join(HAS)})\s+(?:exactly\s+)?\d+(?:\s+(?:{'|'.join(KINDS_OF)}))*\s+(?:{'|'.join(COUNTED)})s?\b".replace("ships with", r"ships\s+with"), re.I)
#: Markers of work left over, in small and in capital letters or in capitals only; words that make them a name.
MARKERS, CAPITALS = ("todo", "fixme"), ("HACK", "XXX")
ITEMS = frozenset("app apps card cards content entries entry item items list lists row rows snapshot snapshots state status".split())
DETERMINERS = frozenset("the a an what which each every".split())
MARKER = re.compile(rf"(?<![\w-])(?:{'|'.join((*MARKERS, *CAPITALS))})(?!\w)", re.I)
OPENER = re.compile(r"[\s#/*!;<\"'-]*")
TRACKED_LINK = re.compile(r"\w+://\S")
TRACKED_NUMBER = re.compile(r"#\d\d|\b(?:bug|issue|ticket)[ #]*\d", re.I)
STEPS = re.compile(r"[-=*#~\s]*(?:step|phase)\s+\d+\s*(?:$|[:.)=–—-])", re.I)
NOTE = re.compile(r"(?:#|//+|/\*+|\*)\s*(.*)")
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
#: Titles of templates' sections, which are empty on purpose.
TEMPLATE_TITLES = frozenset(("unreleased", "todo", "notes", "references"))
BLOCK, BLOCK_BYTES = 10, 180


def test_code(path: str) -> bool:
    *folders, name = path.lower().split("/")
    if any(x in ("fixtures", "testdata") for x in folders):
        return named_test(name)
    return named_test(name) or not {"test", "tests", "__tests__", "spec", "specs"}.isdisjoint(folders)


def named_test(name: str) -> bool:
    return name.startswith("test_") or any(x in name for x in ("_test.", ".test.", "_spec.", ".spec.", ".stories."))


class File:
    """A source file's views and its blocks."""

    def __init__(self, path: str, source: str, language: str | None, prose: str, code: str):
        self.path, self.source, self.language, self.prose, self.code = path.lower(), source, language, prose, code
        self.python = language == "python"
        self.tests = test_code(path)
        self.parsed = None if self.python else Code(code)

    def blocks(self, word: str) -> list[Block]:
        return list(indented(self.code, (word,)) if self.python else self.parsed.braced(word))

    def noted(self, start: int, end: int) -> bool:
        """Whether a comment of three words or more, which is no to-do, stands on the lines of a stretch."""
        first, last = self.prose.rfind("\n", 0, start) + 1, self.prose.find("\n", end)
        said = (re.findall(r"[^\W_]+", x) for x in self.prose[first : last if last >= 0 else None].split("\n"))
        return any(len(w) >= 3 and w[0].lower() not in (*MARKERS, "hack", "xxx") for w in said)

    def decorated(self, start: int) -> bool:
        above = self.code[:start].rstrip().rpartition("\n")[2].lstrip()
        return above.startswith("@") or self.code[self.code.rfind("\n", 0, start) + 1 : start].lstrip().startswith("@")

    def declared(self, start: int, reach: int) -> bool:
        """Whether an abstract type begins within so many bytes before."""
        return DECLARING.search(self.code[:start].encode()[-reach:].decode(errors="ignore").lower()) is not None


def _fails(statements: list[Statement]) -> bool:
    """Whether the last statement raises or fails a test."""
    tokens = statements[-1].tokens if statements else []
    return tokens[:1] in (["raise"], ["throw"]) or "fail" in tokens[:3] and "(" in tokens


def _returned(s: Statement) -> list[str] | None:
    return s.tokens[1:] if s.tokens[:1] == ["return"] else None


def handler_findings(f: File) -> Iterator[tuple[str, int]]:
    """Empty handlers, fallbacks, rethrows and handlers that only log."""
    if not f.python and f.language not in BRACED:
        return
    for b in f.blocks("except" if f.python else "catch"):
        names = [t for t in b.head if t[0].isalpha() or t[0] == "_"]
        alone = b.body[0] if len(b.body) == 1 else None
        quiet = not EXPECTED.isdisjoint(names) or names[-1:] and names[-1] in IGNORED or f.noted(b.start, b.end)
        empty = alone is not None and alone.tokens in NOTHING if f.python else not b.body
        if empty and not quiet and not _fails(b.before) and not any(q in f.source[b.start : b.end] for q in "\"'"):
            yield "DEAD001", b.start
        if alone is None:
            continue
        value = _returned(alone)
        if value in EMPTY and not quiet:
            last = _returned(b.before[-1]) if b.before else None
            if not (value[0] in BOOLEANS and last and BOOLEANS.get(last[0])):
                yield "DEAD004", b.start
        if f.python and alone.tokens == ["raise"] and not b.later or f.language in SCRIPT and alone.tokens == ["throw", *names[-1:]] and len(names) > 1:
            yield "DEAD014", b.start
        said = call(alone.tokens)
        if f.python and said and not said[0] and said[1] == "print" or f.language in SCRIPT and said and [*said[0], ".", said[1]] in CONSOLE:
            yield "DEAD015", b.start


def function_findings(f: File) -> Iterator[tuple[str, int]]:
    """Empty functions, calls handed on, actions that always succeed."""
    words = ("def",) if f.python else ("function", "fn", "func") if f.language in (*SCRIPT, "go", "rust") else ()
    for b in (b for w in words for b in f.blocks(w)):
        name = next((t for t in b.head[b.head.index("def") if f.python else 0 :][1:] if t[0].isalpha() or t[0] in "_$"), "")
        alone = b.body[0] if len(b.body) == 1 else None
        empty = alone is not None and alone.tokens in NOTHING if f.python else not b.body
        line = f.code.rfind("\n", 0, b.start) + 1
        if empty and not f.tests and not f.noted(b.start, b.end) and not f.declared(line, 160) and not f.decorated(line):
            yield "DEAD005", b.start
        value = _returned(alone) if alone else None
        if value and (f.python or f.language in SCRIPT):
            said = call(value[value[0] == "await" :])
            if said and said[1] == name and said[0][:1] not in (["self"], ["this"]) and "(" in b.head and not f.decorated(line):
                opened = b.head.index("(")
                closed = len(b.head) - 1 - b.head[::-1].index(")")
                if arguments(b.head[opened + 1 : closed]) == arguments(said[2]):
                    yield "DEAD008", b.start
    if f.language in SCRIPT and not named_test(f.path.rpartition("/")[2]):
        p = f.parsed
        for i, t in enumerate(p.tokens):
            if (t in ACTIONS or t.startswith("handle") and t[6:7].isupper()) and p.tokens[i + 1 : i + 2] == ["("] and i + 1 in p.partner:
                j = p.partner[i + 1] + 1
                while j < len(p.tokens) and p.tokens[j] not in "{};,)":
                    j += 1
                if j < len(p.tokens) and p.tokens[j] == "{" and j in p.partner:
                    body = p.statements(j + 1, p.partner[j])
                    if len(body) == 1 and [x for x in body[0].tokens if x != ","] in [["return", "{", k, ":", "true", "}"] for k in ("ok", "success")]:
                        yield "DEAD017", p.at[i]
            elif t.startswith("on") and t[2:3].isupper() and p.tokens[i + 1 : i + 3] == ["=", "{"]:
                rest = p.tokens[i + 3 : i + 30]
                rest = rest[rest[:1] == ["async"] :]
                if rest[:1] == ["("] and "=>" in rest and rest[rest.index("=>") - 1] == ")" and rest[rest.index("=>") + 1 :][:3] == ["{", "}", "}"]:
                    yield "DEAD016", p.at[i]


def branch_findings(f: File) -> Iterator[tuple[str, int]]:
    """Branches that return a truth value as another one."""
    if f.python:
        lines = logical_lines(f.code)
        for a, b, c, d in zip(lines, lines[1:], lines[2:], lines[3:]):
            if a.tokens[0] == "if" and c.tokens == ["else", ":"] and a.indent == c.indent < min(b.indent, d.indent) and b.tokens[0] == d.tokens[0] == "return":
                if {BOOLEANS.get(" ".join(b.tokens[1:])), BOOLEANS.get(" ".join(d.tokens[1:]))} == {True, False}:
                    yield "DEAD009", a.start
    elif f.language in (*SCRIPT, "java", "csharp"):
        p = f.parsed
        for b in p.braced("if"):
            after = next((k for k, x in enumerate(p.at) if x >= b.end), len(p.at))
            if p.tokens[after : after + 2] == ["else", "{"] and after + 1 in p.partner and len(b.body) == 1:
                other = p.statements(after + 2, p.partner[after + 1])
                values = [_returned(s) or [""] for s in (b.body[0], *other[:1])]
                if len(other) == 1 and all(len(v) == 1 for v in values) and {BOOLEANS.get(v[0]) for v in values} == {True, False}:
                    yield "DEAD009", b.start


def stub_findings(f: File) -> Iterator[tuple[str, int]]:
    """Code that says it isn't written yet."""
    p = f.parsed or Code(f.code)
    heads = list(indented(f.code, ("def", "if", "elif", "else"))) if f.python else []
    for i, t in enumerate(p.tokens):
        low, nxt = t.lower(), p.tokens[i + 1 : i + 3]
        start = p.at[i]
        if low in ("todo", "unimplemented") and nxt[:1] == ["!"]:
            pass
        elif low == "raise" and nxt and nxt[0].lower() in ("notimplementederror", "notimplementedexception"):
            pass
        elif low == "throw" and len(nxt) == 2 and nxt[0].lower() == "new" and nxt[1].lower() in ("notimplementederror", "notimplementedexception"):
            pass
        elif low == "throw" and len(nxt) == 2 and [x.lower() for x in nxt] == ["new", "error"] or low == "panic" and nxt[:1] in (["("], ["!"]):
            stop = min((x for x in (f.code.find(";", start), f.code.find("\n", start)) if x >= 0), default=len(f.source))
            if not re.search(r"\b(?:todo|not (?:yet )?implemented|unimplemented|placeholder)\b", f.source[start:stop], re.I):
                continue
        else:
            continue
        if re.search(r"abstract|trait |protocol ", f.code[:start].encode()[-240:].decode(errors="ignore").lower()):
            continue
        own = [b for b in heads if b.body and b.body[0].start == start or b.start <= start <= b.end and b.body and b.body[0].start <= start <= b.body[0].end]
        if own and (own[-1].head[0] in ("if", "elif", "else") or len(own[-1].body) == 1 and {"self", "cls"} & set(own[-1].head[:6])):
            continue
        yield "DEAD003", start


def assertion_findings(f: File) -> Iterator[tuple[str, int]]:
    """Assertions that can't fail, in test code."""
    if not ("/test" in f.path or f.path.startswith("test") or any(x in f.path for x in ("_test.", ".test.", ".spec."))):
        return
    p = f.parsed or Code(f.code)
    plain = lambda ts: len(ts) == 1 and ts[0].lower() in ("true", "false", "0", "1")
    for i, t in enumerate(p.tokens):
        rest = p.tokens[i + 1 : i + 14]
        if t == "assert" and f.python:
            line = f.code[p.at[i] : (f.code + "\n").find("\n", p.at[i])].split()
            same = line[1:] == ["True"] or "".join(line[1:]) == "1==1"
        elif t == "expect" and rest[:1] == ["("] and rest[2:4] == [")", "."] and rest[4:5] and rest[4] in ("toBe", "toEqual"):
            same = plain(rest[1:2]) and rest[5:8] == ["(", rest[1], ")"]
        elif t == "assert" and rest[:2] == ["!", "("]:
            same = [x.lower() for x in rest[2:4]] == ["true", ")"]
        elif t == "assert" and rest[:3] == [".", "ok", "("]:
            same = [x.lower() for x in rest[3:5]] == ["true", ")"]
        elif t == "assert" and rest[:1] == ["."] and rest[1:2] and rest[1] in ("equal", "strictEqual") or t == "assert_eq":
            args = rest[3:] if t == "assert" else rest[2:]
            same = plain(args[:1]) and args[1:4] == [",", args[0], ")"]
        else:
            continue
        if same:
            yield "DEAD010", p.at[i]


def code_findings(path: str, source: str, kind: str, language: str | None) -> list[tuple[str, int]]:
    """rule and one-based line of each finding of one file."""
    source = source.replace("\r\n", "\n")
    v = views(source, kind, language, path)
    prose, code = v["prose"], v["code"]
    if kind == "docs":
        return [("DEAD013", source.count("\n", 0, m.start()) + 1) for m in INVENTORY.finditer(prose)] + [("DEAD012", n) for n in empty_sections(prose)]
    if kind != "code":
        return []
    f = File(path, source, language, prose, code)
    found = [x for part in (handler_findings, function_findings, branch_findings, stub_findings, assertion_findings) for x in part(f)]
    out = [(rule, source.count("\n", 0, at) + 1) for rule, at in found]
    lines, notes, bare = source.split("\n"), prose.split("\n"), code.split("\n")
    out += comment_findings(lines, notes, bare, f.tests)
    if not f.tests:
        out += [("DEAD002", n) for n in placeholders(prose, code)] + [("DEAD011", n) for n in repeated_blocks(lines, notes, bare)]
    return out


def placeholders(prose: str, code: str) -> list[int]:
    """One-based lines of comments with a marker of work that is left over and that nobody owns."""
    tests = re.search(r"#\[cfg\(test\)\]\s*(?:pub\s+)?mod\s", code)
    end, out = tests.start() if tests else len(prose), []
    for m in MARKER.finditer(prose, 0, end):
        word, line = m[0], prose.rfind("\n", 0, m.start()) + 1
        before, after = prose[line : m.start()], prose[m.end() :]
        if word.lower() in MARKERS:
            name = after[:1] in "-./" and after[1:2].isalnum() if after[:1] else False
            following = re.match(r" ([A-Za-z]+)", after)
            if not word.isupper() and (not OPENER.fullmatch(before) or name or following and following[1].lower() in ITEMS):
                continue
        elif word not in CAPITALS:
            continue
        # a mark in quotes is spoken of
        quoted = before[-1:] == "`" or (before[-1:], after.lstrip(":")[:1]) in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")) and before[-2:-1] != before[-1:]
        owned = re.match(r"[(\[]\s*[^)\]\s]", after)
        near = prose[m.start() : m.end() + len("\n".join(after.split("\n", 2)[:2]))]
        value = False
        if word == "XXX":
            lead = re.findall(r"\w+", prose[prose.rfind("\n", 0, max(0, line - 1)) + 1 : m.start()])[-2:]
            value = any(before.count(q) % 2 for q in "'\"`") or any(w.lower() in DETERMINERS for w in lead)
        n = prose.count("\n", 0, m.start()) + 1
        if not (quoted or owned or value or TRACKED_LINK.search(near) or TRACKED_NUMBER.search(near)) and n not in out[-1:]:
            out.append(n)
    return out


def comment_findings(lines: list[str], notes: list[str], bare: list[str], tests: bool) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    alone = [NOTE.match(n.strip())[1].strip() if n.strip() and not c.strip() and NOTE.match(n.strip()) else None for n, c in zip(notes, bare)]
    steps = [i for i, t in enumerate(alone) if t and STEPS.match(t)]
    if len(steps) >= 2:
        out.append(("DEAD018", steps[0] + 1))
    last: tuple[int, str] | None = None
    for i, t in enumerate(alone):
        if t is None:
            if bare[i].strip():
                last = None
            continue
        plain = " ".join(re.findall(r"\w+", t.lower()))
        if last and last[1] == plain and i - last[0] <= 2 and len(plain.encode()) >= 12 and " " in plain:
            out.append(("DEAD007", i + 1))
        last = (i, plain) if plain else last
        words = [w for w in dict.fromkeys(plain.split()) if w not in ("the", "a", "an", "to", "of", "and", "in", "is", "for", "we", "this", "it")]
        below = bare[i + 1] if i + 1 < len(bare) else ""
        if 2 <= len(words) <= 8 and len(t.encode()) >= 8 and below.strip() and (i == 0 or alone[i - 1] is None):
            tokens = {x.lower() for w in re.findall(r"\w+", below) for x in re.split(r"_|(?<=[a-z])(?=[A-Z])", w)}
            for sign, more in (("+=", ("increment", "add")), ("-=", ("decrement", "subtract")), ("=", ("set", "assign")), ("return", ("return", "returns"))):
                tokens |= set(more) if sign in below else set()
            same = sum(w in tokens for w in words)
            if same >= 2 and same * 5 >= len(words) * 4:
                out.append(("DEAD006", i + 1))
    return out


def repeated_blocks(lines: list[str], notes: list[str], bare: list[str]) -> list[int]:
    """One-based first lines of blocks that repeat an earlier one; each distinct block once, longer copies merged."""
    plain = [" ".join(x.split()) for x in lines]
    full = [bool(p) and bool(b.strip()) and not re.fullmatch(r"[\d\s,.xXa-fA-F{}\[\]();-]+", p) for p, b in zip(plain, bare)]
    first: dict[str, int] = {}
    out, done, after = [], set(), -1
    for i in range(len(lines) - BLOCK + 1) if len(lines) >= 2 * BLOCK + 2 else ():
        if not all(full[i : i + BLOCK]):
            continue
        body = "\n".join(plain[i : i + BLOCK])
        if len(body.encode()) < BLOCK_BYTES:
            continue
        at = first.setdefault(body, i)
        if i - at >= BLOCK and body not in done:
            if i > after:
                out.append(i + 1)
            done.add(body)
            after = i + BLOCK - 1
    return out


def empty_sections(prose: str) -> list[int]:
    """One-based lines of headings that nothing follows before a heading of their level or above."""
    lines = prose.split("\n")
    heads = [(i, len(m[1]), m[2]) for i, x in enumerate(lines) if (m := HEADING.match(x.strip() if len(x) - len(x.lstrip()) < 4 else x))]
    out = []
    for k, (i, level, title) in enumerate(heads):
        if k + 1 < len(heads) and heads[k + 1][1] > level or k == 0 and level == 1:
            continue
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        body = " ".join(lines[i + 1 : end]).split()
        said = {w.lower().strip(".,:;!?") for w in title.split()}
        if title.strip("[] ").lower() in TEMPLATE_TITLES:
            continue
        if not body or len(body) <= 12 and len([x for x in lines[i + 1 : end] if x.strip()]) <= 2 and {w.lower().strip(".,:;!?") for w in body} <= said:
            out.append(i + 1)
    return out


def findings(df: DataFrame, key: str) -> DataFrame:
    """key, rule_id, line of df (key, path, source, kind, code_lang). Null sources have no findings."""
    ship(df.sparkSession)
    kind = to_arrow_type(FOUND)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[{"rule_id": r, "line": n} for r, n in code_findings(x["path"] or "", x["source"], x["kind"] or "docs", x["code_lang"])] if x["source"] else [] for x in b.to_pylist()], type=kind)

    packed = F.struct("path", "source", "kind", "code_lang")
    found = df.select(F.col(key), run.asNondeterministic()(packed).alias("f"))
    return found.select(key, F.explode("f").alias("x")).select(key, "x.rule_id", "x.line")
