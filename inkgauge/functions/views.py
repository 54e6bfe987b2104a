"""Views of a file: its prose (comments, or running text without code) and its code (without comments and literals).
Both are as long as the source, character by character; what a view leaves out is blank, line feeds stay."""

from __future__ import annotations

import re

#: Languages with hash comments; all others have // and /* */.
HASHED = ("python", "ruby", "shell")
STRING = r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
LEXERS = {
    "python": re.compile(r"(?P<doc>(?<![^\n])[ \t]*(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)))|(?P<off>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|" + STRING + r")|(?P<note>#[^\n]*)"),
    "hashed": re.compile(r"(?P<off>" + STRING + r")|(?P<note>#[^\n]*)"),
    "rust": re.compile(r"(?P<off>(?<!\w)b?r(?P<n>#*)\"[\s\S]*?(?:\"(?P=n)|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\\n])')|(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"),
    "slashed": re.compile(r"(?P<note>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<off>" + STRING + r")"),
}
FILLED = re.compile(r"[^\n]")
FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
INLINE = re.compile(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)")


def blank(s: str) -> str:
    return FILLED.sub(" ", s)


def code_views(source: str, language: str | None) -> tuple[str, str]:
    """Prose and code view of a source file."""
    lexer = LEXERS["python" if language == "python" else "hashed" if language in HASHED else "rust" if language == "rust" else "slashed"]
    prose, code, at = [], [], 0
    for m in lexer.finditer(source):
        between = source[at : m.start()]
        prose += [blank(between), m[0] if m.lastgroup in ("note", "doc") else blank(m[0])]
        code += [between, blank(m[0])]
        at = m.end()
    return "".join(prose) + blank(source[at:]), "".join(code) + source[at:]


def document_view(source: str) -> str:
    """The prose of a document: no front matter, HTML comments, fences or inline code."""
    out: list[str] = []
    fence, comment, front = "", False, False
    for i, line in enumerate(source.split("\n")):
        bare = line.lstrip("﻿").strip() if i == 0 else line.strip()
        if i == 0 and bare == "---":
            front = True
            out.append(blank(line))
        elif front:
            front = bare not in ("---", "...")
            out.append(blank(line))
        elif comment or "<!--" in line:
            kept, at = [], 0
            while at < len(line):
                end = line.find("-->" if comment else "<!--", at)
                end = len(line) if end < 0 else end + 3 if comment else end
                kept.append(blank(line[at:end]) if comment else line[at:end])
                if end < len(line) or comment and line[at:end].endswith("-->"):
                    comment = not comment
                at = end
            out.append("".join(kept))
        elif fence:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = ""
            out.append(blank(line))
        elif m := FENCE.match(line):
            fence = m[1]
            out.append(blank(line))
        else:
            out.append(INLINE.sub(lambda x: blank(x[0]), line))
    return "\n".join(out)


#: Directives whose body is running text.
RST_PROSE = frozenset(
    "admonition attention caution container danger deprecated error hint important note only rubric seealso sidebar tip topic versionadded versionchanged versionremoved warning".split()
)
RST_DIRECTIVE = re.compile(r"\.\.\s+(?:([\w:-]+)::|\S|$)")
RST_INLINE = re.compile(r"``.+?``|:[\w:+.-]+:`[^`\n]+`|`[^`\n]+`_{0,2}")
RST_FIELD = re.compile(r"[ \t]*:[^:\n]+:(?=\s|$)")


def rst_view(source: str) -> str:
    """The prose of a reStructuredText document: no directives but those whose body is text, no literal blocks, doctests,
    roles, fields or inline code."""
    out: list[str] = []
    lines = source.split("\n")
    i = 0

    def width(x: str) -> int:
        return len(x.expandtabs(8)) - len(x.expandtabs(8).lstrip())

    def take(column: int, off: bool) -> None:
        """The lines of a block indented past a column, blanked or kept."""
        nonlocal i
        while i < len(lines) and (not lines[i].strip() or width(lines[i]) > column):
            out.append(blank(lines[i]) if off else lines[i])
            i += 1

    while i < len(lines):
        line, bare = lines[i], lines[i].strip()
        if bare.startswith(">>>"):
            while i < len(lines) and lines[i].strip():
                out.append(blank(lines[i]))
                i += 1
            continue
        m = RST_DIRECTIVE.match(bare)
        if m or bare == "..":
            column = width(line)
            prose = m is not None and m[1] in RST_PROSE
            head = line.index("..") + (m.end() if prose else 0)
            out.append(blank(line[:head]) + line[head:] if prose else blank(line))
            i += 1
            while prose and i < len(lines) and width(lines[i]) > column and lines[i].strip().startswith(":"):
                out.append(blank(lines[i]))
                i += 1
            if not prose:
                take(column, True)
            continue
        text = RST_INLINE.sub(lambda x: blank(x[0]), line)
        text = RST_FIELD.sub(lambda x: blank(x[0]), text, count=1) if RST_FIELD.match(text) else text
        out.append(text)
        i += 1
        if bare.endswith("::"):
            column, at = width(line), i
            while at < len(lines) and not lines[at].strip():
                at += 1
            if at < len(lines) and width(lines[at]) > column:
                take(column, True)
    return "\n".join(out)


def text_view(source: str) -> str:
    """Plain text without the indented block that a line ending in a colon leads in."""
    out, lead, inside = [], False, False
    for line in source.split("\n"):
        if line.strip():
            inside = line.startswith(("\t", "    ")) and (inside or lead)
            if not inside:
                lead = line.rstrip().endswith(":")
        out.append(blank(line) if inside and line.strip() else line)
    return "\n".join(out)


def views(source: str | None, kind: str | None, language: str | None, path: str = "") -> dict | None:
    if source is None:
        return None
    if kind == "code":
        prose, code = code_views(source, language)
    else:
        code = blank(source)
        prose = rst_view(source) if kind == "docs" and path.lower().endswith(".rst") else document_view(source) if kind == "docs" else text_view(source) if kind == "text" else blank(source)
    return {"prose": prose, "code": code}
