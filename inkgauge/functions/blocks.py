"""Blocks of source code, read from its code view: functions, handlers and branches with their statements. Python's are
told by indentation, those of other languages by braces; no rule needs more of the grammar than that."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|=>|===?|!==?|[-+]=|\.\.\.|[^\s\w]")
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Statement(NamedTuple):
    """Tokens of a statement, and where it begins and ends in the code."""

    tokens: list[str]
    start: int
    end: int


class Block(NamedTuple):
    """What a block is headed by, its statements, and where both begin and end; ``before`` is the block it belongs to, as
    the guarded block of a handler."""

    head: list[str]
    body: list[Statement]
    start: int
    end: int
    before: list[Statement]
    later: bool


class Code:
    """The tokens of a code view, with their places and the partners of brackets."""

    def __init__(self, code: str):
        self.code = code
        found = [(m[0], m.start()) for m in TOKEN.finditer(code)]
        self.tokens, self.at = [t for t, _ in found], [a for _, a in found]
        self.partner: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        waiting: list[int] = []
        for i, t in enumerate(self.tokens):
            if t in PAIRS:
                waiting.append(i)
            elif t in ")]}":
                while waiting and PAIRS[self.tokens[waiting[-1]]] != t:
                    waiting.pop()
                if waiting:
                    self.partner[waiting[-1]] = i
                    self.opener[i] = waiting.pop()

    def end(self, i: int) -> int:
        return self.at[i] + len(self.tokens[i])

    def statements(self, first: int, last: int) -> list[Statement]:
        """Of the tokens from first to before last: cut at semicolons and at closed braces."""
        out, i, begin = [], first, first
        while i < last:
            t = self.tokens[i]
            if t in PAIRS and i in self.partner:
                closed = self.partner[i]
                # an object or a function that a call or assignment goes on after is part of the statement
                if t == "{" and begin == i or t == "{" and self.tokens[i - 1] == ")" and self.tokens[closed + 1 : closed + 2] not in ([")"], [";"], [","], ["."]):
                    out.append(Statement(self.tokens[begin : closed + 1], self.at[begin], self.end(closed)))
                    begin = closed + 1
                i = closed + 1
                continue
            if t == ";":
                if i > begin:
                    out.append(Statement(self.tokens[begin:i], self.at[begin], self.end(i - 1)))
                begin = i + 1
            i += 1
        if begin < last:
            out.append(Statement(self.tokens[begin:last], self.at[begin], self.end(last - 1)))
        return out

    def braced(self, word: str) -> Iterator[Block]:
        """Blocks that the word heads, up to the brace: ``catch (e) {...}``."""
        for i, t in enumerate(self.tokens):
            if t != word:
                continue
            j = i + 1
            while j < len(self.tokens) and self.tokens[j] not in "{};":
                j = self.partner.get(j, j) + 1
            if j < len(self.tokens) and self.tokens[j] == "{" and j in self.partner:
                closed = self.partner[j]
                before = self.statements(self.opener[i - 1] + 1, i - 1) if i - 1 in self.opener and self.tokens[i - 1] == "}" else []
                yield Block(self.tokens[i:j], self.statements(j + 1, closed), self.at[i], self.end(closed), before, False)


class Line(NamedTuple):
    indent: int
    tokens: list[str]
    start: int
    end: int


def indent(line: str) -> int:
    head = line[: len(line) - len(line.lstrip())]
    return len(head) + 7 * head.count("\t")


def logical_lines(code: str) -> list[Line]:
    """Python's lines that aren't blank, joined where a bracket is open."""
    out: list[Line] = []
    at = depth = 0
    for raw in code.split("\n"):
        tokens = TOKEN.findall(raw)
        if tokens:
            end = at + len(raw.rstrip())
            if depth > 0:
                last = out[-1]
                out[-1] = Line(last.indent, last.tokens + tokens, last.start, end)
            else:
                out.append(Line(indent(raw), tokens, at + len(raw) - len(raw.lstrip()), end))
            depth = max(0, depth + sum(t in PAIRS for t in tokens) - sum(t in ")]}" for t in tokens))
        at += len(raw) + 1
    return out


def indented(code: str, words: tuple[str, ...]) -> Iterator[Block]:
    """Python's blocks that one of the words heads, with the statements below the colon or behind it."""
    lines = logical_lines(code)
    for i, x in enumerate(lines):
        k = next((k for k, t in enumerate(x.tokens[:2]) if t in words and (not k or x.tokens[0] == "async")), None)
        if k is None or ":" not in x.tokens:
            continue
        depth, colon = 0, -1
        for n, t in enumerate(x.tokens):
            depth += (t in PAIRS) - (t in ")]}")
            if t == ":" and not depth:
                colon = n
                break
        if colon < 0:
            continue
        j = i + 1
        while j < len(lines) and lines[j].indent > x.indent:
            j += 1
        body = [Statement(x.tokens[colon + 1 :], x.start, x.end)] if x.tokens[colon + 1 :] else []
        body += [Statement(y.tokens, y.start, y.end) for y in lines[i + 1 : j]]
        b = i - 1
        while b >= 0 and lines[b].indent > x.indent:
            b -= 1
        before = [Statement(y.tokens, y.start, y.end) for y in lines[b + 1 : i]]
        later = j < len(lines) and lines[j].indent == x.indent and lines[j].tokens[0] == "except"
        yield Block(x.tokens[:colon], body, x.start, body[-1].end if body else x.end, before, later)


def arguments(tokens: list[str]) -> list[str]:
    """The names in a list of parameters or arguments, without the receiver, types, defaults and stars."""
    out, depth, part = [], 0, []
    for t in [*tokens, ","]:
        depth += (t in PAIRS) - (t in ")]}")
        if t == "," and depth == 0:
            name = []
            for p in part:
                if p in ":=":
                    break
                name.append(p)
            text = "".join(name).lstrip("*.")
            if text and text not in ("self", "this"):
                out.append(text)
            part = []
        else:
            part.append(t)
    return out


def call(tokens: list[str]) -> tuple[list[str], str, list[str]] | None:
    """Receiver, name and arguments, if the tokens are one call and no more."""
    names = []
    for i, t in enumerate(tokens):
        if t == "(":
            depth = 0
            for j in range(i, len(tokens)):
                depth += (tokens[j] == "(") - (tokens[j] == ")")
                if not depth:
                    return (names[:-1], names[-1], tokens[i + 1 : j]) if names and j == len(tokens) - 1 else None
            return None
        if t != ".":
            if not (t[0].isalpha() or t[0] in "_$") or i and tokens[i - 1] != ".":
                return None
            names.append(t)
    return None
