"""Text primitives as column expressions; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}']+"
#: A quoted stretch of a line, up to the line's end if it isn't closed.
QUOTED = r"\"[^\"\n]*\"?|“[^”\n]*”?"


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def words(c: Column) -> Column:
    """Lowercase words: runs of letters, figures and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def n_tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.regexp_count(c, F.lit(r"[^ \t\n\f\r]+")).cast("bigint")


def paragraphs(c: Column) -> Column:
    """Maximal runs of lines with a letter or figure, trimmed."""
    plain = replace(c, r"\r\n?", "\n")
    marked = replace(plain, r"(?:^|\n)[^\p{L}\p{N}\n]*(?=\n|$)", "\n\n")
    trimmed = F.transform(F.split(marked, r"\n{2,}"), lambda p: replace(p, r"^\s+|\s+\z", ""))
    return F.filter(trimmed, lambda p: p.rlike(r"[\p{L}\p{N}]"))


def sentences(c: Column) -> Column:
    """A paragraph cut behind . ! ? that white space or the end follows; trimmed, empties dropped."""
    marked = replace(c, r"([.!?])([ \t\n\f\r]+|\z)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: replace(s, r"^\s+|\s+\z", "")), lambda s: s != "")


def unquoted(c: Column) -> Column:
    return replace(c, QUOTED, "\"")


def _tree(tails: list[str]) -> str:
    """A pattern for strings that shares their beginnings, the longest first; "" stands for an end here."""
    heads: dict[str, list[str]] = {}
    for t in tails:
        if t:
            heads.setdefault(t[0], []).append(t[1:])
    parts = [("['’]" if c == "'" else re.escape(c)) + _tree(rest) for c, rest in sorted(heads.items())]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and "" not in tails else f"(?:{'|'.join(parts)})"
    return body + ("?" if "" in tails else "")


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """One pattern for all phrases, the longest first; a phrase ends where no letter, figure or underline follows.
    Straight apostrophes also match curly ones. Phrases share their beginnings, and a look at the first character
    passes over most of the text."""
    first = "".join(sorted({re.escape(p[0]) for p in phrases}))
    return rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])({_tree(list(phrases))})(?![\p{{L}}\p{{N}}_])"


def folded(c: Column) -> Column:
    """What phrases are sought in: lowercase, without quoted stretches."""
    return F.lower(unquoted(c))


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases of a folded text, in order, each as often as it occurs."""
    hits = F.regexp_extract_all(text, F.lit(phrase_pattern(phrases)), F.lit(1))
    return F.transform(hits, lambda h: F.translate(h, "’", "'"))


def has_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(c).rlike(phrase_pattern(phrases))
