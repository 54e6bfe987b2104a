"""Natural language inside source code (problem 3).

``extract`` takes the comments and string literals out of a source file by one regular expression per comment style.
``languages`` finds the function words of all languages in these spans by a single Aho-Corasick pass; a hit counts if
it stands between word boundaries, and gives each of the n languages that have the word 1/n of a vote. The votes
decide among the languages of a sentence's script; writing systems without spaces are settled by
their code point ranges, as are sentences without any function word. Disabled code, identifiers, queries, paths, patterns and other technical strings are no
sentences.

Defined results: null, empty or blank source has no language. A file without a known language of code is read with the
style its extension names, else with C-like comments. Files are independent of each other; a row delivered twice gives
equal results, and ``p3_found`` returns them once. Sources of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang import DENSE_OR_THAI, ONLY_SCRIPT, SCRIPT_OF_LANG, UNSPACED, function_words, scripts, units
from .rows import with_struct

RESULT = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("sentences", T.LongType()), T.StructField("letters", T.LongType()), T.StructField("share", T.DoubleType())]))

#: Languages of code whose comments begin with a hash sign.
HASH = ("python", "ruby", "shell", "perl", "yaml", "r")
EXTENSIONS = {"py": "python", "pyi": "python", "pyw": "python", "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell", "pl": "perl", "r": "r", "yml": "yaml", "yaml": "yaml", "php": "php"}
STRINGS = r"""(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
TRIPLE = r'(?P<t>"""[\s\S]*?(?:"""|\Z)|' + r"'''[\s\S]*?(?:'''|\Z))"
BACKTICK = r"(?P<b>`(?:\\.|[^`\\])*`)"
HASH_COMMENT, SLASH_COMMENT, BLOCK = r"(?P<h>(?<![\w$&{\\])#[^\n]*)", r"(?P<l>//[^\n]*)", r"(?P<c>/\*[\s\S]*?(?:\*/|\Z))"
RUBY_BLOCK = r"(?P<r>^=begin[\s\S]*?^=end)"
STYLES = {
    "python": re.compile("|".join((TRIPLE, HASH_COMMENT, STRINGS))),
    "hash": re.compile("|".join((RUBY_BLOCK, HASH_COMMENT, STRINGS)), re.M),
    "php": re.compile("|".join((SLASH_COMMENT, BLOCK, HASH_COMMENT, STRINGS))),
    "c": re.compile("|".join((SLASH_COMMENT, BLOCK, STRINGS, BACKTICK))),
}
ESCAPE = re.compile(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|\\(.)", re.S)
SHORT = {"n": "\n", "t": " ", "r": " "}
LEAD = re.compile(r"^[ \t]*(?:/{2,}!?|#+!?|/\*+!?|\*+(?!/)|--+|;+|\"\"\"|''')?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
#: What stands in code, queries, patterns and settings, but not in sentences.
TECHNICAL = re.compile(
    r"[{}<>\[\]|\\=^$@~]|\w\(|\);?$|(?<![Ͱ-Ͽ]);\s*$|::|->|=>|&&|\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b.*\b(?:FROM|INTO|SET|TABLE|WHERE)\b|^\s*(?:import|from|return|def|func|fn|let|var|const|use|package|namespace|include|if\s*\(|for\s*\()\b[^.]*[;(){}]|^-{2,}|-{3,}|={3,}|\*{3,}"
)
SENTENCE = re.compile(r"(?<=[.!?।؟])[\"”»’)]*\s+|(?<=[。！？])|\n")
#: A sentence has so many words, and so large a share of its tokens are words.
LEAST_UNITS, LEAST_WORDLIKE = 3.0, 0.7
WORDLIKE = re.compile(r"[\"'(«“„¿¡‘]*[^\W\d_][\w'’\-̀-ͯऀ-ॿ؀-ۿ]*[.,:;!?…\"')»”’؟।]*|\d[\d.,:%]*[.,;:!?]*|[–—-]|[?!:;»«]")
CAMEL = re.compile(r"[a-z][A-Z]|_\w|\w\.\w|/\w")
#: The letters and marks beyond A to Z of each language in Latin script. A letter of n languages gives
#: each 1/n of HINT votes.
ALPHABETS = {
    "de": "äöüß",
    "es": "áéíñóúü¿¡",
    "fr": "àâæçèéêëîïôœùûü",
    "pl": "ąćęłńóśźż",
    "pt": "àáâãçéêíóôõú",
    "tr": "çğıöşü",
}
LETTER_VOTES = {c: tuple(k for k, v in ALPHABETS.items() if c in v) for c in sorted({c for v in ALPHABETS.values() for c in v})}
HINT = 0.5
#: The weight of a language that the rest of the file doesn't have, against that of the file's only one (1 + PRIOR).
PRIOR = 0.35
#: So many sentences of a language make it one of the file's.
LEAST_SENTENCES = 2


UNSPACED_SCRIPTS = {SCRIPT_OF_LANG[k]: k for k in UNSPACED}


def inside(c: str) -> bool:
    """Whether a character beside a word belongs to it: letters, figures, combining marks, apostrophes, underlines."""
    return c.isalnum() or c in "_'’" or c > "\u02ff" and unicodedata.category(c)[0] == "M"


def unescape(s: str) -> str:
    """Code point escapes and line ends of a literal; other escaped characters stand for themselves."""

    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3] or m[4]
        if digits:
            n = int(digits, 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
        return SHORT.get(m[5], m[5])

    return ESCAPE.sub(one, s) if "\\" in s else s


def style(code_lang: str | None, path: str | None) -> str:
    name = (code_lang or EXTENSIONS.get((path or "").rpartition(".")[2].lower(), "")).lower()
    return "python" if name == "python" else "php" if name == "php" else "hash" if name in HASH else "c"


def extract(source: str, kind: str) -> list[str]:
    """The texts of comments and string literals. Line comments that follow each other line by line are one text, as
    are literals joined by nothing but operators and white space."""
    out: list[str] = []
    last_end, last_kind = -1, ""
    for m in STYLES[kind].finditer(source):
        which, raw = m.lastgroup, m[0]
        if which in "st":
            body = unescape(raw[3:-3] if which == "t" else raw[1:-1])
        elif which == "b":
            body = unescape(raw[1:-1])
        else:
            body = LEAD.sub("", raw)
        between = source[last_end : m.start()] if last_end >= 0 else "x"
        if which == last_kind and which in "hl" and between.strip() == "" and between.count("\n") == 1 and out:
            out[-1] += "\n" + body
        elif which == last_kind == "s" and out and between.strip() in ("+", ".", "", "\\", "..", "<<"):
            out[-1] += body
        else:
            out.append(body)
        last_end, last_kind = m.end(), which
    return out


def sentences(text: str) -> list[str]:
    """The pieces of a span that read like sentences."""
    out = []
    for s in SENTENCE.split(text):
        s = s.strip()
        plain = s.isascii()
        if len(s) < 8 or plain and s.count(" ") < 2 or TECHNICAL.search(s):
            continue
        if not plain and units(s) < LEAST_UNITS:
            continue
        if not plain and DENSE_OR_THAI.search(s):
            if len(DENSE_OR_THAI.findall(s)) >= 0.4 * len(s):
                out.append(s)
            continue
        words = s.split()
        if len(words) >= 3 and sum(WORDLIKE.fullmatch(w) is not None and not CAMEL.search(w) for w in words) >= LEAST_WORDLIKE * len(words):
            out.append(s)
    return out


class Finder:
    """Languages of sentences; built once for each worker from the function words."""

    def __init__(self, words: dict[str, list[str]]):
        self.words = words
        self.automaton = None

    def build(self) -> None:
        import ahocorasick

        of: dict[str, list[str]] = {}
        for lang, ws in sorted(self.words.items()):
            if lang not in UNSPACED:
                for w in ws:
                    of.setdefault(w.casefold(), []).append(lang)
        self.automaton = ahocorasick.Automaton()
        for w, langs in of.items():
            self.automaton.add_word(w, (len(w), tuple(dict.fromkeys(langs))))
        self.automaton.make_automaton()
        self.known = bool(of)
        self.script_of = {}
        for lang, ws in self.words.items():
            found = scripts(" ".join(ws))
            self.script_of[lang] = max(found, key=lambda k: (found[k], k), default="latin")

    def __getstate__(self) -> dict:
        return {"words": self.words, "automaton": None}  # each worker builds its own

    def votes(self, pieces: list[str]) -> list[dict[str, float]]:
        """For each piece the votes of the words in it, by one pass over all pieces."""
        if self.automaton is None:
            self.build()
        out: list[dict[str, float]] = [{} for _ in pieces]
        if not self.known or not pieces:
            return out
        folded = [p.casefold().replace("\u0307", "") for p in pieces]  # a dotted capital I leaves a combining dot
        text = "\n".join(folded)
        ends, at = [], 0
        for f in folded:
            at += len(f) + 1
            ends.append(at)
        k, n = 0, len(text)
        for end, (size, langs) in self.automaton.iter(text):
            start = end - size + 1
            if start and inside(text[start - 1]) or end + 1 < n and inside(text[end + 1]):
                continue
            while end >= ends[k]:
                k += 1
            for lang in langs:
                out[k][lang] = out[k].get(lang, 0.0) + 1 / len(langs)
        return out

    def __call__(self, pieces: list[str]) -> list[str | None]:
        voted: list[int] = []
        script: dict[int, str] = {}
        out: list[str | None] = [None] * len(pieces)
        for i, p in enumerate(pieces):
            if p.isascii():
                voted.append(i)
                script[i] = "latin"
                continue
            found = scripts(p)
            cjk = found.get("kana", 0) + found.get("han", 0)
            if found.get("kana", 0) * 10 >= cjk > 0 and cjk * 3 >= found.get("latin", 0):
                out[i] = "ja"
                continue
            best = max((k for k in found), key=lambda k: (found[k] * (3 if k in ("han", "hangul") else 1), k), default=None)
            if best in UNSPACED_SCRIPTS:
                out[i] = UNSPACED_SCRIPTS[best]
            elif best is not None:
                voted.append(i)
                script[i] = best
        votes = self.votes([pieces[i] for i in voted])
        for i, v in zip(voted, votes):
            for lang in [k for k in v if self.script_of[k] != script[i]]:
                del v[lang]
            if script[i] == "latin" and not pieces[i].isascii():
                for c in LETTER_VOTES.keys() & set(pieces[i].lower()):
                    for lang in LETTER_VOTES[c]:
                        v[lang] = v.get(lang, 0.0) + HINT / len(LETTER_VOTES[c])
        total: Counter[str] = Counter()
        for v in votes:
            total.update(v)
        weight = total.total() or 1.0
        for i, v in zip(voted, votes):
            # the file's other sentences settle near ties
            if v:
                out[i] = max(v, key=lambda k: (v[k] * (PRIOR + total[k] / weight), k))
            elif script[i] != "latin":
                out[i] = ONLY_SCRIPT.get(script[i])
            elif pieces[i].isascii():
                out[i] = "en"
        return out


def languages(source: str | None, kind: str, find: Finder) -> list[dict]:
    """The languages of one file with their sentences, letters and shares of the letters of all its sentences."""
    if not source or not source.strip():
        return []
    pieces = [s for t in extract(source, kind) for s in sentences(t)]
    count: Counter[str] = Counter()
    letters: Counter[str] = Counter()
    for s, lang in zip(pieces, find(pieces)):
        if lang is not None:
            count[lang] += 1
            letters[lang] += sum(map(str.isalpha, s))
    total = letters.total()
    return [{"lang": k, "sentences": count[k], "letters": letters[k], "share": letters[k] / total if total else 0.0} for k in sorted(count)]


def file_languages(df: DataFrame, words: dict[str, list[str]], into: str = "languages") -> DataFrame:
    """df (source, code_lang, path) with the array ``into`` of the languages of each file (see RESULT)."""
    find = Finder(words)
    packed = F.struct(F.col("source").alias("s"), F.col("code_lang").alias("l"), F.col("path").alias("p"))
    name = "_packed"
    return with_struct(df.withColumn(name, packed), name, into, RESULT, lambda r: languages(r["s"], style(r["l"], r["p"]), find) if r else []).drop(name)


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id, lang, sentences, letters, share for every code context."""
    code = spark.read.parquet(f"{sf_dir}/contexts.parquet").where(F.col("kind") == "code").select("ctx_id", "source", "code_lang", "path")
    return file_languages(code, function_words(spark, sf_dir)).select("ctx_id", F.explode("languages").alias("x")).select("ctx_id", "x.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id, lang: the languages with at least two sentences in the comments and literals of a code context."""
    return p3_languages(spark, sf_dir).where(F.col("sentences") >= LEAST_SENTENCES).select("ctx_id", "lang").distinct()
