"""Per-document text statistics, and the texts that are lists, tables or junk instead of prose (problem 1).

``text_stats`` adds a struct of statistics to every row. Blocks without sentences get a form of their own: tables by the
vertical alignment of delimiters (the same delimiters, as often, in line after line), lists by short lines that no
wrapping explains, by separators, and by the recurrence of their lines (the period of indentation, or the
autocorrelation of line lengths at the lags of a group of lines), junk by the shape of words and the share of signs. Lines belong to one wrapped text
if the next line's first word wouldn't have fitted on them; only then may a sentence run over a line's end.

Defined results: null, empty or blank text has ``n_visible`` 0, all ratios 0 and form ``empty``. Every row is measured
on its own, so repeated rows get equal statistics and order doesn't matter. Texts of any length are read whole, in
time proportional to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang import DENSE, DENSE_OR_THAI, THAI, WORD, function_words, units
from .rows import with_struct

STATS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_visible", "n_lines", "n_words")]
    + [T.StructField(k, T.DoubleType()) for k in ("mean_word_len", "symbol_ratio", "punct_end_share", "common_word_share", "delimiter_alignment", "indent_period", "length_autocorrelation", "sentence_share", "list_share", "table_share", "junk_share", "repeat_share")]
    + [T.StructField("form", T.StringType())]
)
#: More than this share of the visible text outside sentences makes a text a list, a table or junk.
LEAST_OUTSIDE = 0.5
#: A sentence has so many words; a list item so many at most.
SENTENCE_WORDS, ITEM_WORDS = 4, 6
#: A Thai sentence, which nothing but white space ends, has so many letters.
THAI_SENTENCE = 20

BLANK = re.compile(r"\n[^\S\n]*\n")
SPACE = re.compile(r"\s+")
END = re.compile(r"[.!?।؟;。！？…‥]+[\"'”»’)\]」』*_]*$")
SPLIT = re.compile(r"(?<=[。！？])|(?:(?<=[.!?।؟;…])|(?<=[.!?।؟;…][\"”»’)\]」』]))\s+")
#: What may stand before a list item or heading.
MARKER = re.compile(r"^\s*(?:[-*+•·◦▪‣–—>»#]+|\(?\d{1,4}[.):]|\(?[A-Za-z][.)]|\[[ xX✓]?\]|[☐☑✓✔☒])\s+")
NUMBER = re.compile(r"^\s*\(?\d+[.):]\s")
CELL = {"|": re.compile(r"[|│┃║]"), "\t": re.compile(r"\t"), ",": re.compile(r","), ";": re.compile(r";"), "  ": re.compile(r"(?<=\S)[^\S\n]{2,}(?=\S)")}
RULING = re.compile(r"^[\s|│┃║+:=_\-─━═┼╪╬┬┴├┤┌┐└┘╔╗╚╝╠╣╦╩]+$")
HEX = re.compile(r"[0-9a-fA-F]{2}|[0-9a-fA-F]{6,}")
CODED = re.compile(r"[A-Za-z0-9+/=_\-]{40,}")
CLEAN = re.compile(r"[\"'(\[“«„‘「『¿¡]*[^\W\d_][\w'’\-̀-ͯऀ-ॿ؀-ۿ]*[.,:;!?…\"')\]”»’।؟]*|\(?#?[\d.,:%]+[.,;:!?)]*|[-–—&]")
SEPARATOR = re.compile(r"\s*(;+|•|\||·|,+(?!\s*\d)|/|§|»)(?:\s+|$)")
#: The dots between an entry of a table of contents and its page.
LEADER = re.compile(r"\s?(?:\.{3,}|(?:\. ){3,}|…{2,}|·{3,}|_{3,})\s?\S{0,6}$")
CSV_CELL_WORDS = 4
#: Lines of a group that recurs, and how strongly it has to; rows of a list that only recurrence shows have so many words
#: at most, and there are so many of them.
LAGS, LEAST_RECURRENCE, ROW_WORDS, LEAST_ROWS = (1, 2, 3, 4), 0.5, 12, 4


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def autocorrelation(x: list[float], lag: int = 1) -> float:
    """Of a sequence with itself, so many places on; 0 if it is constant or too short."""
    n = len(x)
    if n <= lag + 1:
        return 0.0
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    return sum((x[i] - m) * (x[i + lag] - m) for i in range(n - lag)) / var if var else 0.0


def recurrence(lines: list[str]) -> tuple[float, float]:
    """The strongest period of the indentation, and of the line lengths, among groups of so many lines as LAGS says."""
    indents = [float(len(x) - len(x.lstrip())) for x in lines]
    lengths = [float(len(x)) for x in lines]
    return max((autocorrelation(indents, k) for k in LAGS), default=0.0) if any(indents) else 0.0, max((autocorrelation(lengths, k) for k in LAGS), default=0.0)


def marked(lines: list[str]) -> list[bool]:
    """Which lines begin with the mark of an item. A number that only one line begins with, and not the first, was put
    there by wrapping."""
    out = [MARKER.match(x) is not None for x in lines]
    numbered = [i for i, x in enumerate(lines) if out[i] and NUMBER.match(x)]
    if len(numbered) == 1 and numbered[0]:
        out[numbered[0]] = False
    return out


def wrapped(lines: list[str]) -> bool:
    """Whether the breaks come from wrapping: the next line's first word wouldn't have fitted."""
    if len(lines) < 2:
        return True
    width = max(len(x) for x in lines)
    tight = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:]))
    return tight >= 0.9 * (len(lines) - 1)


def is_sentence(s: str) -> bool:
    thai = len(THAI.findall(s))
    if thai * 2 > len(s.replace(" ", "")):
        return thai >= THAI_SENTENCE
    if not END.search(s) or units(s) < SENTENCE_WORDS:
        return False
    if DENSE.search(s):
        return True
    words = s.split()
    if len(words) < SENTENCE_WORDS:
        return False
    head = next((c for c in s if c.isalpha()), "")
    return not (head.islower() and head.isascii() and words[0][:1] != "`") and sum(CLEAN.fullmatch(w) is not None for w in words) >= 0.75 * len(words)


def visible(s: str) -> int:
    return len(SPACE.sub("", s))


def alignment(lines: list[str]) -> tuple[float, str]:
    """The largest share of lines with the same number of a delimiter, and that delimiter."""
    best, which = 0.0, ""
    rows = [x for x in lines if not RULING.match(x)] or lines
    for d, pattern in CELL.items():
        least = 2 if d in ",;" else 1
        n, k = Counter(len(pattern.findall(x)) for x in rows).most_common(1)[0]
        if n < least:
            continue
        share = k / len(rows)
        if d in ",;" and any(units(c) > CSV_CELL_WORDS for x in rows for c in x.split(d)):
            continue
        if share > best:
            best, which = share, d
    return best, which


def block_form(lines: list[str]) -> tuple[str, float]:
    """What a block of lines without sentences is, and its alignment."""
    text = "\n".join(lines)
    tokens = text.split()
    share, d = alignment(lines)
    n_sym = sum(not (c.isalnum() or c.isspace()) for c in text)
    letters = sum(c.isalpha() for c in text)
    if "\x1b" in text or sum(len(x) for x in tokens if CODED.fullmatch(x) and x.strip("+-=_/")) > 0.5 * sum(map(len, tokens)):
        return "junk", share
    if len(tokens) >= 8 and sum(HEX.fullmatch(x) is not None for x in tokens) > 0.8 * len(tokens):
        return "junk", share
    ruled = sum(RULING.match(x) is not None for x in lines)
    if ruled and ruled < len(lines) and any(CELL["|"].search(x) for x in lines):
        return "table", share
    if share >= 0.8 and len(lines) - ruled >= 2 and (d != "  " or len(lines) >= 2):
        return "table", share
    bare = [LEADER.sub("", MARKER.sub("", x)) for x in lines]
    if sum(LEADER.search(x) is not None for x in lines) >= 0.7 * len(lines) and sum(units(x) <= ITEM_WORDS for x in bare) >= 0.8 * len(lines):
        return "list", share
    if letters < 0.4 * visible(text) and n_sym > 0.3 * visible(text):
        return "junk", share
    clean = sum(CLEAN.fullmatch(x) is not None or "_" in x for x in tokens)
    if clean < 0.6 * len(tokens) and sum(MARKER.match(x + " ") is not None for x in tokens) < 0.2 * len(tokens):
        return "junk", share
    if len(lines) >= 2 and not (wrapped(lines) and len(lines) > 3) and sum(units(x) <= ITEM_WORDS for x in bare) >= 0.8 * len(lines):
        return "list", share
    seps = Counter(m[1][0] for m in SEPARATOR.finditer(text))
    if seps:
        sep, k = seps.most_common(1)[0]
        if k >= 0.85 * seps.total() and k >= 2:
            items = [x for x in re.split(re.escape(sep), " ".join(lines)) if x.strip()]
            if sum(units(x) <= ITEM_WORDS for x in items) >= 0.8 * len(items):
                return "list", share
    if len(lines) == 1 and units(text) <= ITEM_WORDS or MARKER.match(lines[0]) and units(text) <= ITEM_WORDS + 4:
        return "short", share
    if all(units(x) <= ITEM_WORDS for x in bare):
        return "list", share
    if len(lines) >= LEAST_ROWS and max(recurrence(lines)) >= LEAST_RECURRENCE and sum(map(units, bare)) <= ROW_WORDS * len(lines):
        return "list", share
    return "junk", share


def repeated(text: str, n: int = 12) -> float:
    """The share of letters that lie in a later copy of a run of n letters of the same text."""
    s = re.sub(r"[\W\d_]+", "", text.casefold())
    if len(s) <= n:
        return 0.0
    seen: set[str] = set()
    add, until, total = seen.add, 0, 0
    for i in range(len(s) - n + 1):
        g = s[i : i + n]
        if g in seen:
            total += i + n - max(until, i)
            until = i + n
        else:
            add(g)
    return total / len(s)


def describe(text: str | None, common: frozenset[str]) -> dict:
    """The statistics of one text."""
    out = dict.fromkeys(STATS.names, 0.0) | {"n_visible": 0, "n_lines": 0, "n_words": 0, "form": "empty"}
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    total = visible(text)
    if not total:
        return out
    lines = [x for x in text.split("\n") if x.strip()]
    words = [w.casefold() for w in WORD.findall(text)]
    shares: dict[str, float] = {"sentence": 0, "list": 0, "table": 0, "junk": 0, "short": 0}
    aligned = 0.0
    for block in BLANK.split(text):
        own = [x.rstrip() for x in block.split("\n") if x.strip()]
        if not own:
            continue
        size, good = visible(block), 0
        # marked lines begin an item of their own; the lines after them may continue it
        groups: list[list[str]] = []
        item = False
        for x, starts in zip(own, marked(own)):
            if groups and not starts and (not item or len(x) - len(x.lstrip()) >= 2):
                groups[-1].append(x)
            else:
                groups.append([x])
                item = starts
        for g in groups:
            for piece in [" ".join(x.strip() for x in g)] if wrapped(g) else g:
                piece = MARKER.sub("", piece)
                for s in re.split(r"\s+", piece) if THAI.search(piece) else SPLIT.split(piece):
                    if s and is_sentence(s.strip()):
                        good += visible(s)
        if good * 2 >= size:
            shares["sentence"] += size
        else:
            form, share = block_form(own)
            aligned = max(aligned, share)
            shares["sentence"] += good
            shares[form] += size - good
    # headings and single short lines are what the blocks around them are
    out["n_visible"], out["n_lines"], out["n_words"] = total, len(lines), len(words)
    out["mean_word_len"] = ratio(sum(map(len, words)), len(words))
    out["symbol_ratio"] = ratio(sum(not (c.isalnum() or c.isspace()) for c in text), total)
    out["punct_end_share"] = ratio(sum(END.search(x.rstrip()) is not None for x in lines), len(lines))
    out["common_word_share"] = ratio(sum(w in common for w in words), len(words))
    out["delimiter_alignment"] = aligned
    out["indent_period"], out["length_autocorrelation"] = recurrence(lines)
    for k in ("sentence", "list", "table", "junk"):
        out[f"{k}_share"] = shares[k] / total
    outside = 1 - out["sentence_share"]
    out["form"] = "prose"
    if outside > LEAST_OUTSIDE:
        top = max(("list", "table", "junk"), key=lambda k: shares[k])
        out["repeat_share"] = repeated(text)
        if not shares[top]:
            out["form"] = "short"
        else:
            out["form"] = "repeated" if out["repeat_share"] >= 0.4 and top != "table" else top
    return out


def text_stats(df: DataFrame, words: dict[str, list[str]], text: str = "text", into: str = "stats") -> DataFrame:
    """df with the struct ``into`` (see STATS) of the column ``text``; all other columns stay as they are."""
    common = frozenset(p for ws in words.values() for w in ws for p in w.casefold().split())
    return with_struct(df, text, into, STATS, lambda t: describe(t, common))


def documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan contexts of documentation and text; an unknown kind counts as that."""
    return spark.read.parquet(f"{sf_dir}/contexts.parquet").where((F.col("batch") == "scan") & (F.col("kind").isin("docs", "text") | F.col("kind").isNull()))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id, form: contexts whose visible text is, by more than half, a list, a table or junk."""
    df = text_stats(documentation(spark, sf_dir).select("ctx_id", "prose"), function_words(spark, sf_dir), "prose")
    return df.where(F.col("stats.form").isin("list", "table", "junk")).select("ctx_id", F.col("stats.form").alias("form")).distinct()


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every scan context of documentation and text."""
    return text_stats(documentation(spark, sf_dir).select("ctx_id", "prose"), function_words(spark, sf_dir), "prose").select("ctx_id", "stats.*")
