"""Text that was once read in the wrong character encoding (problem 6).

Three kinds of damage are told apart. ``hard`` finds what a single record proves by itself: replacement characters and
C1 controls, UTF-8 bytes read in a single-byte code page (the stretch, written back in that page, is UTF-8 again and
gives letters that are in use), UTF-8 read in an East Asian code page, East Asian bytes read as Latin-1. The rest, one
code page taken for another, is a substitution cipher: ``swaps`` learns it by expectation-maximization. Bigrams of
letters are counted over the words of all records; scripts and their languages share none. A hypothesis is a table of letters for
characters; each source has one for every pair of code pages, which gives the letters to start from. The E step weighs,
for every word with a letter beyond ASCII that the bigrams find unlikely, "sound" and the source's tables by the
likelihood of what they make of the word, and within each table the letters that a character may stand for by the
bigrams on both sides. The M step re-estimates the weights and the letters of each source's tables, until no letter
changes; then the bigrams are counted again without the words that seem damaged. A source that holds much of the corpus is judged by the bigrams of all others. How often the restored word
occurs, against the damaged one where other sources are sound, goes in as evidence, and the words of a record that one
table explains count together, so neither a source that is damaged throughout nor a word that occurs nowhere intact is
left out if the likelihoods are clear. ``learned`` gives the words restored by the learned tables.

Defined results: null and empty texts are sound. Bytes with a byte order mark are read by it; other bytes that aren't
UTF-8 are sound in another encoding. Redelivered rows are found once. A record is found if one character of it is
damaged, restorable or not. Texts and words are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, staged
from .rows import with_struct

SCAN = T.StructType([T.StructField("hard", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("undone", T.StringType())])

#: Signs of typography and measure that wrong decoding commonly tears apart.
SIGNS = "‘’‚“”„–—…•™°±µ§©®«»·×€£¥½¼¾²³¿¡ªº¬¶†‡‰‹›≤≥≠→←✓✅✨⚠❤🚀﻿\xa0"
#: Letters beyond ASCII of the Latin alphabets in use.
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßąćęłńśźżĄĆĘŁŃŚŹŻğışİĞŞőűŐŰčďěňřšťůžČĎĚŇŘŠŤŮŽœŒ"
USED = re.compile(f"[{re.escape(SIGNS)}{LATIN}]|[\\U0001F300-\\U0001FAFF☀-➿←-⇿∀-⋿]")
OTHER = re.compile("[Ά-ώА-яЁёЄІЇєіїҐґא-ת؀-ۿऀ-ॿก-๛ぁ-ヿ㐀-鿿가-힯　-〿＀-￯]")
C1 = re.compile("[\x80-\x84\x86-\x9f]")
NON_ASCII = re.compile("[^\x00-\x7f]")
RUN = re.compile("[^\x00-\x7f]+")
DENSE = re.compile("[㐀-鿿가-힯ぁ-ヿ豈-﫿]{3,}")
HIGH_LATIN = re.compile("[¡-ÿ\xad\xa0]{4,}")
HANGUL, KANJI = re.compile("[가-힯]"), re.compile("[ぁ-ヿ一-鿿]")
BOX = re.compile("[─-╿]")


def _table(name: str) -> dict[str, int]:
    """Character to byte, from 0x80 on; unassigned bytes of cp125x stand for C1 controls, as readers have them."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


#: Code pages in which UTF-8 gets read by mistake; those whose letters are Latin come first.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859-7", "cp1256", "cp874")
LETTERED = frozenset(("cp1251", "koi8_r", "cp866", "cp1253", "iso8859-7", "cp1256", "cp874"))
BOXED = frozenset(("cp437", "cp850", "cp866", "koi8_r"))
#: Closing marks and spaces, which in sound text follow capitals.
AFTER = frozenset("»«“”’‘–—…\xa0„‚·")


def _sequences() -> list[tuple[str, dict[str, int], frozenset, frozenset, re.Pattern]]:
    out = []
    for name in WRONG:
        table = _table(name)
        of = {b: c for c, b in table.items()}
        cls = lambda lo, hi: "[" + re.escape("".join(of[b] for b in range(lo, hi + 1) if b in of)) + "]"
        tail = cls(0x80, 0xBF)
        pattern = re.compile(f"{cls(0xF0, 0xF4)}{tail}{{3}}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xC2, 0xDF)}{tail}")
        out.append((name, table, frozenset(of[b] for b in range(0xC2, 0xF5) if b in of), frozenset(of[b] for b in range(0x80, 0xC0) if b in of), pattern))
    return out


SEQUENCES = _sequences()


def stretches(text: str, sequence: tuple) -> Iterator[tuple[int, int, str, int]]:
    """start, end, the character that UTF-8 makes of it, and what that proves, for one page: 2 if one such stretch is
    proof, 1 if several are, 0 if it is damaged only where others prove the page (as in what was misread twice)."""
    name, table, _, _, pattern = sequence
    others = 0
    for m in pattern.finditer(text):
        try:
            c = bytes(table[x] for x in m[0]).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        if name in BOXED and (BOX.match(text[m.start() - 1 : m.start()]) or BOX.match(text[m.end() : m.end() + 1])) and not (pattern.match(text, m.end()) or others):
            continue
        if USED.match(c):
            if name in LETTERED and len(m[0]) == 2 and (m[0][1] in AFTER or m[0][1].isalpha()):
                continue
            yield m.start(), m.end(), c, 2
        elif OTHER.match(c):
            others += 1
            yield m.start(), m.end(), c, 1
        elif name not in LETTERED and (c <= "ÿ" or unicodedata.category(c)[0] in "LMNPS"):
            yield m.start(), m.end(), c, 0


def proved(text: str, sequence: tuple, first: bool = False, several: int = 3) -> list[tuple[int, int, str, int]]:
    """The stretches of a page if they prove it (the first that does is enough, if so asked), else none."""
    table, pattern, got, others, covered = sequence[1], sequence[4], [], 0, 0
    sure = False
    for x in stretches(text, sequence):
        got.append(x)
        if x[3] == 2:
            sure = True
            if first:
                return got
        elif x[3]:
            others += 1
            covered += x[1] - x[0]
    if sure or others >= several and covered >= 0.7 * sum(sum(x in table for x in r) for r in RUN.findall(text) if len(r) > 1 and pattern.search(r)):
        return got
    return []


def misread(text: str, chars: set[str]) -> str | None:
    """The code page in which UTF-8 was read, if the text proves one."""
    for q in SEQUENCES:
        if q[2] & chars and q[3] & chars and proved(text, q, first=True):
            return q[0]
    return None


def undo_misread(text: str) -> str:
    """Every stretch of UTF-8 written back in the page that explains most of the text; again as long as the rest proves
    a page, since texts are also misread twice or in parts. Each round makes the text shorter."""
    while True:
        chars = set(text)
        several = 1 if C1.search(text) else 3  # controls are never sound
        found = [g for q in SEQUENCES if q[2] & chars and q[3] & chars and (g := proved(text, q, several=several))]
        if not found:
            return text
        best = max(found, key=lambda g: sum(e - b for b, e, _, _ in g))
        out, at = [], 0
        for b, e, c, _ in best:
            out += (text[at:b], c)
            at = e
        text = "".join(out) + text[at:]


HIGH = "[" + re.escape("".join(sorted(_table("cp1252")))) + "]"
_CP1252 = _table("cp1252")
#: Shift JIS read in cp1252; kana have the lead bytes 0x82 and 0x83.
SJIS_RUN = re.compile(f"(?:{HIGH}(?:[@-~]|{HIGH})?)+")
SJIS_KANA = re.compile(f"(?:[‚ƒ]{HIGH}|‚[@-~]|ƒ[@-~]){{3,}}")
KANA = re.compile("[ぁ-ヿ]")


def shift_jis(run: str) -> str:
    table = _CP1252
    try:
        return bytes(table.get(x, ord(x)) for x in run).decode("cp932")
    except (UnicodeDecodeError, ValueError):
        return ""


def east_asian(text: str) -> str | None:
    """UTF-8 read in an East Asian code page, or East Asian bytes read as Latin-1."""
    if SJIS_KANA.search(text) and any(len(KANA.findall(s)) >= 3 for r in SJIS_RUN.findall(text) if SJIS_KANA.search(r) and (s := shift_jis(r))):
        return "cp1252<cp932"
    for run in DENSE.findall(text):
        for name in ("gbk", "cp949", "cp932", "big5"):
            try:
                s = run.encode(name).decode()
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if len(s) >= 2:
                return name
    runs = HIGH_LATIN.findall(text)
    if runs:
        good: Counter[str] = Counter()
        hits: Counter[str] = Counter()
        for run in runs:
            raw = run.replace("\xa0", "").encode("latin-1", "ignore")
            for name in ("euc_kr", "gb2312", "euc_jp"):
                try:
                    s = raw.decode(name)
                except UnicodeDecodeError:
                    continue
                if name == "euc_kr" and len(HANGUL.findall(s)) >= 0.8 * len(s) or name != "euc_kr" and all(0xA1 <= b <= 0xD7 for b in raw[::2]) and len(KANJI.findall(s)) >= 0.8 * len(s):
                    good[name] += len(s)
                    hits[name] += len((HANGUL if name == "euc_kr" else KANJI).findall(s))
        if good and max(good.values()) >= 4:
            best = hits.most_common(1)[0][0]
            # kana have the same bytes in both pages, kanji don't
            return "euc_jp" if best == "gb2312" and good["euc_jp"] and sum(b in (0xA4, 0xA5) for run in runs for b in run.encode("latin-1")) >= 0.1 * good[best] else best
    return None


EUC_RUN = re.compile("[¡-ÿ\xad]{2,}")
KEPT = re.compile(f"(?:{USED.pattern}|{OTHER.pattern}|[\x00-\x7f])+")


def undo_east_asian(text: str, name: str) -> str:
    """Every run that gives letters in use, written back in the page that was proved."""

    if name == "cp1252<cp932":
        return SJIS_RUN.sub(lambda m: s if (s := shift_jis(m[0])) and OTHER.search(s) and KEPT.fullmatch(s) else m[0], text)

    def back(m: re.Match) -> str:
        try:
            s = m[0].encode(name).decode() if name in ("gbk", "cp949", "cp932", "big5") else m[0].encode("latin-1").decode(name)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return DENSE.sub(back, m[0]) if m.re is RUN else m[0]
        return s if KEPT.fullmatch(s) else m[0]

    return (RUN if name in ("gbk", "cp949", "cp932", "big5") else EUC_RUN).sub(back, text)


#: Single-byte pages whose bytes, read as Latin-1, leave C1 controls; and signs that stand beside words.
UNDER_C1 = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8_r", "cp866")
OPENING, CLOSING, BETWEEN = frozenset("‘“„‚«‹¿¡"), frozenset("’”“»›…™‰®©°"), frozenset("–—•·†‡€£")


def undo_c1(text: str) -> str | None:
    """Single-byte text read as Latin-1, written back in the first page that gives every character a place where it may
    stand; None if no page does."""
    high = [i for i, c in enumerate(text) if c > "\x7f"]
    for name in UNDER_C1:
        of = {chr(b): c for c, b in _table(name).items()}
        if name != "cp1252" and any(text[i] > "ÿ" for i in high):
            continue  # only part of the text was read as Latin-1
        s = "".join(of.get(c, c) if c > "\x7f" else c for c in text)
        if C1.search(s):
            continue
        for i in high:
            c, left, right = s[i], s[i - 1 : i], s[i + 1 : i + 2]
            if c.isalpha():
                fits = (left.isalpha() or right.isalpha()) and not (c.isupper() and left.islower()) and not (c.islower() and left.isupper() and right.isupper())
            else:
                fits = c in OPENING and not left.isalnum() or c in CLOSING and not right.isalnum() or c == "’" and left.isalpha() or c in BETWEEN or c in SIGNS and not (left.isalpha() and right.isalpha())
            if not fits:
                break
        else:
            return s
    return None


def undo(text: str) -> str | None:
    """The whole text with every damaged stretch written back; None if characters are lost for good."""
    text = text.replace("â€�", "”")  # of the bytes that cp1252 lacks, only this one's is a sign in use
    name = east_asian(text)
    if name in ("cp1252<cp932", "euc_kr", "gb2312", "euc_jp"):
        # pairs of their bytes may look like UTF-8, but UTF-8 covers its stretches whole
        pattern, runs = SEQUENCES[0][4], HIGH_LATIN.findall(text)
        if name == "cp1252<cp932" or sum(len(pattern.sub("", r)) for r in runs) > 0.1 * sum(map(len, runs)):
            text = undo_east_asian(text, name)
    text = undo_misread(text)
    if name := east_asian(text):
        text = undo_east_asian(text, name)
    if "�" in text:
        return None
    return undo_c1(text) if C1.search(text) else text


TOKEN = re.compile(r"[^\s!-,./:-@\[-`{-~]+")
UNCASED = re.compile("[ऀ-ॿก-๛ᄀ-ᇿ㄰-㆏가-힯ぁ-ヿ㐀-鿿　-〿＀-￯\U0001F000-\U0001FAFF]")


def hard(text: str | None) -> dict:
    """``hard``: what the record itself proves, or null; then ``undone`` is the original text if it can be had.
    ``words``: its distinct words with a character beyond ASCII."""
    if not text or text.isascii():
        return {"hard": None, "words": None}
    chars = set(text)
    why = "replaced" if "�" in chars else "c1" if C1.search(text) else misread(text, chars) or east_asian(text)
    if why:
        return {"hard": why, "words": None, "undone": undo(text)}
    words = {w for w in TOKEN.findall(text) if not w.isascii() and not UNCASED.search(w)}
    return {"hard": None, "words": sorted(words)}


def read_bytes(raw: bytes | None) -> str | None:
    """Bytes as text: by byte order mark, else UTF-8; None if they're sound in another encoding."""
    raw = bytes(raw or b"")
    try:
        if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            return raw.decode("utf-16")
        return raw.removeprefix(b"\xef\xbb\xbf").decode()
    except UnicodeDecodeError:
        return None


# --- one code page taken for another

#: Pages that texts get read in (A) and pages they were written in (B).
READ = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859-2", "cp1253", "cp1256", "cp1254")
WRITTEN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8_r", "cp866", "cp1253", "cp1254", "cp1256", "iso8859-5", "cp437", "cp850", "mac_roman")


def _pairs() -> dict[str, dict[int, str]]:
    tables = {n: _table(n) for n in {*READ, *WRITTEN}}
    out = {}
    for a in READ:
        for b in WRITTEN:
            back = {v: k for k, v in tables[b].items()}
            m = {ord(c): back[x] for c, x in tables[a].items() if x in back}
            if a != b and sum(chr(k) != v for k, v in m.items()) > 5:
                out[f"{a}>{b}"] = m
    return out


PAIRS = _pairs()
#: Log probability of a bigram that the corpus doesn't have; weight of the hypothesis "sound" to begin with.
UNSEEN, SOUND = math.log(1e-7), 0.98
#: A word is looked at if one of its bigrams is less likely than this; it is damaged from this log ratio on.
RARE, LEAST_RATIO = math.log(1e-3), 4.0
#: Log odds of damage, of all words of a record together, from which it is claimed; what a single word adds at most.
LEAST_ODDS, MOST_EACH = 4.0, 15.0
#: Off the likelihood for each capital after a small letter.
ODD_CASE = 2.0
#: A bound on letter bigrams, which follows from the alphabets: pairs of the letters of one script (uncased scripts are
#: left out) or of a letter and a word's end. Characters beyond the most frequent are counted as one.
MAX_LETTERS = 1_000
#: A source with more than the first share of all words, up to the second, is judged by the other sources' bigrams.
LARGE, LARGEST = 0.02, 0.5
#: Rounds of expectation and maximization at most, what a code page's letter weighs before any word is seen, and how
#: much likelier another letter has to be.
ROUNDS, PAGE_WEIGHT, LEAST_LETTER = 6, 5.0, 0.7
#: A code page's letter gives way only to one that fits so many places in words.
LEAST_PLACES = 3
#: The bigrams are counted again so often, without what then seems damaged; fewer uses than this count as none.
PASSES, LEAST_COUNT = 2, 0.5


def bigrams(word: str) -> list[str]:
    w = f"^{word.casefold()}$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


class Model:
    """Bigram likelihoods, and the published mappings."""

    def __init__(self, counts: dict[str, int]):
        self.first: Counter[str] = Counter()
        for g, n in counts.items():
            self.first[g[0]] += n
        self.counts = counts
        self.logp = {g: math.log(n / (self.first[g[0]] + 50)) for g, n in counts.items()}
        #: The letters that follow each, and come before each, the likeliest first.
        self.near: dict[str, list[str]] = {}
        for g, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if g[1] != "$" and len(self.near.setdefault(g[0], [])) < 8:
                self.near[g[0]].append(g[1])

    def score(self, word: str) -> float:
        odd = sum(a.islower() and b.isupper() for a, b in zip(word, word[1:])) if word[1:].lower() != word[1:] else 0
        return sum(self.logp.get(g, UNSEEN) for g in bigrams(word)) - ODD_CASE * odd

    def as_it_stands(self, word: str, uses: float) -> tuple[float, bool]:
        """The score of a word, so many uses of its own left out, and whether one of its bigrams is rare then."""
        logs = []
        for g in bigrams(word):
            k = self.counts.get(g, 0.0) - uses
            logs.append(math.log(k / (self.first[g[0]] - uses + 50)) if k > LEAST_COUNT else UNSEEN)
        return sum(logs) + self.score(word) - sum(self.logp.get(g, UNSEEN) for g in bigrams(word)), min(logs) < RARE

    def hypothesis(self, word: str, table: dict[int, str], base: float) -> tuple[str, float] | None:
        """What a table makes of the word, if that changes it and gives letters, with its log likelihood ratio to "sound"."""
        s = word.translate(table)
        if s == word or not all(c.isalpha() or c in "’-'" for c in s if ord(c) >= 0x80):
            return None
        return s, self.score(s) - base

    def hypotheses(self, word: str, base: float) -> list[tuple[str, str, float, float]]:
        """The code pages' tables that change the word, which scores ``base`` as it stands, and give likelier letters."""
        out = []
        codes = [ord(c) for c in word if ord(c) >= 0x80]
        for z, m in PAIRS.items():
            if all(c in m for c in codes) and (h := self.hypothesis(word, m, base)):
                out += [(z, h[0], base, h[1])] if h[1] > 0 else []
        return out

    def letters(self, word: str, restored: str) -> list[tuple[str, str, float]]:
        """For each replaced character the letters it may stand for, weighed by the bigrams on both sides."""
        out = []
        if len(word) == len(restored):
            w = f"^{restored.casefold()}$"
            for i, (c, l) in enumerate(zip(word, restored), 1):
                if ord(c) < 0x80:
                    continue
                options = {w[i], *self.near.get(w[i - 1], ())}
                weigh = {o: math.exp(self.logp.get(w[i - 1] + o, UNSEEN) + self.logp.get(o + w[i + 1], UNSEEN)) for o in options}
                total = sum(weigh.values())
                out += [(c, o.upper() if l.isupper() and len(o.upper()) == 1 else o, v / total) for o, v in weigh.items() if v > 0.05 * total]
        return out


def words_of(scanned: DataFrame) -> DataFrame:
    return scanned.where("hard is null").select("source", F.explode("words").alias("word"))


def _fit(by_source: DataFrame, kept: Column, before: DataFrame | None) -> DataFrame:
    """The posterior of every hypothesis, from bigrams of the words as they stand, or, given a posterior, of those that
    it takes for sound (by_source: source, word, n; kept: the source, if it is large)."""
    spark = by_source.sparkSession
    sound = by_source.withColumn("sound", F.col("n").cast("double"))
    if before is not None:
        d = before.groupBy("source", "word").agg(F.sum("p").alias("d"))
        sound = by_source.join(d, ["source", "word"], "left").withColumn("sound", F.col("n") * (1 - F.least(F.lit(1.0), F.coalesce("d", F.lit(0.0)))))
    # words of large sources, and those of all others together (part null)
    vocabulary = staged(sound.groupBy(kept.alias("part"), "word").agg(F.sum("sound").alias("n")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[tuple[str | None, str]] = Counter()
            for part, w, n in zip(b["part"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()):
                for g in bigrams(w):
                    c[part, g] += n
            yield pa.RecordBatch.from_pydict({"part": [k[0] for k in c], "g": [k[1] for k in c], "n": list(c.values())}, schema=pa.schema([("part", pa.string()), ("g", pa.string()), ("n", pa.float64())]))

    counted = vocabulary.mapInArrow(pairs, "part string, g string, n double").groupBy("part", "g").agg(F.sum("n").alias("n"))
    # at most MAX_LETTERS first letters; what is rarer gets no bigram and counts as unseen
    top = counted.groupBy(F.substring("g", 1, 1).alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(MAX_LETTERS)
    top = F.broadcast(top.select("c"))
    kept_g = counted.where("n > 0").join(top, F.substring("g", 1, 1) == F.col("c"), "left_semi").join(top.union(spark.createDataFrame([("$",)], "c string")), F.substring("g", 2, 1) == F.col("c"), "left_semi")
    total: Counter[str] = Counter()
    own: dict[str, dict[str, int]] = {}
    for r in kept_g.collect():
        total[r["g"]] += r["n"]
        if r["part"] is not None:
            own.setdefault(r["part"], {})[r["g"]] = r["n"]
    counts = dict(total)
    models: dict[str | None, Model] = {}

    def model_of(part: str | None) -> Model:
        """Of all sources, or of all but one; made where it's used, one at a time."""
        if part not in models:
            models.clear()
            mine = own.get(part, {})
            models[part] = Model({g: k for g, n in counts.items() if (k := n - mine.get(g, 0)) > LEAST_COUNT})
        return models[part]

    def mapped(rows: DataFrame, names: list[str], f: Callable[[Model, dict], list[tuple]], schema: T.StructType) -> DataFrame:
        """f's rows for each row, given the model of its part."""
        kind = pa.schema([(x.name, pa.float64() if x.dataType == T.DoubleType() else pa.string()) for x in schema])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [x for r in sorted(b.to_pylist(), key=lambda r: r["part"]) for x in f(model_of(r["part"] or None), r)]
                yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*out)))) if out else {k: [] for k in kind.names}, schema=kind)

        return rows.select(*names).mapInArrow(run, schema)

    text, real = T.StringType(), T.DoubleType()
    fields = lambda names, *reals: T.StructType([T.StructField(k, text) for k in names] + [T.StructField(k, real) for k in reals])
    part = F.coalesce(kept, F.lit(""))

    def look(model: Model, r: dict) -> list[tuple]:
        base, rare = model.as_it_stands(r["word"], 0.0 if r["part"] else min(1.0, r["n"]))
        return [(r["part"], r["word"], *h) for h in model.hypotheses(r["word"], base)] if rare else []

    likely = staged(mapped(vocabulary.select(F.coalesce("part", F.lit("")).alias("part"), "word", "n"), ["part", "word", "n"], look, fields(("part", "word", "page_pair", "restored"), "base", "ratio")))
    # a word of a source has a row for each table that beats "sound"
    rows = staged(by_source.withColumn("part", part).join(likely, ["part", "word"]))
    weight = rows.select("source", "page_pair").distinct().withColumn("w", F.lit((1 - SOUND) / len(PAIRS)))
    letters = None
    for _ in range(ROUNDS):
        post = staged(_posterior(rows, weight))
        by_pair = post.groupBy("source", "page_pair").agg(F.sum(F.col("p") * F.col("n")).alias("k"))
        every_k = post.agg(F.sum(F.col("p") * F.col("n"))).first()[0] or 1.0
        all_of = by_pair.groupBy("page_pair").agg(F.sum("k").alias("all"))
        # a source's own weights, drawn towards those of all sources together
        weight = staged(by_pair.join(all_of, "page_pair").select("source", "page_pair", F.least(F.lit(0.5), (1 - SOUND) * (F.col("k") + 5 * F.col("all") / every_k + 1e-3) / 5).alias("w")))
        # the letters: expected counts of what each character stands for, with the code page's letter to begin with
        each = mapped(post.where("p > 0.05").withColumn("k", F.col("p") * F.col("n")), ["part", "source", "page_pair", "word", "restored", "k"], lambda m, r: [(r["source"], r["page_pair"], c, l, k * r["k"]) for c, l, k in m.letters(r["word"], r["restored"])], fields(("source", "page_pair", "c", "l"), "k"))
        table = F.create_map(*(x for z, m in PAIRS.items() for x in (F.lit(z), F.lit("".join(map(chr, m))))))
        to = F.create_map(*(x for z, m in PAIRS.items() for x in (F.lit(z), F.lit("".join(m.values())))))
        page = F.call_function("translate", "c", table[F.col("page_pair")], to[F.col("page_pair")])
        sums = each.groupBy("source", "page_pair", "c", "l").agg(F.sum("k").alias("k"), F.count("*").alias("places")).withColumn("k", F.col("k") + F.when(F.col("l") == page, F.lit(PAGE_WEIGHT)).otherwise(0.0))
        best_l = sums.groupBy("source", "page_pair", "c").agg(F.max(F.struct("k", "l", "places")).alias("b"), F.sum("k").alias("sum"))
        changed = best_l.where((F.col("b.k") >= LEAST_LETTER * (F.col("sum") + F.lit(PAGE_WEIGHT) * (F.col("b.l") != page).cast("int"))) & (F.col("b.l") != page) & (F.col("b.places") >= LEAST_PLACES))
        new = staged(changed.groupBy("source", "page_pair").agg(F.sort_array(F.collect_list(F.struct("c", F.col("b.l").alias("l")))).alias("m")).select("source", "page_pair", F.array_join("m.c", "").alias("characters"), F.array_join("m.l", "").alias("letters")))
        same = new.isEmpty() if letters is None else new.exceptAll(letters).isEmpty() and letters.exceptAll(new).isEmpty()
        letters = new
        if same:
            break

        def again(model: Model, r: dict) -> list[tuple]:
            m = PAIRS[r["page_pair"]] | {ord(c): l for c, l in zip(r["characters"], r["letters"])}
            h = model.hypothesis(r["word"], m, r["base"])
            return [(r["source"], r["word"], r["page_pair"], h[0], r["base"], h[1])] if h and h[1] > 0 else []

        redone = mapped(rows.join(letters, ["source", "page_pair"]), ["part", "source", "word", "page_pair", "characters", "letters", "base"], again, fields(("source", "word", "page_pair", "restored"), "base", "ratio"))
        kept_rows = rows.join(letters.select("source", "page_pair"), ["source", "page_pair"], "left_anti").select("part", "source", "word", "n", "page_pair", "restored", "base", "ratio")
        rows = staged(kept_rows.unionByName(redone.join(by_source, ["source", "word"]).withColumn("part", part).select(*kept_rows.columns)))
    return staged(_posterior(rows, weight))


def swaps(scanned: DataFrame) -> DataFrame:
    """source, word, page_pair, restored, p, w, ratio, evidence: the words of scanned (source, hard, words) that one
    code page taken for another may explain, by the tables learned for their source. Only counts by bigram leave the
    executors."""
    spark = scanned.sparkSession
    ship(spark)
    by_source = staged(words_of(scanned).groupBy("source", "word").agg(F.count("*").alias("n")))
    sums = by_source.groupBy("source").agg(F.sum("n").alias("k"))
    every = sums.agg(F.sum("k")).first()[0] or 0
    large = [r["source"] for r in sums.where((F.col("k") > LARGE * every) & (F.col("k") <= LARGEST * every)).collect()]
    kept = F.when(F.col("source").isin(large), F.col("source")) if large else F.lit(None).cast("string")
    last = None
    for _ in range(PASSES):
        last = _fit(by_source, kept, last)
    # words that are probably damaged where they stand are no evidence for their sound use
    damaged = last.groupBy("source", "word").agg(F.sum("p").alias("d"))
    uses = by_source.join(damaged, ["source", "word"], "left").select("source", F.lower("word").alias("own"), "n", (F.col("n") * (1 - F.coalesce("d", F.lit(0.0)))).alias("sound"))
    known = staged(uses.groupBy("own").agg(F.sum("n").alias("n"), F.sum("sound").alias("sound")))
    mine = uses.groupBy("source", "own").agg(F.sum("sound").alias("mine"))
    rows = last.withColumn("own", F.lower("word"))
    rows = rows.join(known.select(F.col("own").alias("known"), F.col("n").alias("known_n")), F.lower("restored") == F.col("known"), "left").join(known.select("own", F.col("sound").alias("own_n")), "own", "left").join(mine, ["source", "own"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    usage = F.log((zero("known_n") + 0.5) / (F.greatest(F.lit(0.0), zero("own_n") - zero("mine")) + 0.5))
    scored = rows.withColumn("usage", usage).withColumn("evidence", F.least(F.lit(MOST_EACH), F.col("ratio")) + F.greatest(F.lit(-MOST_EACH), F.least(F.lit(MOST_EACH), F.col("usage"))))
    return staged(scored.where(F.col("ratio") >= LEAST_RATIO).select("source", "word", "page_pair", "restored", "p", "w", "ratio", "evidence"))


def _posterior(rows: DataFrame, weight: DataFrame) -> DataFrame:
    """The probability of each hypothesis for each word of a source, against all others and "sound"."""
    joined = rows.join(weight, ["source", "page_pair"]).withColumn("l", F.col("w") * F.exp(F.least(F.col("ratio"), F.lit(200.0))))
    total = joined.groupBy("source", "word").agg((F.sum("l") + SOUND).alias("total"))
    return joined.join(total, ["source", "word"]).withColumn("p", F.col("l") / F.col("total"))


def scan(records: DataFrame) -> DataFrame:
    """rec_kind, rec_id, source, hard, words of records (rec_kind, rec_id, source, text)."""
    return with_struct(records, "text", "s", SCAN, hard).select("rec_kind", "rec_id", "source", "s.*")


def records(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Contents of files and messages of commits as text; the source is the project. Undone texts come only if asked for."""
    files = spark.read.parquet(f"{sf_dir}/files.parquet").select(F.lit("file").alias("rec_kind"), F.col("file_id").alias("rec_id"), F.coalesce("project", F.lit("")).alias("source"), F.col("bytes").alias("text"))
    files = with_struct(files, "text", "s", SCAN, lambda b: hard(read_bytes(b))).select("rec_kind", "rec_id", "source", "s.*")
    commits = spark.read.parquet(f"{sf_dir}/commits.parquet").select(F.lit("commit").alias("rec_kind"), F.col("commit_id").alias("rec_id"), F.coalesce("project", F.lit("")).alias("source"), F.col("source").alias("text"))
    both = files.unionByName(scan(commits)).where("hard is not null or words is not null")
    return staged(both if texts else both.drop("undone"))


WORD_MAP = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("word", "restored")]))


def rewrite(text: str | None, words: list[dict]) -> str | None:
    """The text with each of the damaged words replaced by its restored form."""
    if text is None:
        return None
    of = {w["word"]: w["restored"] for w in words}
    return TOKEN.sub(lambda m: of.get(m[0], m[0]), text)


def learned(scanned: DataFrame) -> DataFrame:
    """rec_kind, rec_id, damage, words: the records whose words a table of their source explains, all of them together by
    odds of LEAST_ODDS, and the words' restored forms; the damage is the pair of pages of the table that explains most."""
    uses = scanned.where("hard is null").select("rec_kind", "rec_id", "source", F.explode("words").alias("word")).distinct()
    found = uses.join(swaps(scanned), ["source", "word"])
    by_pair = found.groupBy("rec_kind", "rec_id", "page_pair").agg((F.sum("evidence") + F.log(F.max("w") / SOUND)).alias("odds"), F.sort_array(F.collect_set(F.struct("word", "restored"))).alias("words"))
    best = by_pair.groupBy("rec_kind", "rec_id").agg(F.max(F.struct("odds", "page_pair", "words")).alias("b")).select("rec_kind", "rec_id", "b.*")
    return best.where(F.col("odds") >= LEAST_ODDS).select("rec_kind", "rec_id", F.col("page_pair").alias("damage"), "words")


def p6_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id, damage, words, restored: what was found in each record, the words that were learned, and the
    record's whole text as it was before; null where characters are lost for good."""
    scanned = records(spark, sf_dir)
    hard_ones = scanned.where("hard is not null").select("rec_kind", "rec_id", F.col("hard").alias("damage"), F.lit(None).cast(WORD_MAP).alias("words"), F.col("undone").alias("restored"))
    swapped = staged(learned(scanned))
    out = hard_ones
    for kind, table, key, column in (("file", "files", "file_id", "bytes"), ("commit", "commits", "commit_id", "source")):
        texts = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("rec_id"), F.col(column).alias("text"))
        both = texts.join(swapped.where(F.col("rec_kind") == kind), "rec_id").withColumn("_both", F.struct("text", "words"))
        read = read_bytes if kind == "file" else (lambda t: t)
        back = with_struct(both, "_both", "restored", T.StringType(), lambda r, read=read: rewrite(read(r["text"]), r["words"]))
        out = out.unionByName(back.select("rec_kind", "rec_id", "damage", "words", "restored"))
    return out.distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id: records with at least one damaged stretch."""
    scanned = records(spark, sf_dir, texts=False)
    return scanned.where("hard is not null").select("rec_kind", "rec_id").unionByName(learned(scanned).select("rec_kind", "rec_id")).distinct()
