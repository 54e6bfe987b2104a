"""Keyword-stuffed pages and link lists (problem 9).

A page is a sequence of pieces (sentences, list items; fenced code is left out). Each piece becomes a sequence of word
classes: function words as themselves, other words by their shape, numbers, prices, links, tags and marks; runs of a
script without spaces are cut at their function words. Trigrams of classes are counted over all pages. Pages whose
share of function words lies far under that of their language's sentences begin as the training text of the model of
what isn't prose, all others as that of the prose model. A piece is off if its perplexity under the prose model is
higher, or for its length and classes lower, than the other model lets expect; a page is spam if more than LEAST_SHARE of its visible
text lies in such pieces. The pages found, and only these, then are the other model's training text, ROUNDS times. The
models alone decide: a page that was set apart at first is honest if its pieces are.

Trigrams are counted in BUCKETS places by a hash of their classes, so the models have the same size for any input.

Defined results: null, empty and blank texts, and stubs of fewer than LEAST_TOKENS words and
tokens outside code, are no spam. Copies of a page are
judged alike. A page's language is that of its own words and script; ``lang`` isn't used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship, staged
from .lang import NOT_LATIN, SCRIPT_OF_LANG, SCRIPT_RANGES, SCRIPT_RE, UNSPACED, function_words
from .prose import MARKER, wrapped
from .rows import with_batch

INTS = T.ArrayType(T.IntegerType())
SEQUENCES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("k", T.LongType()), T.StructField("sentence_n", T.LongType()), T.StructField("sentence_k", T.LongType()), T.StructField("ids", INTS), T.StructField("sizes", INTS)])
LEAST_TOKENS, LEAST_SHARE, ROUNDS = 8, 0.6, 3
#: A page's text starts outside the prose model if its function words are so many standard deviations too few.
SEED = -4.0
#: ... and less than this part of the usual share.
SEED_PART = 0.5
#: The share of function words that pages without any are measured by, since they show no language.
USUAL = 0.3
#: Interpolation of trigrams, bigrams, single classes; what is added to the counts; the least probability.
WEIGHTS, ADDED, FLOOR = (0.6, 0.3, 0.099), 3.0, 1e-5
#: Places in which trigrams are counted.
BUCKETS = 1 << 21

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n[\s\S]*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M)
BLANK = re.compile(r"\n[^\S\n]*\n")
HEADING = re.compile(r"\s*#{1,6}\s")
SENTENCE = re.compile(r"([.!?।؟;…。！？])(?:(?<=[。！？])|[\"”»’)]*[^\S\n]+)")
ENDS, CLOSERS = tuple(".!?।؟;。！？…‥"), "\"'”»’)]」』*_"
SPACES = re.compile(r"[^\S\n ]")
DENSE = "぀-ヿ㐀-䶿一-鿿฀-๿"
LETTER = r"\w\u0300-\u036f\u064b-\u065f\u0900-\u0963"
MORE = LETTER + "'’"
#: Words of plain letters and common marks, which most tokens are, come first; nothing else matches there. No token but
#: the end of a piece has a line break.
TOKEN = re.compile(
    " *+("
    + "|".join(f"{x}[a-z]*+(?![{MORE}-])" for x in ("[A-Za-gi-vx-z]", "h(?!ttps?://)", r"w(?!ww\.)"))
    + r"|[.,;:!?\n]"
    + r"|\[[^\]\[\n]*\]\([^)\s]*\)|<a\b(?=.*>)[^>]*+>(?:[^<\n]++|<(?!/a>|a\b))*+</a>|(?:https?://|www\.)[^\s<>)\"]+|(?<!\w)#[^\W\d_]\w*|`[^`\n]+`|<[^<>\n]+>|&\w+;|[$€£¥][^\S\n]?\d[\d.,]*|\d+[.,]\d{2}\b|\(?#?\d[\w.,:/%-]*\)?"
    + f"|[{DENSE}]+"
    + rf"|[^\W\d_](?:[{MORE}-]*[{LETTER}])?|[^\w\s])"
)
DENSE_RUN = re.compile(f"[{DENSE}]")
PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*|\d+[.,]\d{2}")
#: Classes beside the function words; marks that stand for themselves, and marks counted as those.
KINDS = ("<link>", "<url>", "<tag>", "<code>", "<price>", "<num>", "<d>", "<dd>", "<ddd>", "<id>", "<W>", "<w>", "<m>")
MARKS = ".,;:!?|/»·•()-"
SAME_MARK = dict(zip("。！？।؟…、，；：،—–", ".!?.?.,,;:,--"))
START, STOP = 0, 1
#: The end of a piece and a run of a script without spaces, before these are given their classes.
BREAK, RUN = -1, -2
SCRIPTS = ("", *SCRIPT_RANGES)
SCRIPT_AT = np.zeros(0x10000, np.int8)
for _m in SCRIPT_RE.finditer("".join(map(chr, range(0x10000)))):
    SCRIPT_AT[_m.start() : _m.end()] = SCRIPTS.index(_m.lastgroup)


class Kinds(dict):
    """The class of every token met lately."""

    def __init__(self, kind: Callable[[str], int]):
        self.kind = kind

    def __missing__(self, s: str) -> int:
        i = self.kind(s)
        if i != RUN:
            if len(self) > 200_000:
                self.clear()
            self[s] = i
        return i


class Classes:
    """Turns pages into class numbers; the numbers follow from the function words alone."""

    def __init__(self, words: dict[str, list[str]]):
        self.words = words
        spaced = {p for lang, ws in words.items() if lang not in UNSPACED for w in ws for p in w.casefold().split()}
        dense = {w for lang in UNSPACED for w in words.get(lang, ())}
        names = ["^", "$", *KINDS, *MARKS, *sorted(spaced | dense)]
        self.number = {x: i for i, x in reversed(list(enumerate(names)))}
        self.first_word, self.size = 2 + len(KINDS) + len(MARKS), len(names)
        self.first_mark = 2 + len(KINDS)
        self.spaced = frozenset(spaced)
        self.dense = re.compile(f"({'|'.join(re.escape(w) for w in sorted(dense, key=lambda w: (-len(w), w))) or '(?!)'})")
        self.langs: dict[int, tuple[str, ...]] = {}
        for lang, ws in sorted(words.items()):
            if lang not in UNSPACED and lang not in SCRIPT_OF_LANG:
                for p in {p for w in ws for p in w.casefold().split()}:
                    self.langs[self.number[p]] = (*self.langs.get(self.number[p], ()), lang)
        self.kinds = Kinds(self.kind)

    def __reduce__(self) -> tuple:
        return Classes, (self.words,)

    def kind(self, s: str) -> int:
        n, c = self.number, s[0]
        if c == "\n":
            return BREAK
        if DENSE_RUN.match(s):
            return RUN
        if c.isalpha():
            low = s.casefold()
            if low in self.spaced:
                return n[low]
            if s.startswith(("http://", "https://", "www.")):
                return n["<url>"]
            if "_" in s or s[1:].lower() != s[1:] or any(x.isdigit() for x in s):
                return n["<id>"]
            return n["<W>"] if c.isupper() else n["<w>"]
        if len(s) == 1 and not c.isdigit():
            return n.get(SAME_MARK.get(c, c), n["<m>"]) if c in MARKS or c in SAME_MARK else n["<m>"]
        if c == "[" or s.startswith("<a"):
            return n["<link>"]
        if c == "#" and s[1].isalpha():
            return n["<tag>"]
        if c in "`<&":
            return n["<code>"]
        return n["<price>"] if PRICE.fullmatch(s) else n["<num>"]

    def tokens(self, lines: str) -> np.ndarray:
        """The classes of a page's tokens, with BREAK where a line ends."""
        found = TOKEN.findall(lines)
        out = np.fromiter(map(self.kinds.__getitem__, found), np.int32, len(found))
        at = np.flatnonzero(out == RUN)
        if not len(at):
            return out
        parts, done = [], 0
        for i in at.tolist():
            parts += (out[done:i], [self.number[x] if j & 1 else self._run(len(x)) for j, x in enumerate(self.dense.split(found[i])) if x])
            done = i + 1
        return np.concatenate([*parts, out[done:]], dtype=np.int32)

    def _run(self, n: int) -> int:
        return self.number["<d>" if n < 4 else "<dd>" if n < 9 else "<ddd>"]

    def __call__(self, text: str | None) -> dict | None:
        return self.pages(pa.array([text], pa.string())).to_pylist()[0]

    def pages(self, texts: pa.Array) -> pa.StructArray:
        """The sequences of each page: START START piece STOP for each piece, with the pieces' visible sizes. Pieces
        without a token are left out."""
        langs: list[str | None] = []
        codes: list[np.ndarray] = []
        sizes: list[int] = []
        ends: list[bool] = []
        lines_of: list[int] = []
        for text in texts.to_pylist():
            if not text or not text.strip():
                langs.append(None)
                lines_of.append(0)
                continue
            lines = SPACES.sub(" ", split(text))
            own = lines.split("\n")
            x = self.tokens(lines + "\n")
            codes.append(x)
            lines_of.append(len(own))
            sizes += [len(p) - p.count(" ") for p in own]
            ends += [p.rstrip(CLOSERS).endswith(ENDS) for p in own]
            langs.append(self.language(text, x))
        x = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        stop = np.flatnonzero(x == BREAK)
        length = np.diff(stop, prepend=-1) - 1
        kept = length > 0
        page = np.repeat(np.arange(len(langs)), lines_of)[kept]
        # words and other tokens of each piece
        up_to = [np.concatenate([[0], np.cumsum(v)]) for v in (x >= self.first_word, (x >= 0) & (x < self.first_mark))]
        k, others = (np.diff(v[stop], prepend=0)[kept] for v in up_to)
        n = k + others
        sentence = (n >= 5) & np.array(ends, bool)[kept]
        length = length[kept] + 3
        last = np.cumsum(length) - 1
        ids = np.empty(length.sum(), np.int32)
        own = np.ones(len(ids), bool)
        for at, i in ((last - length + 1, START), (last - length + 2, START), (last, STOP)):
            ids[at], own[at] = i, False
        ids[own] = x[x >= 0]

        def total(v: np.ndarray) -> pa.Array:
            out = np.zeros(len(langs), np.int64)
            np.add.at(out, page, v)
            return pa.array(out)

        def lists(v: np.ndarray, of: np.ndarray) -> pa.Array:
            offsets = np.zeros(len(langs) + 1, np.int64)
            np.add.at(offsets, page + 1, of)
            offsets = np.cumsum(offsets)
            if offsets[-1] >= 1 << 31:
                raise ValueError("a batch has too many tokens; set fewer rows a batch")
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32()), type=to_arrow_type(INTS))

        columns = [pa.array(langs, pa.string()), total(n), total(k), total(n * sentence), total(k * sentence), lists(ids, length), lists(np.array(sizes, np.int64)[kept], np.ones(len(page), np.int64))]
        return pa.StructArray.from_arrays(columns, fields=list(to_arrow_type(SEQUENCES)), mask=pa.array([v is None for v in langs], pa.bool_()))

    def language(self, text: str, codes: np.ndarray) -> str:
        if NOT_LATIN.search(text):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            found = dict(zip(SCRIPTS, np.bincount(SCRIPT_AT[points[points < len(SCRIPT_AT)]], minlength=len(SCRIPTS)).tolist()))
            found = {s: n for s, n in found.items() if s and n}
            if found.get("kana", 0) * 8 >= found.get("han", 0) + found.get("kana", 0) > 0:
                found["kana"] += found.pop("han", 0)
            top = max(found, key=lambda s: (found[s] * (3 if s in ("han", "kana", "hangul") else 1), s), default="latin")
            for lang, script in SCRIPT_OF_LANG.items():
                if script == top:
                    return lang
        by: dict[str, float] = {}
        for i, c in Counter(codes[codes >= self.first_word].tolist()).items():
            for lang in self.langs.get(i, ()):
                by[lang] = by.get(lang, 0.0) + c / len(self.langs[i])
        return max(by, key=lambda x: (by[x], x)) if by else "und"


def pieces(text: str) -> list[str]:
    """Sentences and items; wrapped lines are joined, headings stand alone, code is left out."""
    return [p for p in split(text).split("\n") if p and not p.isspace()]


def split(text: str) -> str:
    """The text with each of its pieces as a line; some lines may be blank."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n\n", text)
    out: list[str] = []
    for block in BLANK.split(text):
        if "\n" not in block:
            joined = [block] if block.strip() else []
        else:
            groups: list[list[str]] = []
            item = False
            for x in block.split("\n"):
                if not x.strip():
                    continue
                starts = MARKER.match(x) is not None
                if groups and not starts and (not item or x[:1] in " \t"):
                    groups[-1].append(x.rstrip())
                else:
                    groups.append([x.rstrip()])
                    item = starts
            joined = []
            for g in groups:
                joined += [" ".join(x.strip() for x in g)] if len(g) == 1 or MARKER.match(g[0]) or wrapped(g) else [x.strip() for x in g]
        out += [x if HEADING.match(x) else MARKER.sub("", x) for x in joined]
    return SENTENCE.sub(r"\1\n", "\n".join(out))


def windows(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a sequence's trigrams, the numbers of the bigrams they begin with, and where they are counted: not
    over the start of a piece."""
    a, b, c = ids[:-2].astype(np.uint64), ids[1:-1].astype(np.uint64), ids[2:].astype(np.uint64)
    pair = a * np.uint64(size) + b
    place = (pair * np.uint64(size) + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (place % np.uint64(BUCKETS)).astype(np.int64), pair.astype(np.int64), ids[2:] != START


class Side:
    """One model: counts of trigrams by place and of the bigrams they begin with, and the log-free lower orders."""

    def __init__(self, triples: np.ndarray, heads: np.ndarray, tails: np.ndarray, size: int):
        bi = tails.reshape(size, size).astype(np.float64)
        self.c3, self.c2 = triples.astype(np.float32), heads.astype(np.float32)
        low = WEIGHTS[1] * bi / (bi.sum(1)[:, None] + ADDED) + WEIGHTS[2] * bi.sum(0)[None, :] / max(1.0, bi.sum()) + FLOOR
        self.low = low.ravel().astype(np.float32)

    def logs(self, place: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.log(WEIGHTS[0] * self.c3[place] / (self.c2[head] + ADDED) + self.low[tail])


class Contrast:
    """The perplexities of pieces under prose and under the other model."""

    def __init__(self, sides: dict[bool, Side], size: int):
        self.sides, self.size = sides, size

    def judge(self, pages: pa.StructArray) -> pa.Array:
        """For each page the share of its visible text in pieces that are likelier under the other model, and the page's
        perplexity under the prose model and under the other."""
        ids, sizes = pages.field("ids"), pages.field("sizes")
        of = np.diff(sizes.offsets.to_numpy()) * np.asarray(sizes.is_valid())
        size = sizes.flatten().to_numpy(zero_copy_only=False).astype(float)
        x = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(of)
        off, prose, other = np.zeros(n), np.ones(n), np.ones(n)
        if len(size):
            place, head, valid = windows(x, self.size)
            tail = x[1:-1] * self.size + x[2:]
            a, b = (np.where(valid, self.sides[k].logs(place, head, tail), 0.0) for k in (False, True))
            starts = np.flatnonzero((x[:-1] == START) & (x[1:] == START))
            page = np.repeat(np.arange(n), of)
            sums = [np.add.reduceat(v, starts) for v in (a, b, valid.astype(float))]
            off = np.bincount(page, size * (sums[0] < sums[1]), n) / np.maximum(1.0, np.bincount(page, size, n))
            total = np.maximum(1.0, np.bincount(page, sums[2], n))
            prose, other = (np.exp(-np.bincount(page, v, n) / total) for v in sums[:2])
        return pa.StructArray.from_arrays([pa.array(v) for v in (off, prose, other)], names=["off_share", "prose_perplexity", "other_perplexity"])


JUDGED = T.StructType([T.StructField(k, T.DoubleType()) for k in ("off_share", "prose_perplexity", "other_perplexity")])
TRIPLE, HEAD, TAIL = range(3)


def count_classes(pages: DataFrame, flag: str, size: int) -> dict[bool, Side]:
    """The models of the pages by the boolean column ``flag``. Batches are counted where they lie; only sums are moved,
    at most BUCKETS + 2 * size * size for each model."""
    kind = pa.schema([("other", pa.bool_()), ("what", pa.int8()), ("t", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = np.array(b["flag"].to_pylist(), dtype=bool)
            column = b["ids"]
            lengths = np.diff(column.offsets.to_numpy())
            ids = column.flatten().to_numpy(zero_copy_only=False)
            if len(ids) < 3:
                continue
            place, head, valid = windows(ids, size)
            tail = ids[1:-1].astype(np.int64) * size + ids[2:]
            of = np.repeat(flags, lengths)[2:]
            for other in (False, True):
                for what, keys in ((TRIPLE, place), (HEAD, head), (TAIL, tail)):
                    t, n = np.unique(keys[valid & (of == other)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), other)), pa.array(np.full(len(t), what, np.int8)), pa.array(t), pa.array(n)], schema=kind)

    rows = pages.where("ids is not null").select(F.col(flag).alias("flag"), "ids").mapInArrow(run, "other boolean, what byte, t long, n long").groupBy("other", "what", "t").agg(F.sum("n").alias("n")).toPandas()

    def dense(other: bool, what: int, length: int) -> np.ndarray:
        x = rows[(rows["other"] == other) & (rows["what"] == what)]
        out = np.zeros(length)
        out[x["t"].to_numpy(np.int64)] = x["n"].to_numpy(float)
        return out

    return {other: Side(dense(other, TRIPLE, BUCKETS), dense(other, HEAD, size * size), dense(other, TAIL, size * size), size) for other in (False, True)}


def spam_pages(df: DataFrame, words: dict[str, list[str]], key: str, text: str = "text") -> DataFrame:
    """key, off_share, prose_perplexity, other_perplexity, spam of every page of df."""
    ship(df.sparkSession)
    classes = Classes(words)
    pages = staged(with_batch(df.select(F.col(key), F.col(text).alias("_t")), "_t", "s", SEQUENCES, classes.pages).select(key, "s.*"))
    # the usual share of function words in sentences, by language; a table with a row for each language
    usual = pages.where(F.col("lang") != "und").groupBy("lang").agg((F.sum("sentence_k") / F.sum("sentence_n")).alias("rate"))
    rate = F.least(F.lit(0.9), F.greatest(F.lit(0.02), F.coalesce("rate", F.lit(USUAL))))
    z = (F.col("k") - F.col("n") * rate) / F.sqrt(F.greatest(F.lit(1.0), F.col("n") * rate * (1 - rate)))
    few = F.when((F.col("n") >= LEAST_TOKENS) & (F.col("k") < SEED_PART * F.col("n") * rate), z).otherwise(0.0)
    pages = pages.join(F.broadcast(usual), "lang", "left").withColumn("spam", F.coalesce(few, F.lit(0.0)) < SEED).select(key, "n", "ids", "sizes", "spam")
    for _ in range(ROUNDS):
        model = Contrast(count_classes(pages, "spam", classes.size), classes.size)
        packed = F.struct("ids", "sizes")
        judged = with_batch(pages.select(key, "n", "ids", "sizes", packed.alias("_p")), "_p", "j", JUDGED, model.judge)
        pages = judged.select(key, "n", "ids", "sizes", "j.*").withColumn("spam", F.coalesce((F.col("off_share") > LEAST_SHARE) & (F.col("n") >= LEAST_TOKENS), F.lit(False)))
    return pages.select(key, *JUDGED.names, "spam")


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, off_share, perplexities and spam of every document."""
    return spam_pages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), function_words(spark, sf_dir), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the documents that are mostly keywords, links, tags or product lines."""
    return p9_pages(spark, sf_dir).where("spam").select("doc_id").distinct()
