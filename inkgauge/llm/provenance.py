"""Source files that nobody wrote by hand in their project: generated, minified, vendored, data saved as code
(problem 4).

``sketch`` reads each file once into tokens without comments. Five-token shingles come in two kinds: with identifiers
masked, and with literals masked as well; keywords and signs stay. Both are banded by MinHash, and every candidate pair
is verified on the whole shingle sets.

* ``copies`` clusters the first kind together with the identifiers themselves: files alike in both are copies of each
  other. A cluster that spans repositories, and that no generator's template explains, is a vendored library.
* ``templates`` clusters the second kind after a language's common shingles (those of more than COMMON of its files)
  have been weighed with zero; only files that still show half of their length take part. A cluster of files that are
  no copies of each other is what one generator wrote into several files: its members are generated, within a
  repository as well as across repositories. If its shingles hold literals only, its members are blobs.

What follows are exact checks on single files, for those that have no second like them: a generator's mark or a
library's banner in a comment, a library's folder, lines that count upwards, the share of literals, missing layout.

Equal shingle sets are grouped before anything is compared; one file stands for each group. The files of a bucket are
compared with its heads, the smallest file first; files that no head is a copy of elect new heads among themselves, and
all files of the bucket are compared with those.

Defined results: null or empty bytes, and files that are no source by their extension, have no row. Files with fewer
than LEAST_KINDS shingles and identifiers (package stubs) take no part in clusters, since such short texts are alike by chance. A
file delivered twice counts once. A null project is a project of its own. Bytes that aren't UTF-8 are read by their
byte order mark, else as Latin-1; nothing is cut off.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .rows import with_batch, with_struct

INTS = T.ArrayType(T.IntegerType())
LONGS = T.ArrayType(T.LongType())
SKETCH_TYPE = T.StructType(
    [T.StructField("language", T.StringType())]
    + [T.StructField(k, INTS) for k in ("shingles", "names", "plan", "plan_times", "plan_bare")]
    + [T.StructField("bands", LONGS), T.StructField("sig", T.LongType())]
    + [T.StructField(k, T.BooleanType()) for k in ("marked", "counting", "minified")]
    + [T.StructField("literal_share", T.DoubleType())]
    + [T.StructField(k, T.StringType()) for k in ("banner", "folder")]
)
PLAN_TYPE = T.StructType([T.StructField("rare", INTS), T.StructField("bands", LONGS), T.StructField("sig", T.LongType()), T.StructField("bare", T.DoubleType())])
#: Tokens of a shingle; bands, and minima of shingles in each (a copy's band also holds one minimum of the identifiers).
WIDTH, BANDS, ROWS, PLAN_ROWS = 5, 16, 4, 4
#: Two files are copies, or of one template, from this similarity on.
LEAST_SIMILARITY = 0.8
#: A language's shingles in more than this share of its files weigh nothing in templates; what is left has to cover
#: this share of the file.
COMMON, LEAST_COVER = 0.35, 0.5
#: The least evidence for likeness: distinct shingles and identifiers of a copy, and runs of tokens that a template covers.
LEAST_KINDS, LEAST_RUNS = 20, 20
#: By its definition, the common shingles of a language are at most (shingles of a mean file) / COMMON.
MAX_COMMON = 1_000_000

#: Extensions of source files by language, and of those the scripts and style sheets that get minified.
LANGUAGE_OF = {e: e for e in "go rs java cs php swift scala m dart r sh".split()} | {e: k for k, v in {"py": "py pyi pyw", "rb": "rb", "sh": "bash", "js": "js mjs cjs jsx", "ts": "ts tsx mts cts", "kt": "kt kts", "c": "c h", "cpp": "cc cpp cxx hpp hh mm", "lua": "lua", "pl": "pl pm", "css": "css scss less"}.items() for e in v.split()}
SQUEEZED = frozenset("js mjs cjs jsx css".split())
#: Words of programming languages, which are no identifiers.
KEYWORDS = frozenset(
    "abstract and as assert async await begin bool boolean break byte case catch char class const continue def default defer del delete do double elif else elsif end enum except export extends extern false False final finally float fn for foreach from func function global go goto if impl implements import in include instanceof int interface is lambda let long loop map match mod module mut namespace new nil None not null of or override package pass private protected pub public raise range require return self short static str string String struct super switch template this throw throws trait true True try type typedef typename typeof union unless unsigned until use using val var virtual void volatile when where while with yield".split()
)
#: Folders that hold other people's libraries, each in a folder of its own.
LIBRARY_FOLDER = re.compile(r"(?:^|/)(?:_?vendor|node_modules|bower_components|third[-_]?party|external|extern|deps|Pods|bundled|vendored|jspm_packages)/(?P<lib>[^/]+)/", re.I)

#: How generators mark their files, in several languages.
MARK = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by)\b|\b(?:code|file) (?:was |is )?(?:automatically |auto-?)?generated by\b|\bautomatically generated (?:by|from)\b|\bgenerated by \S+.*\bdo not (?:edit|modify)\b"
    r"|\bbuilt from \S+ by \S+; do not (?:edit|modify)|\bmachine (?:written|generated)\b|\boutput of \S+ on \S+ -- edits here|\bproduced by \S+ v?\d.*\bdo not (?:edit|modify)\b|\bdo not (?:edit|modify)(?: (?:this file|by hand|manually))?\b[^.]*\bgenerated\b"
    r"|\bautomatisch (?:erzeugt|generiert)\b|\bfichier (?:produit|généré)\b.*\bne pas (?:modifier|éditer)|\b(?:archivo|fichero) generado\b|\barquivo gerado\b|\bплик wygenerowany|\bplik wygenerowany|файл создан программой|автоматически сгенерирован|自动生成|自動生成|자동 ?생성|otomatik olarak (?:üretil|oluştur)",
    re.I,
)
NOT_MARK = re.compile(r"\b(?:nothing|not|none|never|isn't)\b[^.]*\bauto-?generated|\breads? the files\b", re.I)
#: One of these stands in every mark; a cheap test before MARK.
MARK_HINTS = ("generated", "generiert", "erzeugt", "produit", "généré", "generado", "gerado", "built from", "machine", "output of", "produced by", "wygener", "создан", "сгенер", "生成", "생성", "otomatik")
#: How a library's copy names itself: its name, its version and its terms or origin.
BANNERS = (
    re.compile(r"\bupstream:\s*(?P<lib>[\w.@/-]+),?\s+(?:release|version|v)", re.I),
    re.compile(r"^\W*(?P<lib>[A-Za-z][\w.@/-]*) v\d+\.\d+(?:\.\d+)?\S*\s*\n\W*(?:https?://|\(c\)|copyright)", re.I | re.M),
    re.compile(r"^\W*(?P<lib>[A-Za-z][\w.@/-]*) v?\d+\.\d+\.\d+\S* \| .+(?:\| \S+|licen[cs]e|terms)", re.I | re.M),
)
#: One of these stands in every such banner; none has a letter that another sign, ignoring case, could stand for.
BANNER_HINTS = (("tream:",), ("://", "(c)", "copyr"), (" | ",))
TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
#: Comments and texts. Each branch begins with a fixed sign, so that the search skips to the next of these signs.
PIECE = re.compile(
    r"//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)|#(?<![\w&$]#)(?![0-9a-fA-F]{3,8}[;\s}])[^\n]*"
    r"|\"\"\"[^\"]*+(?:\"(?!\"\")[^\"]*+)*+(?:\"\"\"|\Z)|b\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
    r"|b'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
)
NATURAL = re.compile(r"(?<![^\W\d_])[^\W\d_]{2,}+\s++[^\W\d_]{2,}+\s++[^\W\d_]{2}")
INTEGERS = re.compile(r"\d+")
LETTERS = re.compile(r"[^\W\d]+")
DIGIT = re.compile("[0-9]")

#: Data saved as code is so large and, by so large a share, literals; in a cluster of nothing but literals, by this one.
BLOB_BYTES, BLOB_SHARE, CLUSTER_SHARE = 500, 0.85, 0.7
MIN_BYTES, MIN_SPACE, MIN_LINE = 300, 0.09, 120
COUNT_LINES, COUNT_SPREAD = 8, 8

_rng = np.random.default_rng(20240229)
_N = BANDS * max(ROWS + 1, PLAN_ROWS)
_A = _rng.integers(1, 2**63, _N, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, _N, dtype=np.uint64)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
NAME, LITERAL = 1, 2
#: Set in the checksum of every identifier, so that none is zero.
IS_NAME = 1 << 32


class _Words(dict):
    """Rows of ``table`` by token: its number with identifiers masked, and with literals masked too; the checksum that an
    identifier counts by in the names; its length if it is a number, and if it is a word. A literal comes as a quotation
    mark and its checksum."""

    OWN, PLAN, NAME, NUMBER, WORD = range(5)

    def __init__(self):
        super().__init__()
        self.table = np.zeros((5, 4096), np.uint64)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        c, code = token[0], zlib.crc32(token.encode("utf-8", "surrogatepass"))
        word = c.isalpha() or c == "_"
        if word and token not in KEYWORDS:
            self.table[:, at] = NAME, NAME, code | IS_NAME, 0, len(token)
        else:
            plan = LITERAL if c == '"' or c.isdigit() else code | 4
            self.table[:, at] = code | 4, plan, 0, len(token) if c.isdigit() else 0, len(token) if word else 0
        self[token] = at
        return at

    def rows(self, tokens: list[str]) -> np.ndarray:
        """The table's columns of these tokens; what is known is forgotten between files when it gets large."""
        if len(self) > 200_000:
            self.clear()
            self.table = np.zeros((5, 4096), np.uint64)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.table[:, at]


WORDS = _Words()


def decode(raw: bytes | None) -> str:
    raw = bytes(raw or b"")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def runs(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of WIDTH tokens."""
    n = len(codes) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        h ^= codes[i : n + i]
        h *= _P[i]
        h ^= h >> np.uint64(29)
    return h >> np.uint64(32)


def unique(h: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    low = np.sort(h)
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    return low[new]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, sorted, with a place and the number of each."""
    order = np.argsort(h)
    low = h[order]
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    return low[new], order[new], np.diff(np.append(new, len(low)))


def minima(h: np.ndarray, at: int, n: int) -> np.ndarray:
    """The minima of a set under n permutations, from number ``at`` on."""
    moved = h[None, :] * _A[at : at + n, None]
    moved += _B[at : at + n, None]
    return moved.min(axis=1) >> np.uint64(1)


def folded(low: np.ndarray) -> list[int]:
    """One 63-bit hash of each row, in which the row's number counts."""
    out = np.arange(1, len(low) + 1, dtype=np.uint64) * _P[0]
    for i in range(low.shape[1]):
        out = (out ^ low[:, i]) * _P[(i + 1) % 5]
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(1)).astype(np.int64).tolist()


def set_hash(*sets: np.ndarray) -> int:
    """A hash of sorted arrays."""
    h = 0
    for s in sets:
        raw = s.astype("<u4").tobytes()
        h = (h * 0x9E3779B97F4A7C15 + (zlib.crc32(raw) << 32 | zlib.adler32(raw)) + len(s)) & (2**63 - 1)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32).view(np.int32)


def unsigned(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int32).view(np.uint32).astype(np.uint64)


def counting(lines: list[str]) -> bool:
    """Whether lines of one shape count upwards by one, through most of the file."""
    numbered = [x for x in lines if DIGIT.search(x)]
    if len(numbered) < COUNT_LINES or len(lines) > COUNT_SPREAD * len(numbered):
        return False
    shapes = INTEGERS.sub("0", LETTERS.sub("a", "\n".join([x.strip() for x in numbered]))).split("\n")
    by: dict[str, list[str]] = {}
    for shape, x in zip(shapes, numbered):
        by.setdefault(shape, []).append(x)
    for group in by.values():
        if len(group) < COUNT_LINES or len(lines) > COUNT_SPREAD * len(group):
            continue
        for column in zip(*map(INTEGERS.findall, group)):
            n = [int(v) if len(v) < 16 else -9 for v in column]
            if sum(b - a == 1 for a, b in zip(n, n[1:])) >= 0.9 * (len(n) - 1):
                return True
    return False


def sketch(path: str | None, raw: bytes | None) -> dict | None:
    """The marks and signatures of one file; None if it is no source."""
    name = (path or "").rpartition("/")[2]
    extension = name.rpartition(".")[2].lower()
    if extension not in LANGUAGE_OF or not raw:
        return None
    text = decode(raw).replace("\r\n", "\n")
    literal = written = at = 0
    bare: list[str] = []
    joined: list[str] = []  # the code, a comment as a blank and a text as a quotation mark
    quotes: list[str] = []  # the token of each quotation mark there
    notes: list[str] = []  # comments, those with nothing between them as one; and what the file opens with
    begun = after_note = False
    for m in PIECE.finditer(text):
        between = text[at : m.start()]
        if between and not between.isspace():
            if '"' in between:
                quotes += ['"'] * between.count('"')
            begun, after_note = True, False
        bare.append(between)
        joined.append(between)
        at, whole = m.end(), m[0]
        if whole[0] not in "/#":
            parts = whole.split()
            if len(parts) > 2 and NATURAL.search(whole):
                written += len(whole)
            else:
                literal += len("".join(parts))
                bare.append(" S ")
            if not begun:
                notes.append(whole)
            joined.append('"')
            quotes.append(f'"{zlib.crc32(whole.encode("utf-8", "surrogatepass")):x}')
            begun, after_note = True, False
        else:
            bare.append("\n" * whole.count("\n") or " ")
            joined.append(" ")
            if after_note:
                notes[-1] += "\n" + whole
            else:
                notes.append(whole)
            after_note = True
    bare.append(text[at:])
    joined.append(text[at:])
    code = "".join(bare)
    tokens = TOKEN.findall("".join(joined))
    at = -1
    for x in quotes:
        at = tokens.index('"', at + 1)
        tokens[at] = x
    own, plan, named, numbers, words = WORDS.rows(tokens)
    numbers, words = int(numbers.sum()), int(words.sum())
    code_lines = [x for x in code.split("\n") if x and not x.isspace()]
    comments = "\n\n".join(notes)
    low = comments.lower()
    marked = any(x in low for x in MARK_HINTS) and any(MARK.search(x) and not NOT_MARK.search(x) for note in notes for x in (*note.split("\n"), " ".join(y.strip(" /*#") for y in note.split("\n"))))
    spaces = len(code) - len("".join(code.split())) if extension in SQUEEZED else 0
    squeezed = extension in SQUEEZED and len(text) >= MIN_BYTES and spaces <= MIN_SPACE * len(code) and len(code) >= MIN_LINE * max(1, len(code_lines)) / (3 if ".min." in name else 1)
    if extension == "css" and not squeezed:
        squeezed = len(text) >= MIN_BYTES and spaces <= MIN_SPACE * len(code) and not any(x.rstrip().endswith("{") for x in code_lines) and len(code_lines) < code.count("}")
    folder = LIBRARY_FOLDER.search(path or "")
    h = unique(runs(own))
    g, first, often = distinct(runs(plan[:0] if squeezed else plan))
    names = unique(named[named > 0]) & np.uint64(IS_NAME - 1)
    enough = len(h) > 0 and len(h) + len(names) >= LEAST_KINDS
    wordless = plan != NAME
    clean = np.ones(len(plan) - WIDTH + 1, bool) if len(plan) >= WIDTH else np.zeros(0, bool)
    for i in range(WIDTH):
        clean &= wordless[i : len(clean) + i]
    bands = None
    if enough:
        some = names if len(names) else np.zeros(1, np.uint64)
        bands = folded(np.column_stack([minima(h, 0, BANDS * ROWS).reshape(BANDS, ROWS), minima(some, BANDS * ROWS, BANDS)]))
    return {
        "language": LANGUAGE_OF[extension],
        "shingles": signed(h) if enough else None,
        "names": signed(names) if enough else None,
        # what a minifier wrote has its layout for a plan
        "plan": None if squeezed else signed(g),
        "plan_times": None if squeezed else often.astype(np.int32),
        "plan_bare": None if squeezed else clean[first].astype(np.int32),
        "bands": bands,
        "sig": set_hash(h, names) if enough else None,
        "marked": marked,
        "counting": counting(code_lines),
        "minified": bool(squeezed),
        "literal_share": (literal + numbers) / max(1, literal + numbers + words + written) if len(text) >= BLOB_BYTES else 0.0,
        "banner": next((m["lib"] for p, some in zip(BANNERS, BANNER_HINTS) if any(x in low for x in some) and (m := p.search(comments))), None),
        "folder": folder["lib"] if folder else None,
    }


def sketches(files: DataFrame) -> DataFrame:
    """file_id, project and the sketch of every source file (file_id, project, path, bytes), as often as delivered;
    written once, so that the bytes are read once and later steps read the columns they need."""
    packed = F.struct(F.col("path").alias("p"), F.col("bytes").alias("b"))
    out = with_struct(files.select("file_id", "project", packed.alias("_packed")), "_packed", "s", SKETCH_TYPE, lambda r: sketch(r["p"], r["b"]) if r else None)
    return staged(out.select("file_id", F.coalesce("project", F.lit("")).alias("project"), "s").where("s is not null").select("file_id", "project", "s.*"))


def alike(x: Column, y: Column) -> Column:
    """Whether two sets are similar by LEAST_SIMILARITY; two empty sets are."""
    common = F.size(F.array_intersect(x, y))
    return common >= LEAST_SIMILARITY * (F.size(x) + F.size(y) - common)


def links(groups: DataFrame, sets: list[str]) -> DataFrame:
    """a, b: verified links between groups (id, bands and the sets). In each bucket, all are compared with its heads:
    first the smallest id, then, among those not yet linked to a head, four times as many as before."""
    spark = groups.sparkSession
    empty = spark.createDataFrame([], "a long, b long")
    each = groups.select("id", F.explode("bands").alias("band"))
    several = each.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
    bucket = staged(each.join(several, "band").select("band", "id", "head"))
    # the sets of what stands in a bucket with others, moved once
    side = staged(groups.select("id", *sets).join(bucket.select("id").distinct(), "id", "left_semi"))
    pairs = bucket.where("id <> head").select("band", F.col("id").alias("a"), F.col("head").alias("b"))
    left, heads_each, found = bucket.where("id <> head").select("band", "id"), 1, empty
    while True:
        good = staged(_verified(pairs.select("a", "b").distinct(), side, sets))
        found = good if heads_each == 1 else staged(found.unionByName(good).distinct())
        linked = pairs.join(good, ["a", "b"]).select("band", F.col("a").alias("id")).union(pairs.join(good, ["a", "b"]).select("band", F.col("b").alias("id")))
        left = left.join(linked.distinct(), ["band", "id"], "left_anti")
        left = staged(left.join(left.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band"))
        if left.isEmpty():
            return found
        heads_each *= 4
        ranked = left.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("id")))
        heads = staged(ranked.where(F.col("r") <= heads_each).select("band", F.col("id").alias("b")))
        pairs = bucket.select("band", F.col("id").alias("a")).join(heads, "band").where("a <> b")
        left = ranked.where(F.col("r") > heads_each).select("band", "id")


def _verified(pairs: DataFrame, side: DataFrame, sets: list[str]) -> DataFrame:
    """The pairs (a, b) whose sets are alike, each of them whole; sizes alone exclude many."""
    both = pairs.join(side.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in sets)), "a").join(side.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in sets)), "b")
    for c in sets:
        x, y = F.size(f"{c}_a"), F.size(f"{c}_b")
        both = both.where(F.least(x, y) >= LEAST_SIMILARITY * F.greatest(x, y))
    for c in sets:
        both = both.where(alike(F.col(f"{c}_a"), F.col(f"{c}_b")))
    return both.select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, class: the smallest id that links lead to. Each round takes the smallest label among the neighbours and then
    that label's own label; the table is cut from its lineage after each."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("class").alias("near"))
        step = label.join(near, label["id"] == near["a"], "left").select("id", "class", F.least("class", F.coalesce("near", "class")).alias("new"))
        jump = step.select(F.col("id").alias("j"), F.col("new").alias("to"))
        new = staged(step.join(jump, step["new"] == jump["j"], "left").select("id", F.least("new", F.coalesce("to", "new")).alias("class"), F.col("class").alias("old")))
        done = new.where("class <> old").isEmpty()
        label = new.select("id", "class")
        if done:
            return label
    raise RuntimeError("links do not settle")


def clusters(members: DataFrame, sets: list[str]) -> DataFrame:
    """sig, class of members (file_id, sig, bands and the sets): equal sets make a group, which its smallest file
    stands for; groups are linked, and links joined."""
    groups = staged(members.groupBy("sig").agg(F.min("file_id").alias("id"), *(F.first(c).alias(c) for c in ("bands", *sets))))
    label = components(links(groups, sets))
    return staged(groups.select("sig", "id").join(label, "id", "left").select("sig", F.coalesce("class", "id").alias("class")))


def copies(every: DataFrame) -> DataFrame:
    """sig, class: clusters of files with the same identifiers and, identifiers masked, the same shingles."""
    return clusters(every.where("bands is not null").select("file_id", "sig", "bands", "shingles", "names"), ["shingles", "names"])


def common_shingles(every: DataFrame) -> dict[str, np.ndarray]:
    """The shingles that more than COMMON of a language's files have; no more than the mean number of shingles of its
    files divided by COMMON, so the table is small at every size of the input."""
    files = every.select("file_id", "language", "plan")
    n = {r["language"]: r["count"] for r in files.groupBy("language").count().collect()}  # languages are LANGUAGE_OF's
    if not n:
        return {}
    limit = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(COMMON * v))))
    rows = files.select("language", F.explode("plan").alias("h")).groupBy("language", "h").agg(F.count("*").alias("k")).where(F.col("k") > limit[F.col("language")]).limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common shingles")
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["language"], []).append(r["h"])
    return {k: np.unique(np.array(v, np.int32)) for k, v in out.items()}


def plans(every: DataFrame, common: dict[str, np.ndarray]) -> DataFrame:
    """file_id, project, rare, bands, sig, bare of the files that uncommon shingles cover by half: those shingles, and
    the share of them that hold no word."""

    none = np.zeros(0, np.int32)

    def one(language: str, plan: np.ndarray, times: np.ndarray, bare: np.ndarray) -> dict | None:
        known = common.get(language, none)
        keep = known.take(np.searchsorted(known, plan), mode="clip") != plan if len(known) else np.ones(len(plan), bool)
        covered = times[keep].sum()
        if covered < LEAST_RUNS or covered < LEAST_COVER * times.sum():
            return None
        rare = unsigned(plan[keep])
        return {"rare": plan[keep], "bands": folded(minima(rare, 0, BANDS * PLAN_ROWS).reshape(BANDS, PLAN_ROWS)), "sig": set_hash(np.sort(rare)), "bare": float(times[keep & (bare > 0)].sum() / covered)}

    kind = pa.struct([("rare", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64())), ("sig", pa.int64()), ("bare", pa.float64())])

    def run(batch: pa.StructArray) -> pa.Array:
        columns = [batch.field(k) for k in ("language", "plan", "plan_times", "plan_bare")]
        return pa.array([one(a.as_py(), *(np.asarray(x.values, np.int32) for x in (b, c, d))) if b.is_valid and len(b.values) else None for a, b, c, d in zip(*columns)], type=kind)

    packed = F.struct("language", "plan", "plan_times", "plan_bare")
    rows = with_batch(every.select("file_id", "project", "sig", packed.alias("_p")), "_p", "t", PLAN_TYPE, run)
    return staged(rows.where("t is not null").select("file_id", "project", F.col("sig").alias("copy_sig"), "t.*"))


def provenance(files: DataFrame) -> DataFrame:
    """file_id, class, class_files, class_projects, template, template_files, generated, minified, vendored, blob and
    whether clusters alone say so (clustered_...) of every source file (file_id, project, path, bytes)."""
    every = sketches(files)
    label = copies(every)
    flags = ["marked", "counting", "minified", "literal_share", "banner", "folder"]
    s = every.select("file_id", "project", "sig", *flags).dropDuplicates(["file_id"])
    s = staged(s.join(label, "sig", "left").withColumn("class", F.coalesce("class", "file_id")))
    named = F.col("banner").isNotNull() | F.col("folder").isNotNull()
    by_project = s.groupBy("class", "project").agg(F.count("*").alias("n"), F.max(named).alias("named"))
    by_class = staged(by_project.groupBy("class").agg(F.sum("n").alias("class_files"), F.count("*").alias("class_projects"), F.max("named").alias("named")).where("class_files > 1 or named"))

    t = plans(every, common_shingles(every))
    of = clusters(t, ["rare"]).withColumnRenamed("class", "template")
    members = t.select("file_id", "sig", "copy_sig", "bare").dropDuplicates(["file_id"]).join(of, "sig").join(label.select(F.col("sig").alias("copy_sig"), F.col("class").alias("copy")), "copy_sig", "left").select("file_id", "template", "bare", F.coalesce("copy", "file_id").alias("copy"))
    members = staged(members)
    # of so many files that are no copies of each other
    size = members.groupBy("template", "copy").agg(F.count("*").alias("n")).groupBy("template").agg(F.sum("n").alias("template_files"), F.count("*").alias("_kinds")).where("_kinds > 1")
    templates = members.join(size, "template").select("file_id", "template", "template_files", (F.col("bare") >= 0.5).alias("_bare"))

    out = s.join(by_class, "class", "left").join(templates, "file_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    made = F.col("template").isNotNull() & ~no(F.col("_bare")) & (F.col("literal_share") < BLOB_SHARE)
    data = no(F.col("_bare")) & (F.col("literal_share") >= CLUSTER_SHARE)
    # what one generator wrote alike into two repositories is no copy of a library
    spans = (F.coalesce("class_projects", F.lit(1)) > 1) & ~made
    return out.select(
        "file_id",
        "class",
        F.coalesce("class_files", F.lit(1)).alias("class_files"),
        F.coalesce("class_projects", F.lit(1)).alias("class_projects"),
        "template",
        F.coalesce("template_files", F.lit(0)).alias("template_files"),
        made.alias("clustered_generated"),
        spans.alias("clustered_vendored"),
        data.alias("clustered_blob"),
        (made | F.col("marked") | F.col("counting")).alias("generated"),
        "minified",
        (spans | no(F.col("named"))).alias("vendored"),
        (data | (F.col("literal_share") >= BLOB_SHARE)).alias("blob"),
    )


def p4_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, templates and causes of every source file."""
    return provenance(spark.read.parquet(f"{sf_dir}/files.parquet").select("file_id", "project", "path", "bytes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, cause: one row for each cause that applies."""
    causes = F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("generated", "minified", "vendored", "blob"))))
    return p4_provenance(spark, sf_dir).select("file_id", F.explode(causes).alias("cause"))
