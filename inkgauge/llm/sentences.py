"""Sentence units of texts in many languages and scripts (problem 5).

Everything is SQL expressions. Characters that look like an end and are none are masked by private-use characters, one
for one, so that positions stay: full stops inside numbers, addresses and file names, after abbreviations, initials and
ordinals, and all ends inside a quotation or bracket that stands within a longer sentence. Then the text is split
behind the ends of its script: full stop, exclamation and question mark and ellipsis before white space and a capital
or a letter of a script without case, the full-width ends anywhere, the danda, the Arabic question mark, the Greek one
in Greek text, white space in Thai. Blank lines always split, so headings are units; a single line feed never does.
The sentence's text is cut from the original by its positions.

Private-use characters of the text itself are first turned into U+FFFD for the search (not in the result). Defined
results: null, empty and blank texts have no units. A text without any end is one unit for each paragraph. Ids should
be unique; rows that share one are still split each on its own if they differ in another kept column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Abbreviations that the sentence goes on after, in ten languages.
GOES_ON = (
    "Dr Dra Drs Sr Sra Srta Mr Mrs Ms Prof St Mme Mlle Fr Hr Hrn dr mgr inż prof hab αρ Δρ καθ डॉ श्री प्रो".split()
    + "fig figs no nos sec secs approx vs ch chap vol vols pp ed eds ex cf viz al dept est art eq tab ref".split()
    + "aprox cap caps pág págs pag núm num tel ej ap Abschn Nr bzw ca vgl ggf evtl Bd Kap Abb Tab Str inkl zzgl sog".split()
    + "env éd numéro tzn tj np ok ul str rys rozdz nr zob por wg гл рис см стр тов ул им напр прим обр п ст σελ κεφ περ δηλ βλ εικ παρ yak örn şek bkz sf böl no".split()
)
#: Abbreviations with stops inside that the sentence goes on after.
GOES_ON_INNER = ("e.g", "i.e", "π.χ", "p.ej", "z.B", "d.h", "u.a", "n.b", "м.б", "т.е", "à-d")
#: Words before a German ordinal.
BEFORE_ORDINAL = "am vom zum dem der den des im das die jeden ab bis seit".split()
#: Opening and closing marks of quotations, and brackets.
QUOTES = ("“«「『‹", "”»」』›")
BRACKETS = ("([（［【〔", ")]）］】〕")

STOP, END, CUT = "", "", ""
QO, QC, BO, BC = "", "", "", ""
WQO, WQC, WBO, WBC = "", "", "", ""
CLOSERS = f"[{QC}{BC}{WQC}{WBC}'’\"*_]*+"
OPENERS = f"{QO}{BO}{WQO}{WBO}¿¡'‘\"„"
ENDS = ".!?…؟۔।॥。！？｡"
WS = r"(?U)\s"


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def masked(text: Column) -> Column:
    """The text with its marks of quotation told apart and CUT inserted behind every unit but the last."""
    t = _replace(text, "[-]", "�")
    # full stops that end nothing
    t = _replace(t, r"\.(?=[^\s.!?…\"'”“»’)\]」』)}*_])", STOP)
    for name in GOES_ON_INNER:
        t = _replace(t, f"(?<![\\p{{L}}\\p{{M}}])({name.replace('.', STOP)})\\.(?=\\s)", f"$1{STOP}")
    t = _replace(t, f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}{STOP}])({'|'.join(sorted(set(GOES_ON), key=lambda x: (-len(x), x)))})\\.(?=\\s)", f"$1{STOP}")
    t = _replace(t, f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}{STOP}'’])([\\p{{Lu}}\\p{{Ll}}]|[دأبم])\\.(?=\\s+[^\\s])(?!\\s*\\n\\s*\\n)", f"$1{STOP}")
    t = _replace(t, f"(?<![\\p{{L}}])((?i:{'|'.join(BEFORE_ORDINAL)}))(\\s+\\d{{1,2}})\\.(?=\\s)", f"$1$2{STOP}")
    # pairs of marks, each by the same two characters
    t = _replace(t, "„([^„“”\n]*(?:\n[^„“”\n]+)*)[“”]", f"{QO}$1{QC}")
    t = _replace(t, r"(?<![^\s(（])\"(?=\S)", QO)
    t = _replace(t, r"(?<=\S)\"(?![\p{L}\p{N}])", QC)
    t = F.translate(t, QUOTES[0] + QUOTES[1] + BRACKETS[0] + BRACKETS[1], QO * len(QUOTES[0]) + QC * len(QUOTES[1]) + BO * len(BRACKETS[0]) + BC * len(BRACKETS[1]))
    # those that open where a sentence begins hold whole sentences
    for o, c, wo, wc in ((BO, BC, WBO, WBC), (QO, QC, WQO, WQC)):
        t = _replace(t, f"(\\A\\s*|\\n[^\\S\\n]*\\n\\s*|[{ENDS};][{QC}{BC}{WBC}'’]*(?:\\s+|(?<=[。！？｡{QC}{BC}{WBC}])))({o})", f"$1{wo}")
        t = _replace(t, f"({wo}(?:[^{o}{c}\n]|\n(?![^\\S\\n]*\\n)|{o}[^{o}{c}]*{c})*){c}", f"$1{wc}")
        t = _replace(t, f"[{ENDS}](?=[^{o}{c}{CUT}]*{c})", END)
    letter = f"[\\p{{Lu}}\\p{{Lt}}\\p{{Lo}}\\p{{N}}{OPENERS}#]"
    t = _replace(t, f"([.!?…؟۔।॥]{CLOSERS})(?=\\s+{letter})", f"$1{CUT}")
    t = _replace(t, f"([。！？｡]++{CLOSERS})(?=[^。！？｡{CUT}])", f"$1{CUT}")
    t = F.when(text.rlike("[Ͱ-Ͽ]"), _replace(t, f"(;{CLOSERS})(?=\\s+{letter})", f"$1{CUT}")).otherwise(t)
    t = _replace(t, r"\n(?:[^\S\n]*\n)+", f"{CUT}$0")
    return F.when(text.rlike("[ก-๛]{3}"), _replace(t, WS + "+", f"{CUT}$0")).otherwise(t)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos, end_pos, sentence of every unit of df; positions are zero-based code points, the end exclusive."""
    pieces = df.select(F.col(key), F.col(text).alias("_t"), F.monotonically_increasing_id().alias("_row")).where(F.col("_t").isNotNull())
    pieces = pieces.select(key, "_row", F.posexplode(F.split(masked(F.col("_t")), CUT)).alias("_i", "_p"))
    before = F.coalesce(F.sum(F.length("_p")).over(Window.partitionBy(key, "_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head, bare = _replace(F.col("_p"), WS + "+\\z", ""), _replace(F.col("_p"), f"{WS}+\\z|\\A{WS}+", "")
    placed = pieces.withColumn("_at", before).withColumn("end_pos", F.col("_at") + F.length(head)).withColumn("start_pos", F.col("end_pos") - F.length(bare))
    return placed.where("end_pos > start_pos").select(key, F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


def with_text(units: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """The units with their text, cut from the original."""
    cut = F.substring(F.col(text), (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    return units.join(df.select(key, text), key).select(*units.columns, cut.alias("sentence"))


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/contexts.parquet").where(F.col("batch") == "split").select("ctx_id", "prose")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id, start_pos, end_pos of every sentence unit of the running texts of batch split."""
    return sentences(split_texts(spark, sf_dir), "ctx_id", "prose").distinct()


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same units with their text."""
    texts = split_texts(spark, sf_dir)
    return with_text(sentences(texts, "ctx_id", "prose").distinct(), texts, "ctx_id", "prose")
