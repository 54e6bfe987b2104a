"""Writing systems, letters and function words shared by the text operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Two-letter codes whose writing puts no spaces between words.
UNSPACED = ("ja", "th", "zh")

#: Code point ranges of the writing systems that the languages of ``common_words`` use.
SCRIPT_RANGES = {
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯ",
    "arabic": "؀-ۿݐ-ݿ",
    "devanagari": "ऀ-ॿ",
    "thai": "฀-๿",
    "hangul": "ᄀ-ᇿ㄰-㆏가-힯",
    "kana": "぀-ヿ",
    "han": "㐀-䶿一-鿿",
    "latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ",
}
SCRIPT_OF_LANG = {"el": "greek", "ru": "cyrillic", "ar": "arabic", "hi": "devanagari", "th": "thai", "ko": "hangul", "ja": "kana", "zh": "han"}
ONLY_SCRIPT = {v: k for k, v in SCRIPT_OF_LANG.items()}

#: A bound on the word table; it is fixed and small, and sent to every task.
MAX_WORDS = 20_000

SCRIPT_RE = re.compile("|".join(f"(?P<{k}>[{v}]+)" for k, v in SCRIPT_RANGES.items()))
#: A letter of any writing system but Latin; most texts have none, which is quickly seen.
NOT_LATIN = re.compile("[Ͱ-῿぀-ヿ㐀-鿿ᄀ-ᇿ㄰-㆏가-힯]")
NOT_LETTER = re.compile(r"[\W\d_]+")
#: A word of a spaced script: letters with their combining marks, inner apostrophes allowed.
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ًͯ-ٟऀ-ॣะ-๎])*(?:['’][^\W\d_]+)*")
DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿]")
THAI = re.compile("[฀-๿]")
DENSE_OR_THAI = re.compile("[฀-๿぀-ヿ㐀-䶿一-鿿]")


def function_words(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The function words of every language of ``common_words``: {language: sorted words}. Null rows are left out;
    more than ``MAX_WORDS`` rows are refused, since the result is sent to every task."""
    rows = spark.read.parquet(f"{sf_dir}/common_words.parquet").select("lang", "word").dropna().distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"common_words has more than {MAX_WORDS} rows")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def units(text: str) -> float:
    """The length in words; three characters of an unspaced East Asian script or five of Thai count as a word."""
    dense, thai = len(DENSE.findall(text)), len(THAI.findall(text))
    return len(WORD.findall(DENSE_OR_THAI.sub(" ", text) if dense or thai else text)) + dense / 3 + thai / 5


def scripts(text: str) -> dict[str, int]:
    """How many letters of each writing system the text has."""
    out: dict[str, int] = {}
    for m in SCRIPT_RE.finditer(text):
        out[m.lastgroup] = out.get(m.lastgroup, 0) + m.end() - m.start()
    return out


class Voter:
    """Language votes by function words. A word found in n languages gives each 1/n of a vote (inverse language
    frequency); the script alone settles the languages that have one to themselves."""

    def __init__(self, words: dict[str, list[str]]):
        self.by_word: dict[str, tuple[str, ...]] = {}
        for lang in sorted(words):
            if lang not in UNSPACED and SCRIPT_OF_LANG.get(lang) is None:
                for w in words[lang]:
                    for part in w.casefold().split():
                        self.by_word[part] = (*self.by_word.get(part, ()), *([] if lang in self.by_word.get(part, ()) else [lang]))

    def __call__(self, text: str) -> str | None:
        found = scripts(text) if NOT_LATIN.search(text) else {"latin": 1}
        if not found:
            return None
        if found.get("kana", 0) * 8 >= found.get("han", 0) + found.get("kana", 0) > 0 and found.get("kana"):
            found["kana"] += found.pop("han", 0)
        top = max(found, key=lambda k: (found[k] * (3 if k in ("han", "kana", "hangul") else 1), k))
        if top in ONLY_SCRIPT:
            return ONLY_SCRIPT[top]
        votes: dict[str, float] = {}
        for w in WORD.findall(text.casefold()):
            for lang in (langs := self.by_word.get(w, ())):
                votes[lang] = votes.get(lang, 0) + 1 / len(langs)
        return max(votes, key=lambda k: (votes[k], k)) if votes else "und"
