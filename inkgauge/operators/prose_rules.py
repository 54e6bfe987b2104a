"""The prose rules on one file's prose view, each with the place of what it reports. The densities are counted by one
automaton; sentences and paragraphs are cut once and shared by the rules on their order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

from ..functions.lexicons import CITATION, CITATION_LEFTOVERS, CONTRASTS, EMOJI, EXPRESSIONS, HERE_IS, INTERJECTIONS, ONE_OF, REVEALED, STATUS_EMOJI, STOP_WORDS, STRONG_CORRELATIVES, SUBJECTS, TRANSITIONS, VERBS, WEAK_CORRELATIVES
from ..functions.phrases import QUOTED, Phrases
from .density import LIMITS, ONE_HAND, OTHER_HAND

WORD = re.compile(r"(?:[^\W_]|')+")
HAS_WORD = re.compile(r"[^\W_]")
SENTENCE_END = re.compile(r"[.!?](?=[ \t\n\f\r]|\Z)")
SEARCHED = {r: x for r, x in EXPRESSIONS.items() if r not in ("VIBE029",)}
FIND = Phrases({r: x for r, x in SEARCHED.items() if r not in LIMITS or not LIMITS[r].quoted} | {"one hand": ONE_HAND, "other hand": OTHER_HAND}, {r: x for r, x in SEARCHED.items() if r in LIMITS and LIMITS[r].quoted})
_any = lambda patterns, end=r"(?!\w)": re.compile("|".join(rf"\b{p}{end if p[-1].isalnum() or p[-1] in ')?' else ''}" for p in patterns), re.I)
TRANSITION, STRONG, WEAK = _any(TRANSITIONS), _any(STRONG_CORRELATIVES), _any(WEAK_CORRELATIVES)
PARTICIPLE = re.compile(r",\s+(?:(?:thereby|further|ultimately)\s+)?(" + "|".join(map(re.escape, sorted(EXPRESSIONS["VIBE029"], key=len, reverse=True))) + r")(?!\w)", re.I)
CITED = re.compile(CITATION, re.I)
MARKED = re.compile(rf"^[ \t]*(?:#{{1,6}}|[-*+]|\d+[.)])[ \t]+([{EMOJI}])", re.M)
LISTED = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)]|\|)(?:\s|$)")
#: Names of files, and of folders of versioned files, that tell what changed in releases.
RELEASE_FILES, RELEASE_FOLDERS = re.compile(r"^(?:changelog|changes|history|news|releases?|release[-_ ]?notes)\b", re.I), frozenset("changelog changelogs changes release releases release-notes news".split())
VERSION = re.compile(r"\d+(?:[._-]\d+)+")

_it, _is = f"(?:{'|'.join(SUBJECTS)})", f"(?:'s| {'| '.join(VERBS)})"
CONTRAST = tuple(re.compile(t.replace("{it}", _it).replace("{is}", _is), re.I) for t in CONTRASTS)
LEFTOVER = re.compile("|".join(CITATION_LEFTOVERS), re.I)
REVEAL = re.compile(
    rf"(?:the (?:[a-z]+ )?(?:{'|'.join(REVEALED)})(?: is| was)?(?: simple| clear)?|there(?:'s| is| was) (?:one|a|just one|only one) (?:{'|'.join(ONE_OF)})|here(?:'s| is) (?:{'|'.join(HERE_IS)})):\s+\S", re.I
)
COLON = re.compile(r":(?=\s+\S)")
LABEL = re.compile(r"\s*(?:[-*+#/]+\s*)?((?:[\w'-]+\s+){0,4}[\w'-]+):\s")
BARE = re.compile(r"^[\s*+>/#!-]+")

Found = tuple[str, int, int, str]


def release_notes(path: str) -> bool:
    *folders, name = path.lower().split("/")
    return RELEASE_FILES.match(name) is not None or bool(VERSION.search(name)) and not RELEASE_FOLDERS.isdisjoint(folders)


class Prose:
    """One prose view, with its words, paragraphs and sentences; spans are (start, end)."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> int:
        return sum(1 for _ in WORD.finditer(self.text))

    @cached_property
    def unquoted(self) -> str:
        return QUOTED.sub(lambda m: '"' * len(m[0]), self.text).replace("’", "'")

    @cached_property
    def paragraphs(self) -> list[tuple[int, int]]:
        out, at, begin, last = [], 0, None, 0
        for line in [*self.text.split("\n"), ""]:
            if HAS_WORD.search(line):
                begin = at if begin is None else begin
                last = at + len(line)
            elif begin is not None:
                body = self.text[begin:last]
                out.append((begin + len(body) - len(body.lstrip()), begin + len(body.rstrip())))
                begin = None
            at += len(line) + 1
        return out

    @cached_property
    def sentences(self) -> list[tuple[int, int, int]]:
        """start, end and the number of the paragraph."""
        out = []
        for p, (a, b) in enumerate(self.paragraphs):
            for c in [*(m.end() for m in SENTENCE_END.finditer(self.text, a, b)), b]:
                piece = self.text[a:c]
                if piece.strip():
                    out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip()), p))
                a = c
        return out

    def n(self, span: tuple) -> int:
        return sum(1 for _ in WORD.finditer(self.text, span[0], span[1]))

    def tokens(self, span: tuple) -> list[str]:
        return WORD.findall(self.text[span[0] : span[1]].lower())


def densities(p: Prose, path: str) -> Iterator[Found]:
    hits = FIND.spans(p.text)
    # sentences that are an interjection and nothing else
    alone = [(a, w) for a, b, _ in p.sentences if p.text[b - 1] in ".!" and (w := p.text[a : b - 1].lower()) in INTERJECTIONS]
    if alone:
        hits["VIBE002"] = sorted(hits.get("VIBE002", []) + alone)
    for rule, x in LIMITS.items():
        h = hits.get(rule, [])
        if len(h) >= x.least and len({w for _, w in h}) >= x.forms and (not x.words_per_hit or len(h) * x.words_per_hit >= p.words) and not (rule == "VIBE015" and release_notes(path)):
            yield rule, h[0][0], 0, f"{len(h)} expressions, {len({w for _, w in h})} forms, {p.words} words"
    pairs = min(len(hits.get("one hand", ())), len(hits.get("other hand", ())))
    stock = hits.get("VIBE005", [])
    if pairs + len(stock) >= 2:
        yield "VIBE005", min(a for a, _ in [*stock, *hits.get("one hand", ())]), 0, f"{pairs} pairs of hands, {len(stock)} stock phrases"
    closing = hits.get("VIBE016", [])
    half = len(p.text.encode()) / 2
    if len(closing) >= 3 and sum(len(p.text[:a].encode()) >= half for a, _ in closing) >= 2:
        yield "VIBE016", closing[0][0], 0, f"{len(closing)} closing phrases"
    scenes = hits.get("VIBE032", [])
    opening = [a for a, _ in scenes if any(b <= a < e and not HAS_WORD.search(p.text[b:a]) for b, e in p.paragraphs)]
    if opening or len(scenes) >= 2:
        yield "VIBE032", opening[0] if opening else scenes[0][0], 0, f"{len(scenes)} scene setters"
    bare = [a for a, _ in hits.get("VIBE033", []) if not any(b <= a < e and CITED.search(p.text[b:e]) for b, e, _ in p.sentences)]
    if len(bare) >= 2:
        yield "VIBE033", bare[0], 0, f"{len(bare)} appeals to authority without a source"


def patterns(p: Prose, path: str, kind: str) -> Iterator[Found]:
    found = [(m.start(), m[0].rstrip(",").lower()) for m in TRANSITION.finditer(p.unquoted)]
    tokens = len(p.text.split())
    if len(found) >= 4 and len(found) * 120 >= max(tokens, 1):
        yield "VIBE001", found[0][0], 0, f"{len(found)} transitions, {tokens} words"
    dashes = p.text.count("—")
    if dashes >= 5 and dashes * 100 >= p.words:
        yield "VIBE007", p.text.index("—"), 0, f"{dashes} dashes, {p.words} words"
    strong, weak = [m.start() for m in STRONG.finditer(p.unquoted)], [m.start() for m in WEAK.finditer(p.unquoted) if "whether or" not in m[0].lower()]
    n = len(strong) + len(weak)
    if len(strong) >= 2 or strong and n >= 4 and n * 150 >= p.words:
        yield "VIBE021", strong[0], 0, f"{len(strong)} strong correlatives, {len(weak)} others"
    comments = [(m.start(1), m[1].lower()) for m in PARTICIPLE.finditer(p.unquoted)]
    if len(comments) >= 3 and len({w for _, w in comments}) >= 2 and len(comments) * 200 >= p.words and not release_notes(path):
        yield "VIBE029", comments[0][0], 0, f"{len(comments)} trailing participles"
    signs = [m for m in MARKED.finditer(p.text) if m[1] not in STATUS_EMOJI] if kind == "docs" else []
    if len(signs) >= 4 and len({m[1] for m in signs}) >= 3:
        yield "VIBE035", signs[0].start(1), 0, f"{len(signs)} decorated headings and items"


def colons(p: Prose, source: str) -> Iterator[Found]:
    """Staged reveals; else sentences with colons, apart from records with labels."""
    texts = [(a, q, p.unquoted[a:b]) for a, b, q in p.sentences]
    reveals = []
    for i, (a, q, t) in enumerate(texts):
        answered = t.endswith("?") and len(WORD.findall(t)) <= 4 and i + 1 < len(texts) and texts[i + 1][1] == q and not texts[i + 1][2].endswith("?")
        if t[:1] != '"' and (answered or REVEAL.match(t)):
            reveals.append(a)
    if len(reveals) >= 3 and len(reveals) * 200 >= p.words:
        yield "VIBE008", reveals[0], 0, f"{len(reveals)} staged reveals"
        return
    labels = [(m[1].lower() if (m := LABEL.match(x)) else None) for x in source.split("\n")]
    record = [bool(x) and any(labels[max(0, i - k) : i - k + 3] == [x] * 3 for k in range(3) if i >= k) for i, x in enumerate(labels)]
    plain = [(a, t) for a, _, t in texts if len(WORD.findall(t)) >= 3 and not record[min(source.count("\n", 0, a), len(record) - 1)]]
    with_colon = [a for a, t in plain if COLON.search(t)]
    if len(plain) >= 8 and len(with_colon) >= 4 and len(with_colon) * 5 >= len(plain) * 2:
        yield "VIBE008", with_colon[0], 0, f"{len(with_colon)} of {len(plain)} sentences have colons"


def split_contrast(first: str, second: str) -> int | None:
    """Which of the forms two sentences make: something is denied and something else said of it, or it doesn't do one
    thing and then does it, or something as short."""
    one, two = WORD.findall(first.lower()), WORD.findall(second.lower())
    subjects = {f"{s}{e}" for s in (*SUBJECTS, "they") for e in ("", "'s", "'re")}
    if len(one) < 3 or len(two) < 2 or one[0] not in subjects or two[0] not in subjects:
        return None
    verbs = ("is", "are", "was", "were")
    said = lambda w: 1 if "'" in w[0] else 2 if w[1] in verbs else 0
    a, b = said(one), said(two)
    denied = bool(a) and (one[a : a + 1] == ["not"] or one[a : a + 2] == ["no", "longer"]) or one[1] in [f"{v}n't" for v in verbs]
    if denied:
        return len(CONTRASTS) if b and two[b : b + 1] != ["not"] else None
    if one[1] not in ("doesn't", "don't", "didn't") or "'" in two[0]:
        return None
    verb = next((w for w in one[2:] if w not in ("just", "only", "merely")), "")
    same = len(verb) >= 3 and two[1].startswith(verb) and len(two[1]) <= len(verb) + 3
    return len(CONTRASTS) + 1 if same or len(verb) >= 3 and len(one) <= 6 and len(two) <= 6 else None


def contrasts(p: Prose) -> Iterator[Found]:
    texts = [(a, BARE.sub("", p.unquoted[a:b])) for a, b, _ in p.sentences]
    hits = []
    for i, (a, t) in enumerate(texts):
        form = next((k for k, c in enumerate(CONTRAST) if c.search(t)), None)
        if form is None and i + 1 < len(texts):
            form = split_contrast(t, texts[i + 1][1])
        if form is not None and t[:1] != '"':
            hits.append((a, form))
    if len(hits) >= 3 and len({f for _, f in hits}) >= 2 and len(hits) * 250 >= p.words:
        yield "VIBE020", hits[0][0], 0, f"{len(hits)} contrasts of {len({f for _, f in hits})} forms, {p.words} words"


def even(p: Prose, spans: list[tuple], source: str, least: int, length: int, tolerance) -> tuple | None:
    """The first stretch of so many spans of nearly the same length; listed spans and foreign text between them break it."""
    run: list[tuple[tuple, int]] = []
    before = None
    for s in spans:
        line = p.text.rfind("\n", 0, s[0]) + 1
        if LISTED.match(p.text[line : s[1]]):
            run, before = [], s
            continue
        if before is not None and HAS_WORD.search(source[before[1] : s[0]]):
            run = []
        before = s
        n = p.n(s)
        if n < least:
            continue
        run.append((s, n))
        last = [k for _, k in run[-length:]]
        if len(last) == length and max(last) - min(last) <= tolerance(min(last)):
            return run[-length][0]
    return None


def order(p: Prose, source: str, kind: str) -> Iterator[Found]:
    if s := even(p, p.sentences, source, 8, 8, lambda low: 3):
        yield "VIBE010", s[0], 0, "eight sentences in a row of nearly the same length"
    if s := even(p, p.paragraphs, source, 20, 5, lambda low: max(low // 5, 4)):
        yield "VIBE018", s[0], 0, "five paragraphs in a row of nearly the same length"
    last: tuple[int, set[str]] | None = None
    for a, b, q in p.sentences:
        w = {x for x in p.tokens((a, b)) if x not in STOP_WORDS}
        if last and last[0] == q and len(w) >= 7 <= len(last[1]) and len(w & last[1]) >= 7 and len(w & last[1]) * 4 >= len(w | last[1]) * 3:
            yield "VIBE017", a, 0, f"{len(w & last[1])} words in common with the sentence before"
        last = (q, w)
    scopes: dict[int, list[tuple[str, int]]] = {}
    for a, b, q in p.sentences:
        w = p.tokens((a, b))
        if len(w) >= 4:
            scopes.setdefault(q if kind == "code" else 0, []).append((" ".join(w[:2]), a))
    for found in scopes.values():
        count = Counter(o for o, _ in found)
        top = max(count, key=lambda o: (count[o], -min(a for x, a in found if x == o), [-ord(c) for c in o]))
        if count[top] >= 4 and len(found) >= 6 and count[top] * 2 >= len(found):
            yield "VIBE009", min(a for x, a in found if x == top), 0, f"{count[top]} of {len(found)} sentences begin alike"


def prose_findings(path: str, prose: str, source: str, kind: str) -> list[Found]:
    """rule, start, 0, observation of every prose rule that a file's prose view fires."""
    if kind in ("config", "unknown") or not HAS_WORD.search(prose):
        return []
    p = Prose(prose)
    out = [*densities(p, path), *patterns(p, path, kind), *order(p, source, kind)]
    if left := LEFTOVER.search(prose):
        out.append(("VIBE027", left.start(), 0, f"left over from a citation: {left[0].lower()}"))
    if not release_notes(path):
        out += contrasts(p)
        out += colons(p, source) if kind in ("docs", "text") else ()
    return out
