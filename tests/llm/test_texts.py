"""The functions on single texts, against plain definitions and the cases that have a defined result."""

import random
import re
import time
import zlib

import pytest

from inkgauge.llm import code_language, garbled, packing, prose, provenance, repeats, spam
from inkgauge.llm.lang import Voter

WORDS = {"en": "the a and of to in is that for with".split(), "es": "el la los de que y en con por para".split(), "pt": "o a os de que e em com por para".split(), "zh": ["的", "在", "会"], "ja": ["は", "を"], "ru": "и в на не что".split()}


@pytest.mark.parametrize("text", [None, "", " \n\t", "﻿"])
def test_empty_texts(text):
    assert prose.describe(text, frozenset())["form"] == "empty"
    assert repeats.measure(text, Voter(WORDS))["copy_share"] == 0
    assert code_language.languages(text, "python", code_language.Finder(WORDS)) == []
    assert garbled.hard(text) == {"hard": None, "words": None} or text == "﻿"
    assert spam.Classes(WORDS)(text) is None or text == "﻿"
    assert provenance.sketch("a.py", (text or "").encode()) is None or text


@pytest.mark.parametrize(
    ("form", "text"),
    [
        ("prose", "The reader keeps the old value when the list is empty. Nothing else changes in this step of the run."),
        ("list", "\n".join(f"- item {w}" for w in "red green blue black white grey".split())),
        ("list", "red shoe; green hat; blue coat; black belt; white sock; grey tie"),
        ("list", "\n".join(f"{w} chapter {'.' * (20 - len(w))} {i}" for i, w in enumerate("one two three four five six".split()))),
        ("table", "\n".join(f"| {i} | {i * 7} | ok |" for i in range(6))),
        ("table", "\n".join(f"name{i}\t{i}\tyes" for i in range(6))),
        ("junk", "\n".join("".join(random.Random(i).choices("ABCdefGHI0123456789+/", k=64)) for i in range(6))),
        ("junk", "\n".join(f"{i:08x}  " + " ".join(f"{random.Random(i * 20 + j).randrange(256):02x}" for j in range(16)) for i in range(8))),
        ("repeated", "The list is long and it ends here. " + "the same words again " * 30),
    ],
)
def test_forms(form, text):
    assert prose.describe(text, frozenset(WORDS["en"]))["form"] == form
    assert prose.describe(text.replace("\n", "\r\n"), frozenset(WORDS["en"]))["form"] == form


def test_alignment_tests_all_rows():
    rows = [f"a{i},b,c" for i in range(60)]
    assert prose.alignment(rows) == (1.0, ",")
    assert prose.alignment([*rows, "one two three four five six seven,b,c"]) == (0.0, "")


def brute_copies(s: str, n: int) -> float:
    covered = set()
    for i in range(len(s) - n + 1):
        if s[i : i + n] in {s[j : j + n] for j in range(i)}:
            covered.update(range(i, i + n))
    return len(covered) / len(s) if s else 0.0


@pytest.mark.parametrize("seed", range(8))
def test_copies_against_brute_force(seed):
    r = random.Random(seed)
    parts = ["".join(r.choices("abcdefgh", k=r.randrange(3, 20))) for _ in range(4)]
    s = "".join(r.choices(parts, k=r.randrange(1, 12)))
    n = repeats.run_length(len(s))
    assert repeats.copy_share(s) == pytest.approx(brute_copies(s, n) if len(s) - n + 1 >= 2 else 0.0)


@pytest.mark.parametrize(("text", "least", "most"), [("fix bug fix bug", 0.5, 0.5), ("no row, no row, no row", 0.6, 0.7), ("the reader keeps the old value when the list is empty", 0, 0.2), ("検査は空の行です。検査は空の行です。", 0.5, 0.5), ("12 12 12 12 == == ==", 0, 0)])
def test_copies_of_short_texts(text, least, most):
    assert least <= repeats.measure(text, Voter(WORDS))["copy_share"] <= most


def test_consistency_of_the_scatter():
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200_000, 4))
    d = (x**2).sum(1)
    near = x[d <= np.quantile(d, 0.75)]
    assert np.cov(near.T).trace() / 4 * repeats.consistency(0.75, 4) == pytest.approx(1, abs=0.01)
    assert repeats.chi_square(repeats.LIMIT, 2) == pytest.approx(0.975, abs=1e-4)


def test_languages_of_code():
    find = code_language.Finder(WORDS)
    code = "# The value is kept in the list for later.\nx = 'SELECT a FROM the WHERE of = ?'\n# We go to the end of the file with it.\n\ny = '\\u0438 \\u043d\\u0435 \\u0432 \\u0434\\u043e\\u043c\\u0435'\n# и не в доме на горе\n# /usr/the/of/and\n"
    got = {x["lang"]: x["sentences"] for x in code_language.languages(code, "python", find)}
    assert got == {"en": 2, "ru": 2}


def test_votes_reach_all_spaced_scripts():
    words = WORDS | {"uk": ["та", "не", "що"], "hi": ["का", "है"]}
    find = code_language.Finder(words)
    assert find(["Файл та каталог що лежить", "файл и каталог в доме", "सूची का अंत है", "Только слова"]) == ["uk", "ru", "hi", "ru"]
    assert find.votes(["काम है"])[0] == {"hi": 1.0}
    far = "x = 'The value is in the list ' +" + " " * 300 + "'and it is for the file.'\n"
    assert code_language.extract(far, "python") == ["The value is in the list and it is for the file."]


@pytest.mark.parametrize(("form", "text"), [("prose", "El lector guarda el valor cuando el contador pasa de\n24. El analizador no cambia la lista vieja en el\nregistro de la segunda vuelta."), ("list", "\n".join(f"{a} set by {b} of {c} run kept as {d}\n    {b}" for a, b, c, d in zip("red blue sea ice oak elm".split(), "lamp door wall roof floor gate".split(), "north south east west inner outer".split(), "glass stone wood iron copper brick".split())))])
def test_numbers_of_wrapped_lines_and_recurring_rows(form, text):
    assert prose.describe(text, frozenset(WORDS["en"]))["form"] == form


def test_provenance_marks():
    body = "\n".join(f"def part_{w}(a, b):\n    return a.{w} + b" for w in "one two six ten red sea".split())
    own = provenance.sketch("src/a.py", body.encode())
    assert not (own["marked"] or own["counting"] or own["minified"] or own["literal_share"] or own["banner"] or own["folder"])
    assert provenance.sketch("src/a.py", ("# Code generated by tool. DO NOT EDIT.\n" + body).encode())["marked"]
    assert not provenance.sketch("src/a.py", ("# Nothing here is auto-generated, despite the folder name.\n" + body).encode())["marked"]
    assert provenance.sketch("src/a.py", "\n".join(f"F_{i} = field('n{w}', {i})" for i, w in enumerate("abcdefghijkl")).encode())["counting"]
    assert provenance.sketch("a/vendor/lib-1.2.3/x.py", body.encode())["folder"] == "lib-1.2.3"
    assert provenance.sketch("src/vendors/x.py", body.encode())["folder"] is None
    assert provenance.sketch("w/a.js", "".join(f"function a{i}(b){{return b.c?{i}:void 0}}" for i in range(40)).encode())["minified"]
    assert provenance.sketch("w/a.c", ("const int t[] = {" + ",".join(str(i * 37 % 256) for i in range(400)) + "};").encode())["literal_share"] > 0.9
    far = "# Generated by tool " + "with all of its options set as usual " * 4 + "so do not edit.\n"
    assert provenance.sketch("src/a.py", (far + body).encode())["marked"]
    assert provenance.sketch("src/a.py", b"x = 1  # Code generated by tool. DO NOT EDIT.\n")["marked"]
    licence = "".join(f"# Terms of use, clause {w}.\n" for w in "abcdefghijklmnopqrst")
    assert provenance.sketch("src/a.py", (licence + "# Code generated by tool. DO NOT EDIT.\n" + body).encode())["marked"]
    assert provenance.sketch("src/a.py", (body + "\n# Code generated by tool. DO NOT EDIT.\n").encode())["marked"]
    assert provenance.sketch("src/a.py", (licence + "# upstream: leftpad, release 2\n" + body).encode())["banner"] == "leftpad"
    assert not provenance.sketch("src/a.py", (licence + body).encode())["marked"]
    assert provenance.sketch("README.md", body.encode()) is None


@pytest.mark.parametrize("words", ["", "x 1 2 "])
def test_long_literals_are_sketched_in_linear_time(words):
    text = f"a = '{words}{'qwertyuiop' * 2000}'\n".encode()
    began = time.process_time()
    assert provenance.sketch("src/a.py", text)["literal_share"] > 0.9
    assert time.process_time() - began < 2  # once the search for words was quadratic: 10 s


def test_quotes_without_an_end_keep_their_place():
    named = lambda text: {int(x) % 2**32 for x in provenance.sketch("src/a.py", text.encode())["names"]}
    rest = "".join(f"v{i} = f{i}\n" for i in range(20))
    names = {f"{c}{i}" for c in "vf" for i in range(20)}
    crc = lambda *x: {zlib.crc32(w.encode()) for w in (*names, *x)}
    assert named(rest + 'p = "a" + q  # "c\nr = 5" if s\nt = b"u" + "w') == crc("p", "q", "r", "s", "t", "w")
    assert named(rest + 'p/* " */q\nr = """x\ny"""s `t\nu` v') == crc("p", "q", "r", "s", "v")


@pytest.mark.parametrize("page", ["cp1252", "cp437", "cp850", "mac_roman"])
def test_utf8_in_a_wrong_page_is_found(page):
    for s in ("Der Prüfer öffnet", "l’été “là”", "naïve – café"):
        wrong = s.encode().decode(page, "replace")
        assert garbled.hard(wrong)["hard"], (page, wrong)
        assert garbled.hard(s)["hard"] is None


@pytest.mark.parametrize(
    ("text", "wrong"),
    [(s, s.encode().decode(page)) for s in ("Der Prüfer öffnet das Fenster", "“là” – l’été, 3 °C") for page in ("latin-1", "cp437", "cp850", "mac_roman")]
    + [("l’été", "l’été".encode().decode("cp1252").encode().decode("cp1252")), ("sound é, then it’s", "sound é, then it" + "’".encode().decode("cp1252") + "s"), ("“quoted” text", "\x93quoted\x94 text"), ("最后的报告", "最后的报告".encode("gb2312").decode("latin-1")), ("二回目の検査は空の行", "二回目の検査は空の行".encode("euc_jp").decode("latin-1")), ("lost � é", None)],
)
def test_whole_texts_are_restored(text, wrong):
    got = garbled.hard(wrong or text)
    assert got["hard"] and got["undone"] == (wrong and text)


@pytest.mark.parametrize("text", ["NÃO ALTERAR À MÃO", "ÂGE ET ÊTRE", "╔══╗ ║ok║ ╚══╝", "½ ¼ ¾ of it", "éèêë ÀÉÈ", "Всё сердито", "«ТВ» и «МИР»", "£20 ± 5 µs", "最后的报告", "Ðelta Þorn"])
def test_sound_texts(text):
    assert garbled.hard(text)["hard"] is None


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_keeps_the_capacity(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 200))
    sizes = r.integers(1, capacity + 1, 500)
    bins = packing.sum_of_squares(sizes, capacity)
    used = np.bincount(bins, sizes)
    assert used.max() <= capacity and (used > 0).all()
    assert len(used) <= 1.25 * -(-sizes.sum() // capacity) + 5


def test_page_classes():
    c = spam.Classes(WORDS)
    s = c("The list is in the box. [a b](http://x.example/y) #tag 12 3.50\n\n```\nthe code\n```\n")
    assert s["lang"] == "en" and s["k"] == 4 and len(s["sizes"]) == 2
    assert spam.pieces("a b c\r\nd e f") == spam.pieces("a b c\nd e f")
    assert re.fullmatch("(?:x )*x", " ".join("x" * 3))


def test_pages_of_a_batch():
    import pyarrow as pa

    c = spam.Classes(WORDS)
    texts = ["The list is in the box.  See [a b](http://x.example/y)\tand that.\n\n_\n\nwww.x.example with 3.50", None, "", " \n", "我在中文会的。很好！", "Что не в доме.", "```\nthe code\n```"]
    got = c.pages(pa.array(texts)).to_pylist()
    assert got == [c(t) for t in texts] and [x and x["lang"] for x in got] == ["en", None, None, None, "zh", "ru", "und"]
    n = c.number
    links = [n[x] for x in ("<link>", "<url>")]
    assert [x for x in got[0]["ids"] if x in links] == links and got[0]["sizes"] == [18, 35, 21]
    han = [n[x] for x in ("^", "^", "<d>", "在", "<d>", "会", "的", ".", "$", "^", "^", "<d>", "!", "$")]
    assert got[4]["ids"] == han and got[6] == {"lang": "und", "n": 0, "k": 0, "sentence_n": 0, "sentence_k": 0, "ids": [], "sizes": []}


def test_page_classes_in_linear_time():
    text = "The list is in the box " + "." * 20_000 + "x"
    start = time.process_time()
    assert spam.Classes(WORDS)(text)["n"] == 7
    assert time.process_time() - start < 1


def test_a_page_costs_little_more_than_its_tokens():
    r = random.Random(5)
    nouns = "reader parser cache index log table branch module key row".split()
    pages = [" ".join(f"The {r.choice(nouns)} of the {r.choice(nouns)} is in a {r.choice(nouns)} that is for the {r.choice(nouns)}." for _ in range(12)) for _ in range(300)]
    import pyarrow as pa

    c, column, plain = spam.Classes(WORDS), pa.array(pages), re.compile(r"\w+|[^\w\s]")

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    read = getattr(c, "pages", lambda x: [c(t) for t in x.to_pylist()])
    times = [(seconds(lambda: read(column)), seconds(lambda: [plain.findall(t) for t in pages])) for _ in range(7)]
    assert min(a for a, _ in times) < 4.5 * min(b for _, b in times)
