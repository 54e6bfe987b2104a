"""The operators on tables: nulls, empty tables, repeated rows, clashing names, and the whole of small tables."""

import os

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import code_language, garbled, mixing, packing, prose, provenance, repeats, sentences, spam
from inkgauge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORDS = {"en": "the a and of to in is that for with".split(), "de": "der die das und nicht".split()}


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "The box is in the house.", "x", "y"), (2, None, None, "z")], "id long, text string, stats string, s string")
    got = {r["id"]: r for r in prose.text_stats(df, WORDS, into="found").collect()}
    assert got[1]["stats"] == "x" and got[2]["s"] == "z" and got[2]["found"]["form"] == "empty"
    assert repeats.repeat_stats(df, WORDS, into="found").select("found.copy_share").count() == 2


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "id long, text string")
    assert prose.text_stats(texts, WORDS).count() == 0
    assert sentences.sentences(texts, "id", "text").count() == 0
    assert spam.spam_pages(texts, WORDS, "id").count() == 0
    files = spark.createDataFrame([], "file_id long, project string, path string, bytes binary")
    assert provenance.provenance(files).count() == 0
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert packing.pack(sized, {"s": 10}).count() == 0
    assert mixing.mix(sized, {"a": (0.5, 2)}).count() == 0
    stats = spark.createDataFrame([], "lang string, a double, b double")
    assert repeats.mcd(stats, ["lang"], ["a", "b"]).count() == 0
    words = spark.createDataFrame([], "rec_kind string, rec_id long, source string, hard string, words array<string>")
    assert garbled.learned(words).count() == 0


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("A first one. A second one! Is it? Yes.", ["A first one.", "A second one!", "Is it?", "Yes."]),
        ("As Dr. A. B. wrote in sec. 4.2 of v2.1.0, e.g. here. Next", ["As Dr. A. B. wrote in sec. 4.2 of v2.1.0, e.g. here.", "Next"]),
        ("He said “Stop. Try again.” in the log. Then\nhe left.", ["He said “Stop. Try again.” in the log.", "Then\nhe left."]),
        ("(All of it is true.) The rest (see no. 5.) follows.", ["(All of it is true.)", "The rest (see no. 5.) follows."]),
        ("Heading\n\nText here.\n \nMore", ["Heading", "Text here.", "More"]),
        ("これは文です。「次の文です。」彼は「止まれ。待て。」と言う。", ["これは文です。", "「次の文です。」", "彼は「止まれ。待て。」と言う。"]),
        ("Am 3. Mai endet es usw. Der Rest folgt.", ["Am 3. Mai endet es usw.", "Der Rest folgt."]),
        ("Τι είναι αυτό; Δεν ξέρω.", ["Τι είναι αυτό;", "Δεν ξέρω."]),
        ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]),
        ("ประโยคแรกยาวมาก ประโยคที่สอง", ["ประโยคแรกยาวมาก", "ประโยคที่สอง"]),
        ("😀 One. Two", ["😀 One.", "Two"]),
        ("", []),
        (" \n ", []),
        (None, []),
    ],
)
def test_sentences(spark, text, units):
    df = spark.createDataFrame([(1, text)], "id long, prose string")
    got = [(r["start_pos"], r["end_pos"]) for r in sentences.sentences(df, "id", "prose").orderBy("start_pos").collect()]
    assert [text[a:b] for a, b in got] == units


def test_copies_across_projects_are_vendored(spark):
    def body(seed):
        return "\n".join(f"def f{seed}_{i}(a{i}, b):\n    return a{i}.k{seed * 31 + i * 7} + b.z{i * seed}" for i in range(30))

    rows = [(1, "p", "a/x.py", body(1)), (2, "q", "b/y.py", body(1) + "\n# one more"), (3, "r", "c/z.py", body(2)), (3, "r", "c/z.py", body(2)), (4, None, "d/w.py", None)]
    df = spark.createDataFrame([(i, p, path, b.encode() if b else None) for i, p, path, b in rows], "file_id long, project string, path string, bytes binary")
    got = {r["file_id"]: r for r in provenance.provenance(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["vendored"] and got[2]["vendored"] and not got[3]["vendored"]
    assert got[2]["class"] == 1 and got[1]["class_files"] == 2 and got[3]["class_files"] == 1


def test_copies_are_linked_beside_an_unrelated_head(spark):
    sets = {1: range(100), 2: range(1000, 1100), 3: range(1000, 1100), 4: range(2000, 2100), 5: range(2000, 2100), 6: range(3000, 3100), 7: range(3000, 3100), 8: range(3010, 3110)}
    df = spark.createDataFrame([(i, [7], list(v)) for i, v in sets.items()], "id long, bands array<long>, x array<int>")
    label = {r["id"]: r["class"] for r in provenance.components(provenance.links(df, ["x"])).collect()}
    assert label == {2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}


def template(names, values):
    return "\n".join(f"  register_field({n!r}, kind={v}, width={v * 3}) << chain[{v}].{n};" for n, v in zip(names, values))


def test_templates_within_a_repository_are_generated(spark):
    hand = ["\n".join(f"def f{seed}_{i}(a{i}, b):\n    if a{i}.k{seed + i * 7}:\n        return b.z{i * seed}" for i in (3, 1, 8, 5, 9, 2)) for seed in range(2, 9)]
    made = [template([f"{w}{i}" for i in "abcdefghij"], [v * v % 13 + k for v in range(10)]) for k, w in enumerate(("red", "sea"))]
    rows = [(i, f"p{i % 3}", f"src/h{i}.py", b) for i, b in enumerate(hand)] + [(100 + i, "p0", f"src/m{i}.py", b) for i, b in enumerate(made)] + [(200 + i, f"p{i}", f"x{i}/__init__.py", "from .core import *\n") for i in range(3)]
    df = spark.createDataFrame([(i, p, path, bytearray(b.encode())) for i, p, path, b in rows], "file_id long, project string, path string, bytes binary")
    got = {r["file_id"]: r for r in provenance.provenance(df).collect()}
    assert {i for i, r in got.items() if r["generated"]} == {100, 101} == {i for i, r in got.items() if r["clustered_generated"]}
    assert not any(r["vendored"] or r["blob"] for r in got.values())


def test_two_causes_of_one_file(spark):
    text = "// Code generated by tool. DO NOT EDIT.\nconst int t[] = {" + ",".join(str(i * 37 % 256) for i in range(400)) + "};"
    df = spark.createDataFrame([(1, "a", "src/a.c", bytearray(text.encode()))], "file_id long, project string, path string, bytes binary")
    (got,) = provenance.provenance(df).collect()
    assert got["generated"] and got["blob"]


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(101, 100)], "a long, b long")
    got = {r["id"]: r["class"] for r in provenance.components(edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[101] == 100


def test_robust_distances_find_the_outliers(spark):
    import random

    r = random.Random(1)
    rows = [(i, "en", 0.1 + r.random() * 0.05, 0.1 + r.random() * 0.05) for i in range(300)] + [(1000 + i, "en", 0.9, 0.1) for i in range(20)]
    got = repeats.mcd(spark.createDataFrame(rows, "id long, lang string, a double, b double"), ["lang"], ["a", "b"]).collect()
    assert {x["id"] for x in got if x["distance"] > repeats.LIMIT and x["above"]} == {i for i, *_ in rows if i >= 1000}


def test_swapped_pages_are_learned(spark):
    words = ["проверяет", "каталоги", "сообщений", "прежний", "итоговый", "значения"]
    sound = [("commit", i, "s", None, words) for i in range(60)]
    wrong = [w.encode("koi8_r").decode("cp1251") for w in words]
    rows = sound + [("commit", 99, "s", None, wrong[:3])]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id long, source string, hard string, words array<string>")
    (got,) = garbled.learned(df).collect()
    assert got["rec_id"] == 99 and {r["word"]: r["restored"] for r in got["words"]} == dict(zip(wrong[:3], words[:3]))


def test_a_source_damaged_throughout_is_found(spark):
    words = ["проверяет", "каталоги", "сообщений", "прежний", "итоговый", "значения", "перезапускаетсообщенияоченьдлинныхкаталогов"]
    wrong = [w.encode("koi8_r").decode("cp1251") for w in words]
    others = ["короткий", "список", "отчёты", "проверки", "файлов", "каталога"]
    rows = [("commit", i, f"s{i % 9}", None, words[:6] if i < 20 else others) for i in range(60)] + [("commit", 100 + i, "bad", None, wrong) for i in range(30)]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id long, source string, hard string, words array<string>")
    got = garbled.learned(df).collect()
    assert {r["rec_id"] for r in got} == set(range(100, 130))
    assert {(x["word"], x["restored"]) for r in got for x in r["words"]} == set(zip(wrong, words))


def test_letters_beyond_the_code_pages_are_learned(spark):
    words = ["проверяет", "каталоги", "сообщений", "прежний", "итоговый", "значения", "передача", "параметры", "программа", "просмотр", "порядок"]
    sound = [("commit", i, "s", None, words) for i in range(80)]
    # a page that differs from the published one in a letter: its users wrote another sign for it
    wrong = [w.replace("р", "э").encode("koi8_r").decode("cp1251") for w in words]
    df = spark.createDataFrame(sound + [("commit", 500 + i, "bad", None, wrong) for i in range(30)], "rec_kind string, rec_id long, source string, hard string, words array<string>")
    got = garbled.learned(df).collect()
    assert {r["rec_id"] for r in got} == set(range(500, 530))
    restored = {x["word"]: x["restored"] for x in got[0]["words"]}
    assert restored[wrong[0]] == words[0] and restored[wrong[10]] == words[10]
    assert garbled.hard("é" * 50)["words"] == ["é" * 50]


def test_damaged_records_come_with_their_text(spark, tmp_path):
    words = "проверяет каталоги сообщений прежний итоговый значения"
    swapped, misread = "the text: " + words.encode("koi8_r").decode("cp1251"), "l’été".encode().decode("cp1252")
    commits = [(i, "s", words) for i in range(60)] + [(98, "s", swapped), (99, "s", misread)]
    spark.createDataFrame(commits, "commit_id long, project string, source string").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([(1, "s", bytearray(misread.encode()))] * 2, "file_id long, project string, bytes binary").write.parquet(f"{tmp_path}/files.parquet")
    got = sorted((r["rec_kind"], r["rec_id"], r["restored"]) for r in garbled.p6_damage(spark, str(tmp_path)).collect())
    assert got == [("commit", 98, "the text: " + words), ("commit", 99, "l’été"), ("file", 1, "l’été")]


def test_packing_holds_every_token(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 5, 10, 11, 25, 100, 3, 3, 7])], "doc_id long, n_tokens long")
    got = packing.pack(sizes, {"ten": 10, "none": 0}).collect()
    assert {r["profile"] for r in got} == {"ten"}
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["n_tokens"]
        by_bin[r["container_id"]] = by_bin.get(r["container_id"], 0) + r["n_tokens"]
    assert by_doc == {i: n for i, n in enumerate([0, 1, 5, 10, 11, 25, 100, 3, 3, 7])}
    assert max(by_bin.values()) <= 10
    assert all(sum(1 for r in got if r["doc_id"] == i) == 1 for i in (0, 1, 2, 3, 7, 8, 9))


def test_mix_meets_the_shares(spark):
    import random

    r = random.Random(5)
    rows = [(i, "ab"[i % 2], r.randrange(1, 400)) for i in range(4000)] + [(9000 + i, "c", 50) for i in range(40)] + [(9900, None, 5), (9901, "x", 5), (9902, "a", 0)]
    want = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 4), "gone": (0.1, 3)}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), want).collect()
    total = sum(x["copies"] * x["n_tokens"] for x in got)
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert sum(x["copies"] * x["n_tokens"] for x in got if x["source"] == s) / total == pytest.approx(share, abs=0.004)
        assert max(x["copies"] for x in got if x["source"] == s) <= want[s][1]
    assert not {x["doc_id"] for x in got} & {9900, 9901, 9902}
    for s in "ab":  # tilted by length, and by length only
        rates = dict(sorted((x["n_tokens"], x["rate"]) for x in got if x["source"] == s))
        assert len({round(v, 9) for v in rates.values()}) > 100
        order = list(rates.values())
        assert order == sorted(order) or order == sorted(order, reverse=True)


def test_languages_of_a_table(spark):
    df = spark.createDataFrame([(1, "# The box is in the house.\n# It is for the end of that.\n", "python", "a.py"), (2, None, None, None)], "id long, source string, code_lang string, path string")
    got = code_language.file_languages(df, WORDS).select("id", F.size("languages").alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {1: 1, 2: 0}


def test_the_models_decide_on_pages(spark):
    import random

    r = random.Random(4)
    nouns = "reader parser cache index log table branch module key row".split()
    prose = [" ".join(f"The {r.choice(nouns)} of the {r.choice(nouns)} is in a {r.choice(nouns)} that is for the {r.choice(nouns)}." for _ in range(12)) for _ in range(150)]
    stuffed = [" ".join(r.choice(("cheap", "buy", "free", "best", *nouns)) for _ in range(80)) for _ in range(20)]
    short = ["buy cheap, buy free, buy best"] * 3  # too few words for the deviation of function words, and a stub
    pages = [(i, t) for i, t in enumerate([*prose, *stuffed, *short, None, ""])]
    got = {x["id"]: x for x in spam.spam_pages(spark.createDataFrame(pages, "id long, text string"), WORDS, "id").collect()}
    assert {i for i, x in got.items() if x["spam"]} == set(range(150, 170))
    assert all(got[i]["prose_perplexity"] > got[i]["other_perplexity"] for i in range(150, 170))
    link = "[" + "word " * 60 + "](http://x.example/y)"
    assert spam.TOKEN.findall(link) == [link]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_found")])
def test_results_do_not_depend_on_partitions(spark, name):
    first = sorted(map(str, QUERIES[name](spark, SMALL).collect()))
    assert len(first) == len(set(first))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, QUERIES[name](spark, SMALL).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
