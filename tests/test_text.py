"""Text rules against hand-made results and Python's own functions."""

import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import export, text
from quillmark.operators import transcripts


def apply(spark, rule, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", rule(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_spacing(spark):
    assert apply(spark, text.normalize_spacing, "3.14", "a...", "hi!!", " a ,b ", "x.\"y\" (z).)", None) == ["3. 14", "a. .", "hi! !", "a, b", "x.\"y\" (z).)", None]


def test_contractions_and_titles(spark):
    assert apply(spark, lambda c: text.fix_titles(text.expand_contractions(c)), "i dont know MR. smith", "Im here, the court", "idle ill") == ["I don't know Mr. smith", "I'm here, the Court", "idle I'll"]


def test_repeated_words(spark):
    got = apply(spark, text.drop_repeated_words, "the The court no no", "a'b a'b b", "Go go GO on on", "very very no yes yes", "the theory")
    assert got[0] == "the court no no" and got[2:] == ["Go on", "very very no yes yes", "the theory"]
    assert apply(spark, text.drop_repeated_words, *got) == got


def plain_repeats(value):
    """Repeats word by word with Python's engine, until nothing changes."""
    import re

    pattern = re.compile(r"\b([A-Za-z]+(?:'[A-Za-z]+)?)\b(?:\s+\b\1\b)+", re.I)
    while (new := pattern.sub(lambda m: m[0] if m[1].lower() in ("no", "yes", "very") else m[1], value)) != value:
        value = new
    return value


def test_repeated_words_equal_plain_repeats(spark):
    import random

    rng = random.Random(5)
    values = [" ".join(rng.choice(["a", "A", "a'b", "b", "no", "no's", "No", "yes", "é", "été", "aé"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    values += ["a a'b a'b a'b a b a'b", "no's no's", "no no no's no's", "very very VERY", "ab " * 20_000, "ab cd " * 20_000, "no " * 20_000, "éa éa", "x" * 300_000]
    assert apply(spark, text.drop_repeated_words, *values) == [plain_repeats(v) for v in values]


@pytest.mark.parametrize("unit", ["ab ", "!?", "i dont ", "my name is ", "a,", "yes sir ", "é ", "mr. ", "January x "])
def test_rules_take_long_lines(spark, unit):
    line = unit * (400_000 // len(unit))
    rules = [text.normalize_spacing, text.expand_contractions, text.fix_titles, text.fix_legal_phrases, text.drop_repeated_words, text.capitalize_sentences, text.end_sentence, text.fix_questions, text.fix_direct_address]
    for rule in rules:
        assert len(apply(spark, rule, line)) == 1


@pytest.mark.parametrize(
    ("rule", "before", "after"),
    [
        (text.expand_contractions, "Im sure it wasnt mine, alot", "I'm sure it wasn't mine, a lot"),
        (text.expand_contractions, "écant cante i é i", "écant cante I é I"),
        (text.fix_titles, "mr smith and MRS. jones saw dr lee before the court", "Mr. smith and Mrs. jones saw Dr. lee before the Court"),
        (text.fix_legal_phrases, "your honor on friday the people of the philippines", "Your Honor on Friday the People of the Philippines"),
        (text.fix_legal_phrases, "raise your right hand do you swear", "raise your right hand. Do you swear"),
        (text.insert_commas, "yes sir i did", "yes, sir, i did"),
        (text.insert_commas, "no Your Honor", "no, Your Honor"),
        (text.insert_commas, "please state your name age and residence", "please state your name, age, and residence"),
        (text.insert_commas, "correct but late", "correct, but late"),
        (text.end_sentence, "why me", "why me?"),
        (text.end_sentence, "été", "été."),
        (text.fix_questions, "Yes, who saw it.", "Yes, who saw it?"),
        (text.fix_direct_address, "No, Your Honor?", "No, Your Honor."),
    ],
)
def test_rules_by_hand(spark, rule, before, after):
    assert apply(spark, rule, before) == [after]


def test_capitals(spark):
    got = apply(spark, text.capitalize_sentences, "hello. (is it) ok? 3 yes", "", "...a", "élan! ß")
    assert got[:3] == ["Hello. (Is it) ok? 3 Yes", "", "...A"]
    assert apply(spark, text.capitalize_sentences, *got[:3]) == got[:3]


def test_sentence_ends(spark):
    assert apply(spark, text.end_sentence, "who is there", "(Did he", "yes", "done!", "  ") == ["who is there?", "(Did he?", "yes.", "done!", ""]
    assert apply(spark, text.fix_questions, "Do tell.", "Fine, what is it.", "I do you swear.", "Fine.") == ["Do tell?", "Fine, what is it?", "I do you swear?", "Fine."]
    assert apply(spark, text.fix_direct_address, "Yes, Your Honor?", "Your Honor,.", "No, sir?") == ["Yes, Your Honor.", "Your Honor.", "No, sir."]


def test_speakers(spark):
    got = apply(spark, text.speaker_and_utterance, "Court is adjourned", "=> defense: objection", "Bailiff : all rise", "just words", "interpreter- yes")
    assert [tuple(r) for r in got] == [("COURT", "is adjourned"), ("DEFENSE COUNSEL", "objection"), ("BAILIFF", "all rise"), ("", "just words"), ("COURT INTERPRETER", "yes")]


def test_cleaned_words(spark):
    assert apply(spark, text.clean_words, "COURT: Don't move!", "'' a_b", "well-known", "café-bar", "a,b", "'tis 'quoted' --", "x\u00a0y 3.5%", "") == [
        ["court", "don't", "move"], ["a_b"], ["well", "known"], ["caf", "bar"], ["a", "b"], ["tis", "quoted"], ["x", "y", "3", "5"], [],
    ]


def test_interpreter_dates(spark):
    split = lambda speaker: lambda c: text.split_interpreter_date(c, F.lit(speaker))
    assert apply(spark, split("COURT INTERPRETER"), "January x xxxx he came") == [["January X, XXXX", "He came"]]
    assert apply(spark, split("WITNESS"), "January x xxxx he came") == [["January x xxxx he came"]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=12), max_size=30), min_size=8, max_size=8))
def test_wrap_equals_textwrap(spark, lists):
    texts = [" ".join(words) for words in lists]
    want = [textwrap.wrap(t, width=20, break_long_words=False, break_on_hyphens=False) or [t] for t in texts]
    assert apply(spark, lambda c: text.wrap_words(c, 20), *texts) == want


@pytest.mark.parametrize("width", [7, 8])
def test_centering_equals_str_center(spark, width):
    words = ["", "a", "ab", "abc", "abcd", "abcdefghij"]
    assert apply(spark, lambda c: export.center(c, width), *words) == [w.center(width) for w in words]


def test_export_helpers(spark):
    assert apply(spark, export.display_date, "2024-01-05", "soon", None, "2024-13-05") == ["January 05, 2024", "soon", "", "2024-13-05"]
    assert apply(spark, export.display_time, "14:05", "09:30", "noon", "00:10") == ["2:05", "9:30", "noon", "12:10"]
    assert apply(spark, export.file_slug, "a b--c", "__", None, "Été 1") == ["a_b_c", "transcript", "transcript", "Été_1"]
    assert apply(spark, export.normalize_case_no, "CC-2026/001", None) == ["cc2026001", ""]
    assert apply(spark, lambda c: export.left_right(c, F.lit("right"), 12), "left", "much too long") == ["left   right", "much too long right"]
    assert apply(spark, lambda c: export.blank_or_value(c, 3), " ", "x ", None) == ["___", "x", "___"]
    assert apply(spark, lambda c: export.wrap_line(c, 20, 4), "short", "", "long words that do not fit at all") == [["    short"], [""], textwrap.wrap("long words that do not fit at all", 20, initial_indent="    ", subsequent_indent="    ")]


TRANSCRIPT = "\r\npage 3\nhello there\r\ncourt: is it true\nyes sir i dont know the the answer\n\nWitness\nClerk: " + "word " * 30
FORMATTED = "Hello there.\nCOURT:\nIs it true?\nYes, sir, I don't know the answer.\nWITNESS:\nCLERK:\n" + "\n".join(textwrap.wrap(("word " * 30).strip().capitalize() + ".", 76))


def test_whole_transcripts(spark):
    plain = TRANSCRIPT.replace("word " * 30, "alpha beta gamma " * 10)
    want = FORMATTED[: FORMATTED.index("Word")] + "\n".join(textwrap.wrap(("alpha beta gamma " * 10).strip().capitalize() + ".", 76))
    docs = spark.createDataFrame([(1, plain), (2, None), (3, " \n "), (4, "Court")], "doc_id long, text string")
    got = {r["doc_id"]: r["transcript"] for r in transcripts.structure_transcripts(docs).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "COURT:"}


def test_exported_pages(spark):
    fields = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", *[F.lit("Granted" if f == "order_text" else d).alias(f) for f, d in export.CASE_FIELDS.items()])
    docs = spark.createDataFrame([(1, "COURT:\n" + "\n".join(f"line {i}" for i in range(60)) + "\nWITNESS:\nlast")], "doc_id long, transcript string")
    rows = transcripts.export_lines(docs, fields, "doc_id").orderBy("page_no", "line_no").collect()
    pages = {n: [r["text"] for r in rows if r["page_no"] == n] for n in range(1, 5)}
    assert len(rows) == sum(map(len, pages.values())) and pages[1][-1] == export.RULE
    assert pages[2][:7][5].startswith("Page 2 of 4") and len(pages[2]) == 8 + 45 and pages[2][8:10] == ["COURT:", "        line 0"]
    assert pages[3][-7:] == ["", "WITNESS:", "        last", "", "COURT:", "        Order. Granted. So Ordered.", export.RULE]
    assert pages[4][-1] == "         Stenographer"


def test_capitals_stay_one_letter(spark):
    rows = spark.createDataFrame([(1, "so. ßeta. ŉa! b"), (2, "ﬁn. ᾀx.")], "n int, s string")
    got = [r[0] for r in rows.select("n", text.capitalize_sentences(F.col("s")).alias("s")).orderBy("n").select("s").collect()]
    assert got == ["So. ẞeta. ŉa! B", "ﬁn. ᾈx."]


def test_rules_are_skipped_only_where_they_cannot_match(spark):
    rows = [text._needle(p) for p, _ in text.LEGAL_PHRASES] + [text._needle(p) for _, p, _ in text.COMMA_RULES]
    assert rows[0] == "honor" and text._needle(r"\bmr\b\.?") == "mr" and text._needle(r"\b(yes|no), sir\s+([a-z])") == "sir"
    lines = ["Dont and dont", "İM here, ıve", "hadnſt waſnt", "mr Smith, the COURT", "nothing", "", None]
    given = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    rules = [(rf"(?iU)\b{w}\b", f) for w, f in text.CONTRACTIONS.items()] + [(r"(?U)\bi\b", "I")] + [(f"(?iU){p}", r) for p, r in text.TITLES]
    both = given.select(text.fix_titles(text.expand_contractions(F.col("s"))).alias("a"), text._replace(F.col("s"), *rules).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[1].a != lines[1]
