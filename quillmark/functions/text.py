"""Transcript text as Column -> Column functions: spacing, wording, sentences, speakers, wrapping.

Patterns follow Java's syntax with Unicode classes ((?U)); word classes written [A-Za-z] stay ASCII. Null in, null out,
unless a function says otherwise. All run on the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
QUESTION_STARTERS = (
    "who", "what", "when", "where", "why", "how", "do", "does", "did", "is", "are", "was", "were", "can", "could",
    "would", "should", "will", "may", "shall", "have", "has", "had",
)
CONTRACTIONS = {
    "alot": "a lot", "cant": "can't", "couldnt": "couldn't", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hasnt": "hasn't", "havent": "haven't", "im": "I'm", "ive": "I've", "ill": "I'll", "id": "I'd",
    "isnt": "isn't", "shouldnt": "shouldn't", "thats": "that's", "theres": "there's", "theyre": "they're",
    "wasnt": "wasn't", "werent": "weren't", "whats": "what's", "wont": "won't", "wouldnt": "wouldn't",
    "youre": "you're",
}
REPEATS_ALLOWED = ("no", "yes", "very")
TITLES = ((r"\bmr\b\.?", "Mr."), (r"\bmrs\b\.?", "Mrs."), (r"\bms\b\.?", "Ms."), (r"\bdr\b\.?", "Dr."), (r"\bthe court\b", "the Court"))
SPEAKERS = (
    ("DEFENSE COUNSEL", ("defense counsel", "defense")),
    ("COURT INTERPRETER", ("court interpreter", "interpreter")),
    ("PROSECUTOR", ("prosecutor",)),
    ("WITNESS", ("witness",)),
    ("CLERK", ("clerk",)),
    ("COURT", ("court",)),
)
LEGAL_PHRASES = (
    (r"\byour honor\b", "Your Honor"),
    (r"\bpeople of the philippines\b", "People of the Philippines"),
    (r"\bphilippines\b", "Philippines"),
    (r"\bmadam witness\b", "madam witness"),
    (r"\bfriday\b", "Friday"),
    (r"\btuesday\b", "Tuesday"),
    (r"\bjanuary\b", "January"),
    (r"\braise your right hand\s+do you swear\b", "raise your right hand. Do you swear"),
    (r"\bshowing you this document\s+what is this\b", "showing you this document, what is this"),
    (r"\bcriminal case number ([a-z0-9]+)\s+People of the Philippines\b", "criminal case number $1, People of the Philippines"),
    (r"\bversus defendant\s+for hearing\b", "versus defendant, for hearing"),
)
#: (case matters, pattern, replacement) in order: later ones see the output of earlier ones.
COMMA_RULES = (
    (True, r"\bfor the defendant\s+Your Honor\b", "for the defendant, Your Honor"),
    (True, r"\bfor the prosecution\s+Your Honor\b", "for the prosecution, Your Honor"),
    (False, r"\b(yes|no)\s+sir\b", "$1, sir"),
    (False, r"\b(yes|no)\s+Your Honor\b", "$1, Your Honor"),
    (False, r"\b(yes|no), Your Honor\s+([a-z])", "$1, Your Honor, $2"),
    (False, r"\b(yes|no), sir\s+([a-z])", "$1, sir, $2"),
    (False, r"\bcorrect\s+but\b", "correct, but"),
    (False, r"\bmadam witness\s+([a-z])", "madam witness, $1"),
    (False, r"\bplease state your name\s+age\s+and residence\b", "please state your name, age, and residence"),
    (False, r"\bmy name is ([^,]+?)\s+my age is\b", "my name is $1, my age is"),
    (False, r"\bmy age is ([^,]+?)\s+and my residence\b", "my age is $1, and my residence"),
    (False, r"\btestimony\s+photographs\s+statement\s+and police report\b", "testimony, photographs, statement, and police report"),
    (False, r"\bphotographs\s+statement\s+and police report\b", "photographs, statement, and police report"),
)
CLAUSE_QUESTIONS = (
    "who", "what", "when", "where", "why", "how", "do", "does", "did", "is", "are", "was", "were", "can", "could",
    "would", "should",
)
LINE_WIDTH = 76
SPACE_BEFORE_MARK = r"(?U)\s+([,.;:!?])"
NO_SPACE_AFTER_MARK = r"""(?U)([,.;:!?])([^\s"')\]])"""
MARK_RUNS = r"[!?]+([!?])"
PAGE_MARKER = r"(?iU)^\s*page\s+([a-z]+|\d+)\s*\z"
FIRST_WORD = r"""^["'(\[]*([A-Za-z]+)"""
REPEATED_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
OATH = r"(?iU)\bdo you swear\b"
DIRECT_ADDRESS = (
    (r"(?U)\bYour Honor,?\.\z", "Your Honor."),
    (r"(?U)\b(Yes|No), sir\?\z", "$1, sir."),
    (r"(?U)\b(Yes|No), Your Honor\?\z", "$1, Your Honor."),
)
#: Capitals of letters that upper() writes as several.
LONE_CAPITALS = {"\u00df": "\u1e9e", "\u1fb3": "\u1fbc", "\u1fc3": "\u1fcc", "\u1ff3": "\u1ffc"} | {chr(c): chr(c + 8) for row in (0x1F80, 0x1F90, 0x1FA0) for c in range(row, row + 8)}
#: Letters beyond ASCII that match one of its letters where case does not matter.
ODD_CASE = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}
INTERPRETER_DATE = r"(?U)^(January)\s+([xX]{1,2}|\d{1,2})\s+([xX]{4}|\d{4})\s+(.+)\z"
# -----------------------------------------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _replace(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def _needle(pattern: str) -> str:
    """The longest word, in lower case, that every match of a rule's pattern holds."""
    plain = re.sub(r"\([^)]*\)|\\.", " ", re.sub(r"\[[^\]]*\]", " ", pattern))
    return max(re.findall("[A-Za-z]+", plain), key=len).lower()


def _replace_words(text: Column, *rules: tuple[str, str, str]) -> Column:
    """Rules (flags, pattern, replacement) in order, each only on texts that hold its needle, as a search for bytes costs
    a fraction of a match. Rules may change the case of words and what is between them, and may part words, but
    write no word that another rule looks for, so the needles are looked for in the text as it was."""
    odd = lambda t: reduce(or_, [F.contains(t, F.lit(c)) for c in ODD_CASE])
    folded = lambda t: F.lower(F.when(odd(t), F.translate(t, "".join(ODD_CASE), "".join(ODD_CASE.values()))).otherwise(t))

    def once(low: Column, flags: str, pattern: str, to: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(low, F.lit(_needle(pattern))), F.regexp_replace(t, flags + pattern, to)).otherwise(t)

    return let(text, lambda t: let(folded(t), lambda low: reduce(lambda c, rule: let(c, once(low, *rule)), rules, t)))


def _replace_all(text: Column, *rules: tuple[str, str, str]) -> Column:
    """The same without the search: each guard is a lambda deeper, and a whole transcript's rules nest too deep for the
    planner's stack."""
    return _replace(text, *((flags + pattern, to) for flags, pattern, to in rules))


def text_lines(text: Column) -> Column:
    """array<string>: lines without surrounding white space, blank ones dropped; null gives an empty array."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    return F.filter(F.transform(lines, trim_spaces), lambda s: s != "")


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_page_marker(line: Column) -> Column:
    return line.rlike(PAGE_MARKER)


def normalize_spacing(text: Column) -> Column:
    """One space between words, none before ,.;:!? and one behind unless a space, quote or bracket follows; runs of
    marks that are left together are cut to one."""
    spaced = trim_spaces(F.regexp_replace(text, r"(?U)\s+", " "))
    marks = _replace(spaced, (SPACE_BEFORE_MARK, "$1"), (NO_SPACE_AFTER_MARK, "$1 $2"), (MARK_RUNS, "$1"), (r"\.{2,}", "."))
    return trim_spaces(marks)


def expand_contractions(text: Column, replace: Callable[..., Column] = _replace_words) -> Column:
    """Known words without their apostrophe get it; a lone i becomes I."""
    return replace(text, *(("(?iU)", rf"\b{word}\b", full) for word, full in CONTRACTIONS.items()), ("(?U)", r"\bi\b", "I"))


def fix_titles(text: Column, replace: Callable[..., Column] = _replace_words) -> Column:
    return replace(text, *(("(?iU)", p, r) for p, r in TITLES))


def fix_legal_phrases(text: Column, replace: Callable[..., Column] = _replace_words) -> Column:
    return replace(text, *(("(?iU)", p, r) for p, r in LEGAL_PHRASES))


def insert_commas(text: Column, replace: Callable[..., Column] = _replace_words) -> Column:
    return replace(text, *(("(?U)" if case else "(?iU)", p, r) for case, p, r in COMMA_RULES))


def drop_repeated_words(text: Column) -> Column:
    """Adjacent repeats of a word become its first occurrence, but for the words that may repeat, again and again until
    nothing changes. Repeats are matched possessively, so a long run of them needs no stack; a pass that changes a text
    takes a word away, so there are fewer passes than words, and passes after the last change do nothing."""
    word, again = rf"({REPEATED_WORD})\b", r"(?:\s++\b{}\b)++"
    pattern = rf"(?iU)\b(({'|'.join(REPEATS_ALLOWED)})\b{again.format(r'\2')})|\b{word}{again.format(r'\3')}"

    def once(state: Column, _: Column) -> Column:
        shorter = let(F.regexp_replace(state["text"], pattern, "$1$3"), lambda t: F.struct(t.alias("text"), F.coalesce(t == state["text"], F.lit(True)).alias("done")))
        return F.when(state["done"], state).otherwise(shorter)

    start = F.struct(text.alias("text"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.size(F.split(text, " "))), start, once, lambda state: state["text"])


def upper_letter(letter: Column) -> Column:
    """A letter in upper case as one letter: upper() writes some as several (SS), which becomes the upper-case letter of
    its own that there is, else the letter stays."""
    def single(upper: Column) -> Column:
        return F.when(F.length(upper) > 1, F.translate(letter, "".join(LONE_CAPITALS), "".join(LONE_CAPITALS.values()))).otherwise(upper)

    return let(F.upper(letter), single)


def capitalize_sentences(text: Column) -> Column:
    """The first letter of the text and the first after each .!? in upper case."""
    parts = F.split(text, r"(?<=[.!?])")

    def upper_first(part: Column) -> Column:
        before = F.regexp_extract(part, r"^(\P{L}*)", 1)
        letter = F.substring(part, F.length(before) + 1, F.lit(1))
        return F.concat(before, upper_letter(letter), F.substring(part, F.length(before) + 2, F.length(part)))

    return F.array_join(F.transform(parts, upper_first), "")


def first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, FIRST_WORD, 1))


def end_sentence(text: Column) -> Column:
    """A text without .!? at its end gets ? if its first word starts questions, else a full stop."""

    def end(bare: Column) -> Column:
        mark = F.when(first_word(bare).isin(*QUESTION_STARTERS), "?").otherwise(".")
        return F.when((bare == "") | bare.rlike(r"[.!?]\z"), bare).otherwise(F.concat(bare, mark))

    return let(F.regexp_replace(text, r"(?U)\s+\z", ""), end)


def fix_questions(text: Column) -> Column:
    """Texts that ask -- by their first word, an oath or a clause -- end in a question mark."""

    def fix(bare: Column) -> Column:
        clause = bare.rlike(rf"(?iU),\s*({'|'.join(CLAUSE_QUESTIONS)})\b.+$")
        asks = first_word(bare).isin(*QUESTION_STARTERS) | bare.rlike(OATH) | clause
        return F.when((bare != "") & asks, F.concat(F.regexp_replace(bare, r"[.!?]+\z", ""), F.lit("?"))).otherwise(bare)

    return let(F.regexp_replace(text, r"(?U)\s+\z", ""), fix)


def fix_direct_address(text: Column) -> Column:
    return _replace(text, *DIRECT_ADDRESS)


def speaker_and_utterance(line: Column) -> Column:
    """struct<speaker, utterance>: a known speaker's alias at the start (with or without a colon), else a label of
    letters before a colon, else no speaker."""
    def parse(clean: Column) -> Column:
        found = F.when(F.lit(False), F.struct(F.lit("").alias("speaker"), F.lit("").alias("utterance")))
        for speaker, aliases in SPEAKERS:
            for alias in aliases:
                pattern = rf"(?iU)^{alias}\b\s*:?\s*"
                rest = F.btrim(F.regexp_replace(clean, pattern, ""), F.lit(" :-"))
                found = found.when(clean.rlike(pattern), F.struct(F.lit(speaker).alias("speaker"), rest.alias("utterance")))
        label = r"^([A-Za-z ]{2,32})(?U)\s*:\s*(?-U)(.*)\z"
        named = F.struct(F.upper(F.btrim(F.regexp_extract(clean, label, 1))).alias("speaker"), trim_spaces(F.regexp_extract(clean, label, 2)).alias("utterance"))
        return found.when(clean.rlike(label), named).otherwise(F.struct(F.lit("").alias("speaker"), clean.alias("utterance")))

    return let(F.regexp_replace(normalize_spacing(line), r"(?U)^\s*[-+=>]+\s*", ""), parse)


def format_utterance(text: Column) -> Column:
    """All wording and sentence rules in order."""
    text = drop_repeated_words(fix_titles(expand_contractions(normalize_spacing(text), _replace_all), _replace_all))
    text = capitalize_sentences(insert_commas(fix_legal_phrases(text, _replace_all), _replace_all))
    return fix_direct_address(fix_questions(end_sentence(text)))


def split_interpreter_date(text: Column, speaker: Column) -> Column:
    """array<string>: an interpreter's January date and what follows it, or the text alone."""
    def split(t: Column) -> Column:
        date = F.concat(F.regexp_extract(t, INTERPRETER_DATE, 1), F.lit(" "), F.upper(F.regexp_extract(t, INTERPRETER_DATE, 2)), F.lit(", "), F.upper(F.regexp_extract(t, INTERPRETER_DATE, 3)))
        rest = capitalize_sentences(trim_spaces(F.regexp_extract(t, INTERPRETER_DATE, 4)))
        return F.when((speaker == "COURT INTERPRETER") & t.rlike(INTERPRETER_DATE), F.array(date, rest)).otherwise(F.array(t))

    return let(text, split)


def wrap_words(text: Column, width: int = LINE_WIDTH) -> Column:
    """array<string>: words filled greedily into lines of a width; longer words stand alone, none are broken."""
    words = F.filter(F.split(text, r"[\t\n\x0B\f\r ]+"), lambda w: w != "")

    def add(state: Column, word: Column) -> Column:
        fits = F.length(state["line"]) + F.length(word) < width
        longer = F.struct(state["lines"].alias("lines"), F.concat(state["line"], F.lit(" "), word).alias("line"))
        closed = F.struct(F.when(state["line"].isNull(), state["lines"]).otherwise(F.array_append(state["lines"], state["line"])).alias("lines"), word.alias("line"))
        return F.when(F.coalesce(fits, F.lit(False)), longer).otherwise(closed)

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))
    return F.aggregate(words, start, add, lambda s: F.when(s["line"].isNull(), F.array(text)).otherwise(F.array_append(s["lines"], s["line"])))


def utterance_lines(text: Column, speaker: Column, width: int = LINE_WIDTH) -> Column:
    """array<string>: an utterance formatted and wrapped; an empty one has no lines."""
    parts = split_interpreter_date(format_utterance(text), speaker)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(parts, lambda p: wrap_words(p, width))))


def clean_words(text: Column) -> Column:
    """array<string>: words in lower case of [A-Za-z0-9_'], with apostrophes at their ends stripped; any other characters
    part words. Texts are split at what parts words; [^A-Za-z0-9_'] says the same, but a class made of ranges takes Java's
    matcher ten times as long as one made of \\w."""
    # The two characters whose lower case begins with an ASCII letter are no letters of words.
    low = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")))
    bare = lambda w: F.when(F.startswith(w, F.lit("'")) | F.endswith(w, F.lit("'")), F.btrim(w, F.lit("'"))).otherwise(w)
    return F.filter(F.transform(F.split(low, r"[^\w']+"), bare), lambda w: w != "")
