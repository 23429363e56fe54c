"""Transcript text queries over documents and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import export, text
from ..operators import transcripts
from ..sources.shared import kept
from . import bindings as b
from .registry import query

E = b.TEXTS_SQL


def _rx(expression: str, *rules: tuple[str, str]) -> str:
    """Nested regexp_replace calls; Java's $1 is \\1 in RE2."""
    return b.unguarded(_replaced(b.guarded(expression), *rules))


def _replaced(expression: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("'", "''")
        expression = f"regexp_replace({expression}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return expression


def _spacing(e: str) -> str:
    spaced = _replaced(e, (r"\s+", " "), (r"^\s+|\s+$", ""))
    return _replaced(spaced, (r"\s+([,.;:!?])", "$1"), (r"""([,.;:!?])([^\s"')\]])""", "$1 $2"), (r"[!?]+([!?])", "$1"), (r"\.{2,}", "."), (r"^\s+|\s+$", ""))


NORMAL_SQL = f"normal AS (SELECT doc_id, line_no, line, {_spacing('line')} AS s FROM lines)"


def _per_line(spark: SparkSession, d: str, f: Callable[[Column], Column]) -> DataFrame:
    return b.text_lines(spark, d).select("doc_id", "line_no", f(F.col("line")).alias("s"))


@query("SELECT doc_id, line_no, line FROM lines", E)
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """T01, T02."""
    return b.text_lines(spark, d)


@query("SELECT doc_id, line_no, s FROM normal", E, NORMAL_SQL)
def normalized_spacing(spark: SparkSession, d: str) -> DataFrame:
    """T03."""
    return _per_line(spark, d, text.normalize_spacing)


CONTRACTION_RULES = [(rf"(?i)\b{w}\b", f) for w, f in text.CONTRACTIONS.items()] + [(r"\bi\b", "I")]


@query(f"SELECT doc_id, line_no, {_rx('line', *CONTRACTION_RULES, *((f'(?i){p}', r) for p, r in text.TITLES))} AS s FROM lines", E)
def contractions_and_titles(spark: SparkSession, d: str) -> DataFrame:
    """T04, T05."""
    return _per_line(spark, d, lambda c: text.fix_titles(text.expand_contractions(c)))


#: Phrases take the place of frequent words, so that the rules have work on any text.
PLANTS = (("this", "showing you this document what is this"), ("with", "yes sir with"), ("are", "for the defendant your honor"), ("was", "madam witness and my age is"), ("from", "people of the philippines on friday"), ("by", "no your honor"))
PLANT_RULES = [(rf"\b{w}\b", p) for w, p in PLANTS]


def _planted(c: Column) -> Column:
    for word, to in PLANTS:
        c = text.let(c, _plant(word, to))
    return c


def _plant(word: str, to: str) -> Callable[[Column], Column]:
    return lambda c: F.when(F.contains(c, F.lit(word)), F.regexp_replace(c, rf"\b{word}\b", to)).otherwise(c)


@query(f"SELECT doc_id, line_no, {_rx('line', *PLANT_RULES, *((f'(?i){p}', r) for p, r in text.LEGAL_PHRASES))} AS s FROM lines", E)
def legal_phrases(spark: SparkSession, d: str) -> DataFrame:
    """T06."""
    return _per_line(spark, d, lambda c: text.fix_legal_phrases(_planted(c)))


@query(f"SELECT doc_id, line_no, {_rx('line', *PLANT_RULES, *((f'(?i){p}', r) for p, r in text.LEGAL_PHRASES), *((p if case else f'(?i){p}', r) for case, p, r in text.COMMA_RULES))} AS s FROM lines", E)
def comma_rules(spark: SparkSession, d: str) -> DataFrame:
    """T07."""
    return _per_line(spark, d, lambda c: text.insert_commas(text.fix_legal_phrases(_planted(c))))


@query()
def repeated_words_dropped(spark: SparkSession, d: str) -> DataFrame:
    """T08."""
    lines = transcripts.number_lines(b.table(spark, d, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "line_no", text.drop_repeated_words(F.col("line")).alias("s"))


CAPITAL_SQL = """parts AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[^.!?]*[.!?]|[^.!?]+$')) AS p, generate_subscripts(regexp_extract_all(line, '[^.!?]*[.!?]|[^.!?]+$'), 1) AS i FROM lines),
ups AS (SELECT doc_id, line_no, i, length(regexp_extract(p, '^(\\P{L}*)', 1)) AS k, p FROM parts)"""


@query("SELECT doc_id, line_no, string_agg(p[1:k] || upper(p[k+1:k+1]) || p[k+2:], '' ORDER BY i) AS s FROM ups GROUP BY ALL", E, CAPITAL_SQL)
def capitalized_sentences(spark: SparkSession, d: str) -> DataFrame:
    """T09."""
    return _per_line(spark, d, text.capitalize_sentences)


STARTERS = ", ".join(f"'{w}'" for w in text.QUESTION_STARTERS)
FIRST_SQL = "lower(regexp_extract(line, '^[\"''(\\[]*([A-Za-z]+)', 1))"
ENDED_SQL = f"""ended AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[.!?]$') THEN line WHEN {FIRST_SQL} IN ({STARTERS}) THEN line || '?' ELSE line || '.' END AS line FROM (SELECT doc_id, line_no, regexp_replace(line, '[.]$', '') AS line FROM lines))"""


@query("SELECT doc_id, line_no, line AS s FROM ended", E, ENDED_SQL)
def ended_sentences(spark: SparkSession, d: str) -> DataFrame:
    """T10."""
    return _per_line(spark, d, lambda c: text.end_sentence(F.regexp_replace(c, r"[.]\z", "")))


ASKS_SQL = f"{FIRST_SQL} IN ({STARTERS}) OR regexp_matches({b.guarded('line')}, '(?i)\\bdo you swear\\b') OR regexp_matches({b.guarded('line')}, '(?i),\\s*({'|'.join(text.CLAUSE_QUESTIONS)})\\b.+$')"
ASKED_SQL = f"asked AS (SELECT doc_id, line_no, CASE WHEN {ASKS_SQL} THEN regexp_replace(line, '[.!?]+$', '') || '?' ELSE line END AS s FROM lines)"


@query("SELECT doc_id, line_no, s FROM asked", E, ASKED_SQL)
def fixed_questions(spark: SparkSession, d: str) -> DataFrame:
    """T11."""
    return _per_line(spark, d, text.fix_questions)


ADDRESS_RULES = ((r"\bYour Honor,?\.$", "Your Honor."), (r"\b(Yes|No), sir\?$", "$1, sir."), (r"\b(Yes|No), Your Honor\?$", "$1, Your Honor."))


@query(
    f"""SELECT doc_id, line_no, {_rx("s", *ADDRESS_RULES)} AS s FROM (SELECT doc_id, line_no, line || CASE line_no % 3 WHEN 0 THEN ' Your Honor,.' WHEN 1 THEN ' Yes, sir?' ELSE ' No, Your Honor?' END AS s FROM lines)""", E,
)
def direct_address(spark: SparkSession, d: str) -> DataFrame:
    """T12."""
    ends = F.when(F.col("line_no") % 3 == 0, " Your Honor,.").when(F.col("line_no") % 3 == 1, " Yes, sir?").otherwise(" No, Your Honor?")
    return b.text_lines(spark, d).select("doc_id", "line_no", text.fix_direct_address(F.concat("line", ends)).alias("s"))


# Speakers: conversations -----------------------------------------------------------------------------------------
ROLES = {"user": "WITNESS", "assistant": "PROSECUTOR", "system": "- Court:"}
TURNS_SQL = """turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'WITNESS' WHEN 'assistant' THEN 'PROSECUTOR' WHEN 'system' THEN '- Court:' ELSE 'Bailiff:' END || ' ' || text AS t FROM conversations),
docs AS (SELECT conv_id AS doc_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM cut WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '' AND NOT regexp_matches(raw, '(?i)^\\s*page\\s+([a-z]+|\\d+)\\s*$'))"""
_ALIASES = [(s, a) for s, aliases in text.SPEAKERS for a in aliases]
SPOKEN_SQL = (
    f"clean AS (SELECT doc_id, line_no, line, {b.guarded('c')} AS g, c FROM (SELECT doc_id, line_no, line, regexp_replace({_spacing('line')}, '^\\s*[-+=>]+\\s*', '') AS c FROM lines)),\nspoken AS (SELECT doc_id, line_no, line, CASE "
    + " ".join(f"WHEN regexp_matches(g, '(?i)^{a}\\b') THEN '{s}'" for s, a in _ALIASES)
    + " WHEN regexp_matches(c, '^([A-Za-z ]{2,32})\\s*:\\s*(.*)$') THEN upper(trim(regexp_extract(c, '^([A-Za-z ]{2,32})\\s*:\\s*(.*)$', 1))) ELSE '' END AS who, CASE "
    + " ".join(f"WHEN regexp_matches(g, '(?i)^{a}\\b') THEN trim(regexp_replace(c, '(?i)^{a}\\b\\s*:?\\s*', ''), ' :-')" for s, a in _ALIASES)
    + " WHEN regexp_matches(c, '^([A-Za-z ]{2,32})\\s*:\\s*(.*)$') THEN trim(regexp_extract(c, '^([A-Za-z ]{2,32})\\s*:\\s*(.*)$', 2)) ELSE line END AS utterance FROM clean)"
)
BLOCKS_SQL = """blocks AS (SELECT doc_id, line_no, who <> '' AS opens, coalesce(last_value(nullif(who, '') IGNORE NULLS) OVER w, '') AS speaker, sum((who <> '')::BIGINT) OVER w AS block_id, utterance FROM spoken WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as texts."""
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role")), F.lit("Bailiff:"))
    turns = b.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.concat(role, F.lit(" "), "text").alias("t")).alias("s"))
    return turns.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("text"))


@query("SELECT doc_id, line_no, opens, speaker, block_id::BIGINT AS block_id, utterance FROM blocks", TURNS_SQL, SPOKEN_SQL, BLOCKS_SQL)
def speaker_blocks(spark: SparkSession, d: str) -> DataFrame:
    """T13, W05."""
    return transcripts.speaker_blocks(transcripts.number_lines(_turns(spark, d))).drop("line")


@query("SELECT doc_id, speaker, block_id::BIGINT AS block_id, count(*) AS lines, sum(length(utterance))::BIGINT AS chars FROM blocks GROUP BY ALL", TURNS_SQL, SPOKEN_SQL, BLOCKS_SQL)
def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    """T17 (the blocks that are rendered)."""
    blocks = transcripts.speaker_blocks(transcripts.number_lines(_turns(spark, d)))
    return blocks.groupBy("doc_id", "speaker", "block_id").agg(F.count("*").alias("lines"), F.sum(F.length("utterance")).alias("chars"))


@query()
def structured_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The formatter on conversations."""
    return transcripts.structure_transcripts(_turns(spark, d)).select("doc_id", "transcript")


@query()
def structured_twice(spark: SparkSession, d: str) -> DataFrame:
    """T18 on its own output, as stored text is formatted again."""
    once = kept(transcripts.structure_transcripts(_turns(spark, d)).select("doc_id", F.col("transcript").alias("text")), "once")
    return transcripts.structure_transcripts(once).select("doc_id", "transcript")


WRAP_SQL = """words AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM lines),
folded AS (SELECT doc_id, line_no, list_reduce(w, lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 76 THEN a || ' ' || x ELSE a || chr(10) || x END) AS s FROM words)"""


@query("SELECT doc_id, line_no, s FROM folded", E, WRAP_SQL)
def wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """T16."""
    return _per_line(spark, d, lambda c: F.array_join(text.wrap_words(c), "\n"))


@query(
    """SELECT doc_id, line_no, (line_no - 1) // 45 + 2 AS page_no, (line_no - 1) % 45 + 1 AS row_on_page, ceil(max(line_no) OVER (PARTITION BY doc_id) / 45.0)::BIGINT + 2 AS total_pages FROM lines""", E,
)
def paginated_lines(spark: SparkSession, d: str) -> DataFrame:
    """W17."""
    return transcripts.paginate(b.text_lines(spark, d), "doc_id").select("doc_id", "line_no", F.col("page_no").cast("long").alias("page_no"), F.col("row_on_page").cast("long").alias("row_on_page"), "total_pages")


def _case_fields(docs: DataFrame) -> DataFrame:
    given = {"complainant": F.concat(F.lit("Party "), F.col("doc_id")), "accused": F.lit("A. Person"), "hearing_date": F.lit("January 05, 2024"), "order_text": F.when(F.col("doc_id") % 2 == 0, "Granted"), "court_stenographer": F.lit("S. Writer")}
    return docs.select("doc_id", *[export.case_field(given.get(f, F.lit(None).cast("string")), f).alias(f) for f in export.CASE_FIELDS])


@query()
def exported_pages(spark: SparkSession, d: str) -> DataFrame:
    """Front page, body pages and certification page of each conversation."""
    docs = _turns(spark, d)
    made = kept(transcripts.structure_transcripts(docs).select("doc_id", "transcript"), "transcripts")
    return transcripts.export_lines(made, _case_fields(made), "doc_id")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, round(greatest(3.0, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 150.0::DOUBLE * 60), 4) AS seconds FROM texts", E)
def speaking_time(spark: SparkSession, d: str) -> DataFrame:
    """F17."""
    return b.texts(spark, d).select("doc_id", transcripts.word_count(F.col("text")).cast("long").alias("words"), F.round(transcripts.speaking_seconds(F.col("text")), 4).alias("seconds"))


@query("SELECT doc_id, line_no, array_to_string(w, ' ') AS s FROM lw", E, b.VOCABULARY_SQL)
def cleaned_words(spark: SparkSession, d: str) -> DataFrame:
    """T25."""
    return _per_line(spark, d, lambda c: F.array_join(text.clean_words(c), " "))
