"""Lines of exported transcripts: front pages, running headers, certifications and bodies, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import export
from ..operators import transcripts
from . import bindings as b
from .registry import query

W = export.PAGE_WIDTH

#: What is known of a case here; parties have names of many lengths, so that lines fit, just fit, and have to be wrapped.
CASES_SQL = b.METADATA_SQL + """,
cases AS (SELECT batch_id, CASE WHEN criminal_case_no = '' THEN '0000' ELSE criminal_case_no END AS case_no, CASE WHEN hearing_period = '' THEN 'afternoon' ELSE hearing_period END AS period, trim(court_stenographer) AS writer, trim(certifier_name) AS certifier,
  'Party ' || repeat('of ' || batch_id || ' ', batch_id::BIGINT % 7) || 'A' AS complainant, CASE WHEN batch_id::BIGINT % 3 = 0 THEN '' ELSE 'A. ' || repeat('x', batch_id::BIGINT % 41) END AS accused,
  CASE WHEN batch_id::BIGINT % 2 = 0 THEN 'January 05, 2024' ELSE '' END AS hearing_date, CASE WHEN batch_id::BIGINT % 5 = 0 THEN 'Pre-trial' ELSE '' END AS proceeding FROM meta)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("batch_id").cast("long")
    given: dict[str, Column] = {c: F.col(c) for c in ("criminal_case_no", "hearing_period", "court_stenographer", "certifier_name")} | {
        "complainant": F.concat(F.lit("Party "), F.expr("repeat(concat('of ', batch_id, ' '), cast(batch_id % 7 AS int))"), F.lit("A")),
        "accused": F.when(key % 3 != 0, F.concat(F.lit("A. "), F.expr("repeat('x', cast(batch_id % 41 AS int))"))),
        "hearing_date": F.when(key % 2 == 0, "January 05, 2024"), "proceeding": F.when(key % 5 == 0, "Pre-trial"),
    }
    none = F.lit(None).cast("string")
    return b.metadata(spark, d).select("batch_id", *[export.case_field(given.get(f, none), f).alias(f) for f in export.CASE_FIELDS])


def _held(expression: str, width: int) -> str:
    """SQL: the value without white space at its ends, or a line of underscores in its place."""
    return f"CASE WHEN trim({expression}) = '' THEN repeat('_', {width}) ELSE trim({expression}) END"


def _centre(expression: str, width: str = str(W)) -> str:
    spare = f"greatest({width} - length({expression}), 0)"
    left = f"({spare} // 2 + CASE WHEN {spare} % 2 = 1 AND {width} % 2 = 1 THEN 1 ELSE 0 END)"
    return f"repeat(' ', {left}) || {expression} || repeat(' ', {spare} - {left})"


def _ends(left: str, right: str) -> str:
    room = f"{W} - length({left}) - length({right})"
    return f"CASE WHEN {room} <= 1 THEN trim(({left}) || ' ' || ({right})) ELSE ({left}) || repeat(' ', greatest({room}, 0)) || ({right}) END"


def _filled(expression: str, width: int) -> str:
    """SQL: a text's words in lines of a width, a list."""
    words = f"list_filter(regexp_split_to_array({expression}, '[\\t\\n\\f\\r ]+'), lambda t: t <> '')"
    return f"string_split(list_reduce({words}, lambda a, t: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(t) <= {width} THEN a || ' ' || t ELSE a || chr(10) || t END), chr(10))"


def _listed(lines: list[str], source: str) -> str:
    """SQL: batch_id, line_no, text of one line a list entry."""
    return f"SELECT batch_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS text FROM (SELECT batch_id, [{', '.join(lines)}] AS l FROM {source})"


_HEADER = [
    "'TSN'", "'Criminal Case No. ' || case_no", f"({_held('complainant', 19)}) || ' vs. ' || ({_held('accused', 19)})", "'For: ' || repeat('_', 26)", "CASE WHEN proceeding = '' THEN 'Trial' ELSE proceeding END",
    _ends("'Page ' || page_no || ' of 9'", f"({_held('hearing_date', 14)})"), f"'{export.RULE}'",
]


@query(_listed(_HEADER, "(SELECT *, 2 + batch_id::BIGINT % 120 AS page_no FROM cases)"), CASES_SQL)
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header of a page of each case."""
    lines = export.page_header(F.col("batch_id").cast("long") % 120 + 2, F.lit(9))
    return _cases(spark, d).select("batch_id", F.posexplode(lines).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


_CERTIFIED = [f"'{export.RULE}'", "''", "'I HEREBY CERTIFY THAT THIS IS TRUE AND CORRECT TO THE BEST OF MY KNOWLEDGE AND BELIEF.'", "''", "''", "''", "'___    ' || CASE WHEN certifier <> '' THEN certifier ELSE writer END", "'         Stenographer'"]


@query(_listed(_CERTIFIED, "cases"), CASES_SQL)
def certifications(spark: SparkSession, d: str) -> DataFrame:
    """The certification of each case."""
    return _cases(spark, d).select("batch_id", F.posexplode(export.certification_page()).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def _signed(name: str, role: str) -> list[str]:
    return [_centre(name), _centre(f"'{role}'"), "''"]


_BLANK = "repeat('_', 28)"
_FRONT = [
    *[_centre("repeat('_', 36)")] * 4, _centre("('Email Add: ' || repeat('_', 28))"), _centre("('Mobile Number: ' || repeat('_', 16))"), "''",
    _ends("plaintiff", "'Criminal Case No. ' || case_no"), _ends(_centre("'- versus -'", "wide"), "'For: ' || repeat('_', 26)"), "''", "defendant", "repeat(' ', 12) || 'Accused.'", f"'{export.RULE}'", "''",
    _centre("'T R A N S C R I P T'"), "''",
    f"""'of the stenographic notes taken down by the undersigned during the ' || ({_held('proceeding', 18)}) || ' in the above-entitled case held on ' || ({_held('hearing_date', 14)}) || ' at ' || repeat('_', 8) || ' o''clock in the '
    || period || ' at the ' || repeat('_', 24) || ' before the ' || repeat('_', 24) || ', Presiding Judge.'""",
    "''", "'A P P E A R A N C E S:'", "''", *_signed(_BLANK, "Public Prosecutor"), *_signed(_BLANK, "Counsel for the Accused"), "'P R E S E N T:'", "''",
    *_signed(_BLANK, "Court Interpreter"), *_signed("writer", "Court Stenographer"), f"'{export.RULE}'",
]
FRONT_SQL = f"""sides AS (SELECT *, ({_held('complainant', 30)}) || ',' AS plaintiff, ({_held('accused', 30)}) || ',' AS defendant FROM cases),
front AS ({_listed(_FRONT, '(SELECT *, greatest(length(plaintiff), length(defendant), 34) AS wide FROM sides)')}),
filled AS (SELECT batch_id, line_no, CASE WHEN trim(text) = '' THEN [''] WHEN length(text) <= {W} THEN [text] ELSE {_filled('text', W)} END AS l FROM front),
flat AS (SELECT batch_id, line_no AS n, generate_subscripts(l, 1) AS k, unnest(l) AS text FROM filled)"""


@query("SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n, k) AS line_no, text FROM flat", CASES_SQL, FRONT_SQL)
def front_pages(spark: SparkSession, d: str) -> DataFrame:
    """The front page of each case, long lines wrapped."""
    return _cases(spark, d).select("batch_id", F.posexplode(export.front_page()).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


BODY_SQL = f"""turns AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN chr(10) ELSE '' END || upper(role) || ':' || chr(10) || text AS t FROM conversations),
bodies AS (SELECT conv_id, string_split(replace(replace(string_agg(t, chr(10) ORDER BY turn, t), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM turns GROUP BY conv_id),
raws AS (SELECT conv_id, generate_subscripts(p, 1) AS n, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS raw FROM bodies),
near AS (SELECT *, lag(raw) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM raws),
made AS (SELECT conv_id, n, CASE WHEN raw = '' THEN [''] WHEN regexp_matches(raw, '^[A-Z][A-Z ]{{1,32}}:$') THEN CASE WHEN before <> '' THEN ['', raw] ELSE [raw] END
  WHEN length(raw) <= {W - export.BODY_INDENT} THEN ['        ' || raw] ELSE list_transform({_filled('raw', W - 2 * export.BODY_INDENT)}, lambda s: '        ' || s) END AS l FROM near),
flat AS (SELECT conv_id, n, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM made)"""


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n, k) AS line_no, line FROM flat", BODY_SQL)
def wrapped_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts whose speakers stand on lines of their own, indented and wrapped."""
    said = F.concat(F.when(F.col("turn") % 3 == 0, "\n").otherwise(""), F.upper("role"), F.lit(":\n"), "text")
    turns = b.table(spark, d, "conversations").where(said.isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))).alias("s"))
    bodies = turns.select("conv_id", F.array_join(F.transform("s", lambda s: s["t"]), "\n").alias("transcript"))
    return transcripts.body_lines(bodies, "conv_id")
