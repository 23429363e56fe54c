"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong spans are assignments to credential names, access identifiers and long hexadecimal runs. Weak candidates -- an
account name, a bare mixed token of 32 to 128 characters, an endpoint with a host -- say nothing by themselves; they
are reported when complementary parts lie in the same scope: an identifier (access id or account), a secret
(assignment, hexadecimal run or bare token) and, for an endpoint, both of them. A scope is SCOPE code points around a
span. Parts meet in an interval join on (row, bucket of SCOPE code points), as semi joins that never emit pairs.

Positions come from regular expressions that split a text into what lies between matches; a text that cannot hold a
kind is not split. Folds over matches go by chunks, so that their time grows with the number of matches and not with its
square; no pattern repeats a group, so none needs a stack that grows with the text. Code points, end exclusive.

Rows: a null or empty text has no spans; texts of any length are scanned whole; rows that repeat a doc_id are scanned
each, rows of equal doc_id and text get equal results; a null doc_id is kept; an empty table gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ._common import written

SCOPE = 240
#: In listed order: kind, pattern of a match, cheap pattern that every text with a match also matches.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_LONG = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
#: Weak kinds.
_ACCOUNT = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,64}"""
_BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{0,127}[0-9])(?=[A-Za-z0-9+/_=-]{0,127}[a-z])(?=[A-Za-z0-9+/_=-]{0,127}[A-Z])[A-Za-z0-9+/_=-]{32,128}(?![A-Za-z0-9+/_=-])"
#: A host is at most 253 characters and ends in a letter or digit; after a name it needs a dot.
_ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]{0,252}[A-Za-z0-9](?::[0-9]{1,5})?|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{0,189}[A-Za-z0-9](?::[0-9]{1,5})?)"""
KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")
#: Items that a fold works through before it starts on a fresh list.
CHUNK = 128
_NO_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN = ["row_key", "start", "kind", "end"]


def _chunks(items: Column) -> Column:
    """The array cut into arrays of CHUNK items; an empty array is one empty chunk."""
    last = F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def _folded(items: Column, measure: Callable[[Column], Column], combine: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """fold(chunk, base) of all chunks, as one array; base combines measure(chunk) of the chunks before, from 0."""

    def based(chunks: Column) -> Column:
        return let(F.transform(chunks, measure), lambda m: F.flatten(F.transform(chunks, lambda c, i: fold(c, F.aggregate(F.slice(m, F.lit(1), i), F.lit(0), combine)))))

    return let(items, lambda bound: let(_chunks(bound), based))


def _spans(text: Column, kind: int, pattern: str, drop_short: str | None = None) -> Column:
    """array<struct<start, kind, end>> of the non-overlapping matches of a pattern, leftmost first."""
    step = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    width = lambda item: item["gap"] + F.coalesce(F.length(item["match"]), F.lit(0))
    empty = F.array().cast(_NO_SPANS)

    def add(state: Column, item: Column) -> Column:
        begin, end = state["at"] + item["gap"], state["at"] + width(item)
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        good = item["match"].isNotNull() if drop_short is None else F.coalesce(item["match"].rlike(drop_short), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    def fold(chunk: Column, base: Column) -> Column:
        return F.aggregate(chunk, F.struct(base.alias("at"), empty.alias("found")), add, lambda state: state["found"])

    spans = _folded(step, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, item: n + width(item)), lambda a, b: a + b, fold)
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def row_key() -> Column:
    """Rows of the same doc_id and text are one; two independent hashes stand for them."""
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit(""))]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(*reversed(parts), F.lit(1)).alias("h2"))


def _strong(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, 0, _ASSIGN, _ASSIGN_LONG), _spans(text, 1, _ACCESS), _spans(text, 2, _HEX)))


def _weak(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, 3, _ACCOUNT), _spans(text, 4, _BARE), _spans(text, 5, _ENDPOINT)))


def strong_and_weak(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, strong and weak spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", row_key().alias("row_key"), _strong(F.col("text")).alias("strong"), _weak(F.col("text")).alias("weak"))


def linked_spans(found: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """row_key, linked: the weak spans of a row whose complement is near. found: row_key, strong, weak."""
    some = found.where(F.size("weak") > 0)
    exploded = lambda spans: some.select("row_key", F.explode(spans).alias("s")).select("row_key", "s.*").distinct()
    strong, weak = exploded("strong"), exploded("weak")

    def placed(spans: DataFrame, margin: int) -> DataFrame:
        """A row for each bucket of `scope` code points that a span, with a margin, touches."""
        low, high = F.greatest(F.col("start") - margin, F.lit(0)), F.col("end") + margin
        return spans.withColumn("b", F.explode(F.sequence((low / scope).cast("int"), (high / scope).cast("int"))))

    def near(spans: DataFrame, others: DataFrame, margin: int) -> DataFrame:
        """Those of spans that have one of others within the margin (0: that share a code point)."""
        o = placed(others, 0).select(F.col("row_key").alias("o_key"), F.col("b").alias("o_b"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
        close = (F.col("o_start") <= F.col("end") + margin) & (F.col("o_end") >= F.col("start") - margin) if margin else (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
        return placed(spans, margin).join(o, (F.col("row_key") == F.col("o_key")) & (F.col("b") == F.col("o_b")) & close, "left_semi").select(*_SPAN).distinct()

    # Weak spans that lie in a strong one add nothing.
    own = weak.join(near(weak, strong, 0), _SPAN, "left_anti")
    parts = strong.unionByName(own)
    ids, keys = parts.where(F.col("kind").isin(1, 3)), parts.where(F.col("kind").isin(0, 2, 4))
    accounts, bare, ends = near(own.where("kind = 3"), keys, scope), near(own.where("kind = 4"), ids, scope), own.where("kind = 5")
    both = near(near(ends, ids, scope), keys, scope)
    return accounts.union(bare).union(both).groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """doc_id, row_key, n_assign, n_access, n_hex, base (the strong spans), all_spans (with the weak ones that are linked);
    spans are array<struct<start, kind, end>>, kind numbering KINDS."""
    found = written(strong_and_weak(docs))
    joined = found.join(linked_spans(found, scope=scope), "row_key", "left")
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long")
    linked = F.coalesce("linked", F.array().cast(_NO_SPANS))
    return joined.select("doc_id", "row_key", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.col("strong").alias("base"), F.array_sort(F.concat("strong", linked)).alias("all_spans"))


def render(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span (sorted by start; where spans overlap, the whole they cover) replaced by a mark."""
    reach = lambda chunk: F.aggregate(chunk, F.lit(0), lambda at, s: F.greatest(at, s["end"]))

    def fold(chunk: Column, base: Column) -> Column:
        # Positions are taken in the part of the text that the chunk covers.
        def cut(own: Column) -> Column:
            def add(state: Column, s: Column) -> Column:
                fresh = F.concat(state["out"], F.array(F.substr(own, state["at"] - base + 1, s["start"] - state["at"]), F.lit(mark)))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

            return F.aggregate(chunk, F.struct(base.alias("at"), F.array().cast("array<string>").alias("out")), add, lambda state: state["out"])

        return let(F.substr(text, base + 1, F.greatest(reach(chunk) - base, F.lit(0))), cut)

    pieces = _folded(spans, reach, lambda a, b: F.greatest(a, b), fold)
    return F.concat(F.array_join(pieces, ""), F.substr(text, reach(spans) + 1))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every reported span of their texts replaced by a mark. Only rows with a weak candidate are shuffled."""
    text = F.coalesce("text", F.lit(""))
    marked = written(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), row_key().alias("row_key"), _strong(text).alias("strong"), _weak(text).alias("weak")))
    sure = marked.where(F.size("weak") == 0).select("doc", F.col("strong").alias("spans"))
    linked = F.coalesce("linked", F.array().cast(_NO_SPANS))
    open_ = marked.where(F.size("weak") > 0).join(linked_spans(marked), "row_key", "left").select("doc", F.array_sort(F.concat("strong", linked)).alias("spans"))
    clean = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(redact(F.col("doc.text"), F.col("spans")))
    return sure.unionByName(open_).select(*[clean.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
