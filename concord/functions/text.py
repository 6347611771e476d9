"""Text rules as Column expressions; all stay in the JVM except ``nfkc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token classes, the currency signs of a number, and the form of a number with its short unit.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[a-z]+|[가-힣]+"
CURRENCY = "₩$€¥£"
NUMBER_WITH_UNIT = rf"^\s*[{CURRENCY}]?\s*([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|[가-힣A-Za-z]{{1,3}})?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where the value is evaluated once, however often ``use`` names it: Spark repeats what is named several times
    inside of higher-order functions, and in filters that it pushes down."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Search tokens: numbers, Latin runs, Hangul runs; a Hangul run of 3 or more is followed by its bigrams."""
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    found = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    grown = lambda t: F.when(t.rlike("^[가-힣]{3,}$"), F.concat(F.array(t), pairs(t))).otherwise(F.array(t))
    # only texts with such a run are taken apart
    return F.when(lowered.rlike("[가-힣]{3}"), F.flatten(F.transform(found, grown))).otherwise(found)


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed (Unicode white space)."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def is_blank(text: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(_col(text), r"(?U)\s+", "") == "", F.lit(True))


def normalize_value(raw: Column | str) -> Column:
    """A number without currency, thousands commas and trailing zeros, with its short unit; other text collapsed."""
    s = collapse(F.coalesce(_col(raw), F.lit("")))
    pattern = NUMBER_WITH_UNIT
    number = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit(""))
    number = F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
    return F.when(s.rlike(pattern), F.concat(number, F.regexp_extract(s, pattern, 2))).otherwise(s)


def cell_text(value: Column | str) -> Column:
    """A double as cell text: null is empty, whole numbers have no point."""
    v = _col(value)
    return F.when(v.isNull(), "").when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def nfkc(name: Column) -> Column:
    """Unicode NFKC; Spark has no built-in for it.  A batch of nulls goes back as it came."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield a if a.null_count == len(a) else pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in a.to_pylist()], pa.string())

    return run(name)


def norm_name(name: Column | str) -> Column:
    """NFKC, lower case, only digits, Latin and Hangul.  ASCII and Hangul syllables are in that form already, so only names
    with other characters take their text through Python."""
    t = F.coalesce(_col(name), F.lit(""))
    folded = F.coalesce(nfkc(F.when(~t.rlike("^[\\x00-\\x7F가-힣]*$"), t)), t)
    return F.regexp_replace(F.lower(folded), "[^0-9a-z가-힣]", "")


def squeeze(text: Column | str) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", ""))


def slug(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"(?U)[^\w\-]", "_")


def truncate(text: Column | str, limit: int) -> Column:
    """Cut to ``limit`` characters, the last of which is an ellipsis."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def preview(text: Column | str, limit: int = 80) -> Column:
    """Collapsed and cut to ``limit`` characters, an ellipsis after them."""
    t = collapse(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def fold(text: Column | str, head: int = 2000, tail: int = 2000) -> Column:
    """Head and tail of a long text with the number of characters left out between them."""
    t = _col(text)
    cut = F.length(t) - (head + tail)
    return F.when(cut > 0, F.concat(F.substring(t, 1, head), F.lit("\n…("), cut.cast("string"), F.lit(")…\n"), F.right(t, F.lit(tail)))).otherwise(t)


def fingerprint(*parts: Column | str) -> Column:
    """First 12 hex digits of the SHA-1 of the parts, each ended by a NUL."""
    return F.substring(F.sha1(F.concat(*(x for p in parts for x in (F.coalesce(_col(p), F.lit("")), F.lit("\0"))))), 1, 12)


def chunks(text: Column | str, size: int = 800) -> Column:
    """Non-overlapping slices of ``size`` characters; a text no longer than that is one slice."""
    t = _col(text)
    count = F.greatest(F.lit(1), F.ceil(F.length(t) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * size + 1, F.lit(size)))


def column_letters(number: Column | str) -> Column:
    """1-based column number to letters (A, ..., Z, AA, ...)."""
    n = _col(number).cast("long")
    letters, first = [], 0
    for k in range(7):  # letter k from the right is there from 1 + 26 + ... + 26^k on
        first += 26**k
        letters.append(F.when(n >= first, F.chr(F.lit(65) + F.floor((n - first) / 26**k) % 26)).otherwise(""))
    return F.concat(*reversed(letters))


def column_number(letters: Column | str) -> Column:
    """Letters to the 1-based number; anything else sorts last."""
    c = F.upper(_col(letters))
    value = F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return F.when(c.rlike("^[A-Z]{1,6}$"), value).otherwise(F.lit(1_000_000_000))


def format_duration(ms: Column | str) -> Column:
    """Milliseconds for people: 850ms, 12.3s, 4m05s."""
    v = _col(ms)
    minutes = F.floor(v / 60000).cast("string")
    seconds = F.lpad((F.floor(v / 1000) % 60).cast("string"), 2, "0")
    tenths = F.concat(F.floor(v / 1000).cast("string"), F.lit("."), (F.floor(v / 100) % 10).cast("string"), F.lit("s"))
    return F.when(v < 1000, F.concat(v.cast("string"), F.lit("ms"))).when(v < 60000, tenths).otherwise(F.concat(minutes, F.lit("m"), seconds, F.lit("s")))


# Parts of an error's type and message that tell its class, in order of precedence.
ERROR_MARKS: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("length", ("length",), ("length limit", "context length")),
    ("timeout", ("timeout",), ("timed out", "timeout")),
    ("rate_limit", ("ratelimit",), ("rate limit", "429", "too many requests")),
)


def classify_error(kind: Column | str, message: Column | str) -> Column:
    """length, timeout, rate_limit or error, in this order of precedence."""
    k, m = F.lower(_col(kind)), F.lower(_col(message))
    has = lambda c, *words: F.coalesce(F.array_max(F.array(*(F.contains(c, F.lit(w)) for w in words))), F.lit(False))
    out = F
    for name, kinds, messages in ERROR_MARKS:
        out = out.when(has(k, *kinds) | has(m, *messages), name)
    return out.otherwise("error")


def search_text(*parts: Column) -> Column:
    """Distinct non-blank parts in order, joined by spaces."""
    kept = F.filter(F.transform(F.array(*parts), lambda p: collapse(p)), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(kept), " ")


# Words in a column header that name its role; roles are tried in this order.
ROLE_WORDS: dict[str, tuple[str, ...]] = {
    "quantitative_lower_bound": ("하한치", "하한값", "하한", "최소값", "최소", "min", "lower", "lsl"),
    "quantitative_upper_bound": ("상한치", "상한값", "상한", "최대값", "최대", "max", "upper", "usl"),
    "quantitative_target": ("중심치", "중심", "기준값", "기준", "표준값", "target", "nominal", "typ", "center"),
    "unit": ("단위", "unit", "uom"),
    "quantitative_value": ("정격", "규격값", "측정값", "실측값", "설계값", "정격값"),
    "entity_subcategory": ("중분류", "소분류", "subcategory", "subcat"),
    "entity_category": ("대분류", "category", "구분", "분류"),
    "entity_name": ("항목명", "항목", "명칭", "이름", "특성", "name", "item", "parameter", "param"),
    "qualitative_spec": ("조건", "설명", "비고", "remark", "note", "정성", "description", "특기"),
    "metadata": ("작성일", "버전", "version", "date", "작성자", "author", "순번", "번호", "no"),
}


def guess_role(header: Column | str) -> Column:
    """The role that a header names, or null: Latin words at word edges, others anywhere in the header without spaces."""
    h = F.lower(collapse(F.coalesce(_col(header), F.lit(""))))
    despaced = F.regexp_replace(h, " ", "")
    out = F.when(h == "", F.lit(None).cast("string"))
    for role, words in ROLE_WORDS.items():
        latin, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
        hit = F.lit(False)
        if latin:
            hit = hit | h.rlike(rf"(?U)\b(?:{'|'.join(latin)})\b")
        if other:
            hit = hit | despaced.rlike("|".join(other))
        out = out.when(hit, role)
    return out


# Where a fact's name may be found, results of a comparison, and relations.
RESULT_WORDS = ("match", "mismatch", "missing", "unknown")
RELATION_WORDS = ("same_as", "differs_by", "unknown")


def coerce(word: Column | str, known: tuple[str, ...], other: str) -> Column:
    """A known word in lower case without white space at its ends; anything else is ``other``."""
    w = F.lower(F.trim(F.coalesce(_col(word), F.lit(""))))
    return F.when(w.isin(*known), w).otherwise(other)


def first_text(*parts: Column | str) -> Column:
    """The first part that is not blank (what a fact is searched by: search text, evidence, name)."""
    return F.coalesce(*(F.when(~is_blank(p), _col(p)) for p in parts), F.lit(""))


def quote_in_evidence(quote: Column | str, evidence: Column | str) -> Column:
    """Whether a quote, white space collapsed, is not empty and lies in the evidence, as written."""
    q = collapse(F.coalesce(_col(quote), F.lit("")))
    return (q != "") & F.contains(collapse(F.coalesce(_col(evidence), F.lit(""))), q)


def json_object(text: Column | str) -> Column:
    """A JSON object as text: the whole, or else from the first brace to the last; null if neither is an object."""
    t = F.trim(F.coalesce(_col(text), F.lit("")))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    is_object = lambda c: c.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(c).isNotNull()
    return F.when(is_object(t), t).when(is_object(inner), inner)


def split_pair(pair: Column | str, sep: str = "::") -> Column:
    """The two ends of a pair's id (left, right); the right one is empty without a separator."""
    p = _col(pair)
    at = F.instr(p, sep)
    return F.struct(F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p).alias("left"), F.when(at > 0, F.substring(p, at + len(sep), F.length(p))).otherwise("").alias("right"))


def value_type(value: Column | str) -> Column:
    """empty, date, bool, number or text."""
    v = F.trim(F.coalesce(_col(value).cast("string"), F.lit("")))
    number = F.replace(v, F.lit(","), F.lit("")).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(v == "", "empty").when(F.lower(v).isin("true", "false"), "bool").when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), "date").when(number, "number").otherwise("text")


def lines_of(text: Column | str) -> Column:
    """Non-blank lines of a text, stripped and numbered from 1, each with its indent (a tab counts 4)."""
    marked = F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n"), lambda x: F.struct(F.trim(F.regexp_replace(x, r"^[\t\r ]+|[\t\r ]+$", "")).alias("text"), F.length(F.replace(F.regexp_extract(x, r"^[ \t]*", 0), F.lit("\t"), F.lit("    "))).alias("indent")))
    kept = F.filter(marked, lambda m: m["text"] != "")
    return F.transform(kept, lambda m, i: F.struct((i + 1).cast("long").alias("line"), m["text"].alias("text"), m["indent"].cast("long").alias("indent")))


def heading_level(style: Column | str) -> Column:
    """The level that a style such as ``Heading 2`` names, or null."""
    found = F.regexp_extract(F.coalesce(_col(style), F.lit("")), r"(?i)^heading\s*([0-9]+)$", 1)
    return F.when(found != "", found.cast("int"))


def table_line(*cells: Column | str) -> Column:
    """A Markdown table row; white space is collapsed and bars in cells are escaped."""
    parts = [F.replace(collapse((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
