"""Small labels and readings: places, attributes, usage, retries, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

# Where responses keep their token counts, and what tells a rate limit and a timeout.
INPUT_KEYS = ("input_tokens", "prompt_tokens", "prompt_eval_count")
OUTPUT_KEYS = ("output_tokens", "completion_tokens", "eval_count")
NESTED_KEYS = ("usage", "usage_metadata", "token_usage")
RATE_CODES = (429,)
RATE_MARKS = ("rate limit", "too many requests", "quota", "요청 한도")
TIMEOUT_MARKS = ("timed out", "timeout", "read timed out", "시간 초과")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def attributes_text(attributes: Column | str) -> Column:
    """``name=value unit`` of all attributes in one line, in their order; ``-`` without any."""
    parts = F.transform(F.map_entries(_col(attributes)), lambda e: F.trim(F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["value"], F.lit("None")), F.coalesce(e["value"]["unit"], F.lit("")))))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "-").otherwise(F.array_join(parts, ", "))


def named_map(items: Column | str) -> Column:
    """An array of (name, value, unit) as a map; items without a name are left out, of equal names the last stays."""
    named = F.transform(F.filter(_col(items), lambda i: ~is_blank(i["name"])), lambda i: F.struct(F.trim(i["name"]).alias("key"), F.struct(i["value"].alias("value"), i["unit"].alias("unit")).alias("value")))
    names = F.transform(named, lambda e: e["key"])
    last = F.filter(named, lambda e, k: ~F.array_contains(F.slice(names, k + 2, F.size(names)), e["key"]))
    return F.map_from_entries(last)


# Words for places in the texts of reports.
PLACE_WORDS = {"row": "행", "block": "블록", "slide": "슬라이드", "shape": "도형", "notes": "스피커노트 포함"}


def place_text(doc_type: Column | str, sheet: Column, where: Column, block_ids: Column, slide_no: Column, shape_ids: Column, row: Column | None = None, from_notes: Column | None = None) -> Column:
    """Where in its document a fact comes from, for readers; ``-`` if nothing is known.  A sheet's row stands in for a range that is
    not known; a fact of the speaker notes of a slide says so."""
    ids = lambda a: F.array_join(F.transform(a, lambda i: i.cast("string")), ", ")
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    word = lambda name: F.lit(f"{PLACE_WORDS[name]} ")
    cells = F.when(~is_blank(where), where)
    if row is not None:
        cells = F.coalesce(cells, F.when(row.isNotNull() & (row != 0), F.concat(word("row"), row.cast("string"))))
    excel = F.coalesce(F.when(~is_blank(sheet), F.concat(sheet, F.lit("!"), cells)), cells, F.when(~is_blank(sheet), sheet), F.lit("-"))
    blocks = F.when(some(block_ids), F.concat(word("block"), ids(block_ids))).otherwise("-")
    notes = [] if from_notes is None else [F.when(from_notes, PLACE_WORDS["notes"])]
    parts = F.concat_ws(" / ", F.when(slide_no.isNotNull(), F.concat(word("slide"), slide_no.cast("string"))), F.when(some(shape_ids), F.concat(word("shape"), ids(shape_ids))), *notes)
    kind = _col(doc_type)
    return F.when(kind == "excel", excel).when(kind == "word", blocks).when(kind == "ppt", F.when(parts == "", "-").otherwise(parts)).otherwise("-")


def usage(response: Column | str) -> Column:
    """(input_tokens, output_tokens) of a response as JSON: of itself, or of the first object up to two levels inside that has
    any; 0 if none says."""
    scopes = ["$"] + [f"$.{a}" for a in NESTED_KEYS] + [f"$.{a}.{b}" for a in NESTED_KEYS for b in NESTED_KEYS]
    pick = lambda scope, keys: F.coalesce(*(F.when(n > 0, n) for n in (F.get_json_object(_col(response), f"{scope}.{k}").try_cast("long") for k in keys)))
    out = F
    for scope in scopes:
        i, o = pick(scope, INPUT_KEYS), pick(scope, OUTPUT_KEYS)
        out = out.when(i.isNotNull() | o.isNotNull(), F.struct(F.coalesce(i, F.lit(0)).alias("input_tokens"), F.coalesce(o, F.lit(0)).alias("output_tokens")))
    return out.otherwise(F.struct(F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens")))


def retry_kind(kind: Column | str, status: Column | str, message: Column | str) -> Column:
    """What to wait for before a call is repeated: rate_limit (by status code, name or words), timeout (by name or words), or nothing."""
    k, m = F.lower(F.coalesce(_col(kind), F.lit(""))), F.lower(F.coalesce(_col(message), F.lit("")))
    says = lambda marks: m.rlike("|".join(marks))
    rate = F.coalesce(_col(status).isin(*RATE_CODES), F.lit(False)) | F.contains(F.replace(k, F.lit("_"), F.lit("")), F.lit("ratelimit")) | says(RATE_MARKS)
    return F.when(rate, "rate_limit").when(F.contains(k, F.lit("timeout")) | says(TIMEOUT_MARKS), "timeout").otherwise("")


def argb(colour: Column | str) -> Column:
    """A fill colour, given as an integer of blue, green and red bytes, as opaque hex; null for none."""
    c = _col(colour).cast("long")
    part = lambda shift: F.lpad(F.hex(F.shiftright(c, shift) % 256), 2, "0")
    return F.when(c >= 0, F.concat(F.lit("FF"), part(0), part(8), part(16)))


def tristate(flag: Column | str) -> Column:
    """-1 and 1 are true, 0 is false, anything else (mixed) is null."""
    f = _col(flag)
    return F.when(f.isin(-1, 1), True).when(f == 0, False)


def column_summary(col: Column | str, header: Column | str, role: Column | str, unit: Column | str) -> Column:
    """One line on a column: number, header, and role and unit if known."""
    return F.concat_ws(" ", F.concat(_col(col).cast("string"), F.lit(":")), F.when(~is_blank(header), _col(header)), F.when(~is_blank(role), F.concat(F.lit("<"), _col(role), F.lit(">"))), F.when(~is_blank(unit), F.concat(F.lit("("), _col(unit), F.lit(")"))))
