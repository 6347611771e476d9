"""Nested stages, silence and symptoms over the events table; names found in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..operators import matching as M
from ..operators import timelines as T
from ..operators.containment import contained
from ..streaming.progress import watch_batch
from ._tables import NORM, Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles

#: Sign-ups and clicks open a stage of a user, views and purchases close the last open one.  The stack is kept as a list, event by event.
_STACK = """
    e AS (
      SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type IN ('signup', 'click') AS opens
      FROM events WHERE event_type IN ('signup', 'click', 'view', 'purchase')
    ),
    s AS (
      SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS stack, NULL::BIGINT AS closed, NULL::BIGINT AS opened, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT s.user_id, e.n, CASE WHEN e.opens THEN list_append(s.stack, e.event_id) ELSE s.stack[:-2] END,
        CASE WHEN NOT e.opens THEN s.stack[-1] END, CASE WHEN e.opens THEN e.event_id END, e.ts
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
    ),
    stages AS (
      SELECT o.user_id, o.opened AS event_id, len(o.stack) - 1 AS depth, o.stack[-2] AS parent_id,
        round((epoch_us(c.ts) - epoch_us(o.ts)) / 1e6, 6) AS seconds
      FROM s o LEFT JOIN s c ON c.user_id = o.user_id AND c.closed = o.opened WHERE o.opened IS NOT NULL
    )"""


def _stages(spark, sf_dir):
    kind = F.col("event_type")
    return T.nested_stages(table(spark, sf_dir, "events"), "user_id", kind.isin("signup", "click"), kind.isin("view", "purchase"))


@add(f"""WITH RECURSIVE {_STACK}, inside AS (SELECT user_id, parent_id, sum(seconds) AS inside FROM stages WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT t.user_id, t.event_id, t.depth::INTEGER AS depth, t.parent_id, t.seconds, round(t.seconds - coalesce(i.inside, 0), 6) AS self_seconds
    FROM stages t LEFT JOIN inside i ON i.user_id = t.user_id AND i.parent_id = t.event_id""")
def nested_stages(spark, sf_dir):
    return _stages(spark, sf_dir)


@add(f"""WITH RECURSIVE {_STACK}
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, name, status)::INTEGER AS place, name, seconds, status
    FROM (SELECT t.user_id, e.event_type AS name, t.seconds, CASE WHEN e.value > 50 THEN 'slow' ELSE 'ok' END AS status
      FROM stages t JOIN events e USING (event_id) WHERE t.depth = 0 AND t.seconds IS NOT NULL)""")
def stage_summary(spark, sf_dir):
    """Finished stages that lie in no other, longest first."""
    known = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    rows = _stages(spark, sf_dir).where("seconds is not null").join(known, "event_id")
    return T.stage_summary(rows, "user_id", F.col("event_type"), F.col("seconds"), F.col("depth"), F.when(F.col("value") > 50, "slow").otherwise(""))


@add("""WITH x AS (
      SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    ), f AS (
      SELECT user_id, bool_or(event_type = 'error' AND k < 20) AS timeout, bool_or(event_type = 'error' AND k BETWEEN 20 AND 59) AS length,
        bool_or(event_type = 'error' AND k BETWEEN 20 AND 59 AND value > 40) AS reasoning, bool_or(event_type = 'error' AND k >= 95) AS rate_limit,
        bool_or(event_type = 'click' AND floor(value) = 0) AS empty_output, bool_or(event_type = 'view' AND k > 97) AS parse, bool_or(value > 90) AS slow
      FROM x GROUP BY user_id
    ), u AS (UNPIVOT f ON timeout, length, reasoning, rate_limit, empty_output, parse, slow INTO NAME symptom VALUE seen)
    SELECT user_id, list_position(['timeout', 'length', 'reasoning', 'rate_limit', 'empty_output', 'parse', 'slow'], symptom)::INTEGER AS ord, symptom
    FROM u WHERE seen""")
def run_symptoms(spark, sf_dir):
    """The seven symptoms of each user's calls: errors by their number, answers by their value."""
    k, kind, value = F.get_json_object("props", "$.k").cast("long"), F.col("event_type"), F.col("value")
    status = F.when((kind == "error") & (k < 20), "timeout").when((kind == "error") & (k < 60), "length").when((kind == "error") & (k >= 95), "rate_limit")
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.when(kind == "click", T.CALL_END).when(kind == "view", T.RETRY).alias("kind"), status.alias("status"), (kind == "error").alias("failed"),
        F.floor("value").alias("output_chars"), F.when(value > 40, F.floor("value")).otherwise(0).alias("reasoning_tokens"),
        F.when(k > 97, T.PARSE_REASON).alias("reason"), (value > 90).alias("slow"),
    )
    return T.run_symptoms(rows, "user_id")


@add("""WITH r AS (
      SELECT user_id::VARCHAR AS job, epoch_us(ts) / 1e6 AS "at", event_type = 'purchase' AND value > 60 AS final FROM events
    ), m AS (
      SELECT *, lag("at") OVER w AS before, coalesce(bool_or(final) OVER (PARTITION BY job ORDER BY "at", final ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM r
      WINDOW w AS (PARTITION BY job ORDER BY "at", final)
    ), seen AS (
      SELECT job, 'stalled' AS change, before + 86400 AS "at", 86400.0::DOUBLE AS idle FROM m WHERE NOT done AND "at" - before >= 86400
      UNION ALL SELECT job, 'moving', "at", "at" - before FROM m WHERE NOT done AND "at" - before >= 86400
      UNION ALL SELECT job, 'final', "at", 0 FROM m WHERE NOT done AND final
    ), ends AS (SELECT job, max("at") AS last, bool_or(final) AS ended FROM r GROUP BY job), now AS (SELECT max("at") AS now FROM r)
    SELECT job, change, round("at", 3) AS "at", round(idle, 3) AS idle FROM (
      SELECT * FROM seen
      UNION ALL SELECT job, 'expired', last + 172800, 172800 FROM ends, now WHERE ended AND last + 172800 <= now
      UNION ALL SELECT job, 'stalled', last + 86400, 86400 FROM ends, now WHERE NOT ended AND last + 86400 <= now)""")
def watched_jobs(spark, sf_dir):
    """Users that fall silent for a day, speak again, end, and expire two days later, as the stream with timers tells it."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("job"), "ts", ((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("final"))
    now = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).first()[0]
    return watch_batch(rows, 86400.0, 172800.0, now).withColumns({"at": F.round("at", 3), "idle": F.round("idle", 3)})


@add(f"""WITH names AS (SELECT DISTINCT name FROM (SELECT {NORM.format("split_part(text, ' ', 1) || split_part(text, ' ', 2) || split_part(text, ' ', 3)")} AS name FROM benchmark) WHERE name <> '')
    SELECT doc_id, name FROM (SELECT doc_id, {NORM.format('text')} AS body FROM documents) JOIN names ON contains(body, name)""")
def name_mentions(spark, sf_dir):
    """Which whole documents hold the normalised first three words of which benchmark item."""
    words = F.concat(*(F.coalesce(F.get(F.split("text", " "), F.lit(k)), F.lit("")) for k in range(3)))
    names = table(spark, sf_dir, "benchmark").select(norm_name(words).alias("name"))
    return contained(table(spark, sf_dir, "documents"), norm_name("text"), ["doc_id"], names)


#: Orders' dates as names: the golden ones carry a month, answers a day, so names hold each other and are seldom equal.
_GOLDEN = f"""
    golden AS (SELECT c_custkey AS golden_id, c_nationkey AS doc, 'Customer ' || (c_custkey % 50) AS entity_name, CASE WHEN c_acctbal < 0 THEN 'mismatch' ELSE 'match' END AS expected FROM customer),
    answers AS (SELECT c_nationkey AS doc, 'customer-' || (c_custkey % 211) AS entity_name, CASE WHEN c_custkey % 3 = 0 THEN 'mismatch' WHEN c_custkey % 3 = 1 THEN 'match' ELSE 'unknown' END AS result, c_custkey AS pos FROM customer),
    a AS (SELECT doc, {NORM.format('entity_name')} AS name, result, pos FROM answers),
    scored AS (
      SELECT g.golden_id, g.doc, g.entity_name, g.expected, coalesce(
        (SELECT arg_min(a.result, a.pos) FROM a WHERE a.doc = g.doc AND a.name = {NORM.format('g.entity_name')}),
        (SELECT arg_min(a.result, a.pos) FROM a WHERE a.doc = g.doc AND (contains(a.name, {NORM.format('g.entity_name')}) OR contains({NORM.format('g.entity_name')}, a.name)))) AS result
      FROM golden g
    )"""


def _scored(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    golden = c.select(key.alias("golden_id"), F.col("c_nationkey").alias("doc"), F.concat(F.lit("Customer "), (key % 50).cast("string")).alias("entity_name"), F.when(F.col("c_acctbal") < 0, "mismatch").otherwise("match").alias("expected"))
    answers = c.select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("customer-"), (key % 211).cast("string")).alias("entity_name"), F.when(key % 3 == 0, "mismatch").when(key % 3 == 1, "match").otherwise("unknown").alias("result"), key.alias("pos"))
    return M.score_engine(golden, answers)


@add(f"WITH {_GOLDEN} SELECT * FROM scored")
def engine_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@add(f"""WITH {_GOLDEN}, w AS (SELECT unnest(['match', 'mismatch', 'missing', 'unknown']) AS v)
    SELECT e.v AS expected, r.v AS result, count(s.golden_id) AS n FROM w e, w r LEFT JOIN scored s ON s.expected = e.v AND s.result = r.v GROUP BY ALL""")
def engine_confusion(spark, sf_dir):
    return M.engine_confusion(_scored(spark, sf_dir))
