"""Timelines, progress, stalls and limiter over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import classify_error, format_duration
from ..operators import events as E
from ._tables import Registry, table

_reg = Registry()
add = _reg.add
QUERIES, ORACLES = _reg.queries, _reg.oracles


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@add("""with m as (select user_id, event_id, ts, event_type, lead(event_type) over w as nt, lead(ts) over w as nts from events where event_type in ('click', 'view') window w as (partition by user_id order by ts, event_id))
    select user_id, event_id, ts, round((epoch_us(nts) - epoch_us(ts)) / 1e6, 3) as seconds from m where event_type = 'click' and nt = 'view'""")
def stage_durations(spark, sf_dir):
    return E.stage_durations(_events(spark, sf_dir), "user_id", "click", "view")


@add("""with f as (select user_id, bool_or(value > 50) as slow, bool_or(event_type = 'error') as failed, bool_or(value is null or value < 1) as empty from events group by 1)
    select user_id, 1 as ord, 'slow' as symptom from f where slow union all select user_id, 2, 'failed' from f where failed union all select user_id, 3, 'empty' from f where empty""")
def diagnose(spark, sf_dir):
    empty = F.col("value").isNull() | (F.col("value") < 1)
    return E.symptoms(_events(spark, sf_dir), "user_id", slow=F.col("value") > 50, failed=F.col("event_type") == "error", empty=empty)


@add("""with t as (select *, count(*) over (partition by user_id) as total from events), p as (select user_id, event_id, least(1.0, sum(case when event_type <> 'view' then 1 else 0 end) over w / total::double) as part, ts from t window w as (partition by user_id order by ts, event_id rows unbounded preceding))
    select user_id, event_id, round(max(part) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as fraction from p""")
def progress_fraction(spark, sf_dir):
    from pyspark.sql import Window

    counted = _events(spark, sf_dir).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return E.running_fraction(counted, "user_id", F.col("event_type") != "view", "total").select("user_id", "event_id", "fraction")


@add("""with g as (select user_id, event_id, round((epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6, 3) as idle from events) select user_id, event_id, idle from g where idle > 3600""")
def stall_gaps(spark, sf_dir):
    return E.stalls(_events(spark, sf_dir), "user_id", 3600)


@add("select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as in_window from events")
def sliding_rate(spark, sf_dir):
    return E.sliding_count(_events(spark, sf_dir), "user_id", 86400).select("user_id", "event_id", "in_window")


@add("""with recursive a as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, event_id, t, k, t as adm, [t] as last from a where k = 1 union all
          select a.user_id, a.event_id, a.t, a.k, greatest(a.t, f.adm, case when len(f.last) >= 2 then f.last[1] + 86400.0 else a.t end), list_slice(list_concat(f.last, [greatest(a.t, f.adm, case when len(f.last) >= 2 then f.last[1] + 86400.0 else a.t end)]), -2, -1) from f join a on a.user_id = f.user_id and a.k = f.k + 1)
    select user_id, event_id, round(adm - t, 3) as waited from f""")
def limiter_admission(spark, sf_dir):
    return E.admissions(_events(spark, sf_dir), "user_id", 2, 86400.0)


@add("select event_id, event_type, case when value < 1 then (floor(value * 1000)::bigint)::varchar || 'ms' else 'long' end as shown, case when event_type = 'error' then 'timeout' else 'error' end as status from events")
def event_labels(spark, sf_dir):
    ms = F.floor(F.col("value") * 1000).cast("bigint")
    shown = F.when(F.col("value") < 1, format_duration(ms)).otherwise("long")
    status = classify_error(F.lit("Exception"), F.when(F.col("event_type") == "error", "read timed out").otherwise("failed"))
    return _events(spark, sf_dir).select("event_id", "event_type", shown.alias("shown"), status.alias("status"))


@add("select event_id, json_extract_string(props, '$.k') as k, json_valid(props) as valid from events")
def json_extract(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@add("select event_id, user_id from events where event_type <> 'view' and ts < (select max(ts) from events) - interval 7 day")
def expired_jobs(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    return E.expired(e.join(F.broadcast(now)), F.col("now"), 7, F.col("event_type") != "view").select("event_id", "user_id")


@add("select event_type, count(*) as n, round(avg(value), 6) as mean_value, round(sum(value) / count(distinct user_id), 6) as per_user from events group by 1")
def event_rates(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value") / F.count_distinct("user_id"), 6).alias("per_user"))


@add("""with a as (select o_custkey, max(case when o_orderstatus = 'P' then 1 else 0 end) as running from orders group by 1)
    select o.o_custkey, o_orderkey, (row_number() over (partition by o.o_custkey order by o_orderdate, o_orderkey) - 1 + running)::bigint as position from orders o join a using (o_custkey) where o_orderstatus = 'O'""")
def queue_positions(spark, sf_dir):
    status = F.col("o_orderstatus")
    return E.queue_positions(table(spark, sf_dir, "orders"), "o_custkey", status == "O", status == "P", "o_orderdate", "o_orderkey")


@add("select event_id, case when floor(value) > 0 then round(floor(value) * 1000.0 / 250, 1) end as per_second, least(pow(2.0, user_id % 9), 60.0) as wait from events")
def call_rates(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", E.rate(F.floor("value").cast("double"), F.lit(250.0)).alias("per_second"), E.backoff(F.col("user_id") % 9).alias("wait"))


@add("select event_type, count(*) as n, round(count(*) / (select count(*) from events)::double, 6) as share from events group by 1")
def decider_share(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("_all")))).select("event_type", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
