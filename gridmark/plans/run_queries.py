"""Training runs, latency and weekly counts. Runs and series are derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmark.functions.scalars import latest_completed_week
from gridmark.operators import runs as rn
from gridmark.operators import weekly as wk
from gridmark.plans.fixtures import read
from gridmark.plans.registry import query

# One run per user; an epoch is a day of the month; event types are metric columns.
_METRICS = """
    metrics as (select 'run_' || user_id as run, day(ts)::int as epoch, (event_id % 4)::int as step,
      case event_type when 'click' then 'train/loss' when 'view' then 'train/loss_ce_1' when 'purchase' then 'val/mAP_50_95'
        when 'error' then 'val/ema_mAP_50' else 'test/F1' end as "column", value from events)
"""
_SPLIT = """case when split_part("column", '/', 1) in ('train', 'val', 'test') then split_part("column", '/', 1) else '' end"""


def _metrics(spark, folder):
    names = {"click": "train/loss", "view": "train/loss_ce_1", "purchase": "val/mAP_50_95", "error": "val/ema_mAP_50"}
    column = F.lit("test/F1")
    for kind, name in names.items():
        column = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(column)
    split, metric = rn.split_metric(F.col("column"))
    rows = read(spark, folder, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"), F.dayofmonth("ts").alias("epoch"),
        (F.col("event_id") % 4).cast("int").alias("step"), column.alias("column"), "value",
    )
    return rows.withColumns({"split": split, "metric": metric})


@query("wide_metrics_to_rows", """
    with w as (select event_id, case when event_type = 'click' then value end as a, case when event_type = 'view' then value end as b,
                 value * 2 as c from events)
    select event_id, 'train/loss' as "column", 'train' as split, 'loss' as metric, a as value from w where a is not null union all
    select event_id, 'val/mAP', 'val', 'mAP', b from w where b is not null union all
    select event_id, 'lr/base', '', 'lr/base', c from w""")  # fmt: skip
def wide_metrics_to_rows(spark, folder):
    wide = read(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("train/loss"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("val/mAP"), (F.col("value") * 2).alias("lr/base"),
    )
    return rn.long_metrics(wide, ["event_id"]).select("event_id", "column", "split", "metric", "value")


@query("epoch_means", f"""
    with {_METRICS} select run, epoch, "column", round(avg(value), 8) as mean, round(stddev_samp(value), 8) as std,
      round(avg(value) - stddev_samp(value), 8) as low, round(avg(value) + stddev_samp(value), 8) as high
    from metrics group by 1, 2, 3""")  # fmt: skip
def epoch_means(spark, folder):
    stats = rn.epoch_statistics(_metrics(spark, folder), ["run", "epoch", "column"])
    return stats.select("run", "epoch", "column", *[F.round(c, 8).alias(c) for c in ("mean", "std", "low", "high")])


@query("metric_groups", """
    with names as (select distinct case (event_id % 12)::int when 0 then 'train/loss' when 1 then 'train/loss_ce_3' when 2 then 'val/mAP_50'
        when 3 then 'val/mAP_50_95' when 4 then 'val/ema_mAP_75' when 5 then 'val/AP/cat' when 6 then 'test/mAR'
        when 7 then 'val/keypoint_map_50' when 8 then 'val/keypoint_map_50_95' when 9 then 'val/keypoint_mAR'
        when 10 then 'test/F1' else 'kp_heat' end as c from events where value is not null)
    select c as "column", unnest(case c when 'train/loss' then ['Loss'] when 'val/mAP_50' then ['Detection AP@0.50']
        when 'val/mAP_50_95' then ['Detection AP@0.50:0.95'] when 'val/ema_mAP_75' then ['Detection AP@0.75']
        when 'val/AP/cat' then ['Detection AP@0.50:0.95'] when 'test/mAR' then ['Detection AR']
        when 'val/keypoint_map_50' then ['Keypoint AP@0.50'] when 'val/keypoint_map_50_95' then ['Keypoint AP@0.50:0.95']
        when 'val/keypoint_mAR' then ['Keypoint AR'] when 'test/F1' then ['F1 / Precision / Recall']
        when 'kp_heat' then ['Loss'] else [] end) as metric_group from names""")  # fmt: skip
def metric_groups(spark, folder):
    names = ["train/loss", "train/loss_ce_3", "val/mAP_50", "val/mAP_50_95", "val/ema_mAP_75", "val/AP/cat", "test/mAR",
             "val/keypoint_map_50", "val/keypoint_map_50_95", "val/keypoint_mAR", "test/F1", "kp_heat"]
    column = F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 12).cast("int"))
    return rn.metric_groups(read(spark, folder, "events").select(column.alias("column"), "value"))


@query("drop_trailing_evaluations", f"""
    with {_METRICS}, s as (select *, {_SPLIT} as split from metrics where not ({_SPLIT} = 'train' and epoch > 20 + length(run) % 3)),
    f as (select run, epoch, bool_or(split = 'train') as t, bool_or(split in ('val', 'test')) as e from s group by all),
    l as (select run, max(epoch) filter (t or not e) as last, bool_or(t) as any_train from f group by 1)
    select s.run, s.epoch, s.split, count(*) as n from s join l using (run) where not any_train or epoch <= last group by all""")  # fmt: skip
def drop_trailing_evaluations(spark, folder):
    rows = _metrics(spark, folder).filter(~((F.col("split") == "train") & (F.col("epoch") > F.length("run") % 3 + 20)))
    return rn.drop_trailing_evaluations(rows, ["run"]).groupBy("run", "epoch", "split").agg(F.count("*").alias("n"))


_VALUES = """
    daily as (select 'run_' || user_id as run, day(ts)::int as epoch, event_type in ('error', 'view') as is_ema, max(value) as value
              from events group by all),
    single as (select run || '/' || is_ema as run, epoch, value from daily)
"""


def _daily(spark, folder):
    return read(spark, folder, "events").groupBy(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.col("event_type").isin("error", "view").alias("is_ema"),
    ).agg(F.max("value").alias("value"))


def _single(spark, folder):
    """The regular and the EMA values as runs of their own."""
    return _daily(spark, folder).select(F.concat("run", F.lit("/"), F.col("is_ema").cast("string")).alias("run"), "epoch", "value")


@query("best_metric_so_far", f"""
    with {_VALUES}, r as (select * from single),
    b as (select run, epoch, value, greatest(100, max(value) over (partition by run order by epoch)) as best,
            greatest(100, coalesce(max(value) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 100)) as before from r)
    select run, epoch, value, value > before as improved, best,
      coalesce(max(case when value > before then epoch end) over (partition by run order by epoch), -1) as best_epoch from b""")  # fmt: skip
def best_metric_so_far(spark, folder):
    return rn.best_so_far(_single(spark, folder), ["run"], ["epoch"], initial=100.0)


@query("best_metric_by_track", f"""
    with {_VALUES}, t as (select run, 'all' as track, epoch, is_ema, value from daily union all
      select run, case when is_ema then 'ema' else 'regular' end, epoch, is_ema, value from daily)
    select run, track, max(value) as best, arg_min(epoch, (epoch, is_ema)) filter (value = top) as best_epoch
    from (select *, max(value) over (partition by run, track) as top from t) group by 1, 2""")  # fmt: skip
def best_metric_by_track(spark, folder):
    return rn.best_by_track(_daily(spark, folder), ["run"])


@query("smoothed_metric", f"""
    with recursive {_VALUES}, r as (select run, epoch, value, row_number() over (partition by run order by epoch) as i from single),
    s as (select run, epoch, i, 0.7::double * 0 + value * (1.0::double - 0.7::double) as smoothed from r where i = 1 union all
      select r.run, r.epoch, r.i, s.smoothed * 0.7::double + r.value * (1.0::double - 0.7::double)
      from s join r on r.run = s.run and r.i = s.i + 1)
    select run, epoch, smoothed from s where epoch >= 4""")  # fmt: skip
def smoothed_metric(spark, folder):
    return rn.smooth(_single(spark, folder), ["run"], 0.7, skip_epochs=4)


@query("early_stopping", f"""
    with recursive {_VALUES}, e as (select run, epoch, max(value) as value from daily where epoch >= 2 group by all),
    r as (select *, row_number() over (partition by run order by epoch) as i from e),
    s as (select run, 0::bigint as i, '-inf'::double as best, 0 as waited, null::int as stopped from (select distinct run from r) union all
      select r.run, r.i, case when s.stopped is null and r.value - 5 > s.best then r.value else s.best end,
        case when s.stopped is not null then s.waited when r.value - 5 > s.best then 0 else s.waited + 1 end,
        case when s.stopped is not null then s.stopped when not r.value - 5 > s.best and s.waited + 1 >= 6 then r.epoch end
      from s join r on r.run = s.run and r.i = s.i + 1)
    select run, best, stopped as stopped_epoch from s where i = (select max(i) from r where r.run = s.run)""")  # fmt: skip
def early_stopping(spark, folder):
    rows = _daily(spark, folder).groupBy("run", "epoch").agg(
        F.max(F.when(~F.col("is_ema"), F.col("value"))).alias("regular"), F.max(F.when(F.col("is_ema"), F.col("value"))).alias("ema")
    )
    return rn.early_stop(rows, ["run"], patience=6, min_delta=5.0, skip_epochs=2)


_LATENCY = """select event_type as format, (user_id % 4)::int as batch, count(*) as calls, round(avg(value), 8) as mean_ms,
    round(stddev_pop(value), 8) as std_ms, round(median(value), 8) as median_ms, round(quantile_cont(value, 0.95), 8) as p95_ms
    from events group by 1, 2"""


def _latency(spark, folder):
    timings = read(spark, folder, "events").select(
        F.col("event_type").alias("format"), (F.col("user_id") % 4).cast("int").alias("batch"), F.col("value").alias("ms")
    )
    return rn.latency_statistics(timings, ["format", "batch"])


@query("latency_statistics", _LATENCY)
def latency_statistics(spark, folder):
    stats = _latency(spark, folder)
    return stats.select("format", "batch", "calls", *[F.round(c, 8).alias(c) for c in ("mean_ms", "std_ms", "median_ms", "p95_ms")])


@query("throughput_rows", """
    with f as (select event_type as format, (user_id % 4)::int as batch, avg(value) as m from events group by 1, 2),
    e as (select format, batch, case when batch = 1 then 0 else m * 1.25::double end as m from f where batch <> 3)
    select f.format, f.batch, case when coalesce(e.m, f.m) = 0 then f.batch * 'inf'::double
      else round(f.batch * (1000.0::double / coalesce(e.m, f.m)), 1) end as images_per_s
    from f left join e using (format, batch)""")  # fmt: skip
def throughput_rows(spark, folder):
    forward = _latency(spark, folder)
    scoped = forward.filter("batch <> 3").withColumn(
        "mean_ms", F.when(F.col("batch") == 1, F.lit(0.0)).otherwise(F.col("mean_ms") * 1.25)
    )
    return rn.result_rows(forward, scoped, ["format", "batch"]).select("format", "batch", "images_per_s")


_WEEKS = """
    counts as (select event_type as series, ts::date as day, count(*) as downloads from events
               where not (event_type = 'view' and day(ts) = 10) group by 1, 2),
    weeks as (select series, date_trunc('week', day)::date as week_start, cast(sum(downloads) as bigint) as downloads,
                count(distinct day) = 7 as complete from counts group by 1, 2)
"""


def _counts(spark, folder):
    rows = read(spark, folder, "events").filter(~((F.col("event_type") == "view") & (F.dayofmonth("ts") == 10)))
    return rows.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count("*").alias("downloads"))


@query("daily_count_rejects", """
    with d as (select event_type as series, ts::date as day, case when day(ts) = 3 and event_type = 'click' then 'mirrors'
                 else 'without_mirrors' end as category, case when day(ts) = 5 then -count(*) else count(*) end as downloads
               from events group by 1, 2, 3, day(ts)),
    x as (select * from d union all select * from d where day(day) = 7)
    select series, day, case when min(category) = 'mirrors' then 'wrong category' when min(downloads) < 0 then 'negative count'
      else 'duplicate day' end as reason, count(*) as entries from x group by 1, 2
    having min(category) = 'mirrors' or min(downloads) < 0 or count(*) > 1""")  # fmt: skip
def daily_count_rejects(spark, folder):
    day = F.dayofmonth("day")
    events = read(spark, folder, "events")
    rows = events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    daily = rows.select(
        "series", "day",
        F.when((day == 3) & (F.col("series") == "click"), F.lit("mirrors")).otherwise(F.lit("without_mirrors")).alias("category"),
        F.when(day == 5, -F.col("n")).otherwise(F.col("n")).alias("downloads"),
    )
    return wk.check_daily(daily.unionAll(daily.filter(day == 7)), ["series"])


@query("weekly_sums", f"with {_WEEKS} select series, week_start, week_start + 6 as week_end, downloads, complete from weeks")
def weekly_sums(spark, folder):
    return wk.weekly_sums(_counts(spark, folder), ["series"])


# A history without the week of 15 January for one series, and cumulative stars.
_HISTORY = f"""
    {_WEEKS},
    history as (select series, week_start, (week_start + 6)::date as week_end,
      cast(sum(downloads) over (partition by series order by week_start) as bigint) as stars_total, downloads
      from weeks where not (series = 'error' and week_start = date '2024-01-15')),
    deltas as (select *, case when lag(week_end) over w + 1 = week_start then stars_total - lag(stars_total) over w end as new_stars
      from history window w as (partition by series order by week_start))
"""


def _history(spark, folder):
    from pyspark.sql import Window

    weeks = wk.weekly_sums(_counts(spark, folder), ["series"]).drop("complete")
    kept = weeks.filter(~((F.col("series") == "error") & (F.col("week_start") == F.lit("2024-01-15").cast("date"))))
    order = Window.partitionBy("series").orderBy("week_start")
    total = F.sum("downloads").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The total is taken over the kept weeks.
    return wk.with_deltas(kept.withColumn("stars_total", total), ["series"])


@query("weekly_deltas", f"with {_HISTORY} select series, week_start, week_end, stars_total, downloads, new_stars from deltas")
def weekly_deltas(spark, folder):
    return _history(spark, folder).select("series", "week_start", "week_end", "stars_total", "downloads", "new_stars")


@query("weekly_history_problems", f"""
    with {_HISTORY}, broken as (select *, case when series = 'click' and week_start = date '2024-01-15' then 7 else new_stars end as given,
        case when series = 'signup' and week_start = date '2024-01-08' then week_end + 1 else week_end end as e from deltas)
    select series, week_start, case when e <> week_start + 6 then 'not one Monday-to-Sunday week' else 'wrong delta' end as reason
    from broken b where e <> week_start + 6 or (series = 'click' and week_start = date '2024-01-15')
      or (series = 'signup' and week_start = date '2024-01-15')""")  # fmt: skip
def weekly_history_problems(spark, folder):
    day, next_week = F.lit("2024-01-08").cast("date"), F.lit("2024-01-15").cast("date")
    rows = _history(spark, folder).withColumns(
        {
            "new_stars": F.when((F.col("series") == "click") & (F.col("week_start") == next_week), F.lit(7)).otherwise(F.col("new_stars")),
            "week_end": F.when((F.col("series") == "signup") & (F.col("week_start") == day), F.date_add("week_end", 1)).otherwise(F.col("week_end")),
        }
    )
    return wk.history_problems(rows, ["series"]).select("series", "week_start", "reason")


@query("latest_history_rows", f"""
    with {_HISTORY} select series, week_start, downloads from (
      select *, row_number() over (partition by series order by week_start desc) as n from deltas) where n <= 2""")  # fmt: skip
def latest_history_rows(spark, folder):
    return wk.keep_latest(_history(spark, folder), ["series"], 2).select("series", "week_start", "downloads")


@query("upsert_week", f"""
    with {_HISTORY}, past as (select * from deltas where week_start < date '2024-01-22'),
    week as (select series, case when series = 'error' then date '2024-01-01' else max(week_start) end as week_start,
               cast(999 as bigint) as downloads, cast(5000 as bigint) as stars_total from deltas
             where week_start <= case series when 'view' then date '2024-01-15'
               else date '2024-01-22' end group by series),
    latest as (select series, max(week_start) as latest, arg_max(week_end, week_start) as e, arg_max(stars_total, week_start) as s from past group by 1),
    fresh as (select w.*, case when l.e + 1 = w.week_start then w.stars_total - l.s end as d from week w join latest l using (series)
              where w.week_start >= l.latest)
    select coalesce(p.series, f.series) as series, coalesce(p.week_start, f.week_start) as week_start,
      coalesce(p.week_end, (f.week_start + 6)::date) as week_end, coalesce(p.stars_total, f.stars_total) as stars_total,
      case when p.series is not null then p.new_stars else f.d end as new_stars, coalesce(f.downloads, p.downloads) as downloads
    from past p full join fresh f on p.series = f.series and p.week_start = f.week_start""")  # fmt: skip
def upsert_week(spark, folder):
    """One series reruns its latest week, most add the next week, one is refused as too old."""
    history = _history(spark, folder)
    past = history.filter(F.col("week_start") < F.lit("2024-01-22").cast("date"))
    limit = F.when(F.col("series") == "view", F.lit("2024-01-15")).otherwise(F.lit("2024-01-22")).cast("date")
    week = history.filter(F.col("week_start") <= limit).groupBy("series").agg(
        F.max("week_start").alias("week_start")
    )
    start = F.when(F.col("series") == "error", F.lit("2024-01-01").cast("date")).otherwise(F.col("week_start"))
    week = week.withColumn("week_start", start).withColumns(
        {"week_end": F.date_add("week_start", 6), "stars_total": F.lit(5000).cast("long"), "downloads": F.lit(999).cast("long")}
    )
    return wk.upsert_week(past, week, ["series"])[0]


@query("latest_completed_week", """
    select distinct ts::date as today, (date_trunc('week', ts)::date - 7)::date as week_start, (date_trunc('week', ts)::date - 1)::date as week_end
    from events""")  # fmt: skip
def latest_week(spark, folder):
    start, end = latest_completed_week(F.col("today"))
    days = read(spark, folder, "events").select(F.to_date("ts").alias("today")).distinct()
    return days.select("today", start.alias("week_start"), end.alias("week_end"))
