"""Policy change events: applying them and measuring utilization before and after.

Events are a table of any size: ``position`` (unique), ``policy_id, description, effective_date, affected_services``
(code prefixes) and ``change_type``. Claims meet them through an index of prefixes and weeks, so that the plan is the same
for four events and for thousands, without an expression per event. A list of ``PolicyChangeEvent`` becomes such a table.
Null prefixes, events without a date and claims without a code or date meet nothing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimgauge.config import DetectionConfig, PolicyChangeEvent
from claimgauge.functions import money
from claimgauge.functions.codes import has_any_prefix
from claimgauge.functions.ratios import count_where, rate, ratio
from claimgauge.functions.text import percent
from claimgauge.sources.monthly_claims import in_months, in_months_of

Events = DataFrame | list[PolicyChangeEvent]

EVENT_COLUMNS = (
    "position BIGINT, policy_id STRING, description STRING, effective_date DATE, affected_services ARRAY<STRING>, "
    "change_type STRING"
)
#: A Monday; weeks are counted from here.
FIRST_DAY = dt.date(1970, 1, 5)
#: Distinct prefixes up to this number are also filters of the scan.
PUSHED_PREFIXES = 16
PERIODS = ("pre", "post")
METRICS = ("volume", "total_allowed", "avg_allowed", "denial_rate", "oon_rate")


def prefix_filter(claims: DataFrame, prefixes) -> DataFrame:
    """Claims whose procedure code starts with one of the prefixes."""
    return claims.where(has_any_prefix(F.col("procedure_code"), prefixes))


def _in_days(start: dt.date, end: dt.date) -> Column:
    return (F.col("service_date") >= F.lit(start)) & (F.col("service_date") < F.lit(end))


def _windows(effective: dt.date, weeks: int) -> dict[str, Column]:
    """Half-open ranges of service dates before and after the effective date."""
    length = dt.timedelta(weeks=weeks)
    return {
        "pre": _in_days(effective - length, effective),
        "post": _in_days(effective, effective + length),
    }


def window_filter(claims: DataFrame, effective: dt.date, weeks: int) -> DataFrame:
    """Claims within the windows around a date, with ``period`` 'pre' or 'post'; of claims by month only these months."""
    windows = _windows(effective, weeks)
    length = dt.timedelta(weeks=weeks)
    return in_months(claims, effective - length, effective + length).where(windows["pre"] | windows["post"]).withColumn(
        "period", F.when(windows["pre"], "pre").otherwise("post")
    )


def event_table(spark: SparkSession, events: Events) -> DataFrame:
    """The events as a table; a list keeps its order as ``position``."""
    if isinstance(events, DataFrame):
        return events
    rows = [
        (i, e.policy_id, e.description, e.effective_date, list(e.affected_procedure_prefixes), e.change_type)
        for i, e in enumerate(events)
    ]
    return spark.createDataFrame(rows, EVENT_COLUMNS)


def _by_prefix(events: DataFrame) -> DataFrame:
    """One row per event and prefix. Prefixes that begin with another one of the same event add nothing and go, so
    that a code has at most one prefix in an event."""
    given = F.array_distinct(F.filter("affected_services", lambda p: p.isNotNull()))
    shortest = F.filter(given, lambda p: ~F.exists(given, lambda q: (q != p) & p.startswith(q)))
    return events.where("effective_date IS NOT NULL").select(
        "position", "change_type", "effective_date", F.explode(shortest).alias("prefix")
    )


def _prefixes_of(code: Column, indexed: DataFrame) -> Column:
    """The code's beginnings of all lengths that prefixes of the index have; there are as many as the longest prefix allows."""
    lengths = indexed.agg(F.sort_array(F.collect_set(F.char_length("prefix")))).first()[0]
    beginnings = [F.when(F.char_length(code) >= n, F.substring(code, 1, n)) for n in lengths]
    return F.array_compact(F.array(*beginnings)) if beginnings else F.array().cast("array<string>")


def apply_policy_event(claims: DataFrame, events: Events) -> DataFrame:
    """Lift the authorization requirement where a 'removed' event covers the claim.

    Of all events with a prefix only the earliest date counts, and of all prefixes of a code too: the index is one date
    per distinct code, however many events there are.
    """
    removed = _by_prefix(event_table(claims.sparkSession, events)).where(F.col("change_type") == "removed")
    earliest = removed.groupBy("prefix").agg(F.min("effective_date").alias("from_date"))
    codes = claims.select(F.col("procedure_code").alias("code")).where("code IS NOT NULL").distinct()
    lifted = (
        codes.withColumn("prefix", F.explode(_prefixes_of(F.col("code"), removed)))
        .join(earliest, "prefix")
        .groupBy("code")
        .agg(F.min("from_date").alias("lifted_from"))
    )
    joined = claims.join(lifted, F.col("procedure_code") == F.col("code"), "left")
    required = F.col("authorization_required")
    covered = (F.col("service_date") >= F.col("lifted_from")) & (required == "Y")
    return joined.withColumn("authorization_required", F.when(covered, "N").otherwise(required)).select(
        *[f"`{name}`" for name in claims.columns]
    )


def _measures() -> list[Column]:
    return [
        F.count("*").alias("volume"),
        F.count("allowed_amount").alias("n_allowed"),
        *money.sum_parts("allowed_amount", "allowed"),
        count_where(F.col("denial_flag") == "Y").alias("denials"),
        F.count("denial_flag").alias("n_denial_flag"),
        count_where(F.col("network_status") == "OON").alias("oon"),
        F.count("network_status").alias("n_network_status"),
    ]


def _metric_columns() -> dict[str, Column]:
    return {
        "volume": F.col("volume"),
        "total_allowed": money.total("allowed"),
        "avg_allowed": F.coalesce(ratio(money.total("allowed"), F.col("n_allowed")), F.lit(0.0)),
        "denial_rate": rate(F.col("denials"), F.col("n_denial_flag")),
        "oon_rate": rate(F.col("oon"), F.col("n_network_status")),
    }


def period_metrics(claims: DataFrame) -> DataFrame:
    """One row with volume, allowed total and mean, denial and out-of-network rate; zeros if empty."""
    return claims.agg(*_measures()).select(
        *[value.alias(name) for name, value in _metric_columns().items()]
    )


def _merged() -> list[Column]:
    """The measures of several rows together."""
    counts = ("volume", "n_allowed", "denials", "n_denial_flag", "oon", "n_network_status")
    return [*[F.sum(name).alias(name) for name in counts], *money.merge_parts("allowed")]


def _week(day: Column) -> Column:
    return F.floor(F.date_diff(day, F.lit(FIRST_DAY)) / 7)


def _with_windows(by_prefix: DataFrame, weeks: int) -> DataFrame:
    start, end = F.date_sub("effective_date", 7 * weeks), F.date_add("effective_date", 7 * weeks)
    return by_prefix.where(F.lit(weeks > 0)).withColumns({"start_date": start, "end_date": end})


def _windows_by_week(windows: DataFrame, weeks: int) -> DataFrame:
    """The prefix and date of every window in every week that it touches."""
    touched = F.sequence(_week(F.col("start_date")), _week(F.date_sub("end_date", 1)))
    return _with_windows(windows, weeks).withColumn("week", F.explode(touched))


def events_metrics(claims: DataFrame, events: DataFrame, weeks: int) -> DataFrame:
    """``position, period`` and the measures of the claims that each event covers in its windows.

    Claims are summed per code and day, then per prefix of the index and day; only these sums meet the windows, by
    prefix and week, and exact dates decide after that. Events with a prefix and a date in common share a window, so that
    there are no more windows than prefixes times days, and every event looks its windows' measures up. Spark would take
    the size of the files of the events for that of the rows made from them, so neither join is a broadcast of these.
    A claim that two prefixes of an event cover counts once. Of claims by month, only months that a window touches are read.
    """
    by_prefix = _by_prefix(events)
    windows = by_prefix.select("prefix", "effective_date").distinct()
    first, last = by_prefix.agg(F.min("effective_date"), F.max("effective_date")).first()
    reach = F.lit(False)
    if first:
        reach = (F.col("service_date") >= F.date_sub(F.lit(first), 7 * weeks)) & (F.col("service_date") < F.date_add(F.lit(last), 7 * weeks))
    in_reach = in_months_of(claims, _with_windows(windows, weeks)).where(reach & F.col("procedure_code").isNotNull())
    wanted = by_prefix.select("prefix").distinct()
    # A few prefixes go to the reader as well; more would only lengthen the plan.
    few = wanted.limit(PUSHED_PREFIXES + 1).agg(F.collect_set("prefix")).first()[0]
    if len(few) <= PUSHED_PREFIXES:
        in_reach = prefix_filter(in_reach, sorted(few))
    daily = in_reach.groupBy("procedure_code", "service_date").agg(*_measures())
    spread = daily.withColumn("prefix", F.explode(_prefixes_of(F.col("procedure_code"), by_prefix)))
    by_day = spread.join(wanted, "prefix", "left_semi").groupBy("prefix", "service_date").agg(*_merged())
    period = F.when(F.col("service_date") < F.col("effective_date"), PERIODS[0]).otherwise(PERIODS[1])
    measured = (
        by_day.withColumn("week", _week(F.col("service_date")))
        .join(_windows_by_week(windows, weeks).hint("merge"), ["prefix", "week"])
        .where((F.col("service_date") >= F.col("start_date")) & (F.col("service_date") < F.col("end_date")))
        .groupBy("prefix", "effective_date", period.alias("period"))
        .agg(*_merged())
    )
    met = by_prefix.hint("merge").join(measured, ["prefix", "effective_date"])
    return met.groupBy("position", "period").agg(*_merged())


def policy_impact(claims: DataFrame, events: Events, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """One row per event, in the given order, with the metrics before and after and their change.

    A claim that two prefixes of one event cover counts once; events without claims get zeros.
    """
    table = event_table(claims.sparkSession, events)
    measured = (
        events_metrics(claims, table, config.rebound_window_weeks)
        .select("position", "period", F.struct(*[v.alias(m) for m, v in _metric_columns().items()]).alias("m"))
        .groupBy("position")
        .pivot("period", list(PERIODS))
        .agg(F.first("m"))
    )
    table = table.withColumn("effective_date", F.col("effective_date").cast("string"))

    def metric(period: str, name: str) -> Column:
        zero = F.lit(0).cast("long") if name == "volume" else F.lit(0.0)
        return F.coalesce(F.col(f"{period}.{name}"), zero)

    flat = table.join(measured, "position", "left").select(
        "position",
        "policy_id",
        "description",
        "effective_date",
        "affected_services",
        "change_type",
        *[metric(period, name).alias(f"{period}_{name}") for period in PERIODS for name in METRICS],
    )

    def change_pct(name: str) -> Column:
        before, after = F.col(f"pre_{name}"), F.col(f"post_{name}")
        return F.round(rate((after - before), before) * 100, 2)

    def change(name: str) -> Column:
        return F.round(F.col(f"post_{name}") - F.col(f"pre_{name}"), 4)

    before, after = F.col("pre_volume"), F.col("post_volume")
    rebound = (
        (F.col("change_type") == "removed")
        & (before > 0)
        & (after >= before * config.rebound_threshold_pct)
    )
    detail = F.concat(
        F.lit("Post-removal volume ("), after.cast("string"), F.lit(") is "), percent(rate(after, before), 0),
        F.lit(" of pre-removal volume ("), before.cast("string"),
        F.lit("). Utilization did not decrease as expected."),
    )
    return flat.orderBy("position").select(
        "policy_id",
        "description",
        "effective_date",
        "affected_services",
        *[f"{period}_{name}" for period in PERIODS for name in METRICS],
        change_pct("volume").alias("volume_change_pct"),
        change_pct("total_allowed").alias("cost_change_pct"),
        change("denial_rate").alias("denial_rate_change"),
        change("oon_rate").alias("oon_rate_change"),
        rebound.alias("rebound_detected"),
        F.when(rebound, detail).otherwise("").alias("rebound_detail"),
    )
