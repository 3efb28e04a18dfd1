"""Report and endpoint metrics over the routing history.

Every metric is a declarative aggregation: partial aggregates per task, one small
final merge, only the result rows reach the driver.  Exact percentiles (nearest rank)
are found by distributed selection, so no buffer grows with the number of distinct
values and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (ACCURACY_VIEW_THRESHOLD, BATCH_P95_TARGET_MS, BATCH_QUEUE,
                         CRITICAL_ACCURACY_TARGET, METRICS_WINDOW_ROWS,
                         MISSING_P95_MS, URGENT_P95_TARGET_MS, URGENT_QUEUE)
from .history import clean_latency, recent_history
from .scan import ordered_scan


#: Buckets per unit of the logarithm of 1 + value: a bucket is about 0.006 % of its values wide.
BUCKETS = 16_384


def exact_percentiles(df: DataFrame, col: str, ps=(0.95, 0.99), by=()) -> DataFrame:
    """Nearest-rank percentiles (``sorted[ceil(p*n)-1]``, A3) by distributed selection: no
    sort of the values and no buffer that grows with them.

    The values are counted by group and value (partial aggregation; one exchange that both
    steps below reuse) and these counts by bucket.  A running count over a group's buckets
    (some 100,000 at most for values up to a thousand, whatever the number of rows) finds
    the bucket that holds each rank; only its values are then ranked.  A bucket's number
    never falls as values rise, so the result is exact for any values.  A group without
    values has no row."""
    G = list(by) or ["_g"]
    v = F.col(col).cast("double")
    clean = df.filter(v.isNotNull() & ~F.isnan(v))
    if not by:
        clean = clean.withColumn("_g", F.lit(0))
    hist = clean.groupBy(*G, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # infinities are values; they lie beyond all others' buckets
    scaled = F.floor(F.signum("_v") * F.least(F.log1p(F.abs("_v")), F.lit(800.0)) * BUCKETS)
    hist = hist.withColumn("_b", scaled)
    upto = Window.partitionBy(*G).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_n"))).cast("long")
    wanted = (hist.groupBy(*G, "_b").agg(F.sum("_c").alias("_c"))
              .withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*G)))
              .select(*G, "_b", "_c", "_upto", F.posexplode(F.array(*[rank(p) for p in ps])).alias("_p", "_rank"))
              .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
              .select(*G, "_b", "_p", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")))
    w = Window.partitionBy(*G, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (_join_null_safe(hist, wanted, [*G, "_b"], "inner").withColumn("_upto", F.sum("_c").over(w))
             .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))))
    out = found.groupBy(*G).agg(*[
        F.max(F.when(F.col("_p") == i, F.col("_v"))).alias(_pct_name(p)) for i, p in enumerate(ps)])
    return out if by else out.drop("_g")


def _pct_name(p: float) -> str:
    return f"p{int(round(p * 100))}_ms"


def _join_null_safe(left: DataFrame, right: DataFrame, by, how: str = "left") -> DataFrame:
    """Join of aggregates on group keys, where a missing key is a key."""
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), cond, how).select(
        "l.*", *[F.col(f"r.{c}") for c in right.columns if c not in by])


def _with_percentiles(agg: DataFrame, rows: DataFrame, col: str, ps, by=()) -> DataFrame:
    """The aggregate's rows (one per group) with the percentiles of ``rows``."""
    return _join_null_safe(agg, exact_percentiles(rows, col, ps, by), by)


def _lat_ok(col: str = "latency_ms") -> Column:
    c = F.col(col).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (c >= 0)


def _lat(col: str = "latency_ms") -> Column:
    return F.when(_lat_ok(col), F.col(col).cast("double"))


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


# ---------------------------------------------------------------- latency
def latency_summary(h: DataFrame) -> DataFrame:
    """A1: avg, min, max, p95, p99 over clean latencies."""
    c = clean_latency(h)
    a = c.agg(F.count(F.lit(1)).alias("n"),
              F.avg("latency_ms").alias("avg_ms"),
              F.min("latency_ms").alias("min_ms"),
              F.max("latency_ms").alias("max_ms"))
    return _with_percentiles(a, c, "latency_ms", (0.95, 0.99))


def latency_by_queue(h: DataFrame) -> DataFrame:
    """A2: per queue count, avg (0 if none), p95, p99; both queues always present."""
    c = clean_latency(h)
    agg = c.groupBy("target_queue").agg(F.count(F.lit(1)).alias("n"),
                                        F.avg("latency_ms").alias("avg_ms"))
    agg = _with_percentiles(agg, c, "latency_ms", (0.95, 0.99), ["target_queue"])
    queues = h.sparkSession.createDataFrame([(URGENT_QUEUE,), (BATCH_QUEUE,)], "target_queue string")
    # both queues always reported; the per-queue aggregate is joined without a
    # hint (its size is one row per distinct queue value; AQE picks the plan)
    return (queues.join(agg, "target_queue", "left")
            .select("target_queue",
                    F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"),
                    "p95_ms", "p99_ms"))


def latency_percentiles(h: DataFrame, ps=(0.55, 0.95, 0.99), by="benchmark_id") -> DataFrame:
    """A3: nearest-rank percentiles per group."""
    return exact_percentiles(clean_latency(h), "latency_ms", ps, [by])


def latency_targets(h: DataFrame) -> DataFrame:
    """A4: urgent p95 < 100 ms, batch p95 < 300 ms; a missing queue counts 999."""
    q = latency_by_queue(h)
    limit = F.when(F.col("target_queue") == URGENT_QUEUE, F.lit(URGENT_P95_TARGET_MS)) \
        .otherwise(F.lit(BATCH_P95_TARGET_MS))
    p95 = F.coalesce(F.col("p95_ms"), F.lit(float(MISSING_P95_MS)))
    return q.select("target_queue", p95.alias("p95_checked_ms"),
                    limit.alias("target_ms"), (p95 < limit).alias("passed"))


# ---------------------------------------------------------------- volume
def throughput(h: DataFrame, min_duration_s: float = 0.0, ts_col: str = "ts") -> DataFrame:
    """A5: messages / (max - min time stamp); 1 s when fewer than two valid
    stamps; ``min_duration_s=1`` gives the endpoint's ``max(duration, 1)``.
    A zero duration gives NULL (the reports print Infinity)."""
    ms = F.unix_millis(F.col(ts_col))
    a = h.agg(F.count(F.lit(1)).alias("n"), F.count(ms).alias("_nts"),
              F.min(ms).alias("_t0"), F.max(ms).alias("_t1"))
    dur = F.when(F.col("_nts") > 1, (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)) \
        .otherwise(F.lit(1.0))
    if min_duration_s:
        dur = F.greatest(dur, F.lit(float(min_duration_s)))
    return a.select("n", dur.alias("duration_s"),
                    F.try_divide(F.col("n").cast("double"), dur).alias("throughput"))


def queue_share(h: DataFrame) -> DataFrame:
    """Urgent / batch counts and their share of all rows (percent)."""
    a = h.agg(F.count(F.lit(1)).alias("total"),
              F.count_if(F.col("target_queue") == URGENT_QUEUE).alias("urgent_count"),
              F.count_if(F.col("target_queue") == BATCH_QUEUE).alias("batch_count"))
    return a.select("total", "urgent_count", "batch_count",
                    _pct(F.col("urgent_count"), F.col("total")).alias("urgent_pct"),
                    _pct(F.col("batch_count"), F.col("total")).alias("batch_pct"))


def priority_accuracy(h: DataFrame, when_empty: float = 0.0) -> DataFrame:
    """Critical messages routed urgent; ``when_empty`` 0 (reports) or 100
    (endpoint) when there is no critical row (G7)."""
    crit = F.col("is_critical") == F.lit(True)
    a = h.agg(F.count_if(crit).alias("critical"),
              F.count_if(crit & (F.col("target_queue") == URGENT_QUEUE)).alias("correct"))
    acc = F.when(F.col("critical") > 0, _pct(F.col("correct"), F.col("critical"))) \
        .otherwise(F.lit(float(when_empty)))
    return a.select("critical", "correct",
                    (F.col("critical") - F.col("correct")).alias("misrouted"),
                    acc.alias("accuracy_pct"),
                    (acc >= F.lit(CRITICAL_ACCURACY_TARGET)).alias("meets_target"))


def overall_accuracy(h: DataFrame) -> DataFrame:
    """(critical->urgent + non-critical->batch) / all rows."""
    crit = F.col("is_critical") == F.lit(True)
    noncrit = F.col("is_critical") == F.lit(False)
    a = h.agg(F.count(F.lit(1)).alias("total"),
              F.count_if(crit & (F.col("target_queue") == URGENT_QUEUE)).alias("critical_correct"),
              F.count_if(noncrit & (F.col("target_queue") == BATCH_QUEUE)).alias("noncritical_correct"))
    acc = F.when(F.col("total") > 0,
                 _pct(F.col("critical_correct") + F.col("noncritical_correct"), F.col("total"))) \
        .otherwise(F.lit(0.0))
    return a.select("total", "critical_correct", "noncritical_correct", acc.alias("overall_pct"))


# ---------------------------------------------------------------- waits
def _wait_ms(h: DataFrame) -> DataFrame:
    w = F.col("processed_ms") - F.unix_millis(F.col("ts"))
    return (h.filter(F.col("processed_ms").isNotNull() & F.col("ts").isNotNull())
            .withColumn("wait_ms", w.cast("double"))
            .filter(F.col("wait_ms") >= 0))


def queue_wait(h: DataFrame) -> DataFrame:
    """Processed time - routing time per queue: n, avg, min, max, p95."""
    w = _wait_ms(h).filter(F.col("target_queue").isin(URGENT_QUEUE, BATCH_QUEUE))
    a = w.groupBy("target_queue").agg(
        F.count(F.lit(1)).alias("n"), F.avg("wait_ms").alias("avg_ms"),
        F.min("wait_ms").alias("min_ms"), F.max("wait_ms").alias("max_ms"))
    return _with_percentiles(a, w, "wait_ms", (0.95,), ["target_queue"])


def priority_effectiveness(h: DataFrame) -> DataFrame:
    """A10: (batch avg wait - urgent avg wait) / batch avg wait x 100; NULL
    unless both queues have processed rows."""
    w = _wait_ms(h)
    a = w.agg(F.avg(F.when(F.col("target_queue") == URGENT_QUEUE, F.col("wait_ms"))).alias("urgent_avg_ms"),
              F.avg(F.when(F.col("target_queue") == BATCH_QUEUE, F.col("wait_ms"))).alias("batch_avg_ms"))
    eff = F.when(F.col("urgent_avg_ms").isNotNull() & F.col("batch_avg_ms").isNotNull(),
                 F.try_divide((F.col("batch_avg_ms") - F.col("urgent_avg_ms")) * F.lit(100.0),
                              F.col("batch_avg_ms")))
    return a.select("urgent_avg_ms", "batch_avg_ms", eff.alias("effectiveness_pct"))


# ---------------------------------------------------------------- types
def type_distribution(h: DataFrame) -> DataFrame:
    """Per message type (falsy -> 'unknown'): urgent, batch (= not urgent),
    total and the majority tag; ordered by total desc, then type."""
    t = F.coalesce(F.when(F.col("message_type") != "", F.col("message_type")), F.lit("unknown"))
    urgent = F.col("target_queue") == URGENT_QUEUE
    a = h.groupBy(t.alias("message_type")).agg(
        F.count_if(urgent).alias("urgent"),
        F.count_if(~urgent | F.col("target_queue").isNull()).alias("batch"))
    return (a.withColumn("total", F.col("urgent") + F.col("batch"))
             .withColumn("tag", F.when(F.col("urgent") > F.col("batch"), F.lit("urgent"))
                         .otherwise(F.lit("batch")))
             .orderBy(F.col("total").desc(), F.col("message_type")))


# ---------------------------------------------------------------- summary
def _summary_aggs() -> list[Column]:
    u = F.col("target_queue") == URGENT_QUEUE
    b = F.col("target_queue") == BATCH_QUEUE
    lat = _lat()
    crit = F.col("is_critical") == F.lit(True)
    ms = F.unix_millis(F.col("ts"))
    return [
        F.count(F.lit(1)).alias("total"),
        F.avg(lat).alias("avg_all"),
        F.avg(F.when(u, lat)).alias("avg_urgent"),
        F.avg(F.when(b, lat)).alias("avg_batch"),
        F.count(ms).alias("_nts"), F.min(ms).alias("_t0"), F.max(ms).alias("_t1"),
        F.count_if(crit).alias("_crit"),
        F.count_if(crit & u).alias("_crit_ok"),
        F.count_if(u).alias("urgent_count"),
        F.count_if(b).alias("batch_count"),
    ]


def benchmark_summary(h: DataFrame, rules_evaluated: int) -> DataFrame:
    """The summary table as (metric, value) rows from one aggregation."""
    p = exact_percentiles(clean_latency(h), "latency_ms", (0.95,), ["target_queue"])
    p = p.agg(F.max(F.when(F.col("target_queue") == URGENT_QUEUE, F.col("p95_ms"))).alias("p95_urgent"),
              F.max(F.when(F.col("target_queue") == BATCH_QUEUE, F.col("p95_ms"))).alias("p95_batch"))
    a = _join_null_safe(h.agg(*_summary_aggs()), p, [])   # one row and one row
    dur = F.when(F.col("_nts") > 1, (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)).otherwise(F.lit(1.0))
    acc = F.when(F.col("_crit") > 0, _pct(F.col("_crit_ok"), F.col("_crit"))).otherwise(F.lit(0.0))
    wide = a.select(
        F.col("total").cast("double").alias("total_messages"),
        F.coalesce("avg_all", F.lit(None)).alias("avg_latency_all_ms"),
        F.coalesce("avg_urgent", F.lit(0.0)).alias("avg_latency_urgent_ms"),
        F.coalesce("avg_batch", F.lit(0.0)).alias("avg_latency_batch_ms"),
        F.col("p95_urgent").cast("double").alias("p95_latency_urgent_ms"),
        F.col("p95_batch").cast("double").alias("p95_latency_batch_ms"),
        F.try_divide(F.col("total").cast("double"), dur).alias("throughput_per_s"),
        acc.alias("priority_accuracy_pct"),
        F.col("urgent_count").cast("double").alias("urgent_count"),
        F.col("batch_count").cast("double").alias("batch_count"),
        F.lit(float(rules_evaluated)).alias("rules_evaluated"),
    )
    names = wide.columns
    stack = "stack({}, {}) as (metric, value)".format(
        len(names), ", ".join(f"'{n}', `{n}`" for n in names))
    return wide.selectExpr(stack)


def _cohort_aggs() -> list[Column]:
    u = F.col("target_queue") == URGENT_QUEUE
    lat = _lat()
    crit = F.col("is_critical") == F.lit(True)
    ms = F.unix_millis(F.col("ts"))
    return [F.count(F.lit(1)).alias("n"), F.avg(lat).alias("avg_ms"),
            F.avg(F.when(u, lat)).alias("urgent_avg_ms"),
            F.count(ms).alias("_nts"), F.min(ms).alias("_t0"), F.max(ms).alias("_t1"),
            F.count_if(crit).alias("_crit"), F.count_if(crit & u).alias("_crit_ok")]


def compare_cohorts(h: DataFrame, smart_id: str, naive_id: str) -> DataFrame:
    """A13 + A14 + J5: both cohorts from ONE grouped aggregation (the filter on
    the two ids is pushed to the scan), folded to one row — no cross join."""
    both = h.filter(F.col("benchmark_id").isin(smart_id, naive_id))
    per = _with_percentiles(both.groupBy("benchmark_id").agg(*_cohort_aggs()), clean_latency(both),
                            "latency_ms", (0.95, 0.99), ["benchmark_id"])
    dur = F.when(F.col("_nts") > 1, (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)).otherwise(F.lit(1.0))
    per = per.select("benchmark_id", "n", "avg_ms", "urgent_avg_ms", "p95_ms", "p99_ms",
                     F.try_divide(F.col("n").cast("double"), dur).alias("thr"),
                     F.when(F.col("_crit") > 0, _pct(F.col("_crit_ok"), F.col("_crit")))
                      .otherwise(F.lit(0.0)).alias("acc"))
    s = F.col("benchmark_id") == smart_id
    nv = F.col("benchmark_id") == naive_id

    def side(cond, c):
        return F.max(F.when(cond, F.col(c)))
    row = per.agg(
        side(s, "n").alias("smart_messages"), side(nv, "n").alias("naive_messages"),
        side(s, "avg_ms").alias("smart_avg_ms"), side(nv, "avg_ms").alias("naive_avg_ms"),
        F.coalesce(side(s, "urgent_avg_ms"), F.lit(0.0)).alias("smart_urgent_avg_ms"),
        side(s, "p95_ms").alias("smart_p95_ms"), side(nv, "p95_ms").alias("naive_p95_ms"),
        side(s, "p99_ms").alias("smart_p99_ms"), side(nv, "p99_ms").alias("naive_p99_ms"),
        side(s, "thr").alias("smart_throughput"), side(nv, "thr").alias("naive_throughput"),
        side(s, "acc").alias("smart_accuracy_pct"))
    return improvement(row.withColumn("naive_accuracy_pct", F.lit(0.0)))


def improvement(row: DataFrame) -> DataFrame:
    """(naive - smart) / naive x 100 for avg and p95; (smart - naive) / naive
    x 100 for throughput; 0 when the base is not positive."""
    def imp(base, new, reverse=False):
        b, n = F.col(base), F.col(new)
        num = (n - b) if reverse else (b - n)
        return F.when(b > 0, F.try_divide(num * F.lit(100.0), b)).otherwise(F.lit(0.0))
    return (row.withColumn("latency_reduction_pct", imp("naive_avg_ms", "smart_avg_ms"))
               .withColumn("p95_improvement_pct", imp("naive_p95_ms", "smart_p95_ms"))
               .withColumn("throughput_change_pct",
                           imp("naive_throughput", "smart_throughput", reverse=True)))


def live_metrics(h: DataFrame, n: int = METRICS_WINDOW_ROWS) -> DataFrame:
    """Over the newest ``n`` rows (T2): total, avg latency, urgent, batch,
    accuracy (100 when no critical row) and throughput (duration >= 1 s);
    all zero when there is no row."""
    last = recent_history(h, n)
    u = F.col("target_queue") == URGENT_QUEUE
    crit = F.col("is_critical") == F.lit(True)
    ms = F.unix_millis(F.col("ts"))
    a = last.agg(F.count(F.lit(1)).alias("total_messages"),
                 F.avg(_lat()).alias("_avg"),
                 F.count_if(u).alias("urgent_count"),
                 F.count_if(F.col("target_queue") == BATCH_QUEUE).alias("batch_count"),
                 F.count_if(crit).alias("_crit"), F.count_if(crit & u).alias("_ok"),
                 F.count(ms).alias("_nts"), F.min(ms).alias("_t0"), F.max(ms).alias("_t1"))
    empty = F.col("total_messages") == 0
    dur = F.when(F.col("_nts") > 1, (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)).otherwise(F.lit(1.0))
    out = a.select(
        "total_messages",
        F.coalesce(F.col("_avg"), F.lit(0.0)).alias("avg_latency_ms"),
        "urgent_count", "batch_count",
        F.when(empty, F.lit(0.0)).when(F.col("_crit") > 0, _pct(F.col("_ok"), F.col("_crit")))
         .otherwise(F.lit(100.0)).alias("accuracy_pct"),
        F.when(empty, F.lit(0.0)).otherwise(
            F.try_divide(F.col("total_messages").cast("double"), F.greatest(dur, F.lit(1.0))))
         .alias("throughput"))
    # the view shows accuracy as healthy from 95 % up
    return out.withColumn("accuracy_ok", F.col("accuracy_pct") >= F.lit(ACCURACY_VIEW_THRESHOLD))


def queue_split(metrics: DataFrame) -> DataFrame:
    """Rounded shares ``round(x / (u + b or 1) x 100)`` for the pie."""
    den = F.col("urgent_count") + F.col("batch_count")
    den = F.when(den == 0, F.lit(1)).otherwise(den)
    return metrics.select(
        F.round(F.col("urgent_count").cast("double") / den * F.lit(100.0)).cast("long").alias("urgent_share"),
        F.round(F.col("batch_count").cast("double") / den * F.lit(100.0)).cast("long").alias("batch_share"))


def send_progress(h: DataFrame, every: int = 1000) -> DataFrame:
    """Cumulative sent count per cohort at every ``every``-th message and
    at the last one, with elapsed seconds and rate.  Running counts use the
    distributed ordered scan, so one large cohort is spread over many tasks."""
    ms = F.unix_millis(F.col("ts"))
    d = h.select("benchmark_id", "message_id", "ts", ms.alias("ts_ms"))
    s = ordered_scan(d, ["benchmark_id"], ["ts_ms", "message_id"], pos_col="sent")
    firsts = d.groupBy("benchmark_id").agg(F.min("ts_ms").alias("_t0"),
                                           F.count(F.lit(1)).alias("_total"))
    s = _join_null_safe(s, firsts, ["benchmark_id"], "inner")  # one row per cohort
    s = s.filter((F.col("sent") % every == 0) | (F.col("sent") == F.col("_total")))
    elapsed = (F.col("ts_ms") - F.col("_t0")) / F.lit(1000.0)
    return s.select("benchmark_id", "sent", elapsed.alias("elapsed_s"),
                    F.floor(F.try_divide(F.col("sent").cast("double"), elapsed)).cast("double").alias("rate"))


def publish_latency_summary(h: DataFrame) -> DataFrame:
    """Naive run's printout: avg, p95, floor(n / duration), accuracy 0."""
    ms = F.unix_millis(F.col("ts"))
    a = h.agg(F.count(F.lit(1)).alias("n"), F.avg(_lat()).alias("avg_ms"),
              F.min(ms).alias("_t0"), F.max(ms).alias("_t1"))
    a = _with_percentiles(a, clean_latency(h), "latency_ms", (0.95,))
    dur = (F.col("_t1") - F.col("_t0")) / F.lit(1000.0)
    return a.select("n", "avg_ms", "p95_ms",
                    F.floor(F.try_divide(F.col("n").cast("double"), dur)).cast("double").alias("throughput"),
                    F.lit(0.0).alias("accuracy_pct"))


def count_by_cohort(h: DataFrame) -> DataFrame:
    """Rows per benchmark id."""
    return h.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("n"))


def status_count(h: DataFrame) -> DataFrame:
    """Rows with status 'processed'."""
    return h.agg(F.count_if(F.col("status") == "processed").alias("total_processed"))
