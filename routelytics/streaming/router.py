"""Continuous routing (ST1, S1/S2, K1-K3, R13, ST8) with Structured Streaming.

``readStream`` -> stamp receipt -> (parse / validate when the input is raw
text) -> route -> ``foreachBatch``: the routed queues, the dead letters and the
history are written in the same micro-batch, each into its own ``batch_id=<n>``
folder, and published by one commit, so readers (``sinks.commits.read_committed``)
see all three or none, and a replayed batch replaces what a failed attempt left or,
after its commit, changes nothing.  Rules are re-read at the start of every micro-batch, so rule
changes reach the router (the intended behaviour of the cache invalidation).
"""

from __future__ import annotations

import time
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TOPIC
from ..operators.history import to_history
from ..operators.quality import dead_letters, parse_and_validate, split_valid
from ..operators.routing import delivery_priority, route, route_as_of, route_json
from ..operators.rules import RuleVersions
from ..schemas import MESSAGE
from ..sinks.commits import CommitLog


def rules_from_table(spark, path: str) -> Callable[[], object]:
    """A loader that re-reads the rule table (S4) each time it is called;
    the router calls it at the start of every micro-batch, so a change written
    to the table (``rules.apply_rule_changes`` then ``seed.write_rules``) is
    used by the next batch."""
    from ..operators.rules import collect_rules, load_rules
    return lambda: collect_rules(load_rules(spark, path))


def stamp_received(df: DataFrame) -> DataFrame:
    """Receipt time (one value per micro-batch)."""
    return df.withColumn("received_at", F.current_timestamp())


def from_variant(df: DataFrame, v: str = "v", schema=MESSAGE) -> DataFrame:
    """Typed message columns from a parsed VARIANT (missing -> NULL)."""
    names = {"risk_score": "riskScore", "user_id": "userId", "benchmark_id": "benchmarkId",
             "is_critical": "isCritical", "ts": "timestamp"}
    cols = []
    for f in schema.fields:
        key = names.get(f.name, f.name)
        t = f.dataType.simpleString()
        if f.name == "ts":
            c = F.coalesce(F.try_variant_get(F.col(v), f"$.{key}", "timestamp"),
                           F.try_variant_get(F.col(v), f"$.{f.name}", "timestamp"))
        else:
            c = F.coalesce(F.try_variant_get(F.col(v), f"$.{key}", t),
                           F.try_variant_get(F.col(v), f"$.{f.name}", t))
        cols.append(c.alias(f.name))
    return df.select(*cols, *[c for c in df.columns if c not in {f.name for f in schema.fields} and c != v])


def routing_batch(rules_loader: Callable[[], object], out_dir: str,
                  prepare: Callable[[DataFrame], DataFrame] | None = None,
                  raw: bool = False, step: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body: route one micro-batch and write queues, dead letters and
    history for it (K1, K2, K3), published by one commit (``sinks.commits``).  ``step``:
    called after every write (tests inject failures there).  A loader that gives
    ``RuleVersions`` has typed messages routed as of their stamps, so a replayed log
    routes as it did then."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, out_dir, step)
        if log.committed(batch_id):                 # a replay after the commit
            return
        received = time.time()                      # receipt of this micro-batch
        rules = rules_loader()                      # R13: fresh rules per batch
        kept, entries = [], {}

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]
        try:
            if raw:
                checked = keep(parse_and_validate(batch))   # one parse per message
                good, bad = split_valid(checked)
                # rejected before routing: the letter's origin is the topic, no queue
                entries |= log.write(batch_id, {"dead_letters": dead_letters(bad, TOPIC)})
                # rules see the JSON values themselves (null, types, any field), and the
                # typed columns are taken from the routed message
                routed = from_variant(route_json(good, rules)).drop("matched_position")
                routed = prepare(routed) if prepare is not None else routed
            else:
                rows = keep(batch) if prepare is None else prepare(keep(batch))
                routed = route_as_of(rows, rules) if isinstance(rules, RuleVersions) else route(rows, rules)
            routed = keep(routed.drop("matched_position").withColumn("delivery_priority", delivery_priority(F.col("target_queue"))))
            entries |= log.write(batch_id, {"routed": (routed, ["target_queue"])})
            # latency = queue write done - receipt, as publish - receipt in the
            # source; every message of a micro-batch shares its batch's value
            published_ms = round((time.time() - received) * 1000.0, 3)
            if "latency_ms" not in routed.columns:
                routed = routed.withColumn("latency_ms", F.lit(published_ms))
            # history has the routing time, not the message's own stamp
            at = F.col("received_at") if "received_at" in routed.columns else F.current_timestamp()
            entries |= log.write(batch_id, {"history": to_history(routed.withColumn("routed_at", at))})
            log.publish(batch_id, entries)
        finally:
            for df in reversed(kept):
                df.unpersist()
    return run


def route_stream(stream: DataFrame, rules_loader: Callable[[], object], out_dir: str,
                 checkpoint: str, prepare=None, raw: bool = False,
                 available_now: bool = False, processing_time: str | None = None):
    """ST1: start the routing query; returns the StreamingQuery."""
    w = (stamp_received(stream).writeStream
         .foreachBatch(routing_batch(rules_loader, out_dir, prepare, raw))
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def console_sink(stream: DataFrame, checkpoint: str):
    """K5: print parsed messages (demo / debugging)."""
    return (stream.writeStream.format("console").option("truncate", "false")
            .option("checkpointLocation", checkpoint).start())
