"""Training events: the same steps over a batch and over a stream of (run, seq, event, split, step, epoch, ...) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENT = "run bigint, seq bigint, event string, split string, step string, epoch string, loss_nats_per_token double, bits_per_base double, learning_rate double, tokens_per_second double"
BEST = "run bigint, step bigint, bits_per_base double, best double, improved boolean"


def metric_rows(events: DataFrame) -> DataFrame:
    """``run, seq, step, epoch, metric, value``: train and eval events as metrics; other events give none.

    Steps and epochs count only if they are whole numbers. Validation metrics are listed under ``eval/`` too.
    """
    whole = lambda c: F.when(F.col(c).cast("string").rlike("^-?[0-9]+$"), F.col(c).cast("bigint"))
    item = lambda name, col: F.struct(name.alias("metric"), F.col(col).alias("value"))
    train = F.array(*(item(F.lit(f"train/{n}"), c) for n, c in (("loss", "loss_nats_per_token"), ("bpb", "bits_per_base"), ("lr", "learning_rate"), ("tokens_per_second", "tokens_per_second"))))
    of = lambda p: [item(F.concat(p, F.lit(f"/{n}")), c) for n, c in (("loss", "loss_nats_per_token"), ("bpb", "bits_per_base"))]
    eval_ = F.array(*of(F.col("split")))
    val = F.array(*of(F.col("split")), *of(F.lit("eval")))
    items = F.when(F.col("event") == "train", train).when((F.col("event") == "eval") & (F.col("split") == "val"), val).when(F.col("event") == "eval", eval_)
    return events.select("run", "seq", whole("step").alias("step"), whole("epoch").alias("epoch"), F.explode(items).alias("m")).select("run", "seq", "step", "epoch", "m.*").filter("value is not null")


def undelivered(events: DataFrame, delivered: int | None) -> DataFrame:
    """Events after those already delivered (``seq`` counts from 1); all of them if that is unknown."""
    return events if delivered is None else events.filter(F.col("seq") > delivered)


def best_validation(events: DataFrame, delivered: int | None) -> DataFrame:
    """Per run: the best validation bits per base among new events (else among old ones), and over all."""
    val = (F.col("event") == "eval") & (F.col("split") == "val")
    new = F.col("seq") > (delivered or 0)
    of = lambda cond: F.min(F.when(val & cond, F.col("bits_per_base")))
    return events.groupBy("run").agg(F.coalesce(of(new), of(~new)).alias("reported_best"), F.min(F.when(val, F.col("bits_per_base"))).alias("true_best"))


def running_best(events: DataFrame) -> DataFrame:
    """Each validation with the best before it and whether it is strictly better."""
    val = events.filter((F.col("event") == "eval") & (F.col("split") == "val")).select("run", F.col("step").cast("bigint").alias("step"), "seq", "bits_per_base")
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.min("bits_per_base").over(w)
    v = val.withColumns({"improved": before.isNull() | (F.col("bits_per_base") < before), "best": F.least("bits_per_base", before)})
    return v.select("run", "step", "bits_per_base", "best", "improved")


def running_best_stream(events: DataFrame) -> DataFrame:
    """``running_best`` with one number of state per run; micro-batches are put in order by ``seq``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        best = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples():
            improved = best is None or r.bits_per_base < best
            best = r.bits_per_base if improved else best
            out.append((key[0], r.step, r.bits_per_base, best, improved))
        state.update((best,))
        yield pd.DataFrame(out, columns=["run", "step", "bits_per_base", "best", "improved"])

    val = events.filter((F.col("event") == "eval") & (F.col("split") == "val")).select("run", "seq", F.col("step").cast("bigint").alias("step"), "bits_per_base")
    return val.groupBy("run").applyInPandasWithState(step, BEST, "best double", "append", "NoTimeout")


def throughput(intervals: DataFrame, batch: int, length: int, k: int, world: int = 1) -> DataFrame:
    """Tokens and bases per second of logging intervals (``steps``, ``seconds``)."""
    t = F.lit(batch * length * world) * F.col("steps") / F.greatest(F.col("seconds"), F.lit(1e-12))
    return intervals.withColumns({"tokens_per_second": t, "bases_per_second": t * k})
