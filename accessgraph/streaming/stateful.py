"""Stream operators whose state is a table: one step per micro-batch, from the state before to the state after.

A step reads the state that the batch before wrote and writes its outputs and
its own state under its batch number. A batch that is replayed after a failure
reads the same state and overwrites the same folders, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessgraph.functions.geo import haversine_m
from accessgraph.operators.tracks import CHUNK, GAP_SEC
from accessgraph.session import cut_lineage, durable_dir, written
from accessgraph.streaming.operators import combine_trip_islands
from accessgraph.streaming.sinks import BATCH

Outputs = dict[str, DataFrame]
Step = Callable[[DataFrame, DataFrame, datetime | None], tuple[DataFrame, Outputs]]
MARK = T.StructType([T.StructField("latest", T.TimestampType())])


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that wrote below a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


def _drop_batch(spark: SparkSession, folder: str, number: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{BATCH}={number}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def take_step(
    batch: DataFrame, number: int, folder: str, state: T.StructType, step: Step, event_time: str, lateness: timedelta
) -> None:
    """Run ``step`` for one micro-batch; running it again for the same number changes nothing.

    The step's third argument is the watermark: the latest event time of all
    batches before, less the lateness; null for the first. The state before
    last is deleted, as no replay can ask for it.
    """
    spark = batch.sparkSession
    earlier = [n for n in _batches(spark, f"{folder}/state") if n < number]
    if earlier:
        before = spark.read.schema(state).parquet(f"{folder}/state/{BATCH}={earlier[-1]}")
        latest = spark.read.schema(MARK).parquet(f"{folder}/marks/{BATCH}={earlier[-1]}").first()["latest"]
    else:
        before, latest = spark.createDataFrame([], state), None
    after, outputs = step(batch, before, None if latest is None else latest - lateness)
    for name, rows in outputs.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/{BATCH}={number}")
    passed = F.greatest(F.max(F.col(event_time).cast("timestamp")), F.lit(latest).cast("timestamp"))
    batch.agg(passed.alias("latest")).write.mode("overwrite").parquet(f"{folder}/marks/{BATCH}={number}")
    after.select([F.col(f.name).cast(f.dataType) for f in state]).write.mode("overwrite").parquet(f"{folder}/state/{BATCH}={number}")
    for old in earlier[:-1]:
        _drop_batch(spark, f"{folder}/state", old)


def run_steps(
    stream: DataFrame, folder: str, state: T.StructType, step: Step, event_time: str, lateness: timedelta, trigger: dict | None = None
):
    """Start a stream that takes a step per micro-batch; its outputs and ``state`` are folders below ``folder``."""
    return (
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda batch, number: take_step(batch, number, folder, state, step, event_time, lateness))
        .start()
    )


def drain_steps(
    stream: DataFrame, state: T.StructType, step: Step, event_time: str, lateness: timedelta = timedelta(0)
) -> Callable[[str], DataFrame]:
    """Process all available data; returns a function from an output's name, or ``state``, to its rows."""
    spark = stream.sparkSession
    folder = f"{durable_dir(spark)}/steps-{uuid4().hex}"
    run_steps(stream, folder, state, step, event_time, lateness).awaitTermination()

    def rows(name: str) -> DataFrame:
        numbers = _batches(spark, f"{folder}/{name}")
        if name == "state":
            return spark.read.schema(state).parquet(f"{folder}/state/{BATCH}={numbers[-1]}")
        return spark.read.parquet(f"{folder}/{name}")

    return rows


def _split_late(batch: DataFrame, event_time: str, watermark: datetime | None) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows at or before the watermark; a row without time is late."""
    late = F.col(event_time).isNull()
    if watermark is not None:
        late = late | (F.col(event_time) <= F.lit(watermark))
    return batch.where(~late), batch.where(late)


# --- segments -------------------------------------------------------------------------

SEGMENT = T.StructType(
    [T.StructField("trip_id", T.StringType())]
    + [T.StructField(n, T.TimestampType()) for n in ("started_at", "ended_at")]
    + [T.StructField(n, T.LongType()) for n in ("from_sequence", "to_sequence", "point_count")]
)


def joined_segments(parts: DataFrame, gap_sec: float, chunk_sec: int = 86_400) -> DataFrame:
    """Segments that overlap or follow within the gap, as one; a trip's order is kept in chunks of time.

    What starts in one chunk is joined there and written. Of each chunk only its last start and its farthest end
    are compared with the chunks before, which tells the segments of a chunk that go on from an earlier one.
    """
    order = ["started_at", "ended_at", "from_sequence", "to_sequence"]
    sums = (
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.min("from_sequence").alias("from_sequence"),
        F.max("to_sequence").alias("to_sequence"),
        F.sum("point_count").alias("point_count"),
    )
    group = ["trip_id", "_chunk"]

    def opens(start: str, reach: str) -> Column:
        micros = F.timestamp_diff("MICROSECOND", F.col(reach), F.col(start))
        return F.when(F.coalesce(micros > gap_sec * 1e6, F.lit(True)), F.col(start))

    chunked = parts.withColumn("_chunk", F.floor(F.unix_seconds("started_at") / F.lit(chunk_sec)))
    inside = Window.partitionBy(*group).orderBy(*order)
    seen = chunked.withColumn("_reach", F.max("ended_at").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("_opens", opens("started_at", "_reach"))
    seen = seen.withColumn("_group", F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = written(seen.groupBy(*group, "_group").agg(*sums).drop("_group"))

    before = Window.partitionBy("trip_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy(*group).agg(F.max("started_at").alias("_last"), F.max("ended_at").alias("_end"))
    ends = ends.withColumn("_reach", F.max("_end").over(before)).withColumn("_opens", opens("_last", "_reach"))
    carried = ends.select(F.col("trip_id").alias("_trip"), F.col("_chunk").alias("_part"), "_reach", F.max("_opens").over(before).alias("_open"))
    linked = local.join(carried, F.col("trip_id").eqNullSafe(F.col("_trip")) & (F.col("_chunk") == F.col("_part"))).withColumn("_group", F.coalesce(opens("started_at", "_reach"), "_open"))
    return linked.groupBy("trip_id", "_group").agg(*sums).drop("_group")


def segment_step(gap_sec: float = GAP_SEC) -> Step:
    """Closed ``segments`` and ``late`` points; the state holds the segments that a point in time can still join."""

    def step(batch: DataFrame, state: DataFrame, watermark: datetime | None) -> tuple[DataFrame, Outputs]:
        timely, late = _split_late(batch, "recorded_at", watermark)
        at = F.col("recorded_at").cast("timestamp")
        points = timely.groupBy("trip_id", at.alias("started_at")).agg(
            F.max(at).alias("ended_at"),
            F.min("sequence").alias("from_sequence"),
            F.max("sequence").alias("to_sequence"),
            F.count(F.lit(1)).alias("point_count"),
        )
        joined = written(joined_segments(state.unionByName(points), gap_sec))
        closed = F.lit(False)
        if watermark is not None:
            closed = F.col("ended_at") + F.make_dt_interval(secs=F.lit(gap_sec)) <= F.lit(watermark)
        return joined.where(~closed), {"segments": joined.where(closed), "late": late}

    return step


# --- trips ----------------------------------------------------------------------------

POINT = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("quality", T.StringType()),
        T.StructField("micros", T.LongType()),
    ]
)
RUNS = T.StructType(
    [T.StructField("trip_id", T.StringType()), T.StructField("chunk", T.LongType())]
    + [T.StructField(n, POINT) for n in ("first", "last")]
    + [T.StructField("point_count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("distance_m", "largest_gap_sec")]
    + [T.StructField(f"{q}_count", T.LongType()) for q in ("rejected", "weak", "good")]
)


def point_runs(points: DataFrame, chunk: int) -> DataFrame:
    """Every point as a run of its own; :func:`joined_runs` joins them with the runs before in one pass."""
    part = F.floor(F.col("sequence") / F.lit(chunk)).cast("long")
    micros = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    point = F.struct("sequence", "latitude", "longitude", "quality", micros.alias("micros"))
    return points.select(
        "trip_id", part.alias("chunk"), point.alias("first"), point.alias("last"), F.lit(1).cast("long").alias("point_count"),
        F.lit(0.0).alias("distance_m"), F.lit(0.0).alias("largest_gap_sec"),
        *[F.coalesce((F.col("quality") == q).cast("long"), F.lit(0)).alias(f"{q}_count") for q in ("rejected", "weak", "good")],
    )


def joined_runs(runs: DataFrame, gap_sec: float = GAP_SEC) -> DataFrame:
    """Runs that follow each other without a missing number, as one, with the hop between them."""
    # A chunk holds a bounded number of runs, so one window sees all of them and the totals need no other shuffle.
    inside = Window.partitionBy("trip_id", "chunk").orderBy("_from")
    seen = runs.withColumn("_from", F.col("first.sequence")).withColumn("_prev", F.lag("last").over(inside))
    follows = F.coalesce(F.col("_prev.sequence") + 1 == F.col("_from"), F.lit(False))
    kept = follows & (F.col("_prev.quality") != "rejected") & (F.col("first.quality") != "rejected")
    hop = haversine_m(F.col("_prev.latitude"), F.col("_prev.longitude"), F.col("first.latitude"), F.col("first.longitude"))
    gap = F.when(follows, (F.col("first.micros") - F.col("_prev.micros")) / 1e6)
    zero = F.lit(0.0)
    opened = seen.withColumns({"_hop": F.when(kept, hop), "_gap": gap, "_opens": F.when(~follows, F.col("_from"))})
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    grouped = opened.withColumn("_group", F.max("_opens").over(upto))
    sums = grouped.groupBy("trip_id", "chunk", "_group").agg(
        F.min_by("first", "_from").alias("first"),
        F.max_by("last", "_from").alias("last"),
        F.sum("point_count").alias("point_count"),
        (F.sum("distance_m") + F.coalesce(F.sum("_hop"), zero)).alias("distance_m"),
        F.greatest(F.max("largest_gap_sec"), F.coalesce(F.max(F.when(F.col("_gap") > gap_sec, F.col("_gap"))), zero)).alias("largest_gap_sec"),
        *[F.sum(f"{q}_count").alias(f"{q}_count") for q in ("rejected", "weak", "good")],
    )
    return sums.drop("_group")


def trip_step(pause_sec: float, gap_sec: float = GAP_SEC, chunk: int = CHUNK) -> Step:
    """One final row in ``trips`` when no point came for ``pause_sec``, and ``late`` points.

    The state holds the runs of consecutive points of open trips, joined where
    they meet, so a trip whose points come in order is a row per ``chunk``. A
    trip that goes on after the pause gets a row for each of its visits.
    """

    def step(batch: DataFrame, state: DataFrame, watermark: datetime | None) -> tuple[DataFrame, Outputs]:
        timely, late = _split_late(batch, "recorded_at", watermark)
        runs = written(joined_runs(state.unionByName(point_runs(timely, chunk)), gap_sec))
        if watermark is None:
            return runs, {"trips": combine_trip_islands(runs.limit(0), gap_sec), "late": late}
        last = runs.groupBy("trip_id").agg(F.max(F.greatest("first.micros", "last.micros")).alias("_last"))
        over = last.where(F.timestamp_micros(F.col("_last") + F.lit(int(pause_sec * 1e6))) <= F.lit(watermark)).select("trip_id")
        finished = runs.join(over, "trip_id", "left_semi")
        return runs.join(over, "trip_id", "left_anti"), {"trips": combine_trip_islands(finished, gap_sec), "late": late}

    return step


# --- conditions -----------------------------------------------------------------------

CONDITION = T.StructType([T.StructField("condition_id", T.StringType()), T.StructField("valid_to", T.TimestampType())])


def condition_step() -> Step:
    """``stale`` conditions (condition_id, valid_to, stale_at), each when the clock passes its ``valid_to``.

    Rows are (condition_id, valid_to, clock); rows without id only move the
    clock, such as those of a ``rate`` source, so a condition turns stale
    without any new condition. The clock never goes back. The state holds the
    conditions that are still valid; the latest ``valid_to`` given for an id in
    a batch replaces an earlier batch's, and null never ends.
    """

    def step(batch: DataFrame, state: DataFrame, watermark: datetime | None) -> tuple[DataFrame, Outputs]:
        given = batch.where(F.col("condition_id").isNotNull()).groupBy("condition_id").agg(
            F.max(F.coalesce("valid_to", F.lit(datetime(9999, 12, 31)))).cast("timestamp").alias("valid_to")
        )
        held = cut_lineage(state.join(given, "condition_id", "left_anti").unionByName(given))
        clock = batch.agg(F.greatest(F.max(F.col("clock").cast("timestamp")), F.lit(watermark).cast("timestamp")).alias("c")).first()["c"]
        over = F.lit(False) if clock is None else F.col("valid_to") <= F.lit(clock)
        return held.where(~over), {"stale": held.where(over).withColumn("stale_at", F.lit(clock).cast("timestamp"))}

    return step


# --- outbox ---------------------------------------------------------------------------


def deliver_batch(batch: DataFrame, number: int, folder: str, send: Callable[[DataFrame, int], None], key: str = "event_id") -> None:
    """Send the pending rows of a micro-batch that no other batch has sent, and acknowledge them.

    ``send(rows, number)`` must replace what it sent under the same number, as a
    write in overwrite mode does. Acknowledgements come after it, so a batch
    that failed between is sent again under its number, and a row that returns
    in a later batch is not.
    """
    spark = batch.sparkSession
    acks = f"{folder}/acks"
    sent = [n for n in _batches(spark, acks) if n != number]
    pending = batch.where(F.col("flushed_at").isNull() & F.col(key).isNotNull()).dropDuplicates([key])
    if sent:
        known = spark.read.parquet(*[f"{acks}/{BATCH}={n}" for n in sent]).select(key)
        pending = pending.join(known, key, "left_anti")
    pending = cut_lineage(pending)
    send(pending, number)
    pending.select(key, F.current_timestamp().alias("flushed_at")).write.mode("overwrite").parquet(f"{acks}/{BATCH}={number}")


def deliver_outbox(events: DataFrame, folder: str, send: Callable[[DataFrame, int], None], key: str = "event_id"):
    """Start a stream that delivers every pending row once; acknowledgements are kept below ``folder``."""
    return (
        events.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: deliver_batch(batch, number, folder, send, key))
        .start()
    )


def flushed(events: DataFrame, folder: str, key: str = "event_id") -> DataFrame:
    """Outbox rows with ``flushed_at`` set where they were delivered."""
    acks = events.sparkSession.read.parquet(f"{folder}/acks").select(key, F.col("flushed_at").alias("_at"))
    return events.join(acks, key, "left").withColumn("flushed_at", F.coalesce("flushed_at", "_at")).drop("_at")
