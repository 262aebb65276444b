"""Rate audit of a request log, and the admission its limits make."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.settings import REQUESTS_PER_HOUR, REQUESTS_PER_MINUTE

MINUTE = 60_000_000
HOUR = 3_600_000_000


def rate_audit(requests: DataFrame, provider: str = "provider",
               per_minute: int = REQUESTS_PER_MINUTE, per_hour: int = REQUESTS_PER_HOUR) -> DataFrame:
    """For each request the earlier ones of its provider in the last minute (younger than 60 s)
    and hour (not older than 3600 s), and whether a limit over all of them, refused ones too, would
    let it through. ``admissions`` counts as a service does, only those let through.

    No window spans a provider's requests or even an hour of them. Requests are counted by minute;
    sums of these counts, one row per minute, give the minutes that count whole. Only the own
    minute and the ones the two spans begin in are looked at row by row: a request goes to its
    minute, and, as an event that ends, to the minute it leaves the last minute or hour in.
    """
    fields = F.struct(*requests.columns)
    micros, minute = F.col("micros"), F.col("minute")
    rows = requests.select(fields.alias("row"), F.col(provider).alias("key"), F.unix_micros("ts").alias("micros"))
    none = F.lit(None).cast(requests.schema)

    def event(at: Column, own: int, leaves_minute: int, leaves_hour: int, row: Column = none) -> Column:
        return F.struct(at.alias("at"), F.lit(own).alias("own"), F.lit(leaves_minute).alias("leaves_minute"),
                        F.lit(leaves_hour).alias("leaves_hour"), row.alias("row"))

    # An hour counts to its last microsecond, a minute ends before.
    events = rows.select("key", F.inline(F.array(
        event(micros, 1, 0, 0, F.col("row")), event(micros + MINUTE, 0, 1, 0),
        event(micros + HOUR + 1, 0, 0, 1)))).withColumn("minute", F.expr(f"at div {MINUTE}"))
    along = Window.partitionBy("key").orderBy("minute")
    left = events.groupBy("key", "minute").agg(*[F.sum(c).alias(c) for c in ("own", "leaves_minute", "leaves_hour")])
    # What is open at the start of a minute: all that came before, less all that left before.
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    open_ = left.select(
        F.col("key").alias("k"), F.col("minute").alias("m"),
        *[F.coalesce(F.sum(F.col("own") - F.col(c)).over(before), F.lit(0)).alias(f"open_{c}")
          for c in ("leaves_minute", "leaves_hour")])
    # The default frame of an ordered window includes rows with an equal time.
    within = Window.partitionBy("key", "minute").orderBy("at")
    counted = events.withColumns({c: F.sum(F.col("own") - F.col(c)).over(within) - 1
                                  for c in ("leaves_minute", "leaves_hour")}).where(F.col("row").isNotNull())
    found = counted.join(open_, F.col("key").eqNullSafe(F.col("k")) & (minute == F.col("m"))).select(
        "row.*", (F.col("leaves_minute") + F.col("open_leaves_minute")).alias("last_minute"),
        (F.col("leaves_hour") + F.col("open_leaves_hour")).alias("last_hour"))
    return found.withColumn(
        "allowed", (F.col("last_hour") < per_hour) & (F.col("last_minute") < per_minute))


class Admission:
    """Times let through in the last hour; at most ``per_hour`` are held."""

    def __init__(self, per_minute: int, per_hour: int) -> None:
        self.per_minute, self.per_hour = per_minute, per_hour
        self.times: deque[int] = deque()

    def admit(self, now: int) -> bool:
        times = self.times
        while times and now - times[0] > HOUR:
            times.popleft()
        if len(times) >= self.per_hour or self.per_minute <= 0:
            return False
        if len(times) >= self.per_minute and now - times[-self.per_minute] < MINUTE:
            return False
        times.append(now)
        return True


def admissions(requests: DataFrame, provider: str = "provider", id_col: str = "entry_id",
               per_minute: int = REQUESTS_PER_MINUTE, per_hour: int = REQUESTS_PER_HOUR) -> DataFrame:
    """Requests with ``admitted``: whether the limits let it through, when only requests let through
    count. Requests go by time, those of one instant by id, which is unique; a null provider is one of
    its own, a null time is refused.

    A refused request changes nothing, so the fold reads one number per instant and gives one for each
    instant that lets any through. After more than an hour without a request nothing is remembered: there a
    provider's times are cut into pieces that are folded apart. Gaps are found among the first and
    last request of each hour. A piece is streamed through its task in order, with at most
    ``per_hour`` times held.
    """
    key, micros = F.col(provider), F.unix_micros("ts")
    instants = requests.where("ts IS NOT NULL").groupBy(key.alias("key"), micros.alias("micros")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("hour", F.expr(f"micros div {HOUR}"))
    hours = instants.groupBy("key", "hour").agg(F.min("micros").alias("first"), F.max("micros").alias("last"))
    along = Window.partitionBy("key").orderBy("hour")
    cut = F.coalesce(F.col("first") - F.lag("last").over(along) > HOUR, F.lit(True))
    pieces = hours.withColumn("cut", cut.cast("int")).select(
        F.col("key").alias("k"), F.col("hour").alias("h"), F.sum("cut").over(along).alias("piece"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hour") == F.col("h"))
    ordered = (instants.join(pieces, same).select("key", "piece", "micros", "n")
               .repartition("key", "piece").sortWithinPartitions("key", "piece", "micros"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, Admission(per_minute, per_hour)
        for batch in batches:
            keys, places, times, counts = (c.to_pylist() for c in batch.columns)
            out = []
            for k, p, now, n in zip(keys, places, times, counts):
                if (k, p) != current:
                    current, state = (k, p), Admission(per_minute, per_hour)
                let = 0
                while let < n and state.admit(now):
                    let += 1
                if let:
                    out.append((k, now, let))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((batch.schema.types[0], pa.int64(), pa.int64()))],
                ["k", "m", "let"])

    kind = requests.schema[provider].dataType.simpleString()
    let = ordered.mapInArrow(fold, f"k {kind}, m long, let long")
    # Of an instant only as many rows as can be let through are numbered; each task keeps no more.
    turn = F.row_number().over(Window.partitionBy("key", "micros").orderBy(id_col))
    numbered = requests.where("ts IS NOT NULL").select(key.alias("key"), micros.alias("micros"), id_col).withColumn("turn", turn).where(
        F.col("turn") <= max(1, min(per_minute, per_hour)))
    found = numbered.join(let, F.col("key").eqNullSafe(F.col("k")) & (F.col("micros") == F.col("m"))).where(
        F.col("turn") <= F.col("let")).select(id_col, F.lit(True).alias("admitted"))
    return requests.join(found, id_col, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
