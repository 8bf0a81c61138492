"""Streaming queries, run to completion over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.bars import arrival_order
from barloom.plans import datasets as data
from barloom.plans import sql
from barloom.plans.features import INTRADAY
from barloom.plans.ingestion import _CLASSES, _ERRORS, scratch
from barloom.plans.quality import RAW
from barloom.plans.raw import raw_bars
from barloom.plans.stateful import FOLD
from barloom.session import use_utc
from barloom.sources import tables
from barloom.streaming import bars as stream_bars
from barloom.streaming import cooldown as stream_cooldown
from barloom.streaming import ingest as stream_ingest

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@query("st02_stream_bars", sql.with_(sql.M15) + """
SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE""")
def st02_stream(spark: SparkSession, folder: str) -> DataFrame:
    """15-minute bars of the event stream; the bars still open at the end stay in the state."""
    use_utc(spark)
    schema = tables.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    ticks = events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), arrival_order(F.col("ts").cast("timestamp"), F.col("event_id")).alias("seq"),
        (100 + F.col("value") / 50).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))
    out = scratch(spark, "stream-bars")
    run = stream_bars.write_once(stream_bars.stream_bars(ticks, "15m"), f"{out}/data", f"{out}/log")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query("st03_late_and_revised", RAW + "," + _ERRORS + "," + _CLASSES + """
SELECT 'bars' AS kind, count(*) AS rows FROM kept UNION ALL SELECT 'revisions', count(*) FROM cls WHERE c = 'revision' UNION ALL SELECT 'quarantine', count(*) FROM errs WHERE k > 0""")
def st03(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bars arriving in two parts; the copies come with the second one."""
    out = scratch(spark, "stream-ingest")
    raw = raw_bars(spark, folder).drop("fault", "slot")
    sink = stream_ingest.keep_first(f"{out}/store")
    _feed([raw.filter(F.col("copy") == k).drop("copy") for k in (0, 1)], f"{out}/in", lambda arriving: arriving.writeStream.foreachBatch(
        sink).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start())
    kinds = None
    for kind in ("bars", "revisions", "quarantine"):
        part = spark.read.parquet(f"{out}/store/{kind}").agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit(kind))
        kinds = part if kinds is None else kinds.unionByName(part)
    return kinds


_COPIES = """cuts AS (SELECT min(ts) + (max(ts) - min(ts)) / 3 AS a FROM raw),
fed AS (SELECT symbol, ts, copy, copy = 1 AND ts < a - INTERVAL 3 DAY AS late FROM raw, cuts WHERE copy = 0 OR ts < a - INTERVAL 3 DAY OR (ts >= a - INTERVAL 1 DAY AND ts < a))"""


@query("st03_first_copies", RAW + "," + _COPIES + """
SELECT 'first' AS kind, count(*) AS rows FROM (SELECT DISTINCT symbol, ts FROM fed WHERE NOT late)
UNION ALL SELECT 'late', count(*) FROM fed WHERE late
UNION ALL SELECT 'copies', (SELECT count(*) FROM fed WHERE NOT late) - (SELECT count(*) FROM (SELECT DISTINCT symbol, ts FROM fed WHERE NOT late))""")
def st03_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Bars in three parts: the second brings copies of the last day before it, the third copies that are too late.

    First copies pass, copies within the watermark are dropped by state, and the late ones, which the
    state no longer knows, are counted by the stream.
    """
    out = scratch(spark, "stream-copies")
    raw = stream_bars.with_event_time(raw_bars(spark, folder).drop("fault", "slot"))
    first, last = raw.agg(F.min("ts"), F.max("ts")).first()
    a, b = first + (last - first) / 3, first + (last - first) * 2 / 3
    ts, again = F.col("ts"), F.col("copy") == 1
    day = F.expr("INTERVAL 1 DAY")
    parts = [
        raw.filter(~again & (ts < F.lit(a))),
        raw.filter((~again & (ts >= F.lit(a)) & (ts < F.lit(b))) | (again & (ts >= F.lit(a) - day) & (ts < F.lit(a)))),
        raw.filter((~again & (ts >= F.lit(b))) | (again & (ts < F.lit(a) - 3 * day))),
    ]
    fed = late = 0
    for part in parts:
        part.drop("copy").write.mode("append").parquet(f"{out}/in")
        fed += part.count()
        arriving = spark.readStream.schema(part.drop("copy").schema).parquet(f"{out}/in")
        run = stream_bars.write_once(stream_bars.first_copies(arriving), f"{out}/data", f"{out}/log")
        run.awaitTermination()
        late += sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    kept = spark.read.schema(parts[0].drop("copy").schema).parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("kept"))
    return kept.select(F.explode(F.array(
        F.struct(F.lit("first").alias("kind"), F.col("kept").alias("rows")), F.struct(F.lit("late").alias("kind"), F.lit(late).cast("long").alias("rows")),
        F.struct(F.lit("copies").alias("kind"), (F.lit(fed - late) - F.col("kept")).alias("rows")))).alias("x")).select("x.*")


def _feed(parts: Iterable[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let the parts arrive one after the other, each as many files as it has tasks; the query takes up where it stopped."""
    for part in parts:
        part.write.mode("append").parquet(path)
        start(part.sparkSession.readStream.schema(part.schema).parquet(path)).awaitTermination()


def _by_time(rows: DataFrame, parts: int, ts: str = "ts", ends: tuple | None = None) -> Iterator[DataFrame]:
    """The rows in order of time: equal spans between the first and the last, the ends open."""
    first, last = ends or rows.agg(F.min(ts), F.max(ts)).first()
    cuts = [None, *(first + (last - first) * k / parts for k in range(1, parts)), None]
    for a, b in zip(cuts, cuts[1:]):
        part = rows
        part = part if a is None else part.filter(F.col(ts) >= F.lit(a))
        yield part if b is None else part.filter(F.col(ts) < F.lit(b))


_DELAY_MINUTES = 180
_LATE = "bar_no % 40 = 7"


@query("st04_stream_cooldown", INTRADAY + """,
src AS MATERIALIZED (SELECT symbol, ts, radar_score AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM snap),
""" + FOLD + f"""
SELECT symbol, ts, score, decision FROM fold WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM src) - INTERVAL {_DELAY_MINUTES} MINUTE
UNION ALL SELECT symbol, ts, radar_score, 'LATE' FROM snap WHERE {_LATE.replace("bar_no", "n")} AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 3 FROM snap) - INTERVAL 1 DAY""")
def st04_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The cooldown as keyed state over signals that arrive up to two hours out of order.

    Some signals of the first third come once more with the last part and are late.  Signals whose
    step the watermark has not passed stay undecided.
    """
    out = scratch(spark, "stream-cooldown")
    snaps = data.snapshot_rows(spark, folder).select("symbol", "timeframe", "ts", F.col("radar_score").cast("long").alias("score"), "bar_no")
    noise = F.make_interval(mins=F.pmod(F.xxhash64("symbol", "ts"), F.lit(120)).cast("int"))
    arrivals = snaps.withColumn("arrival", F.col("ts") + noise)
    first, last = snaps.agg(F.min("ts"), F.max("ts")).first()
    third = first + (last - first) / 3
    again = arrivals.filter(_LATE).filter(F.col("ts") < F.lit(third) - F.expr("INTERVAL 1 DAY")).withColumn("arrival", F.lit(last))
    parts = _by_time(arrivals.unionByName(again), 3, "arrival", (first, last))
    _feed((p.drop("arrival", "bar_no") for p in parts), f"{out}/in", lambda arriving: stream_bars.write_once(
        stream_cooldown.stream_decisions(arriving, delay_minutes=_DELAY_MINUTES), f"{out}/data", f"{out}/log"))
    return spark.read.parquet(f"{out}/data").select("symbol", "ts", "score", "decision")
