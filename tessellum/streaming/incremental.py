"""Incremental operators: activity buckets, job tables, invalidation, and their Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators.ranking import global_rank
from tessellum.plans.catalog import NOW, Tables, query

_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"


@query("STM08_import_activity", f"WITH s AS (SELECT unnest(generate_series({_NOW} - INTERVAL 29 DAY, {_NOW}, INTERVAL 1 DAY)) AS day) SELECT CAST(s.day AS TIMESTAMP) AS day, count(b.id) AS imports FROM s LEFT JOIN bot_packages b ON date_trunc('day', b.created) = s.day GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Daily buckets, the empty ones too: rows are grouped first and then joined to the spine."""
    now = f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}'"
    spine = t.spark.sql(f"SELECT explode(sequence({now} - interval 29 days, {now}, interval 1 day)) AS day")
    counts = t.bot_packages.groupBy(F.date_trunc("day", "created").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("imports"))
    return spine.join(counts, "day", "left").na.fill(0, ["imports"])


@query("JN11_hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("JN11_hourly_series", "WITH b AS (SELECT date_trunc('hour', min(ts)) AS low, max(ts) AS high FROM events), s AS (SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS hour FROM b) SELECT CAST(s.hour AS TIMESTAMP) AS hour, count(e.event_id) AS n FROM s LEFT JOIN events e ON e.ts >= s.hour AND e.ts < s.hour + INTERVAL 1 HOUR GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Every hour of the events with their number, the empty ones too: rows are grouped first and then joined to the series."""
    counts = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    spine = t.events.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("low"), F.max("ts").cast("timestamp_ntz").alias("high")).select(F.explode(F.expr("sequence(low, high, interval 1 hour)")).alias("hour"))
    return spine.join(counts, "hour", "left").na.fill(0, ["n"])


@query("STM02_deduplicated_jobs", "SELECT name, checkout_dir, max(priority) AS priority, min(id) AS job FROM bot_packages WHERE indexed IS NULL OR state = 'new' GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.where("indexed IS NULL OR state = 'new'").groupBy("name", "checkout_dir").agg(F.max("priority").alias("priority"), F.min("id").alias("job"))


@query("STM04_coalesced_requests", "SELECT name, max(created) AS requested, max(priority) AS priority, count(*) AS requests FROM bot_packages GROUP BY name")
def _(t: Tables) -> DataFrame:
    return t.bot_packages.groupBy("name").agg(F.max("created").alias("requested"), F.max("priority").alias("priority"), F.count("*").alias("requests"))


@query("STM05_snapshot", "SELECT package, count(*) FILTER (WHERE generation = 0) AS live, count(*) FILTER (WHERE generation <> 0) AS building FROM pattern_matches GROUP BY package")
def _(t: Tables) -> DataFrame:
    return t.pattern_matches.groupBy("package").agg(F.count_if(F.col("generation") == 0).alias("live"), F.count_if(F.col("generation") != 0).alias("building"))


@query("STM06_abandoned", "SELECT DISTINCT m.package, m.generation FROM pattern_matches m JOIN bot_packages b ON b.id = m.package WHERE m.generation <> 0 AND b.indexed IS NOT NULL")
def _(t: Tables) -> DataFrame:
    settled = t.bot_packages.where("indexed is not null").select(F.col("id").alias("package"))
    return t.pattern_matches.where("generation <> 0").select("package", "generation").distinct().join(settled, "package", "left_semi")


@query("STM07_invalidated", f"SELECT DISTINCT m.package FROM pattern_matches m JOIN license_patterns p ON p.id = m.pattern WHERE p.created > {_NOW} - INTERVAL 365 DAY")
def _(t: Tables) -> DataFrame:
    changed = t.license_patterns.where(F.col("created") > F.expr(f"timestamp_ntz'{NOW:%Y-%m-%d %H:%M:%S}' - interval 365 days")).select(F.col("id").alias("pattern"))
    return t.pattern_matches.select("package", "pattern").distinct().join(changed, "pattern", "left_semi").select("package").distinct()


@query("STM09_drain_order", "SELECT id, (row_number() OVER (ORDER BY id DESC) - 1) // 100 AS batch FROM snippets WHERE NOT classified")
def _(t: Tables, size: int = 100) -> DataFrame:
    """Batches of pending snippets, newest first. Places come from range partitions, not from one sorted task."""
    pending = t.snippets.where(~F.col("classified")).select("id")
    return global_rank(pending, [F.desc("id")]).select("id", F.expr(f"(place - 1) div {size}").alias("batch"))


def activity(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and event type of a stream with `ts`, for events that are not later than `late`."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(stream: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key of a stream, with state that the watermark bounds."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder of Parquet files as a stream, a file at a time."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
