"""Operations: traces, metric series, health, latency summaries, intents, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.staging import join_groups, order_statistics, percentiles

# The phrases of each intent.
GREETING = r"(?i)^\s*(hi|hello|hey|yo|howdy|hola|good\s+(morning|afternoon|evening)|thanks|thank\s+you|thx|ok|okay|cool|great|nice)[\s!.?]*$"
CAPABILITY = (
    r"(?i)(what(?:\s+\w+){0,3}\s+(can|could|should)\s+(i|you)\s+(ask|do|help|query|offer|cover)|what\s+are\s+the\s+things|^\s*what\s+(else|more)[\s?!.]*$|"
    r"what\s+(topics?|things|docs?|documents?|subjects?)\b|what\s+is\s+this\s+(for|about)|what\s+do\s+you\s+(know|cover|contain|do|support)|how\s+can\s+you\s+help|"
    r"\b(help|capabilities|who\s+are\s+you)\b|hey\s+what\s+can|tell\s+me\s+what\s+you|anything\s+else\s+you\s+can)"
)
OFF_TOPIC = (
    r"(?i)(\b(weather|stock|crypto|bitcoin|joke|poem|recipe|sports?|movie|celebrity|dating|homework|write\s+(me\s+)?(code|essay)|translate|who\s+won|latest\s+news)\b)"
)
CHATTER = ["hey", "hi", "hello", "sup", "yo", "thanks", "bye"]


def intent(question: Column) -> Column:
    """greeting, capability, off_topic or rag."""
    text = T.strip(F.coalesce(question, F.lit("")))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    plain = T.tokens(text)
    short = (F.size(plain) <= 2) & (F.size(plain) > 0) & F.get(plain, F.lit(0)).isin(CHATTER)
    return (
        F.when(text == "", "capability")
        .when(text.rlike(GREETING), "greeting")
        .when(text.rlike(CAPABILITY), "capability")
        .when(text.rlike(OFF_TOPIC) & (words < 16), "off_topic")
        .when(F.coalesce(short, F.lit(False)), "greeting")
        .otherwise("rag")
    )


# The answers to what is not a question about the corpus.
GUIDE = {
    "greeting": "Hello! Ask a question about the indexed documents.",
    "capability": "I answer questions about the indexed documents, with citations.",
    "off_topic": "That is outside the indexed documents.",
}


def guide(questions: DataFrame) -> DataFrame:
    """Questions with their intent and, unless it is rag, the canned answer."""
    rows = questions.withColumn("intent", intent(F.col("query")))
    answer = F.lit(None).cast("string")
    for k, v in GUIDE.items():
        answer = F.when(F.col("intent") == k, F.lit(v)).otherwise(answer)
    return rows.withColumn("guide_answer", answer)


# ---------------------------------------------------------------- traces and metrics


def traces(spans: DataFrame) -> DataFrame:
    """A row for each trace: spans, start, duration (the longest span), and error if any span failed."""
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.min("start_ts").alias("start_ts"), F.max("duration_ms").alias("duration_ms"),
        F.when(F.bool_or(F.col("status") == "error"), "error").otherwise("ok").alias("status"),
    )


def recent_traces(spans: DataFrame, limit: int = 50) -> DataFrame:
    return traces(spans).orderBy(F.desc("start_ts"), "trace_id").limit(limit)


def histograms(observations: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """p50, p95, count and sum of each series."""
    rows = observations.groupBy(*keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = join_groups(rows, percentiles(observations, keys, value, (0.5, 0.95)), keys)
    return rows.withColumn("p50", F.col("p")[0]).withColumn("p95", F.col("p")[1]).drop("p", "n")


def registry(observations: DataFrame) -> DataFrame:
    """Samples (name, labels, stat, value): counters summed, gauges at their last value, histograms as p50, p95 and count.

    ``observations`` has name, labels (a map), kind, value and ts.
    """
    key = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",").alias("labels")
    rows = observations.select("name", key, "kind", "value", "ts")
    counters = rows.where("kind = 'counter'").groupBy("name", "labels").agg(F.sum("value").alias("value")).withColumn("stat", F.lit(""))
    gauges = rows.where("kind = 'gauge'").groupBy("name", "labels").agg(F.max_by("value", "ts").alias("value")).withColumn("stat", F.lit(""))
    held = histograms(rows.where("kind = 'histogram'"), ["name", "labels"]).withColumn("count", F.col("count").cast("double")).unpivot(["name", "labels"], ["p50", "p95", "count"], "stat", "value")
    columns = ["name", "labels", "stat", "value"]
    return counters.select(columns).unionByName(gauges.select(columns)).unionByName(held.select(columns))


def exposition(samples: DataFrame) -> DataFrame:
    """Text lines of a metrics page: name{labels} value."""
    stat = F.when(F.col("stat") != "", F.concat(F.lit('stat="'), F.col("stat"), F.lit('"')))
    labels = F.concat_ws(",", F.when(F.col("labels") != "", F.col("labels")), stat)
    shown = F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise("")
    return samples.select(F.concat("name", shown, F.lit(" "), F.col("value").cast("string")).alias("line"))


def layer_latencies(observations: DataFrame, layer: str = "layer", value: str = "value") -> DataFrame:
    return histograms(observations, [layer], value)


def success_rate(rows: DataFrame, ok: Column) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("errors"))
    return counts.withColumn("success_rate", F.round((F.col("total") - F.col("errors")) / F.greatest(F.col("total"), F.lit(1)), 4))


def system_health(components: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The worst component's status: unhealthy over degraded over healthy."""
    severity = F.max(F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0))
    return components.groupBy(*(keys or [])).agg(severity.alias("s")).withColumn("status", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("s") + 1)).drop("s")


def load_summary(latencies: DataFrame, keys: list[str], value: str = "latency_ms", ok: Column | None = None) -> DataFrame:
    """Requests, errors, mean, median, p95 by index (not interpolated) and requests a second of summed latency."""
    good = latencies if ok is None else latencies.where(ok)
    rows = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("success"), F.avg(value).alias("avg_ms"), F.try_divide(F.count(F.lit(1)), F.sum(value) / 1000).alias("qps"))
    rows = join_groups(rows, order_statistics(good, keys, value, ["(n - 1) * 0.5D", "greatest(1, floor(n * 0.95D)) - 1"]), keys)
    rows = rows.withColumn("p50_ms", F.col("p")[0]).withColumn("p95_ms", F.col("p")[1]).drop("p", "n")
    all_ = latencies.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))
    return join_groups(all_, rows, keys).withColumn("errors", F.col("requests") - F.coalesce("success", F.lit(0)))


# ---------------------------------------------------------------- capacity

# Corpus tiers and the model's constants.
TIERS = [("10K", 10_000), ("100K", 100_000), ("1M", 1_000_000), ("10M", 10_000_000)]


def capacity(spark: SparkSession, chunks_per_doc: int = 8, dimensions: int = 768, bytes_per_float: int = 4) -> DataFrame:
    """Storage, build time, query latency and bottlenecks of each tier."""
    rows = spark.createDataFrame(TIERS, "tier string, documents long").withColumn("chunks", F.col("documents") * chunks_per_doc)
    mb = lambda b: b / F.lit(1024 * 1024)
    rows = rows.withColumn("vector_mb", mb(F.col("chunks") * dimensions * bytes_per_float)).withColumn("metadata_mb", mb(F.col("chunks") * 2048))
    rows = rows.withColumn("storage_mb", F.col("vector_mb") + F.col("metadata_mb")).withColumn("build_minutes", F.col("chunks") / 1000 * 0.5)
    rows = rows.withColumn("query_p95_ms", 5 + F.col("documents") / 10_000 * 2)
    flags = [("vector_index_size", F.col("documents") >= 100_000), ("keyword_rebuild", F.col("documents") >= 1_000_000), ("embedding_throughput", F.col("documents") >= 10_000_000), ("disk_budget", F.col("storage_mb") > 500)]
    return rows.withColumn("bottlenecks", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags))), ","))
