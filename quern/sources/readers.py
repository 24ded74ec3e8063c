"""Sources and sinks: payload folders, text folders, evaluation files, synthetic and sample corpora, a paged REST source."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern import schemas

# ---------------------------------------------------------------- payload folders


def write_payloads(payloads: DataFrame, root: str, received: str = "received_at") -> None:
    """JSON payload rows into day folders; Spark's committer makes each write atomic."""
    payloads.withColumn("ingest_date", F.date_format(received, "yyyyMMdd")).write.partitionBy("ingest_date").mode("append").json(root)


def read_payloads(spark: SparkSession, root: str, schema: str = schemas.ISSUE) -> DataFrame:
    """Payloads of all days; what is not JSON comes as ``_corrupt_record``."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string, ingest_date string").option("mode", "PERMISSIVE").json(root)
    return rows


def replay(payloads: DataFrame, document: str, received: str = "received_at") -> DataFrame:
    """A document's payloads, newest first."""
    return payloads.where(F.col("document_id") == document).orderBy(F.desc(received))


def not_pull_requests(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("pull_request").isNull())


# ---------------------------------------------------------------- text and evaluation files


def read_texts(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """(doc_id, text) of a folder of text files, the id being the file's name without its ending."""
    rows = spark.read.text(f"{root}/{suffix}", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return rows.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a dataset file with the dataset's name and version."""
    data = spark.read.schema(schemas.DATASET).option("multiLine", True).json(path)
    return data.select(F.col("name").alias("dataset"), "version", F.explode("samples").alias("s")).select("dataset", "version", "s.*")


def write_samples(samples: DataFrame, path: str, name: str, version: str = "1.0") -> None:
    """One dataset document (an evaluation set is small by nature)."""
    columns = [f.split(" ", 1)[0] for f in schemas.SAMPLE.split(", ")]
    rows = samples.agg(F.array_sort(F.collect_list(F.struct(*columns[:4], *columns[4:5], "metadata")), _by_id).alias("samples")) if "metadata" in samples.columns else samples
    rows.select(F.lit(name).alias("name"), F.lit("").alias("description"), F.lit(version).alias("version"), F.current_timestamp().cast("string").alias("created_at"), F.array().cast("array<string>").alias("source_documents"), "samples").coalesce(1).write.mode("overwrite").json(path)


def _by_id(a, b):
    return F.when(a["sample_id"] < b["sample_id"], -1).when(a["sample_id"] > b["sample_id"], 1).otherwise(0)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a baseline or report file, which holds an object ``metrics``."""
    rows = spark.read.schema("name string, created_at string, metrics map<string,double>").option("multiLine", True).json(path)
    return rows.select(F.explode("metrics").alias("metric", "value"))


def write_metrics(metrics: DataFrame, path: str, name: str) -> None:
    row = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    row.select(F.lit(name).alias("name"), F.current_timestamp().cast("string").alias("created_at"), "metrics").coalesce(1).write.mode("overwrite").json(path)


def append_failures(failures: DataFrame, root: str) -> None:
    failures.write.mode("append").json(root)


def read_failures(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.FAILURE).json(root)


# ---------------------------------------------------------------- generated corpora


def synthetic_corpus(spark: SparkSession, count: int) -> DataFrame:
    """``count`` templated incident documents."""
    i = F.col("id")
    # fixed values: the template and the title
    body = F.format_string(
        "# Incident %d\n\nService degradation observed in region-%d. Root cause: memory pressure on node pool %d. Resolution: scale replicas and apply resource quotas.", i, i % 10, i % 50
    )
    return spark.range(count).select(F.format_string("synthetic-%06d", i).alias("doc_id"), F.format_string("Synthetic Runbook %d", i).alias("title"), body.alias("body"))


def sample_corpus(spark: SparkSession) -> DataFrame:
    """Two short documents to try things with."""
    rows = [
        ("cluster-incident", "Pods that would not start", "# Pods that would not start\n\nNew pods stayed pending although the cluster had room in total. Free memory was spread over many nodes in small pieces.\n\n## Fix\n\nQuotas were set, priorities given to critical pods, and workloads bound to suitable nodes."),
        ("async-guide", "Running coroutines well", "# Running coroutines well\n\nStart the event loop once, from the program's entry point. Keep one client session and reuse its connections.\n\n## Errors\n\nGather tasks so that one failure does not cancel the others, and set timeouts."),
    ]
    return spark.createDataFrame(rows, "doc_id string, title string, text string")


def sample_questions(spark: SparkSession) -> DataFrame:
    """Ten questions on the two documents, three of causes, two of fixes and five of how to do things."""
    incident, guide = "cluster-incident", "async-guide"
    short, quotas = "Free memory was spread over many nodes in small pieces.", "Quotas were set, priorities given to critical pods, and workloads bound to suitable nodes."
    loop, gather = "Start the event loop once, from the program's entry point.", "Gather tasks so that one failure does not cancel the others, and set timeouts."
    rows = [
        ("q1", "Why did new pods stay pending?", "Free memory was spread over many nodes.", [short], incident, {"task_type": "incident_rca"}),
        ("q2", "Did the cluster lack room in total?", "No, it had room in total.", ["New pods stayed pending although the cluster had room in total."], incident, {"task_type": "incident_rca"}),
        ("q3", "How was the free memory spread?", "In small pieces over many nodes.", [short], incident, {"task_type": "incident_rca"}),
        ("q4", "How were the pending pods fixed?", "Quotas, priorities and node binding.", [quotas], incident, {"task_type": "incident_resolution"}),
        ("q5", "Which pods were given priorities?", "The critical ones.", [quotas], incident, {"task_type": "incident_resolution"}),
        ("q6", "How should the event loop be started?", "Once, from the entry point.", [loop], guide, {"task_type": "how_to"}),
        ("q7", "How many client sessions should be kept?", "One, whose connections are reused.", ["Keep one client session and reuse its connections."], guide, {"task_type": "how_to"}),
        ("q8", "How are tasks gathered safely?", "So that one failure does not cancel the others.", [gather], guide, {"task_type": "how_to"}),
        ("q9", "What should be set besides gathering tasks?", "Timeouts.", [gather], guide, {"task_type": "how_to"}),
        ("q10", "Where does the event loop start?", "At the program's entry point.", [loop], guide, {"task_type": "how_to"}),
    ]
    return spark.createDataFrame(rows, schemas.SAMPLE)


def chunking_questions(spark: SparkSession) -> DataFrame:
    """Nine questions whose answers lie in different places of a text, to compare chunkings by."""
    rows = [
        ("c1", "What did the team see first?", "Requests timed out.", ["Requests timed out in the evening.", "The queue grew for an hour."], "outage", {}),
        ("c2", "How long did the queue grow?", "For an hour.", ["The queue grew for an hour."], "outage", {}),
        ("c3", "What caused the time-outs?", "A connection pool that was too small.", ["The connection pool was too small for the evening's load."], "outage", {}),
        ("c4", "What was changed?", "The pool was doubled and a limit set.", ["The pool was doubled, and a limit was set for waiting requests."], "outage", {}),
        ("c5", "How is a release built?", "By tagging a commit.", ["A release is built by tagging a commit."], "release", {}),
        ("c6", "Who approves a release?", "Two reviewers.", ["Two reviewers approve the tag before it is published."], "release", {}),
        ("c7", "How is a release undone?", "By publishing the tag before it.", ["To undo a release, publish the tag before it."], "release", {}),
        ("c8", "Which tests run before a release?", "The whole suite and a load test.", ["The whole suite and a load test run first."], "release", {}),
        ("c9", "When are releases made?", "On Tuesdays.", ["Releases are made on Tuesdays."], "release", {}),
    ]
    return spark.createDataFrame(rows, schemas.SAMPLE)


def list_sources(docs: DataFrame) -> DataFrame:
    """The catalogue: id, title, address and the first line as preview."""
    preview = F.substring(F.split(F.trim("text"), "\n")[0], 1, 120)
    return docs.select("doc_id", F.coalesce("title", "doc_id").alias("title"), F.concat(F.lit("/sources/"), "doc_id").alias("url"), preview.alias("preview"))


# ---------------------------------------------------------------- paged REST source


def next_link(header: str | None) -> str | None:
    """The address marked rel="next" in a Link header."""
    for part in (header or "").split(","):
        found = re.match(r'\s*<([^>]*)>\s*;.*rel="next"', part)
        if found:
            return found[1]
    return None


def rate_limit_wait(headers, now: float) -> float:
    """Seconds to wait: none unless the remaining calls are used up."""
    if headers.get("X-RateLimit-Remaining") != "0":
        return 0.0
    return max(0.0, float(headers.get("X-RateLimit-Reset", now)) - now)


def retry_wait(status: int, headers, now: float, attempt: int, most: int = 5) -> float | None:
    """Seconds until a refused request (403 or 429) is tried again, None if it is not: as the headers say, else doubling from a second."""
    if status not in (403, 429) or attempt >= most or (status == 403 and headers.get("X-RateLimit-Remaining") != "0" and not headers.get("Retry-After")):
        return None
    return float(headers.get("Retry-After") or 0) or rate_limit_wait(headers, now) or float(2**attempt)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split(" ") if u]
        self.token = options.get("token")

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition) -> Iterator[tuple]:
        for item in _items(partition.value, self.token):
            yield (json.dumps(item),)


def _items(url: str | None, token: str | None) -> Iterator[dict]:
    """The items of a listing's pages but pull requests; limits are waited for, refused requests made again."""
    attempt = 0
    while url:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        try:
            reply = urllib.request.urlopen(request, timeout=60)  # noqa: S310  the address is the user's own
        except urllib.error.HTTPError as refused:
            wait = retry_wait(refused.code, refused.headers, time.time(), attempt)
            if wait is None:
                raise
            attempt += 1
            time.sleep(wait)
            continue
        attempt = 0
        with reply:
            for item in json.load(reply):
                if "pull_request" not in item:
                    yield item
            url, wait = next_link(reply.headers.get("Link")), rate_limit_wait(reply.headers, time.time())
        if url and wait:
            time.sleep(wait)


class _NewPages(DataSourceStreamReader):
    """The items of each listing by the time of their last change: a batch is a span of time, its start included, and a partition a listing.

    A replayed batch asks for the same span. ``lag`` seconds keep the end of a span behind the clock, so that what the server
    stamps meanwhile belongs to the next; items without a time come with the first span.
    """

    def __init__(self, options):
        self.pages = _Pages(options)
        self.since, self.lag, self.changed = options.get("since", ""), float(options.get("lag", "60")), options.get("changed", "updated_at")

    def initialOffset(self) -> dict:
        return {"until": self.since}

    def latestOffset(self) -> dict:
        return {"until": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(time.time() - self.lag))}

    def partitions(self, start: dict, end: dict):
        return [InputPartition((url, start["until"], end["until"])) for url in self.pages.urls] if start["until"] < end["until"] else []

    def read(self, partition) -> Iterator[tuple]:
        url, start, end = partition.value
        if start:
            url += ("&" if "?" in url else "?") + "since=" + start
        for item in _items(url, self.pages.token):
            if start <= (item.get(self.changed) or "") < end:
                yield (json.dumps(item),)

    def commit(self, end: dict) -> None:
        pass


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("urls", "...")``: a row of JSON text for each item of a paged REST listing.

    With ``spark.readStream`` each run fetches what was changed since the one before (``since``, ``lag``, ``changed``: see ``_NewPages``).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NewPages(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
