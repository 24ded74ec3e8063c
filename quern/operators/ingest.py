"""Ingestion: payload validation, transformation, change detection, versions, run events.

Tables are append-only or rewritten as new snapshots; nothing is updated in place. A batch is
validated into good rows and failures, compared with the active versions, and only new or changed
documents get a version.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.schemas import ERROR_CODES

# Payload limits.
MAX_TITLE, MAX_BODY, MAX_URL, MAX_LABELS, MAX_LOGIN = 256, 65535, 2048, 100, 39


# ---------------------------------------------------------------- validation


def _checks(comment: bool) -> list[tuple[str, str, Column]]:
    """(field, kind of error, fails) in the order in which fields are declared; the first that fails names the error."""
    missing = lambda c: (c, "missing", F.col(c).isNull())
    too_long = lambda c, n: (c, "too_long", F.length(c) > n)
    late = lambda c: F.length(c) - F.length(F.regexp_replace(F.substring(F.col(c), 11, 1 << 20), "-", "")) > F.least(F.length(c), F.lit(10))
    stamp = lambda c: (c, "value_error", (F.col(c) == "") | ~(F.endswith(F.col(c), F.lit("Z")) | F.contains(F.col(c), F.lit("+")) | late(c)))
    # an id that came as text must be a whole number
    whole_number = F.regexp_replace(F.col("id").cast("string"), r"^[+-]?\d{1,18}$", "") == ""
    out = [missing("id"), ("id", "type", ~whole_number), ("id", "greater_than", F.col("id").try_cast("long") <= 0), missing("html_url"), too_long("html_url", MAX_URL), ("html_url", "value_error", ~F.contains(F.lower("html_url"), F.lit("github")))]
    out += [] if comment else [too_long("title", MAX_TITLE)]
    out += [too_long("body", MAX_BODY), missing("created_at"), stamp("created_at"), missing("updated_at"), stamp("updated_at")]
    out += [missing("user"), ("user.login", "missing", F.col("user.login").isNull()), ("user.login", "too_short", F.length("user.login") < 1), too_long("user.login", MAX_LOGIN)]
    if comment:
        return [*out, too_long("issue_url", MAX_URL)]
    return [
        *out, ("labels", "too_long", F.size("labels") > MAX_LABELS), too_long("repository_url", MAX_URL), ("number", "greater_than", F.col("number") <= 0),
        ("state", "pattern_mismatch", ~F.col("state").isin("open", "closed")),
    ]


# The error code of each kind of failure; the rest are schema mismatches.
_CODES = {"missing": "validation_missing_required_field", "type": "validation_invalid_field_type", "too_long": "validation_payload_too_large", "value_error": "validation_field_constraint"}


def validate(payloads: DataFrame, comment: bool = False) -> DataFrame:
    """Payload rows with ``error_field``, ``error_kind``, ``error_code`` and ``error_category``, null where valid.

    A ``_corrupt_record`` column, as a permissive JSON scan gives it, counts as malformed.
    """
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"))) for field, kind, bad in _checks(comment)])
    if "_corrupt_record" in payloads.columns:
        first = F.when(F.col("_corrupt_record").isNotNull(), F.struct(F.lit("").alias("field"), F.lit("malformed").alias("kind"))).otherwise(first)
    rows = payloads.withColumn("__bad", first)
    kind = F.col("__bad.kind")
    code = F.when(kind == "malformed", "validation_malformed_json")
    for k, c in _CODES.items():
        code = code.when(kind == k, c)
    code = F.when(F.col("__bad").isNotNull(), code.otherwise("validation_schema_mismatch"))
    return rows.select("*", F.col("__bad.field").alias("error_field"), kind.alias("error_kind"), code.alias("error_code")).withColumn("error_category", error_category(F.col("error_code"))).drop("__bad")


def error_category(code: Column) -> Column:
    """The category that a code's prefix names; anything unknown is internal."""
    prefix = F.substring_index(code, "_", 1)
    known = F.when(prefix == "infra", "infrastructure").when(prefix.isin([c for c in ERROR_CODES if c != "infra"]), prefix).otherwise("internal")
    return F.when(code.isNotNull(), known)


def is_retryable(code: Column) -> Column:
    return error_category(code) == "transient"


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA-256 of a text's UTF-8 bytes."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda byte: F.lit(bytes(k ^ byte for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signature_ok(message: Column, signature: Column, secret: str | None) -> Column:
    """Is a payload signed (``sha256=`` and the HMAC) with the secret? Without a secret everything is."""
    if not secret:
        return F.lit(True)
    return F.coalesce(F.lower(signature) == F.concat(F.lit("sha256="), hmac_sha256(message, secret)), F.lit(False))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    errors = ["error_field", "error_kind", "error_code", "error_category"]
    return validated.where("error_code is null").drop(*errors), validated.where("error_code is not null")


# ---------------------------------------------------------------- transformation


def sorted_json_hash(column: Column) -> Column:
    """SHA-256 of a JSON text rewritten with sorted keys; keys are sorted at every level, which column expressions cannot do for unknown fields."""

    @F.pandas_udf("string")
    def run(payload: pd.Series) -> pd.Series:
        distinct = {p: hashlib.sha256(json.dumps(json.loads(p), sort_keys=True).encode()).hexdigest() for p in payload.dropna().unique()}
        return payload.map(distinct)

    return run(column)


def payload_hash(rows: DataFrame) -> Column:
    """Hash of a payload's own fields, in name order: JVM-side and stable under field order."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)


def parse_time(value: Column, now: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(value), now)


def to_documents(payloads: DataFrame, source_type: str, tenant: str | None = None, now: Column | None = None, raw: str | None = None) -> DataFrame:
    """Documents with their version columns (body_text, hash_payload, valid_from) from valid payloads.

    ``raw`` names a column with the payload's JSON text, whose sorted form is then hashed.
    """
    now = F.current_timestamp() if now is None else now
    external, owner = F.col("id").cast("string"), F.col("user.login")
    issue = source_type == "github_issue"
    extra = {"repo": F.col("repository_url"), "issue_number": F.col("number").cast("string"), "state": F.col("state"), "is_pull_request": F.col("pull_request").isNotNull().cast("string")} if issue else {"issue_url": F.col("issue_url")}
    digest = sorted_json_hash(F.col(raw)) if raw else payload_hash(payloads)
    body = F.coalesce("body", F.lit(""))
    return payloads.select(
        T.document_id(F.lit(source_type), external, F.lit(tenant).cast("string")).alias("document_id"), external.alias("external_id"), (F.col("title") if issue else F.lit(None).cast("string")).alias("title"),
        F.lit(source_type).alias("source_type"), F.col("html_url").alias("source_uri"), F.lit(tenant).cast("string").alias("tenant_id"), F.array(owner).alias("owners"),
        (F.transform("labels", lambda x: x["name"]) if issue else F.lit(None).cast("array<string>")).alias("labels"),
        F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v)]).alias("extra"), T.sha256_text(body).alias("hash_content"),
        parse_time(F.col("created_at"), now).alias("created_at"), parse_time(F.col("updated_at"), now).alias("updated_at"), now.alias("ingested_at"), F.lit("received").alias("lifecycle_state"),
        body.alias("body_text"), digest.alias("hash_payload"), now.alias("valid_from"),
    )


# ---------------------------------------------------------------- versions


def active_versions(versions: DataFrame) -> DataFrame:
    """The active version of each document, the highest index if several claim to be."""
    top = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_index")))
    return versions.where("is_active").withColumn("__turn", top).where("__turn = 1").drop("__turn")


def detect_changes(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Incoming documents with ``outcome`` (new, changed, skipped_no_change) and the active index."""
    active = active_versions(versions).select("document_id", F.col("hash_payload").alias("active_hash"), F.col("version_index").alias("active_index"))
    rows = incoming.join(active, "document_id", "left")
    outcome = F.when(F.col("active_hash").isNull(), "new").when(F.col("active_hash") == F.col("hash_payload"), "skipped_no_change").otherwise("changed")
    return rows.withColumn("outcome", outcome)


def build_versions(history: DataFrame, keys: tuple[str, ...] = ("document_id",), order: str = "valid_from", digest: str = "hash_payload") -> DataFrame:
    """Versions from a history of deliveries: a delivery equal to the one before is dropped, the rest are numbered and closed by the next.

    An edit back to an earlier content is a version of its own.
    """
    w = Window.partitionBy(*keys).orderBy(order, digest)
    changed = history.withColumn("__before", F.lag(digest).over(w)).where(~F.col(digest).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")
    following = F.lead(order).over(w)
    return changed.withColumn("version_index", F.row_number().over(w)).withColumn("valid_to", following).withColumn("is_active", following.isNull())


def apply_changes(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """The version table after a batch: new and changed documents get the next index, their old version is closed."""
    fresh = changed.where("outcome <> 'skipped_no_change'")
    closing = fresh.where("outcome = 'changed'").select("document_id", F.col("valid_from").alias("__closed"))
    old = versions.join(closing, "document_id", "left")
    close = F.col("is_active") & F.col("__closed").isNotNull()
    old = old.withColumn("valid_to", F.when(close, F.col("__closed")).otherwise(F.col("valid_to"))).withColumn("is_active", F.col("is_active") & ~close).drop("__closed")
    index = F.coalesce(F.col("active_index"), F.lit(0)) + 1
    new = fresh.withColumn("version_index", index.cast("int")).withColumn("version_id", T.uuid5(T.DOCUMENT_NAMESPACE, F.concat_ws(":", "document_id", index.cast("string"), "hash_payload")))
    new = new.withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("is_active", F.lit(True)).withColumn("source_payload_uri", F.lit(None).cast("string"))
    return old.unionByName(new.select(*versions.columns))


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table after an upsert: incoming rows win except for ``keep`` columns of rows that exist."""
    new = incoming.select(F.struct(*incoming.columns).alias("new"), F.col(key).alias("__k"))
    old = current.select(F.struct(*current.columns).alias("old"), F.col(key).alias("__k"))
    rows = old.join(new, "__k", "full")
    pick = lambda c: F.when(F.col("new").isNull() | (F.lit(c in keep) & F.col("old").isNotNull()), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return rows.select(*(pick(c).alias(c) for c in current.columns))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the table does not have, each key once."""
    return incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")


def mark(rows: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """Rows with changes applied where the key is among the ids."""
    flagged = rows.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    for c, v in changes.items():
        old = F.col(c) if c in rows.columns else F.lit(None)
        flagged = flagged.withColumn(c, F.when(F.col("__hit"), v).otherwise(old))
    return flagged.drop("__hit")


def latest_state(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, state)).alias(state))


# ---------------------------------------------------------------- runs


def transitions(events: DataFrame, key: str = "run_id", at: str = "event_ts", status: str = "status", tie: str | None = None) -> DataFrame:
    """Status changes with the status before and the milliseconds since the run's previous event; repeats of a status are dropped."""
    order = [at] + ([tie] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("previous_status", F.lag(status).over(w)).withColumn("__before", F.lag(at).over(w))
    micros = F.unix_micros(F.col(at)) - F.unix_micros(F.col("__before"))
    rows = rows.withColumn("duration_since_previous_ms", F.floor(micros / 1000).cast("long")).drop("__before")
    return rows.where(~F.col(status).eqNullSafe(F.col("previous_status")) | F.col("previous_status").isNull())


def run_states(events: DataFrame) -> DataFrame:
    """Current state of each run: last status, other columns as last given, retries, start and end."""
    last = lambda c: F.max_by(c, F.struct("event_ts", "status")).alias(c)
    kept = [c for c in events.columns if c not in ("run_id", "event_ts", "status")]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("event_ts", "status"))).alias(c) for c in kept]
    done = F.max(F.when(F.col("status").isin("registered", "skipped_no_change", "failed"), F.col("event_ts"))).alias("finished_at")
    return events.groupBy("run_id").agg(last("status"), *filled, F.min("event_ts").alias("started_at"), done, F.count_if(F.col("status") == "retry").alias("retry_count"))


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0, **equal: str | None) -> DataFrame:
    """A page of runs, newest first, by any of the equality conditions."""
    for column, value in equal.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs.orderBy(F.desc("started_at"), "run_id").offset(offset).limit(limit)


def count_by(rows: DataFrame, column: str, since: str | None = None, at: str = "started_at", source: str | None = None) -> DataFrame:
    if since:
        rows = rows.where(F.col(at) >= F.lit(since).cast("timestamp"))
    if source:
        rows = rows.where(F.col("source_type") == source)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def not_corrupt(payloads: DataFrame) -> DataFrame:
    """Payload columns alone, without what a permissive scan adds."""
    return payloads.drop("_corrupt_record")


# ---------------------------------------------------------------- lookups


def document(documents: DataFrame, document_id: str | None = None, source_uri: str | None = None) -> DataFrame:
    """A document by id or by address."""
    rows = documents if document_id is None else documents.where(F.col("document_id") == document_id)
    return rows if source_uri is None else rows.where(F.col("source_uri") == source_uri)


def active_version(versions: DataFrame, document_id: str) -> DataFrame:
    return active_versions(versions.where(F.col("document_id") == document_id))


def latest_payload(payloads: DataFrame, document_id: str) -> DataFrame:
    return payloads.where(F.col("document_id") == document_id).orderBy(F.desc("received_at")).limit(1)


def exists(rows: DataFrame, key: str, value: str) -> bool:
    return not rows.where(F.col(key) == value).isEmpty()


def chunks_of_document(chunks: DataFrame, versions: DataFrame, document_id: str, active_only: bool = True) -> DataFrame:
    """A document's chunks in order, by default those of its active version."""
    rows = chunks.where(F.col("document_id") == document_id)
    if active_only:
        rows = rows.join(versions.where("is_active").select("version_id"), "version_id", "left_semi")
    return rows.orderBy("version_id", "chunk_index")


def active_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """The chunks of all active versions."""
    return chunks.join(versions.where("is_active").select("version_id"), "version_id", "left_semi")


def delete_version_chunks(chunks: DataFrame, version_id: str) -> DataFrame:
    return chunks.where(~F.col("version_id").eqNullSafe(F.lit(version_id)))


def retry_after(code: Column, attempt: Column, delay: int = 60, most: int = 3) -> Column:
    """Seconds until the next attempt, null if the error is not worth one or the attempts are used up."""
    return F.when(is_retryable(code) & (attempt < most), F.lit(delay))
