"""The vector collection as a table: upsert, delete, lookup, metadata flattening, per-document re-indexing.

Records are (id, embedding, metadata map, document). Every operation takes the current table and
returns the next; ``SnapshotTable`` keeps the versions on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quern.operators.embedding import Backend, EmbeddingModel, embed
from quern.operators.search import where_metadata
from quern.operators.snapshots import Conflict, Snapshots, SnapshotTable
from quern.operators.staging import stored


def check_dimensions(records: DataFrame, dimensions: int, embedding: str = "embedding") -> DataFrame:
    """The records; a row of another dimension fails the job."""
    size = F.size(embedding)
    wrong = F.raise_error(F.format_string(f"embedding has %d dimensions, not {dimensions}", size)).cast("boolean")
    return records.where(F.when(size == dimensions, True).otherwise(wrong))


def upsert_vectors(current: DataFrame, incoming: DataFrame, dimensions: int | None = None, key: str = "id", order: str | None = None) -> DataFrame:
    """Incoming records replace those with their id; of several for an id the last by ``order`` counts."""
    if dimensions is not None:
        incoming = check_dimensions(incoming, dimensions)
    by = F.desc(order) if order else F.lit(0)
    tagged = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), by))
    return tagged.withColumn("__turn", turn).where("__turn = 1").drop("__turn", "__new")


def delete_vectors(current: DataFrame, ids: DataFrame | None = None, conditions: Mapping[str, object] | None = None, key: str = "id") -> DataFrame:
    """Records without those named by ids or, if none are given, without those that match the conditions."""
    if ids is not None:
        return current.join(ids.select(key), key, "left_anti")
    if not conditions:
        raise ValueError("give ids or conditions")
    gone = where_metadata(current, conditions).select(key)
    return current.join(gone, key, "left_anti")


def by_document(current: DataFrame, document: str) -> DataFrame:
    return where_metadata(current, {"document_id": document})


def replace_documents(current: DataFrame, incoming: DataFrame, document: str = "document_id") -> DataFrame:
    """Re-indexing: all records of the incoming documents are replaced by the incoming ones."""
    return current.join(incoming.select(document).distinct(), document, "left_anti").unionByName(incoming)


def index_documents(current: DataFrame, chunks: DataFrame, model: EmbeddingModel, make: Callable[[], Backend] | None = None, metadata: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index documents: embed their chunks, replace their records, mark the chunks; returns the next collection, the marked chunks and the counts.

    ``chunks`` has document_id, chunk_id and text. All three tables follow from the same rows and nothing is written
    here, so a job that fails anywhere leaves the old snapshots. The counts are a row (indexed, replaced).
    """
    embedded = stored(check_dimensions(embed(chunks, model, make), model.dimensions))
    payload = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("document_id", *metadata))), lambda e: e["value"].isNotNull()))
    records = embedded.select(F.col("chunk_id").alias("id"), "embedding", payload.alias("metadata"), F.col("text").alias("document"), "document_id")
    old = current.withColumn("document_id", F.col("metadata")["document_id"])
    gone = old.join(chunks.select("document_id").distinct(), "document_id", "left_semi").agg(F.count(F.lit(1)).alias("replaced"))
    counts = embedded.agg(F.count(F.lit(1)).alias("indexed")).crossJoin(gone)
    return replace_documents(old, records).drop("document_id"), embedded.withColumns({"embedded": F.lit(True), "indexed": F.lit(True), "embedding_model": F.lit(model.name)}).drop("embedding"), counts


def remove_documents(current: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The collection without the documents (document_id), and how many records went, a row (removed)."""
    held = current.withColumn("document_id", F.col("metadata")["document_id"])
    gone = held.join(documents.select("document_id").distinct(), "document_id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return held.join(documents.select("document_id").distinct(), "document_id", "left_anti").drop("document_id"), gone


def statistics(current: DataFrame) -> DataFrame:
    """A row of (records, documents, dimensions) of a collection."""
    return current.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(F.col("metadata")["document_id"]).alias("documents"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"))


def flatten_metadata(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(other columns, metadata map<string,string>): null leaves out, lists joined by commas, structs one level deep."""
    parts: list[tuple[str, Column]] = []
    for field in rows.schema[metadata].dataType.fields:
        value = F.col(f"{metadata}.{field.name}")
        if isinstance(field.dataType, StructType):
            scalar = [f for f in field.dataType.fields if not isinstance(f.dataType, (StructType, ArrayType, MapType))]
            parts += [(f"{field.name}_{f.name}", value[f.name]) for f in scalar]
        elif isinstance(field.dataType, ArrayType):
            parts.append((field.name, F.array_join(F.transform(value, lambda x: x.cast("string")), ",")))
        else:
            parts.append((field.name, value))
    entries = F.array(*(F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in parts))
    flat = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.withColumn(metadata, flat)


def vector_payload(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunk rows with the flat columns stored next to a vector: empty strings for what is missing, lists joined."""
    texts = ["source_type", "source_uri", "tenant_id", "section_header", "service", "component"]
    lists = ["tags", "labels"]
    out = chunks
    for c in texts:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in chunks.columns else F.lit(""))
    for c in lists:
        out = out.withColumn(c, F.coalesce(F.array_join(F.col(c), ","), F.lit("")) if c in chunks.columns else F.lit(""))
    return out.withColumn("embedding_model", F.lit(model)).withColumn("embedding_dimensions", F.lit(dimensions))


def resolve_document(metadata: Column, chunk_id: Column, known: list[str]) -> Column:
    """A known document id from metadata keys, else one named anywhere in chunk id or metadata, else empty."""
    keys = ("source_doc_id", "external_id", "document_key", "doc_id")
    direct = F.coalesce(*[F.when(metadata[k].isin(known), metadata[k]) for k in keys])
    blob = F.lower(F.concat_ws(" ", chunk_id.cast("string"), F.map_keys(metadata), F.map_values(metadata)))
    named = F.coalesce(*[F.when(F.contains(blob, F.lit(d.lower())), F.lit(d)) for d in known])
    return F.coalesce(direct, named, F.lit(""))


__all__ = ["check_dimensions", "upsert_vectors", "delete_vectors", "by_document", "replace_documents", "index_documents", "remove_documents", "statistics", "flatten_metadata", "vector_payload", "Conflict", "Snapshots", "SnapshotTable", "resolve_document"]
