"""Line deduplication across documents.

Lines are exploded as narrow rows (id, position, 128-bit hash of the normalised line); a hash is
shared if the smallest and the largest id that hold it differ, which one map-side combined
aggregation answers; lines that are very frequent are dropped by a broadcast, the others in a
join; the positions to drop are gathered for each document and the text is reassembled by position
from the original row. Texts move once, to meet their positions.

Edge cases: a null text is one empty line; lines whose key is shorter than ``min_chars`` always
stay; repeated lines of the keeping document all stay; an empty table gives an empty result;
repeated rows of one id count as one document and get the same result each; rows with a null id
keep all lines and hold no line for others. All columns stay; where one is called ``n_lines`` or
``n_dropped`` already, in any case, the new one gets an underscore behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import BLANKS, ascii_lower, free, hash128, join_spread, land, whole


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, pos, h1, h2) of every line that can be dropped."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(whole(text_col), "\n")).alias("pos", "line"))
    keys = rows.select("id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("id", "pos", *hash128(F.col("key")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with its columns, the text rewritten, plus ``n_lines`` and ``n_dropped``.

    A line found in at least ``min_docs`` documents stays only in the document with the smallest id.
    """
    lines = land(line_hashes(docs, id_col, text_col, min_chars), "lines")
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).where("first < last")
    else:
        holders = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
        shared = holders.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    shared = land(shared.select("h1", "h2", "first", "rows"), "shared")
    dropped = join_spread(lines, shared, ["h1", "h2"], "rows").where(F.col("id") != F.col("first"))
    key, drop, number, new = free([*docs.columns, "n_lines", "n_dropped"], "holder", "drop", "number", "new")
    places = dropped.groupBy(F.col("id").alias(key)).agg(F.collect_set("pos").alias(drop))
    split = F.split(whole(text_col), "\n")
    last = (F.size(split) - 1).cast("int")
    joined = docs.join(places, docs[id_col] == F.col(key), "left")
    # array_except works by hash set, so this is linear in the lines of a document
    keep = F.array_except(F.sequence(F.lit(0), last), F.col(drop))
    text = F.when(F.col(drop).isNull(), whole(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: split[i]), "\n"))
    out = joined.withColumn(number, F.size(split).cast("long")).withColumn(new, text)
    columns = [F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    n_lines, n_dropped = free(docs.columns, "n_lines", "n_dropped")
    return out.select(*columns, F.col(number).alias(n_lines), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped))
