"""Line dedup: a line found in several documents stays only in the first of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import carried_out, durable, framed, lower_ascii

#: The white space that a line's key loses at its ends.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text` less its repeated lines, plus `n_lines` and `n_dropped`.

    Lines split at newline; a line's key is trimmed and A-Z lower-cased. Keys of at least min_chars code points
    found in at least min_docs documents (distinct ids) stay only in the smallest id that holds them. A null or
    empty text is one empty line and comes back as ''. A null id counts as one document, the smallest. Rows that
    repeat an id count once as a document, and each keeps or loses lines by its own text. Other columns pass through;
    n_lines and n_dropped replace columns so called.

    A key is carried as two 64-bit hashes of different seeds. The first aggregate combines before its shuffle, so
    a line held by a third of all documents reaches the reducers once a map task; the keys it finds are written to the
    shared folder, and the join with them is one that adaptive execution splits where it is skewed.
    """
    carried = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = framed(docs, carried, id_col, text_col).withColumn("_lines", F.split("_t", "\n"))
    key = line_key(F.col("_line"))
    found = (
        rows.select("_id", "_th", F.posexplode("_lines").alias("_pos", "_line"))
        .withColumn("_key", key)
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_th", "_pos", F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"))
    )
    if min_docs == 2:  # two documents hold it if the smallest and the largest id differ
        repeated = found.groupBy("_h1", "_h2").agg(F.min("_id").alias("_keep"), F.max("_id").alias("_last")).where("_keep < _last")
    else:
        repeated = (
            found.groupBy("_h1", "_h2", "_id").agg(F.lit(1).alias("_one"))
            .groupBy("_h1", "_h2").agg(F.min("_id").alias("_keep"), F.sum("_one").alias("_docs")).where(F.col("_docs") >= min_docs)
        )
    repeated = durable(repeated.select("_h1", "_h2", "_keep"))  # a table of its own, so that the join below can be split
    drop = (
        found.join(repeated, ["_h1", "_h2"])
        .where("_id > _keep")
        .groupBy("_id", "_th")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    rows = rows.select("_row", "_id", "_th", "_lines").join(drop, ["_id", "_th"], "left")
    all_pos = F.sequence(F.lit(0), F.size("_lines") - 1)
    rows = rows.withColumn("_left", F.when(F.col("_drop").isNull(), all_pos).otherwise(F.array_except(all_pos, "_drop")))
    whole = F.array_join("_lines", "\n")
    kept = F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n")
    return rows.select(
        *carried_out(carried),
        F.when(F.col("_drop").isNull(), whole).otherwise(kept).alias(text_col),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), counted AS (
  SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(c.n >= 2 AND k.doc_id <> c.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN counted c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
