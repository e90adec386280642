"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words and so an expected number of copies of each of its documents. These
are summed up along the source's documents, one random offset is added, and a document is emitted once for
each integer that the sum crosses. Documents stand in order of size (to two digits), so that the words taken
come near the target too.

The prefix sum needs no task that sees a whole source: documents are counted by source, size and some digits
of a hash, the counts are summed up within each size and the sizes within each source, and in such a chunk
documents are numbered on their own. The digits grow with the table, so a chunk doesn't.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Share of 4096 from three hexadecimal digits.
OFFSET = "(256 * (instr('0123456789abcdef', substr({0}, 1, 1)) - 1) + 16 * (instr('0123456789abcdef', substr({0}, 2, 1)) - 1) + instr('0123456789abcdef', substr({0}, 3, 1)) - 1) / 4096D"


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """key, source_size, target of each source: shares by weight, none above `most` times its size, the excess shared anew.

    sizes: key, source, size. Works on one row a source. Sources stand by code point, null last, and take the weights in turn.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", most * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("w"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return rows.select("key", "source_size", F.least(F.col("most").cast("double"), level * F.col("w")).alias("target"), "source")


CHUNK = 1 << 16  #: documents of one size and source that one task may number, about


def copies(docs: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs, and those columns of docs named in `keep`, as the struct `kept`.

    size counts words [^\\x20\\x09-\\x0D]+; null and empty text: 0. A null source is a source of its own, last.
    Without any words, all targets are 0. Repeated rows are sampled each on its own. The result depends on
    ids, texts, sources and seed alone, so reruns agree. docs is read three times (once for its number of rows), so
    it should be a stored table.
    """
    n = docs.count()
    digits = 2 + max(0, ceil(log(max(1, n / CHUNK), 16)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), text).cast("binary")).alias("hash"), F.struct(*keep).alias("kept"),
    ).withColumns({
        "key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
        "band": (F.length(F.col("size").cast("string")) * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int")),
        "chunk": F.substring("hash", 1, digits),
    })
    band, chunk = ["key", "band"], ["key", "band", "chunk"]
    counts = cut(sizes.groupBy(*chunk, "source").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    goals = cut(targets(counts, most, weights))
    earlier = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = cut(counts.groupBy(*band).agg(F.sum("n").alias("n")).select(*band, earlier(["key"], "band").alias("behind")))
    counts = cut(counts.select(*chunk, earlier(band, "chunk").alias("before")).join(bands, band).select(*chunk, (F.col("before") + F.col("behind")).alias("before")))
    ranked = sizes.withColumn("k", F.row_number().over(Window.partitionBy(*chunk).orderBy("hash", "size", F.col("doc_id")))).join(counts, chunk)
    ranked = ranked.select("doc_id", "size", "key", (F.col("k") + F.col("before")).alias("k"), "kept")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.expr(OFFSET.format(f"md5(concat('{seed}', key))"))
    out = ranked.join(goals, "key").withColumn("rate", rate).withColumn("offset", offset)
    out = out.withColumn("copies", F.floor(F.col("offset") + F.col("rate") * F.col("k")) - F.floor(F.col("offset") + F.col("rate") * (F.col("k") - 1)))
    out = out.withColumn("copies", F.least("copies", F.lit(most)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))


def mixed(docs: DataFrame, **of) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to `most` times). Parameters as of `copies`."""
    out = copies(docs, keep=tuple(docs.columns), **of).where("copies > 0").select("kept", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("kept.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, mixed by the weights 1, 2, 3 in turn."""
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS hash FROM documents),
banded AS (SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INTEGER AS band FROM sizes),
sources AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY key, source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
levels AS (
  SELECT *, 3 * source_size / w AS full_at,
    ((SELECT sum(source_size) FROM weighed) - coalesce(sum(3 * source_size) OVER o, 0)) / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT key, source_size, least((3 * source_size)::DOUBLE, w * (SELECT min_by(level, full_at) FROM levels WHERE level <= full_at)) AS target FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY band, hash, size, doc_id) AS k FROM banded),
rated AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.k, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    (256 * (instr('0123456789abcdef', substr(md5('mix' || r.key), 1, 1)) - 1) + 16 * (instr('0123456789abcdef', substr(md5('mix' || r.key), 2, 1)) - 1)
      + instr('0123456789abcdef', substr(md5('mix' || r.key), 3, 1)) - 1) / 4096.0::DOUBLE AS u
  FROM ranked r JOIN goals g ON r.key = g.key)
SELECT doc_id, size, source_size, target, (least(floor(u + rate * k) - floor(u + rate * (k - 1)), 3) * size)::BIGINT AS taken FROM rated
"""
