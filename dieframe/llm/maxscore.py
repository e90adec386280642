"""Exact top-k by inner product with MaxScore.

A term is a dimension; its posting list is the shard's column of it. For one query, terms stand by their
largest possible contribution in the shard. With a threshold from the best rows of the strongest postings,
the weakest terms whose bounds together stay below it are non-essential: the others are traversed for all
rows, the non-essential ones are probed only for rows that can still reach the threshold. Shards answer
with their own top k, which are merged.

Queries come in blocks and vectors in shards of bounded size; each pair of them is one group of a hash
shuffle, so no task sees all of either. One shard is searched first: what a query finds there is the least
that it asks of all the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

PROBES = 4  # non-essential terms between two prunings


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """row, id and terms (floor(scale * x)); vectors that are null or hold null, NaN or infinite components are left out.

    row numbers the rows by where they stand, so it must be stored before it is used twice.
    """
    sound = "{0} IS NOT NULL AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))".format(f"`{vec_col}`")
    out = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(sound.replace(f"`{vec_col}`", "v"))
    return out.select("row", "id", F.expr(f"transform(v, x -> floor({scale} * double(x)))").alias("terms"))


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """(rows, width); shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    flat = column.combine_chunks()
    edge, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    many = np.diff(edge)
    if len(many) and many.min() == many.max() == width:
        return values[edge[0] : edge[-1]].reshape(-1, width)
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        out[i, : b - a] = values[a:b]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Shard:
    def __init__(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.rows, self.ids, self.k = rows, ids, k
        self.postings = np.ascontiguousarray(vectors.T)
        self.high, self.low = self.postings.max(1), self.postings.min(1)
        self.furthest = max(1, vectors.shape[1]) * max([1, *(abs(int(x)) for x in (*self.high, *self.low))])
        self.kinds: dict[type, np.ndarray] = {}
        k = min(k + 1, len(rows))
        part = np.argpartition(self.postings, [k - 1, len(rows) - k], axis=1)
        self.top, self.bottom = part[:, len(rows) - k :], part[:, :k]

    def of_kind(self, q: np.ndarray) -> np.ndarray:
        """The postings in numbers in which every sum for this query is exact."""
        most = self.furthest * max((abs(int(x)) for x in q), default=0)
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        if kind not in self.kinds:
            self.kinds[kind] = self.postings.astype(kind)
        return self.kinds[kind]

    def search(self, q: np.ndarray, own: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the top k, without the query's own row and those known to score below `least`."""
        postings = self.of_kind(q)
        q = q.astype(postings.dtype)
        bound = np.maximum(q * self.high.astype(q.dtype), q * self.low.astype(q.dtype))
        order = np.argsort(bound)
        strongest = order[-4:]
        seed = np.unique(np.concatenate([self.top[d] if q[d] > 0 else self.bottom[d] for d in strongest])) if len(order) else np.empty(0, int)
        seed = seed[self.rows[seed] != own]
        first = least
        if len(seed) >= self.k:
            reached = np.sort(q @ postings[:, seed])[-self.k]
            first = reached if least is None else max(least, reached)
        reach = np.cumsum(bound[order])
        skip = 0 if first is None else int(np.max(np.flatnonzero(reach < first) + 1, initial=0))
        essential, rest = order[skip:], order[:skip][::-1]
        at = np.flatnonzero(self.rows != own) if len(essential) or not len(order) else np.empty(0, int)
        score = (q[essential] @ postings[essential])[at] if len(essential) else np.zeros(len(at), q.dtype)
        for i in range(0, len(rest), PROBES):
            keep = score + bound[rest[i:]].sum() >= first
            at, score = at[keep], score[keep]
            d = rest[i : i + PROBES]
            score = score + q[d] @ postings[np.ix_(d, at)]
        if first is not None:
            keep = score >= first
            at, score = at[keep], score[keep]
        best = _best(score, self.ids[at], self.k)
        return at[best], score[best].astype(np.int64)


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_row", "query_id", "vec_id", "score")}
        if queries.num_rows and vectors.num_rows:
            width = max(np.diff(c.combine_chunks().offsets.to_numpy()).max() for c in (queries["terms"], vectors["v_terms"]))
            ids = vectors["v_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            shard = Shard(vectors["v_row"].to_numpy(), _rows(vectors["v_terms"], width), ids, k)
            for row, name, least, q in zip(queries["row"].to_pylist(), queries["id"].to_pylist(), queries["least"].to_pylist(), _rows(queries["terms"], width)):
                at, score = shard.search(q, row, least)
                out["query_row"] += [row] * len(at)
                out["query_id"] += [name] * len(at)
                out["vec_id"] += vectors["v_id"].take(pa.array(at)).to_pylist()
                out["score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = 8192, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id is divisible by `every`.

    Scores are integer inner products of floor(scale * x), which must fit in a long; ties go to the smaller id, a
    null id last. Of vectors of different length the shorter one is filled up with zeros. A row never answers
    itself, but another row with its id may. With fewer rows, all are returned; an empty table gives no rows.
    """
    rows = cut(quantized(vectors, id_col, vec_col, scale))  # both sides must know a row by the same number
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    place = lambda c, of: F.pmod(F.xxhash64("row", F.lit(c)), F.lit(of)).cast("int")
    queries = rows.where(F.col("id") % every == 0).select("row", "id", "terms", place("q", blocks).alias("block"))
    # Names of their own: sides that share attributes lose columns when Catalyst prunes above a cogroup.
    others = rows.select(*(F.col(c).alias(f"v_{c}") for c in ("row", "id", "terms")), place("v", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def found(queries: DataFrame, others: DataFrame, low: int, high: int) -> DataFrame:
        sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high)))).groupBy("shard", "block")
        return sent.cogroup(others.where(F.col("shard").between(low, high)).groupBy("shard", "block")).applyInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")

    out = found(queries.withColumn("least", F.lit(None).cast("long")), others, 0, 0)
    if shards > 1:
        out = cut(out)
        least = out.groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_row").alias("row"), "least")
        out = out.unionByName(found(queries.join(least, "row", "left"), others, 1, shards - 1))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_maxscore(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 5 best other rows for each 50th id of embeddings."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
