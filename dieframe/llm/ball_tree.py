"""Exact ranked lexical search over sparse ball trees.

A document's score for a query is the inner product of two sparse vectors of integers: the query's weights (a term's
weight times its repeats) and the document's impacts, in the terms that some query has; no other term adds to any
score. Documents are dealt to shards of bounded size. A shard's tree halves its documents again and again between two
far ones. Each node keeps a centroid (rounded to integers), the radius around it, its radius along each term, and its
smallest document id. With centroid c, no document d of a node scores above either of

    <q, c> + |q| * radius            (the ball as a whole)
    sum of q_t * (c_t + radius_t)    (one axis at a time)

Centroids, squared distances and the second bound are exact integers; of the first, only the product of two roots is
in floating point, and it is rounded up. Subtrees are searched best bound first, and left out once their bound falls
below the k-th score found so far, or equals it when all their ids are larger. Leaves are scored exactly.

One shard is searched first; what each query finds there is the least that it asks of the others.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, batch_of, by_value, cut, mix, released, sized, table

#: Bytes of terms stay, A-Z as a-z; all others become blanks. Bytes of 128 and more belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  #: the same in characters
LEAF = 8  # documents of a leaf at most
WIDTH = 32  # nodes opened at once
CELLS = 1 << 22  # nodes times terms of a shard's tree, about
TERMS = 1 << 13  # terms of the queries that are searched together, about; a longer query is searched alone
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Scoring:
    """What a score depends on besides a document's own terms: documents with terms, their terms with repeats, and weights."""

    n: int
    total: int
    weight: np.ndarray

    @classmethod
    def of(cls, n: int, total: int, df: np.ndarray) -> Scoring:
        return cls(n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))

    def impacts(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of postings, with their documents' lengths. Lengths of any size: the product may need over 64 bits."""
        of, back = np.unique(length, return_inverse=True)
        m = np.array([25 + 75 * x * self.n // self.total for x in of.tolist()], np.int64)[back]
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Documents' vectors (edge: where each one's postings begin and end) under a balanced tree.

    Node i has the children 2i + 1 and 2i + 2; every document has a posting at least.
    """

    def __init__(self, ids: np.ndarray, edge: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int):
        n = len(ids)
        self.depth = max(0, math.ceil(math.log2(n / LEAF))) if n else 0
        size = np.diff(edge)
        doc = np.repeat(np.arange(n), size)
        value = impact.astype(np.float64)
        norm = np.bincount(doc, value * value, n)
        order = np.arange(n)
        nodes = (2 << self.depth) - 1
        self.centroid, self.reach = np.zeros((nodes, width), np.int32), np.zeros((nodes, width), np.int32)
        self.radius, self.low = np.zeros(nodes), np.full(nodes, NO_ID)

        def dots(dense: np.ndarray) -> np.ndarray:
            """Each document times its node's row."""
            return np.bincount(doc, value * dense[node[doc], term], n)

        def rows(docs: np.ndarray) -> np.ndarray:
            """Those documents as dense rows."""
            out = np.zeros((len(docs), width))
            own = np.concatenate([np.arange(edge[x], edge[x + 1]) for x in docs])
            out[np.repeat(np.arange(len(docs)), size[docs]), term[own]] = value[own]
            return out

        def furthest(distance: np.ndarray) -> np.ndarray:
            return np.lexsort((distance, node))[at[1:] - 1]

        for level in range(self.depth + 1 if n else 0):
            k, base = 1 << level, (1 << level) - 1
            at = (n * np.arange(k + 1)) >> level
            node = np.empty(n, np.int64)
            node[order] = np.repeat(np.arange(k), np.diff(at))
            cell = node[doc] * width + term
            mean = np.rint(np.bincount(cell, value, k * width).reshape(k, width) / np.diff(at)[:, None]).astype(np.int64)
            top = np.zeros(k * width, np.int32)
            np.maximum.at(top, cell, impact.astype(np.int32))
            near = mean[node[doc], term]
            far = np.add.reduceat((impact - near) ** 2 - near**2, edge[:-1]) + (mean**2).sum(1)[node]
            self.centroid[base : base + k], self.reach[base : base + k] = mean, top.reshape(k, width)
            self.radius[base : base + k] = np.sqrt(np.maximum.reduceat(far[order], at[:-1]).astype(np.float64))
            self.low[base : base + k] = np.minimum.reduceat(ids[order], at[:-1])
            if level < self.depth:
                one = rows(furthest(far))
                two = rows(furthest(norm - 2 * dots(one)))
                order = np.lexsort((dots(one - two), node))
        self.ids = ids[order]
        self.at = np.append(0, np.cumsum(size[order]))
        moved = np.arange(len(term)) + np.repeat(edge[:-1][order] - self.at[:-1], size[order]) if n else np.empty(0, np.int64)
        self.term, self.impact = term[moved], impact[moved]
        self.touched = 0

    def bounds(self, nodes: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        cells = np.ix_(nodes, term)
        axes = self.reach[cells] @ weight
        spread = np.sqrt((weight.astype(np.float64) ** 2).sum()) * self.radius[nodes]
        return np.minimum(axes, self.centroid[cells] @ weight + np.ceil(spread * (1 + 1e-12)).astype(np.int64))

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        size = self.at[docs + 1] - self.at[docs]
        first = np.cumsum(size) - size
        own = np.arange(size.sum()) + np.repeat(self.at[docs] - first, size)
        return np.add.reduceat(dense[self.term[own]] * self.impact[own], first)

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents that score `least` or more, best first, ties by id."""
        n, base = len(self.ids), (1 << self.depth) - 1
        dense = np.zeros(self.centroid.shape[1], np.int64)
        dense[term] = weight
        ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
        last = NO_ID
        front = np.zeros(1 if n and len(term) else 0, np.int64)
        bound = self.bounds(front, term, weight)
        while True:
            open_ = (bound > least) | ((bound == least) & (self.low[front] <= last))
            front, bound = front[open_], bound[open_]
            if not len(front):
                return ids, found
            best = np.argpartition(-bound, WIDTH)[:WIDTH] if len(front) > WIDTH else np.arange(len(front))
            now = front[best]
            left = np.ones(len(front), bool)
            left[best] = False
            leaf = now >= base
            inner, leaf = now[~leaf], now[leaf] - base
            young = np.concatenate([2 * inner + 1, 2 * inner + 2])
            front, bound = np.append(front[left], young), np.append(bound[left], self.bounds(young, term, weight))
            if len(leaf):
                low, high = (n * leaf) >> self.depth, (n * (leaf + 1)) >> self.depth
                docs = np.arange((high - low).sum()) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
                self.touched += len(docs)
                score = self.scores(docs, dense)
                sure = score >= least
                ids, found = np.append(ids, self.ids[docs[sure]]), np.append(found, score[sure])
                order = np.lexsort((ids, -found))[:k]
                ids, found = ids[order], found[order]
                if len(found) == k:
                    least, last = int(found[-1]), int(ids[-1])


def _postings(word: dict[bytes, int], id_col: str, text_col: str, docs: DataFrame) -> DataFrame:
    """place, doc_id, length, term, tf of each document with terms: its postings in the queries' terms, little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, task, done = pickle.loads(shared.value), TaskContext.get().partitionId(), 0
        for part in sized(batches, 1):
            found = [terms_of(x) for x in part.column(1).to_pylist()]
            length = np.array([*map(len, found)], np.int64)
            hits = [[x for x in map(names.get, of) if x is not None] for of in found]
            many = np.array([*map(len, hits)], np.int64)
            key, tf = np.unique(np.repeat(np.arange(len(hits)), many) << 32 | np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in hits)]), return_counts=True)
            edge = np.searchsorted(key >> 32, np.arange(len(hits) + 1)).tolist()
            term, tf = (key & 0xFFFFFFFF).astype("<u4"), tf.astype("<u4")
            place = mix((np.arange(done, done + len(found)) | task << 40).astype(U)) >> U(1)
            done += len(found)
            rows = {
                "place": place.astype(np.int64), "doc_id": part.column(0), "length": length,
                "term": [term[a:b].tobytes() for a, b in zip(edge, edge[1:])], "tf": [tf[a:b].tobytes() for a, b in zip(edge, edge[1:])],
            }
            yield batch_of(rows, place=pa.int64(), doc_id=pa.int64(), length=pa.int64(), term=pa.binary(), tf=pa.binary()).filter(pa.array(length > 0))

    shared = by_value(docs.sparkSession, word)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "place long, doc_id long, length long, term binary, tf binary")


def _counts(width: int):
    """Documents and, as term -1, their lengths, and, as any other term, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += int(batch.column(0).to_numpy().sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4"), minlength=width)
        held = np.flatnonzero(df)
        yield batch_of({"term": np.append([-2, -1], held), "many": np.append([n, total], df[held])}, term=pa.int64(), many=pa.int64())

    return run


def _search(shared, k: int):
    def run(t: pa.Table) -> pa.Table:
        scoring, queries, least = pickle.loads(shared.value)
        size = np.array([len(x) // 4 for x in t["term"].to_pylist()], np.int64)
        term, tf = (np.frombuffer(b"".join(t[c].to_pylist()), "<u4").astype(np.int64) for c in ("term", "tf"))
        ids = t["doc_id"].fill_null(NO_ID).to_numpy()
        tree = Tree(ids, np.append(0, np.cumsum(size)), term, scoring.impacts(tf, np.repeat(t["length"].to_numpy(), size)), len(scoring.weight))
        out: list[tuple] = []
        for number, (own, weight) in queries.items():
            out += [(number, int(i), int(s)) for i, s in zip(*tree.search(own, weight, k, least.get(number, 1)))]
        cols = {"query": [r[0] for r in out], "doc_id": [None if r[1] == NO_ID else r[1] for r in out], "score": [r[2] for r in out]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()})

    return run


def _ranked(docs: DataFrame, queries: dict[int, Counter], k: int, id_col: str, text_col: str) -> DataFrame:
    """query, doc_id, score of the best documents of each shard for some queries (number: terms with their repeats)."""
    spark = docs.sparkSession
    word = {w: i for i, w in enumerate(sorted(set().union(*queries.values())))}
    postings = cut(_postings(word, id_col, text_col, docs))
    counts = {r.term: r.many for r in postings.select("length", "term").mapInArrow(_counts(len(word)), "term long, many long").groupBy("term").agg(F.sum("many").alias("many")).collect()}
    n = counts.get(-2, 0)
    scoring = Scoring.of(n, counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(word))], np.int64))
    vectors = {}
    for number, of in queries.items():
        own = np.array([word[w] for w in of], np.int64)
        vectors[number] = own, scoring.weight[own] * np.array([*of.values()], np.int64)
    shards = max(1, -(-n // max(LEAF, min(1 << 14, CELLS * LEAF // 2 // max(1, len(word))))))
    dealt = postings.where("octet_length(term) > 0").withColumn("shard", F.col("place") % shards)

    def found(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        return rows.groupBy("shard").applyInArrow(_search(by_value(spark, (scoring, vectors, least)), k), "query long, doc_id long, score long")

    out = found(dealt.where("shard = 0"), {})
    if shards > 1:
        out = cut(out)
        first = out.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()  # a row a query
        out = out.unionByName(found(dealt.where("shard > 0"), {r["query"]: r.least for r in first}))
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items the k documents that score highest, and above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Scores are
    those of the op11 contract, in integers. Ties go to the smaller doc_id, a null one last. Every row of docs is a
    document and every row of items a query of its own, also when ids are repeated or null; other columns are left
    out, whatever their names. Null or empty texts, and those without terms, neither answer nor count as documents;
    such items have no rows. Items are searched in blocks of about `terms` terms, each a pass over docs; a block's
    terms are on the driver and broadcast.
    """
    spark = docs.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    numbered = cut(rows.withColumn("size", F.regexp_count("text", F.lit(TERM))))
    total = numbered.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // terms)
    out = spark.createDataFrame([], "query long, doc_id long, score long")
    for block in range(blocks):
        rows = numbered.where((F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) & (F.col("size") > 0)).select("query", "text").collect()
        if rows:
            out = out.unionByName(_ranked(docs, {r["query"]: Counter(terms_of(r.text)) for r in rows}, k, id_col, text_col))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = out.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return best.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_ball_tree(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the 10 best documents for each benchmark item. See `rank` for nulls and other cases."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT row, doc_id, len(terms)::BIGINT AS n, terms FROM low WHERE len(terms) > 0),
sums AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS repeats FROM items GROUP BY ALL),
postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sums GROUP BY term),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), sums GROUP BY item, row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
