"""Toxicity: a convolutional text classifier over hashed words, with thresholds by language.

A word counts by the hash of itself and of its first letters. The network is trained in numpy in one
task, on a sample bounded by `most` rows of each label; all other labelled rows calibrate it and choose the
thresholds. Scoring is a scan. Scores come from the text alone; the language only chooses the threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, by_value, cut, released, sized, table, word_hashes
from .convnet import ConvNet, frequent

#: ASCII punctuation and controls, as blanks.
BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """(positions, 2): hashes of each word and of its first 6 bytes. A text without words has one empty word."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(BLANK).split() if text else []
    words = words or [b""]
    return np.stack([word_hashes(words), word_hashes([w[:6] for w in words]) ^ U(0x5851F42D4C957F2D)], 1)


@dataclass
class Model:
    net: ConvNet
    default: float = 0.7
    by_language: dict[str, float] = field(default_factory=dict)

    def _laid(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [features(x) for x in texts]
        return self.net.rows(np.concatenate(found)), np.append(0, np.cumsum([len(x) for x in found]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.net.score(*self._laid(texts))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return self.net.logits(*self._laid(texts)).astype(np.float64)


#: The cuts that a threshold is chosen from, and the steps of a logit that calibration tells apart.
CUTS = [round(0.5 + 0.02 * i, 2) for i in range(21)]
STEPS, FAR = 256, 64


def threshold(hits: list[tuple[float, float]], toxic: float, default: float = 0.7) -> float:
    """The cut of the best F1, nearest to `default` among equals. hits: per cut, how many rows of label 1 and 0 reach it."""
    f1 = [2 * one / max(1e-9, one + zero + toxic) for one, zero in hits]
    return min(zip(CUTS, f1), key=lambda x: (-round(x[1], 6), abs(x[0] - default)))[0]


def _fitted(texts: list[str], label: np.ndarray, seed: int) -> dict:
    """The network's parts as plain arrays and numbers."""
    found = [features(x) for x in texts]
    net = ConvNet(frequent([x.ravel() for x in found], 3), seed=seed)
    net.fit([net.rows(x) for x in found], label, epochs=max(6, 25_000 // max(1, len(found))), seed=seed)
    return vars(net)


def _constant(share: float, seed: int) -> Model:
    net = ConvNet(frequent([], 3), seed=seed)
    share = min(max(share, 0.01), 0.99)
    net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
    return Model(net)


def _logits(docs: DataFrame, net: ConvNet) -> DataFrame:
    """doc_id, lang and logit of each row."""
    shared = by_value(docs.sparkSession, Model(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for part in sized(batches, 2, 256):
            made = own.logits(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.float64())], names=["doc_id", "lang", "logit"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(released(run), "doc_id long, lang string, logit double")


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, seed: int = 7) -> Model:
    """Fits on at most `most` rows of each label, chosen by a hash of the id, out of four fifths of them.

    All other labelled rows are scored. They calibrate, and they choose the common threshold and that of each
    language with 20 rows of either label or more; rows of a label weigh as much as all rows of that label
    do, so that the shares of the labels are the true ones. Of a sampled id's texts, the smallest is fitted on;
    else every row of an id counts. Texts are scanned, never shuffled: only ids, labels and logits meet in joins.

    Null ids, texts that are missing and labels other than 0 and 1 take no part; of labels that disagree on
    an id, the larger counts. Without both labels the model gives the share of label 1 as every score.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    rows = cut(docs.groupBy("doc_id").agg(F.count("*").alias("many")).join(known, "doc_id").withColumn("order", F.xxhash64("doc_id")))
    free = "pmod(order, 5) > 0"
    total = {r.toxic: r.many for r in rows.groupBy("toxic").agg(F.sum("many").alias("many")).collect()}
    last = {}
    for x in (0, 1):
        ids = rows.where(f"toxic = {x} AND {free}").select("order", "doc_id").orderBy("order", "doc_id").limit(most)
        last[x] = ids.agg(F.max(F.struct("order", "doc_id")).alias("last")).first().last
    if None in last.values():
        return _constant(total.get(1, 0) / max(1, sum(total.values())), seed)
    own = F.expr(f"{free} AND ({' OR '.join(f'toxic = {x} AND (order < {r.order} OR order = {r.order} AND doc_id <= {r.doc_id})' for x, r in last.items())})")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        return pa.table({"model": pa.array([pickle.dumps(_fitted(t["text"].to_pylist(), np.array(t["toxic"].to_pylist(), np.float64), seed))], pa.binary())})

    sample = docs.select("doc_id", "text").join(F.broadcast(rows.where(own).drop("many")), "doc_id")  # 2 * most ids at most
    sample = sample.groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text"))
    made = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "model binary").collect()
    parts = pickle.loads(made[0].model)
    net = ConvNet(parts.pop("vocabulary"))
    vars(net).update(parts)

    scored = cut(_logits(docs, net).join(rows.where(~own).select("doc_id", "toxic"), "doc_id").drop("doc_id"))
    step = F.round(F.least(F.greatest(F.col("logit"), F.lit(-FAR)), F.lit(FAR)) * STEPS).cast("int").alias("step")
    bins = scored.groupBy("toxic", step).count().orderBy("toxic", "step").collect()
    label, many = np.array([r.toxic for r in bins], np.float64), np.array([r["count"] for r in bins], np.float64)
    weight = {x: total[x] / max(1.0, many[label == x].sum()) for x in (0, 1)}
    net.calibrate(np.array([r.step for r in bins]) / STEPS, label, many, np.where(label == 1, weight[1], weight[0]))

    value = 1 / (1 + F.exp(-(F.lit(net.scale) * F.col("logit") + F.lit(net.shift))))
    hits = [F.count_if((F.col("toxic") == x) & (F.col("value") >= c)).alias(f"n{x}_{i}") for x in (0, 1) for i, c in enumerate([0.0, *CUTS])]
    reached = scored.withColumn("value", value).groupBy("lang").agg(*hits).withColumn("common", F.lit(False))
    all_of = scored.withColumn("value", value).agg(F.lit("").alias("lang"), *hits).withColumn("common", F.lit(True))
    model, own_cut = Model(net), {}
    for r in reached.where("least(n0_0, n1_0) >= 20").unionByName(all_of).collect():
        of = [(r[f"n1_{i}"] * weight[1], r[f"n0_{i}"] * weight[0]) for i in range(len(CUTS) + 1)]
        if r.common and min(r.n0_0, r.n1_0) >= 20:
            model.default = threshold(of[1:], of[0][0])
        elif not r.common:
            own_cut[r.lang] = of
    model.by_language = {x: threshold(of[1:], of[0][0], model.default) for x, of in own_cut.items()}
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col (0 to 1), which must be a new column. Null, empty and wordless texts get the score of no evidence. Scans once."""
    names = docs.columns
    if out_col.lower() in map(str.lower, names):
        raise ValueError(f"a column that exists already: {out_col}")
    shared = by_value(docs.sparkSession, model)  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for part in sized(batches, names.index(text_col), 256):
            made = own.scores(part.column(names.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.float64())], names=[*part.schema.names, out_col])

    return docs.mapInArrow(released(run), type(docs.schema)([*docs.schema.fields]).add(out_col, "double"))


def rejected(scored: DataFrame, model: Model, lang_col: str = "lang", score_col: str = "score") -> DataFrame:
    """Adds rejected (boolean): the score reaches the threshold of the row's language, or the common one."""
    least = F.lit(model.default)
    for lang, own in model.by_language.items():
        least = F.when(F.coalesce(F.col(lang_col), F.lit("")) == lang, F.lit(own)).otherwise(least)
    return scored.withColumn("rejected", F.col(score_col) >= least)


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by a model that no held-out row has a part in.

    A null id is not held out. Null, empty and wordless texts get the score of no evidence; repeated rows and ids a row each.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(f"NOT ({HELD_OUT})"), table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
