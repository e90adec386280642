"""Substring dedup by fixed-block anchors.

Every document puts its non-overlapping blocks of 7 words into an index, and probes that index with each of
its rolling windows of 7 words. A passage of 13 words holds a whole aligned block wherever it starts
(13 >= 2 * 7 - 1), so each repeated passage shows up as a hit. Around hits only, all 13-word windows are
compared under two hashes (64 bits, and the bucket of another), and those met first in a smaller document are removed; overlapping windows
join into the maximal exact repeat.

Texts lie in groups by a hash of their id, about 16 MB each. Index and probes meet in hash buckets, for which a
group gives each window at most twice: with the smallest of its documents that has it as a block, and with the
largest that has it. A bucket answers a group with the smallest document of each window, and the group finds
out for which of its own documents that is a hit. So a passage in a third of all documents costs two entries a
group, never one a document or a pair. Groups and buckets grow in number with the input, not in size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batch_of, mix, pack, packed_batch, rolling, runs, shuffle_parts, sized, table, unpack, word_hashes

SEED = 0xD6E8FEB86659FD93
SIZE = 16 << 20  #: bytes of text in a group, about
MOST_PARTS = 4096
PACKED = "bucket int, owner binary, n binary, keys binary"


def _anchor(h: np.ndarray, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 31-bit key of each window of block words."""
    w = rolling(h, block)
    return ((w >> U(33)) % U(buckets)).astype(np.int64), (w & U(0x7FFFFFFF)).astype(np.int64)


def _place(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document."""
    return (mix(doc.astype(U)) % U(groups)).astype(np.int64)


def _shrink(groups: int):
    """Group, id and text (as zstd, for the shuffle). A row without an id goes where a hash of its text says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in sized(batches, 1):
            packed = [press.compress(x.encode("utf-8", "surrogatepass")) if x else None for x in part.column(1).to_pylist()]
            own = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            place = np.where(own, _place(part.column(0).fill_null(0).to_numpy(zero_copy_only=False), groups), _place(word_hashes([x or b"" for x in packed]), groups))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), part.column(0), pa.array(packed, pa.binary())], names=["place", "doc", "packed"])

    return run


def _texts(t: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    open_ = zstandard.ZstdDecompressor()
    for batch in t.to_batches():
        for doc, x in zip(batch.column("doc").to_pylist(), batch.column("packed")):
            yield doc, open_.decompress(x.as_buffer()) if x.is_valid else b""


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *arrays])


def _ends(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Of entries ordered by key, then owner: the places of each key's first one that is a block, and of its last one."""
    last = np.append(runs(key)[1:], len(key)) - 1 if len(key) else np.empty(0, np.int64)
    blocks = np.flatnonzero(block)
    return np.unique(np.concatenate([blocks[runs(key[blocks])], last]))


def _probes(window: int, block: int, buckets: int):
    def run(texts: pa.Table) -> pa.Table:
        """Of one group: its windows for the index's buckets."""
        each, owner = [], []
        for doc, text in _texts(texts):
            words = text.split() if doc is not None else []
            if len(words) < window:
                continue
            b, k = _anchor(word_hashes(words), block, buckets)
            flag = np.ones(len(b), np.int64)
            flag[::block] = 0  # in the index; sorts before a mere probe of the same window
            one = np.sort((b << 32) | (k << 1) | flag)
            each.append(one[runs(one >> 1)])
            owner.append(np.full(len(each[-1]), doc, np.int64))
        value, who = _joined(each, np.int64), _joined(owner, np.int64)
        order = np.lexsort((who, value >> 1))
        value, who = value[order], who[order]
        ends = _ends(value >> 1, (value & 1) == 0)
        value, who = value[ends], who[ends]
        order = np.argsort(who, kind="stable")
        value, who = value[order], who[order]
        return pa.Table.from_batches([packed_batch(pack(value >> 32, who, {"keys": (value & 0xFFFFFFFF).astype(np.uint32)}), "keys")])

    return run


def _reply(owner: np.ndarray, low: np.ndarray, keys: np.ndarray, groups: int) -> pa.Table:
    """For each group of an owner, once: the keys with the smallest document of each, packed like the questions."""
    place = _place(owner, groups)
    order = np.lexsort((keys, place))
    order = order[runs(np.stack([place, keys.view(f"i{keys.itemsize}").astype(np.int64)], 1)[order].view("V16").ravel())]
    order = order[np.argsort(low[order], kind="stable")]
    return pa.Table.from_batches([packed_batch(pack(place[order], low[order], {"keys": keys[order]}), "keys")])


class Answers:
    """What the buckets answered to a group: keys, each with the smallest document that has it."""

    def __init__(self, t: pa.Table, kind):
        low, v = unpack(t, {"keys": kind}) if t.num_rows else (np.empty(0, np.int64), {"keys": np.empty(0, kind)})
        order = np.lexsort((low, v["keys"]))
        first = order[runs(v["keys"][order])]
        self.keys, self.low = v["keys"][first], low[first]

    def before(self, keys: np.ndarray, doc: int) -> np.ndarray:
        """Whether each key was answered with a document up to `doc`."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (self.low[at] <= doc)


def _short(bucket: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    """32 bits of an anchor, enough to tell it from the others of a group; a false hit only adds a candidate."""
    return mix((np.asarray(bucket, np.int64) << 31 | key.astype(np.int64)).astype(U)).astype(np.uint32)


def _hits(groups: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one bucket: for each group, its windows that one document has as a block and a larger one has too."""
        owner, v = unpack(t, {"keys": np.uint32})
        key = v["keys"] >> 1
        order = np.argsort(key, kind="stable")
        key, owner, block = key[order], owner[order], (v["keys"][order] & 1) == 0
        at = runs(key)
        size = np.diff(np.append(at, len(key)))
        low = np.repeat(np.minimum.reduceat(np.where(block, owner, np.iinfo(np.int64).max), at), size)
        high = np.repeat(np.maximum.reduceat(owner, at), size)
        hit = (low < high) & (low <= owner)
        return _reply(owner[hit], low[hit], _short(t["bucket"][0].as_py(), key[hit]), groups)

    return run


def _windows(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(words)
    return rolling(h, window), rolling(h, window, SEED)


def _candidates(window: int, block: int, buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one group: the windows near a hit, each with the smallest and the largest of its documents."""
        found = Answers(answers, np.uint32)
        bucket, owner, one = [], [], []
        for doc, text in _texts(texts) if len(found.keys) else ():
            words = text.split() if doc is not None else []
            if len(words) < window:
                continue
            hit = found.before(_short(*_anchor(word_hashes(words), block, buckets)), doc)
            span = window - block + 1  # anchors inside a window
            many = np.concatenate([[0], np.cumsum(hit)])
            near = many[span:] > many[:-span]
            w1, w2 = _windows(words, window)
            w1, first = np.unique(w1[near], return_index=True)
            bucket.append(((w2[near][first] >> U(32)) % U(buckets)).astype(np.int64))
            one.append(w1)
            owner.append(np.full(len(w1), doc, np.int64))
        where, who, key = _joined(bucket, np.int64), _joined(owner, np.int64), _joined(one, U)
        order = np.lexsort((who, where, key))
        where, who, key = where[order], who[order], key[order]
        ends = _ends(np.stack([key, where.astype(U)], 1).view("V16").ravel(), np.ones(len(key), bool))
        ends = ends[np.argsort(who[ends], kind="stable")]
        return pa.Table.from_batches([packed_batch(pack(where[ends], who[ends], {"keys": key[ends]}), "keys")])

    return run


def _repeated(groups: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one bucket: for each group, its windows that a document smaller than one of its own has."""
        owner, v = unpack(t, {"keys": U})
        order = np.argsort(v["keys"], kind="stable")
        owner, one = owner[order], v["keys"][order]
        at = runs(one)
        low = np.repeat(np.minimum.reduceat(owner, at), np.diff(np.append(at, len(one)))) if len(at) else owner
        again = low < owner
        return _reply(owner[again], low[again], one[again], groups)

    return run


def _covered(words: list[bytes], found: Answers, doc: int | None, window: int) -> np.ndarray:
    """Which words lie in a window that a smaller document has."""
    cover = np.zeros(len(words) + 1, np.int64)
    if doc is not None:
        start = np.flatnonzero(found.before(rolling(word_hashes(words), window), doc - 1))
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(window: int, with_text: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = Answers(answers, U)
        rows: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "ranges", "kept")}
        for doc, text in _texts(texts):
            words = text.split()
            gone = _covered(words, found, doc, window)
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            rows["doc_id"].append(doc)
            rows["n_words"].append(len(words))
            rows["n_removed"].append(int(gone.sum()))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["ranges"].append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            rows["kept"].append(kept.decode("utf-8", "surrogatepass") if with_text else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_batches([batch_of(rows, doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string(), ranges=span, kept=pa.string())])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, size: int = SIZE) -> DataFrame:
    """Drops each word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256, ranges (the maximal repeats removed,
    as word positions, end exclusive) and kept (the words left, joined by one space; null without with_text).

    Null text: no words, sha256 of nothing. A null id has no order: such a row loses nothing and is no one's
    original. Rows that share an id never count as originals of each other. Texts below `window` words, empty
    tables and other columns of any name pass without effect.
    """
    if window < 3:
        raise ValueError("a window needs 3 words or more")
    block = (window + 1) // 2
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    parts = shuffle_parts(docs.sparkSession)
    groups = max(parts, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size))
    buckets = max(2 * parts, groups)
    wide = max(parts, min(groups, MOST_PARTS))
    dealt = lambda df: df.repartition(wide, "bucket").groupBy("bucket")
    packed = texts.mapInArrow(_shrink(groups), "place long, doc long, packed binary").repartition(wide, "place").groupBy("place")
    hits = dealt(packed.applyInArrow(_probes(window, block, buckets), PACKED)).applyInArrow(_hits(groups), PACKED)
    answered = lambda df: df.select(F.col("bucket").cast("long").alias("place"), "owner", "n", "keys").repartition(wide, "place").groupBy("place")
    again = dealt(packed.cogroup(answered(hits)).applyInArrow(_candidates(window, block, buckets), PACKED)).applyInArrow(_repeated(groups), PACKED)
    return packed.cogroup(answered(again)).applyInArrow(
        _kept(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, ranges array<struct<start: long, end: long>>, kept string"
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document, by windows of 13 words. See `remove_repeats` for nulls, ties and repeated ids."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
