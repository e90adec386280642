"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

1. A document's set of shingles gets a class (a hash of the set): equal sets are one class from here on.
2. Shingles meet in hash buckets, each class once, and come back with the number of classes that have them.
   Only those of two classes or more can be in an intersection; a class with too few of them links to none. The
   number of buckets follows that of shingles. Shingles so frequent that one would fill a bucket are counted
   beforehand, take no part in this and stand last in the order, so no bucket grows with the corpus.
3. The rest order their shingles rare first. Two sets of similarity t share one of their first
   n - ceil(t * n) + 1 shingles; those are joined, under the length and the positional filter.
4. Each pair that comes out is verified once: a suffix filter bounds the intersection from the counts of
   shingles in 16 ranges, and the full sets decide.
5. A prefix shingle of more than `group` classes is not joined with itself. Its classes are first compared
   with one of them (the one whose shingles are the most common); after that, classes that are not connected
   yet are compared with the others in blocks of `block`, pairs with an earlier hot shingle in common left out.
   No link between different classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, joined, mix, pack, packed_batch, released, released_group, rolling, runs, shuffle_parts, slices, table, unpack, word_hashes, words_of
from .components import components

ROOM = 1_000_000  #: shingles that meet in one task
MOST_PARTS = 4096
COUNTERS = 1 << 17  #: of a task's frequent shingles
MOST_HOT = 1 << 20
PACKED = "bucket int, owner binary, n binary, key binary, df binary, size binary"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted. Fewer words than width: the whole sequence as one."""
    h = word_hashes([w for w in words_of(text.translate(LOWER) if text else text)])
    if not len(h):
        return h
    k = min(width, len(h))
    return np.unique(mix(rolling(h, k), k))


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _class(s: np.ndarray) -> int:
    """A class id of 63 bits; 0 stands for no shingles."""
    with np.errstate(over="ignore"):
        total = mix(s, 0x2545F4914F6CDD1D).sum(dtype=U) + U(len(s))
    return int(mix(np.array([total]))[0] >> U(1)) or 1


def _classes(width: int):
    """Number of shingles and class of each row; after a task's rows, its frequent shingles (in tie, with minus how often as n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Often()
        names = ["doc", "tie", "n", "cls"]
        for part in slices(batches):
            sets = [shingles(x, width) for x in part.column(1).to_pylist()]
            classes = [_class(s) if len(s) else None for s in sets]
            often.add({c: s for c, s in zip(classes, sets) if c is not None})
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64())], names=names)
        key, many = often.found()
        none = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(key.view(np.int64)), pa.array(-many), none], names=names)

    return run


class Often:
    """Shingles that make up a 65,536th of all those added or more, with lower bounds of how often they came.

    Counts as Misra and Gries do: once there are too many different shingles, all counts sink alike.
    """

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.key, self.many, self.waiting, self.total = np.empty(0, U), np.empty(0, np.int64), 0, 0

    def add(self, of_class: dict[int, np.ndarray]) -> None:
        self.held += [*of_class.values()]
        self.waiting += sum(map(len, of_class.values()))
        if self.waiting > 2 * COUNTERS:
            self._merge()

    def _merge(self) -> None:
        more, count = np.unique(np.concatenate([np.empty(0, U), *self.held]), return_counts=True)
        self.total, self.held, self.waiting = self.total + self.waiting, [], 0
        more, count = more[count > 1], count[count > 1]  # the rest sinks to nothing
        both, n = np.concatenate([self.key, more]), np.concatenate([self.many, count])
        order = np.argsort(both, kind="stable")
        at = runs(both[order])
        both, n = both[order][at], np.add.reduceat(n[order], at) if len(at) else n
        if len(n) > COUNTERS:
            n = n - np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
            both, n = both[n > 0], n[n > 0]
        self.key, self.many = both, n

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        keep = self.many >= max(2, self.total >> 16)
        return self.key[keep], self.many[keep]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hashes' upper 32 bits."""
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    """The lower 7 bytes, which cross the shuffle."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).view("V7").ravel()


def _whole(low: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """A key of 64 bits from a bucket and the lower 7 bytes: with 256 buckets or more the hash itself, with fewer one of 56 bits and the bucket's."""
    key = np.zeros((len(low), 8), np.uint8)
    key[:, :7] = low.view(np.uint8).reshape(-1, 7)
    first = U(-(-(bucket << 32) // buckets) << 32)
    with np.errstate(over="ignore"):
        return first + ((key.view(U).ravel() - first) & U((1 << 56) - 1))


def _spread(width: int, buckets: int, hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            seen = _distinct(part.column(0).to_pylist(), width)
            if seen:
                h = np.concatenate([*seen.values()])
                size = np.array([len(s) for s in seen.values()], np.int32)
                owner = np.repeat(np.array([*seen], np.int64), size)
                known = _hot_places(hot.value, h)
                bucket = np.where(known < 0, _bucket(h, buckets), buckets + owner % buckets)
                low = _low(np.where(known < 0, h, known.astype(U)))
                rows = pack(bucket, owner, {"key": low}, {"size": np.repeat(size, size)})
                yield packed_batch(rows, "key", "size")

    return run


def _distinct(texts: list[str | None], width: int) -> dict[int, np.ndarray]:
    """The shingles of each class."""
    seen: dict[int, np.ndarray] = {}
    for text in texts:
        s = shingles(text, width)
        if len(s):
            seen.setdefault(_class(s), s)
    return seen


def _hot_places(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the frequent shingles each is, or -1."""
    if not len(hot):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return np.where(hot[at] == h, at, -1)


def _shared(buckets: int, hot: Broadcast):
    def run(t: pa.Table) -> pa.Table:
        """Of one bucket: each class's shingles that another class has too, with their frequency, dealt by class.

        Buckets from `buckets` on hold frequent shingles by class; these count as shared and as the most frequent.
        """
        owner, v = unpack(t, {"key": "V7"})
        size = np.repeat(joined(t["size"], np.int32), joined(t["n"], np.int32))
        bucket = t["bucket"][0].as_py()
        key = _whole(v["key"], bucket % buckets, buckets) if bucket < buckets else hot.value[_whole(v["key"], 0, 1).astype(np.int64)]
        order = np.lexsort((owner, key))
        key, owner, size = key[order], owner[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner, size = key[new], owner[new], size[new]
        at = runs(key)
        df = np.diff(np.append(at, len(key)))
        df = np.repeat(df, df) if bucket < buckets else np.full(len(key), np.iinfo(np.int32).max)
        keep = np.flatnonzero(df > 1)
        keep = keep[np.argsort(owner[keep], kind="stable")]
        rows = pack((owner[keep] % buckets).astype(np.int64), owner[keep], {"key": key[keep], "df": df[keep].astype(np.int32)}, {"size": size[keep]})
        return pa.Table.from_batches([packed_batch(rows, "key", "df", "size")])

    return run


def _candidates(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one bucket of classes: those with enough shared shingles, in rare-first order."""
        owner, v = unpack(t, {"key": U, "df": np.int32})
        size = np.repeat(joined(t["size"], np.int32), joined(t["n"], np.int32))
        order = np.lexsort((v["key"], v["df"], owner))
        owner, key, df, size = owner[order], v["key"][order], v["df"][order], size[order]
        at = runs(owner)
        many = np.diff(np.append(at, len(owner)))
        keep = 100 * many.astype(np.int64) >= percent * size[at].astype(np.int64)
        n = size[at][keep].astype(np.int64)
        shared = many[keep]
        inside = np.repeat(keep, many)
        key, df = key[inside], df[inside]
        offsets = np.append(0, np.cumsum(shared)).astype(np.int32)
        prefix = n - -(-percent * n // 100) + 1
        which = np.repeat(np.arange(len(n)), shared)
        sig = np.bincount(which * 16 + (key & U(15)).astype(np.int64), minlength=16 * len(n)).astype(np.int32)
        common = np.bincount(which, np.log(df), minlength=len(n)) / np.maximum(shared, 1)
        return pa.table({
            "cls": pa.array(owner[at][keep], pa.int64()), "n": pa.array(n, pa.int64()),
            "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.astype(np.int64))),
            "lead": pa.array(np.maximum(0, prefix - (n - shared)), pa.int64()), "common": pa.array(common, pa.float64()),
            "sig": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 16), pa.array(sig)),
        })

    return run


def _enough(x: str, percent: int) -> str:
    """Whether an intersection of size x is enough for sets of n and n2."""
    return f"{100 + percent} * ({x}) >= {percent} * (n + n2)"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    second = sets.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("keys").alias("keys2"), F.col("sig").alias("sig2"))
    both = pairs.join(sets.select(F.col("cls").alias("a"), "n", "keys", "sig"), "a").join(second, "b")
    suffix = "aggregate(zip_with(sig, sig2, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    return both.where(F.expr(_enough(suffix, percent))).where(F.expr(_enough("size(array_intersect(keys, keys2))", percent))).select("a", "b")


def _matrix(lists: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(among)), np.float32)
    for i, x in enumerate(lists):
        at = np.searchsorted(among, x)
        at[at == len(among)] = 0
        out[i, at[among[at] == x] if len(among) else []] = 1
    return out


def _block(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Links between left rows (not connected to the hot shingle's main component) and right rows of another component."""
        token = t["token"][0].as_py()
        left = np.flatnonzero(t["left"].to_numpy())
        right = np.flatnonzero(~t["left"].to_numpy())
        cls, n, comp = (t[c].to_numpy() for c in ("cls", "n", "comp"))
        todo = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :]))
        if todo.any():
            hot = [np.sort(np.array([k for k in x if k < token], np.int64)) for x in t["hot"].to_pylist()]
            among = np.unique(np.concatenate(hot))
            if len(among):
                todo &= _matrix([hot[i] for i in left], among) @ _matrix([hot[i] for i in right], among).T == 0
        left, todo = left[todo.any(1)], todo[todo.any(1)]
        right, todo = right[todo.any(0)], todo[:, todo.any(0)]
        a: np.ndarray = np.empty(0, np.int64)
        b = a
        if todo.size:
            flat, offset = t["keys"].combine_chunks(), None
            offset, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            keys = lambda i: np.sort(values[offset[i] : offset[i + 1]])
            rows, columns = [keys(i) for i in left], [keys(i) for i in right]
            among = np.intersect1d(np.concatenate(rows), np.concatenate(columns))
            for at in range(0, len(among), 4096) or [0]:
                part = _matrix(rows, among[at : at + 4096]) @ _matrix(columns, among[at : at + 4096]).T
                total = part if not at else total + part  # noqa: F821
            total = total.astype(np.int64)
            linked = todo & ((100 + percent) * total >= percent * (n[left][:, None] + n[right][None, :]))
            i, j = np.nonzero(linked)
            _, one = np.unique(np.stack([left[i], comp[right[j]]]), axis=1, return_index=True)  # one link to a component is enough
            a, b = cls[left[i[one]]], cls[right[j[one]]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_blocks(hot: DataFrame, sets: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    comp = components(links)
    at = cut(hot.join(comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").select("token", "cls", F.coalesce("comp", "cls").alias("comp")))
    share = at.groupBy("token", "comp").agg(F.count("*").alias("size"))
    main = cut(share.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("main.comp").alias("main"), "all", (F.col("all") - F.col("main.size")).alias("others")))
    left_blocks, right_blocks = (F.ceil(F.col(c) / block).cast("int") for c in ("others", "all"))
    rows = at.join(main, "token").withColumns({"i": F.pmod(F.xxhash64("cls"), left_blocks).cast("int"), "j": F.pmod(F.xxhash64("cls"), right_blocks).cast("int"), "ni": left_blocks, "nj": right_blocks})
    mine = rows.where("comp <> main").select("token", "cls", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("left"))
    all_ = rows.select("token", "cls", "comp", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), "j", F.lit(False).alias("left"))
    own = cut(rows.groupBy("cls").agg(F.collect_list("token").alias("hot")).join(sets.select("cls", "n", "keys"), "cls"))
    return mine.unionByName(all_).join(own, "cls").groupBy("token", "i", "j").applyInArrow(_block(percent), "a long, b long")


def class_links(classes: DataFrame, texts: DataFrame, percent: int, width: int, group: int, block: int, room: int) -> DataFrame:
    """Edges a, b between classes whose graph has the same components as that of all linked pairs."""
    spark = texts.sparkSession
    total = classes.where("n > 0").agg(F.sum("n")).first()[0] or 0
    parts = shuffle_parts(spark)
    buckets = max(2 * parts, -(-total // room))
    parts = max(parts, min(buckets, MOST_PARTS))
    least = max(room // 4, total // MOST_HOT)  # so the frequent ones are a million at most
    often = classes.where("n < 0").groupBy(F.col("tie").alias("shingle")).agg(F.sum("n").alias("n")).where(F.col("n") <= -least)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.shingle for r in often.collect()], np.int64).view(U)))
    sets = cut(
        texts.mapInArrow(released(_spread(width, buckets, hot)), "bucket int, owner binary, n binary, key binary, size binary")
        .repartition(parts, "bucket").groupBy("bucket").applyInArrow(released_group(_shared(buckets, hot)), PACKED)
        .repartition(parts, "bucket").groupBy("bucket").applyInArrow(released_group(_candidates(percent)), "cls long, n long, keys array<long>, lead long, common double, sig array<int>")
    )
    prefix = sets.where("lead > 0").select("cls", "n", "common", (F.col("n") - F.size("keys")).alias("rare"), F.posexplode(F.slice("keys", F.lit(1), F.col("lead").cast("int"))).alias("i", "token")).select("token", "cls", "n", "common", (F.col("rare") + F.col("i")).alias("pos"))
    many = cut(prefix.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct("common", "cls")).alias("hub")).where("many > 1").select("token", "many", F.col("hub.cls").alias("hub")))
    prefix = cut(prefix.drop("common").join(many, "token"))
    x = prefix.where(F.col("many") <= group).select("token", F.col("cls").alias("a"), "n", "pos")
    y = x.select("token", F.col("a").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    ordered = "(n < n2 OR n = n2 AND a < b)"
    near = x.join(y, "token").where(f"{ordered} AND 100 * n >= {percent} * n2 AND {_enough('least(n - pos, n2 - pos2)', percent)}").select("a", "b")
    hot = prefix.where(F.col("many") > group)
    pairs = near.unionByName(hot.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"))).distinct()
    links = cut(_verified(pairs, sets, percent))
    if hot.select("token").head(1):
        links = links.unionByName(cut(_in_blocks(hot.select("token", "cls"), sets, links, percent, block)))
    return links


def members(texts: DataFrame, percent: int, width: int, group: int, block: int, room: int) -> DataFrame:
    """doc, tie, n (shingles) and component (null without shingles) of each row of texts (doc, text, tie)."""
    classes = cut(texts.select("doc", "text", "tie").mapInArrow(released(_classes(width)), "doc long, tie long, n long, cls long"))
    comp = components(class_links(classes, texts.select("text"), percent, width, group, block, room))
    known = classes.where("cls IS NOT NULL").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("doc", "tie", "n", F.coalesce("component", "cls").alias("component"))
    return known.unionByName(classes.where("cls IS NULL AND n = 0").select("doc", "tie", "n", F.lit(None).cast("long").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", group: int = 64, block: int = 768, room: int = ROOM) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links of Jaccard similarity >= percent / 100.

    Sets are of distinct `width`-word shingles of the text with A-Z in lower case; with fewer words, the whole
    sequence. Null, empty and blank texts have no shingles and link with nothing: each is its own component.
    Equal texts are linked. Rows that share an id keep a row each. A null id counts as no id: its component is
    the smallest other id, or null. `group`, `block` and `room` say how work is divided; they change no result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("tie"))
    rows = cut(members(texts, percent, width, group, block, room).drop("tie"))
    least = cut(rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc").alias("least")))
    out = rows.join(least, "component", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", group: int = 64, block: int = 768, room: int = ROOM) -> DataFrame:
    """The rows of docs of which one of each group of near duplicates stays, with all their columns.

    Of a group, the row of the smallest id stays, a null id last; among rows of that id, the one whose columns'
    hash is smallest; of rows equal in every column, one. Rows without a word are in no group and all stay.
    """
    key = F.xxhash64(*docs.columns).alias("tie")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), key)
    rows = members(texts, percent, width, group, block, room).where("component IS NOT NULL")
    won = cut(rows.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "tie")).alias("w")).select("w.doc", "w.tie").distinct())
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own_doc"), key.alias("own_tie"))
    wordless = ~F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = own.where(~wordless).join(won, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_tie") == F.col("tie")), "left_semi")
    return one.dropDuplicates(["own_doc", "own_tie"]).unionByName(own.where(wordless)).select("row.*")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of each document, by 5-word shingles and a similarity of 0.8. See `near_duplicates` for nulls and repeated ids."""
    return near_duplicates(table(spark, sf_dir, "documents"))
