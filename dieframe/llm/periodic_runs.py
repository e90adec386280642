"""Periodic run detection with the dictionary of basic factors.

A basic factor is a stretch of 2^k words. Each level of the dictionary names the factors of its length, equal ones
alike; the next level's names come from pairs of names that stand 2^k apart. An occurrence's successor is the next
place of the same factor. Where successors follow each other at one distance p of at most 2 * 2^k, the occurrences
form an arithmetic progression and propose the period p there. A proposal is extended both ways as long as words p
apart are equal, and counts once, whichever levels and places propose it.

Nothing is missed: take a run of smallest period q and length >= 4q, and the level with 2^k >= q > 2^k / 2. A factor
of that length that begins in the run's first q words fits twice more, q and 2q further on (2q + 2^k <= 4q), and
nowhere in between, since the rotations of a smallest period all differ. Nor is a wrong period proposed: were the
stretch's smallest period d < p, it would divide p (the stretch is 2p long or longer), and the successor would stand
d further on. So exponents below 4 aren't offered.

The texts of a slice lie end to end under one naming, and factors don't reach over their ends. A place goes on to the
next level only if its factor stands in its text again, so prose is done after a few levels, and memory follows the
words of a slice (the names of one level), not words times levels.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, released, sized, table, words_of

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "array<struct<start: long, length: long, period: long>>"
STEP = 16  # words compared one by one when a proposal is extended; then in blocks, doubled each time


def named(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word of all texts, equal ones alike; the places where the text of each word begins and ends."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
    sizes = np.array([len(text) for text in texts], np.int64)
    ends = np.cumsum(sizes)
    return words, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)


def _agree(w: np.ndarray, each: list[int], a: int, b: int, most: int, way: int) -> int:
    """How many of the next `most` words from a and b on are equal, forwards (1) or backwards (-1), the first ones included.

    Most proposals end soon, so the first words are compared one by one.
    """
    for done in range(min(STEP, most)):
        if each[a + way * done] != each[b + way * done]:
            return done
    done, step = min(STEP, most), 4 * STEP
    while done < most:
        n = min(step, most - done)
        at = done * way + way * np.arange(n)
        other = np.flatnonzero(w[a + at] != w[b + at])
        if len(other):
            return done + int(other[0])
        done, step = done + n, 2 * step
    return done


def _proposals(w: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places and periods: the first place of each stretch of places that propose the same one, level by level."""
    name = w.copy()
    at = np.arange(len(w))  # places whose factor is named, ascending
    k = 0
    while len(at):
        order = np.argsort(name[at], kind="stable")
        place = at[order]
        again = (name[place[1:]] == name[place[:-1]]) & (end[place[1:]] == end[place[:-1]])
        after = np.zeros(len(w), np.int64)  # distance of the successor; 0 for none
        after[place[:-1][again]] = (place[1:] - place[:-1])[again]
        near = np.flatnonzero((after > 0) & (after <= 2 << k))
        p = after[near]
        third = after[near + p] == p
        near, p = near[third], p[third]
        first = (np.diff(near, prepend=-2) > 1) | (np.diff(p, prepend=0) != 0)
        yield from zip(near[first].tolist(), p[first].tolist())
        # a longer factor repeats only where both of its halves do
        twice = np.zeros(len(w), bool)
        twice[place[:-1][again]] = True
        twice[place[1:][again]] = True
        low = np.flatnonzero(twice)
        low = low[low + (2 << k) <= end[low]]
        low = low[twice[low + (1 << k)]]
        pair = name[low] * len(w) + name[low + (1 << k)]  # names are below the number of words
        name[low] = np.unique(pair, return_inverse=True)[1]
        at, k = low, k + 1


def find_runs(texts: list[list[bytes]], least: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Start, length and period of every run of each text, by start, then period."""
    w, begin, end = named(texts)
    each = w.tolist()
    found: dict[tuple[int, int], int] = {}  # start and period: end
    last: dict[int, tuple[int, int]] = {}  # by period: the places looked at last whose words recur one period on
    for i, p in _proposals(w, end):
        low, high = last.get(p, (0, 0))
        if low <= i < high:
            continue
        start = i - _agree(w, each, i - 1, i - 1 + p, i - int(begin[i]), -1)
        stop = i + p + _agree(w, each, i, i + p, int(end[i]) - i - p, 1)
        last[p] = (start, stop - p)
        if stop - start >= max(least, exponent * p):
            found[start, p] = stop
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0, *map(len, texts)])
    for (start, p), stop in sorted(found.items()):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[k].append((start - int(starts[k]), stop - start, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words left when each run keeps its first period only, as far as no other run drops a word of that."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        gone[start + p] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def collapse_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text", words: Callable[[int | None, str | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row of docs.

    A run is a stretch of words with smallest period q, at least max(least, exponent * q) long, that no neighbouring
    word extends. collapsed has the words outside all runs and each run's first q words that no other run drops,
    joined by one space. exponent is 4 or more.

    `words` gives a row's words from id and text. Null and empty texts, and those of blanks alone, have none: no
    runs, and collapsed is ''. Rows that are repeated, or share an id or have none, stand each for itself; other
    columns are left out, whatever their names. An empty table gives no rows.
    """
    if exponent < 4:
        raise ValueError("runs of an exponent below 4 aren't all proposed")
    take = words or (lambda _, text: words_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized(batches, 1):
            texts = [take(i, x) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            found = find_runs(texts, least, exponent)
            rows = {
                "doc_id": part.column(0), "n_words": [*map(len, texts)], "runs": [[dict(zip(("start", "length", "period"), r)) for r in of] for of in found],
                "collapsed": [b" ".join(collapsed(*x)).decode("utf-8", "surrogatepass") for x in zip(texts, found)],
            }
            yield batch_of(rows, doc_id=pa.int64(), n_words=pa.int64(), runs=pa.list_(RUN), collapsed=pa.string())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"doc_id long, n_words long, runs {RUN_DDL}, collapsed string")


def planted(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; of about a tenth of all, chosen by crc32 of the id, the end is made periodic. A null id changes nothing."""
    words = words_of(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """n_runs, the longest run, and digests of all runs and of the collapsed words of each document.

    Null text and texts without words: no runs, four nulls, digests of nothing. See `collapse_runs` for other cases.
    """
    found = collapse_runs(table(spark, sf_dir, "documents"), words=planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
