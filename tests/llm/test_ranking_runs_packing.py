"""Ranked search, runs and packing against brute force: ids null and repeated, texts null, empty, long and tied, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_documents import LIBRARY, SCHEMA, corpus

from dieframe.llm import ball_tree, packing, periodic_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
R = random.Random(9)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS length", "'x' AS term", "2 AS shard", "3 AS query", "4 AS task", "5 AS runs").repartition(3)


def brute_ranks(docs, items, k):
    terms = [(i, Counter(TERM.findall((x or "").translate(LOWER)))) for i, x in docs]
    terms = [x for x in terms if x[1]]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            weights = ((math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))), c[w]) for w in TERM.findall((text or "").translate(LOWER)))
            scores.append((sum(w * ((10**9 * tf) // (1000 * tf + 8 * m)) for w, tf in weights), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(str(item), r, str(i), s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells, terms", [(1 << 22, 1 << 13), (600, 1 << 13), (3000, 20)])
def test_ranks(spark, docs, rows, monkeypatch, cells, terms):
    """Also with shards of a few documents and blocks of a few terms."""
    monkeypatch.setattr(ball_tree, "CELLS", cells)
    texts = [r[1] for r in rows if r[1]]
    items = [(1, texts[0]), (2, texts[3][:80]), (3, "THE the ab1 ÇA ñu2 çu"), (3, "one two"), (None, texts[5][:60]), (4, None), (5, ""), (6, " .,"), (7, "nowhere"), (8, texts[0])]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS query", "2 AS size", "3 AS doc_id", "4 AS score")
    out = ball_tree.rank(docs, table, terms=terms).collect()
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in out) == brute_ranks([r[:2] for r in rows], items, 10)
    assert ball_tree.rank(docs.where("false"), table).count() == 0 == ball_tree.rank(docs, table.where("false")).count()


def test_ranks_equal_sql(spark, tmp_path):
    docs = [(i, " ".join(R.choice(("Aa", "b", "Éa", "d9", "e-f", "x")) + str(R.randrange(9)) for _ in range(R.randrange(40)))) for i in range(120)] + [(500, None)]
    items = [(i, docs[i][1][:50]) for i in range(20)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert sorted(con.execute(ball_tree.OP11_SQL).fetchall()) == sorted(map(tuple, ball_tree.op11_ball_tree(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    """Copies, ties and repeated ids; every search is exact, and a search for what a few documents hold prunes."""
    r = np.random.default_rng(seed)
    vectors = r.integers(0, 1_000_000, (300, 40)) * (r.random((300, 40)) < 0.15)
    vectors[:, 0] += 1
    vectors[100:220] = vectors[3]
    ids = r.integers(0, 1000, 300)
    doc, term = np.nonzero(vectors)
    tree = ball_tree.Tree(ids, np.searchsorted(doc, np.arange(301)), term, vectors[doc, term], 40)
    for k in (1, 7, 400):
        for _ in range(20):
            own = np.sort(r.choice(40, r.integers(1, 12), replace=False))
            weight = r.integers(0, 40_000, len(own))
            score = vectors[:, own] @ weight
            order = np.lexsort((ids, -score))
            order = order[score[order] > 0][:k]
            got_ids, got = tree.search(own, weight, k)
            assert got.tolist() == score[order].tolist() and got_ids.tolist() == ids[order].tolist()
    tree.touched = 0
    tree.search(np.array([5]), np.array([1000]), 3)
    assert tree.touched < 300


def brute_runs(w, least=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, exponent * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def periodic_words(r):
    kinds = r.choice([1, 2, 3, 30])
    w = [b"%d" % r.randrange(kinds) for _ in range(r.randrange(50))]
    if r.random() < 0.6:
        w += [b"%d" % r.randrange(kinds) for _ in range(r.randrange(1, 14))] * r.randrange(2, 9) + w[: r.randrange(4)]
    return w * r.choice([1, 1, 4, 5])


def test_find_runs():
    for _ in range(500):
        texts = [periodic_words(R) for _ in range(R.randrange(4))]
        assert periodic_runs.find_runs(texts) == [brute_runs(w) for w in texts]
        assert periodic_runs.find_runs(texts, least=20, exponent=5) == [brute_runs(w, 20, 5) for w in texts]
    long = [b"%d" % (k % 700) for k in range(40_000)]  # a period far longer than what is compared at once
    assert periodic_runs.find_runs([long, [b"a"] * 50_000]) == [[(0, 40_000, 700)], [(0, 50_000, 1)]]


def test_collapse_runs(spark, docs, rows):
    rows = [*rows, *((700 + k, b" ".join(periodic_words(R)).decode(), "en", "s", 1) for k in range(40)), (900, "x y " * 9 + "y y y y y y y z", None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS n_words").repartition(4)
    want = []
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        runs = brute_runs(w)
        gone = {k for start, n, q in runs for k in range(start + q, start + n)}
        want.append((str(i), len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    out = periodic_runs.collapse_runs(table).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out) == sorted(want)
    assert periodic_runs.collapse_runs(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(table, exponent=3)


def test_op12(spark, tmp_path):
    rows = [(i, " ".join(R.choice("abc") + str(R.randrange(30)) for _ in range(R.randrange(90)))) for i in range(150)] + [(None, "a b " * 8), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        w = (text or "").split()
        h, n = (1 if i is None else zlib.crc32(str(i).encode())), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for start, m, q in runs for k in range(start + q, start + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) + (0,) if runs else (None,) * 4
        top = (*top[:3], 1000 * top[1] // top[2]) if runs else top
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
        want.append((i, len(runs), *top, *digests))
    out = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert any(x[1] for x in want)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return len(rooms)


def laid_out(pieces, capacity):
    """pieces: sequence, offset, length. True if every sequence is gapless and within the capacity."""
    ends: Counter = Counter()
    for sequence, offset, length in sorted(pieces):
        if offset != ends[sequence]:
            return False
        ends[sequence] += length
    return all(x <= capacity for x in ends.values())


def test_plan():
    for _ in range(200):
        capacity = R.choice([1, 10, 50, 2048])
        lengths = [R.randint(1, capacity if R.random() < 0.5 else max(1, capacity // 8)) for _ in range(R.randrange(600))]
        made = packing.plan(Counter(lengths), capacity)
        assert laid_out([(s + k, offset, length) for length, _, n, s, offset in made for k in range(n)], capacity)
        assert len({s + k for _, _, n, s, _ in made for k in range(n)}) == best_fit(lengths, capacity)
        ranks: Counter = Counter()
        for length, rank, n, *_ in made:
            assert rank == ranks[length]
            ranks[length] += n
        assert ranks == Counter(lengths)
    billions = packing.plan({k: 10**9 + k for k in range(1, 2049)}, 2048)  # the plan follows the capacity, not the rows
    assert len(billions) < 10_000


def test_pack(spark):
    lengths = [R.choice([R.randint(1, 64), 64, 7]) for _ in range(3000)]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "task long, n int").selectExpr("*", "1 AS length", "2 AS before", "3 AS slot").repartition(5)
    out = packing.pack(pieces, 64, length_col="n")
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = out.collect()
    assert sorted((r.task, r.n) for r in rows) == [*enumerate(lengths)]
    assert laid_out([(r.sequence_id, r.offset, r.n) for r in rows], 64)
    assert len({r.sequence_id for r in rows}) == best_fit(lengths, 64)
    assert packing.pack(pieces.where("false"), 64, length_col="n").count() == 0
    with pytest.raises(ValueError, match="exist already"):
        packing.pack(pieces.withColumn("Offset", pieces.n), 64)
    for bad in ("NULL", "0", "65"):
        with pytest.raises(Exception, match="lengths go from 1 to 64"):
            packing.pack(pieces.selectExpr(f"CAST({bad} AS INT) AS length"), 64)


@pytest.mark.parametrize("capacity", [2048, 10])
def test_token_pieces_and_sequences(docs, rows, capacity):
    tok = LIBRARY
    want, ids_of = [], []
    for i, text, *_ in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        ids_of.append(ids.tobytes())
        for k, at in enumerate(range(0, len(ids), capacity)):
            one = ids[at : at + capacity]
            want.append((str(i), k, at, len(one), zlib.crc32(one.tobytes())))
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity)
    packed = packing.pack(pieces, capacity)
    out = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert laid_out([(r.sequence_id, r.offset, r.length) for r in out], capacity)
    assert len({r.sequence_id for r in out}) == best_fit([x[3] for x in want], capacity)
    by_sequence: dict[int, bytes] = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        by_sequence[r.sequence_id] = by_sequence.get(r.sequence_id, b"") + bytes(r.ids)
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()} == by_sequence
    assert sum(map(len, by_sequence.values())) == sum(map(len, ids_of))


def test_op13(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, None), (2, "a b c")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op13_packing(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert sorted((r.doc_id, r.length) for r in out.collect()) == [(1, 4), (2, 1), (2, 4)]
