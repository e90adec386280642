"""The corpus pipeline stage by stage against brute force: ids null and repeated, texts null, empty and copied, empty tables."""

import corpus_pipeline as P
import numpy as np
from test_documents import LIBRARY, SCHEMA, brute_copies, toxic_rows

from dieframe.llm import secrets

LABELS = "doc_id long, quality int, toxic int"


def key(row):
    return tuple(map(str, row))


def test_stages(spark, tmp_path):
    rows, labels = toxic_rows()
    truth = dict((i, t) for i, _, t in labels)
    clean = [r for r in rows if truth.get(r[0]) == 0][:30]
    rows = [r[:4] + (None if r[1] is None else len(r[1]),) for r in rows]
    rows += [(3000 + k, r[1], "en", "t", len(r[1])) for k, r in enumerate(clean)]  # copies
    rows += [(4000 + k, f"{r[1]} token = abcdef{k}123456 ab cd", "en", None, 5) for k, r in enumerate(clean[:10])]
    rows += [(3000, "another text of the same id", "fr", "t", 27), (None, "a text without an id", None, "t", 20), (None, None, None, None, None), (None, clean[0][1], "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), rows
    after = {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == P.COLUMNS or name == "bpe"
        after[name] = [tuple(r) for r in docs.collect()]

    kept = after["toxicity"]
    assert set(map(key, kept)) <= set(map(key, before))
    clean_ids, toxic_ids = ({i for i, t in truth.items() if t == x} for x in (0, 1))
    left = {r[0] for r in kept}
    assert len(clean_ids & left) >= 0.97 * len(clean_ids) and len(toxic_ids & left) <= 0.05 * len(toxic_ids)

    groups = {}
    for r in kept:
        words = (r[1] or "").lower().split()
        shingles = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None
        groups.setdefault((shingles, len(groups) if shingles is None else None), []).append(r)
    linked = [(a, b) for a in groups for b in groups if a[0] and b[0] and a != b and 100 * len(a[0] & b[0]) >= 80 * len(a[0] | b[0])]
    root = {g: g for g in groups}
    for _ in range(3):  # chains are short here
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b], key=str)
    members = {}
    for g, of in groups.items():
        members.setdefault(root[g], []).extend(of)
    best = [min((r[0] is None, r[0] or 0) for r in of) for of in members.values()]
    got = sorted(((r[0] is None, r[0] or 0) for r in after["near_duplicates"]))
    assert got == sorted(best) and set(map(key, after["near_duplicates"])) <= set(map(key, kept))

    masked = {key(r): r for r in after["secrets"]}
    assert len(after["secrets"]) == len(after["near_duplicates"])
    for r in after["near_duplicates"]:
        if not secrets.base_spans(r[1] or ""):
            assert key(r) in masked
    assert all(not secrets.base_spans(r[1] or "") and (r[1] is None or "[SECRET]" not in r[1] or r[4] == len(r[1])) for r in after["secrets"])
    assert sum("[SECRET]" in (r[1] or "") for r in after["secrets"]) == sum(bool(secrets.base_spans(r[1] or "")) for r in after["near_duplicates"]) > 0

    assert sorted((str(r[0]), len((r[1] or "").split())) for r in after["mixing"]) == sorted((i, n) for i, n, c in brute_copies(after["secrets"]) for _ in range(c))

    want = sorted((str(r[0]), LIBRARY.encode(r[1] or "", add_special_tokens=False).ids) for r in after["mixing"])
    assert sorted((str(r[0]), np.frombuffer(r[4], "<u4").tolist()) for r in after["bpe"]) == want
    assert all(r[3] == len(r[4]) // 4 for r in after["bpe"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
