"""The operators on documents against brute force, over texts that are null, empty, long, tied, repeated and short."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dieframe.llm import bpe, mixing, ngram_jaccard, secrets, substring_dedup, toxicity
from dieframe.llm.components import components
from dieframe.llm.convnet import ConvNet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
WORDS = ["the", "of", "Ab", "cd", "e", "fgh", "ç", "ñu"]


def prose(n: int) -> str:
    return R.choice([" ", "\n", "\t "]).join(R.choice(WORDS) + str(R.randrange(40)) for _ in range(n))


def corpus() -> list[tuple]:
    base = [prose(60) for _ in range(6)]
    passage = prose(30)
    rows = []
    for i in range(40):
        text = R.choice(base)
        words = text.split(" ") if i % 3 else prose(50).split(" ")
        if i % 2:
            words[R.randrange(len(words))] = f"edit{i}"
        rows.append((i + 1, " ".join(words) + (" " + passage if i % 5 == 0 else "")))
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one two"), (54, "One  two"), (55, "a b c d"), (56, prose(5000)), (57, "x " * 300), (58, "x " * 300), (1, rows[0][1]), (None, rows[1][1]), (None, None), (-7, rows[2][1])]
    return [(i, t, R.choice(["en", "fr", None]), R.choice(["s1", "s1", "s1", "S2", "é", None]), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bucket", "'x' AS owner", "2 AS n").repartition(3)


@pytest.mark.parametrize("size", [200, 2000, 16 << 20])
def test_remove_repeats(docs, rows, size):
    first: dict[tuple, int] = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    out = substring_dedup.remove_repeats(docs, size=size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in out) == sorted(want)
    assert all(sum(x.end - x.start for x in r.ranges) == r.n_removed for r in out)
    assert any(r.n_removed for r in out)
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None] if sets[k] else [i]
        out.append((str(i), len(sets[k]), str(min(ids) if ids and None not in ids else None)))
    return sorted(out)


@pytest.mark.parametrize("group, room", [(2, 2_000_000), (64, 40), (64, 300)])
def test_near_duplicates(docs, rows, group, room):
    """Also with so little room that the shingles of copies count as frequent ones."""
    out = ngram_jaccard.near_duplicates(docs, group=group, block=5, room=room).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_components(rows)


@pytest.mark.parametrize("buckets", [1, 3, 64, 256, 1000])
def test_shingles_come_back_from_their_buckets(buckets):
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 4000, np.uint64))
    bucket = ngram_jaccard._bucket(h, buckets)
    back = np.concatenate([ngram_jaccard._whole(ngram_jaccard._low(h[bucket == b]), b, buckets) for b in range(buckets)])
    assert len(np.unique(back)) == len(h) and (buckets < 256 or (np.sort(back) == h).all())


def test_representatives(docs, rows, spark):
    out = ngram_jaccard.representatives(docs)
    assert out.columns == docs.columns
    groups = {}
    for i, n, c in brute_components(rows):
        groups.setdefault((n > 0, c), []).append(i)
    got = sorted(str(r.doc_id) for r in out.collect() if (r.text or "").split())
    assert got == sorted(c for wordy, c in groups if wordy)
    assert out.where("text IS NULL OR text RLIKE '^\\\\s*$'").count() == sum(not (t or "").split() for _, t, *_ in rows)
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s"), (None, "q r s"), (None, None), (None, None), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, ngram_jaccard.representatives(again).collect())) == sorted(map(str, spark.createDataFrame([(1, "a b c d e f"), (1, "q r s"), (None, None), (None, None)], again.schema).collect()))


def test_near_duplicates_of_nothing(docs):
    assert ngram_jaccard.near_duplicates(docs.where("false")).count() == 0
    assert ngram_jaccard.near_duplicates(docs.where("text IS NULL")).select("n_shingles").distinct().first()[0] == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 101), (7, 7), (200, 100), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 200: 100}


ALPHABET = list("abAB 019'\"!?.,\t\n\x1c\x85\xa0éÉΣσςİıßǅ漢ひ가́​﻿😀🏽١²½K") + ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", "</w>", "the", "<|", " "]
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH, encoding="utf-8").read(), cached=50)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=30), max_size=8))
def test_texts_together_equal_texts_alone(texts):
    OWN.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode_all(texts)] == [LIBRARY.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join) | st.text(max_size=30))
def test_bpe_equals_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_of_every_character():
    """Each between a sign and letters, so that its class and its lower case show."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a:{chr(c)}b" for c in points[at : at + 128]) for at in range(0, len(points), 128)]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    wrong = [x for x, e in zip(texts, want) if np.frombuffer(OWN.encode(x), "<u4").tolist() != e]
    assert not wrong
    OWN.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode_all(texts)] == want


@pytest.mark.parametrize("letters", ["ab", "aaaab", "the", "éa漢"])
def test_bpe_of_long_words(letters):
    """Words far beyond the length up to which pieces are kept, merged through a heap."""
    r = np.random.default_rng(3)
    text = "".join(r.choice([*letters], 4000))
    parts = [text[a : a + n] for n in (30, 47, 48, 49, 100) for a in range(0, 4000, n)]
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode_all(parts)] == [e.ids for e in LIBRARY.encode_batch(parts, add_special_tokens=False)]
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


LATIN = list("aeAEzZ 09.!'-\n") + ["'S", "\u2003", "\xa0", "\x1d", "²", "J\u030c", "漢", "<|endoftext|>"] + [chr(c) for c in range(0xC0, 0x100)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(LATIN), max_size=40).map("".join), max_size=8))
def test_bpe_of_latin_words(texts):
    OWN.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode_all(texts)] == [LIBRARY.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bpe_takes_plain_words_in_arrays(monkeypatch):
    """Words of ASCII and Latin letters aren't cut one by one, and what a word repeats, in other case or beside signs, is merged once."""
    texts = [f"Été{k % 7} été, ÉTÉ! the The THE. x{'y' * (k % 5)}÷é" for k in range(500)] + [None, "", " \n"]
    want = [LIBRARY.encode(x or "", add_special_tokens=False).ids for x in texts]
    cut, merged, encode = [], [], OWN._encode_pieces
    monkeypatch.setattr(OWN, "_found", lambda w: cut.append(w))
    monkeypatch.setattr(OWN, "_encode_pieces", lambda pieces: merged.append(len(pieces)) or encode(pieces))
    OWN.forget()
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode_all(texts)] == want
    assert not cut and merged == [2 + 7 + 3 + 5 + 2]  # words, digits, signs, x and ys, ÷ and é


def test_bpe_columns(docs):
    with pytest.raises(ValueError):
        bpe.encode(bpe.encode(docs, PATH), PATH)
    both = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert both.columns == [*docs.columns, "ids", "decoded"] and both.count() == docs.count()
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0


def test_bpe_digests(docs, rows):
    out = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == want


def test_forced_cuts_stand_where_no_token_has_the_pair():
    assert any("th" in t for t in OWN.ids) and ("t", "h") in OWN.inside
    cuts = [a + b for a in OWN.letters for b in OWN.letters if (a, b) not in OWN.inside]
    assert cuts and not any(c in t.removesuffix(bpe.END) for c in cuts[:50] for t in OWN.ids)


def test_mixing(docs, rows):
    out = mixing.copies(docs.where("doc_id IS NOT NULL")).collect()
    again = mixing.copies(docs.where("doc_id IS NOT NULL").repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    total = sum(r.size for r in out)
    sources = {(r.source_size, r.target) for r in out}
    assert abs(sum(t for _, t in sources) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for s, t in sources)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    for size, target in sources:
        mine = [r for r in out if r.source_size == size]
        assert abs(sum(r.copies for r in mine) - len(mine) * target / size) <= 1
    assert mixing.copies(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).columns == docs.columns
    assert {r.target for r in mixing.copies(docs.where("text IS NULL")).collect()} == {0.0}


def brute_copies(rows):
    """The sampling itself: documents of a source in order, a copy for each integer that the running sum crosses."""
    out = []
    size = {i: len((t or "").split()) for i, (_, t, *_) in enumerate(rows)}
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        each = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / each for s in names}
        over = {s for s in names if target[s] > 3 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in names:
        mine = []
        for i, (doc, text, _, source, _) in enumerate(rows):
            if source == s:
                h = hashlib.md5(f"{'' if doc is None else doc} {text or ''}".encode()).hexdigest()
                mine.append((len(str(size[i])) * 100 + int(str(size[i])[:2]), h, size[i], i))
        u = int(hashlib.md5(("mix" + ("" if s is None else "s" + s)).encode()).hexdigest()[:3], 16) / 4096
        rate = target[s] / total[s] if total[s] else 0.0
        for k, (_, _, n, i) in enumerate(sorted(mine), 1):
            out.append((str(rows[i][0]), n, min(3, int(np.floor(u + rate * k) - np.floor(u + rate * (k - 1))))))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_mixing_equals_the_sampling_by_hand(docs, rows, monkeypatch, chunk):
    """With any number of digits, ids null and repeated included; and the rows come as often as they are counted."""
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    assert sorted((str(r.doc_id), r["size"], r.copies) for r in mixing.copies(docs).collect()) == brute_copies(rows)
    many = sorted((str(r.doc_id), len((r.text or "").split())) for r in mixing.mixed(docs).collect())
    assert many == sorted((i, n) for i, n, c in brute_copies(rows) for _ in range(c))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Password", "api_KEY", "ſecret", "secret", "=", " : ", "'", '"', "abcdef", "x", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789ab", "deadbeef" * 2, "é", " ", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    want = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.base_spans(text) == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def secret_rows():
    r = random.Random(1)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
    out = []
    for i in range(300):
        kind = i % 4
        s = "".join(r.choice(hexa) for _ in range(40))
        text = {0: f"the token = \"{s}\" here", 1: f"see {s} there", 2: f"card {r.randrange(10**15, 10**16)} and", 3: f"mail a.b{r.randrange(99)}@mail{r.randrange(9)}.example.com.of.thing"}[kind]
        out.append((i, text, "en", "s", len(text)))
    odd = "".join(r.choice(alnum) for _ in range(3))
    return out + [(1000, None, None, None, None), (1001, "", None, None, 0), (1002, "z" * 200_000 + odd, None, None, 200_003)]


def brute_windows(text, spans):
    """Label, start and end of each labelled window, by regular expressions: 0, or 1 and the number of the kind."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", text):
        a, b = m.span()
        edges = [(a, b)] if b - a <= 80 else [(x, x + 80) for x in range(a, b - 80, 40)] + [(b - 80, b)]
        if not any(s < b and e > a for _, s, e, _, _ in spans):
            out += [(0, x, y) for x, y in edges]
            continue
        for x, y in edges:
            kinds = [secrets.KINDS.index(k) + 1 for k, _, _, s, e in spans if s < y and e > x]
            out += [(kinds[0], x, y)] if kinds else []
    return sorted(out, key=lambda x: x[1:])


TEXTS = ["", "a", "password: hunter2hunter2 and more", "k" * 300 + " " + "0123456789abcdef" * 8 + "/tail", "é" * 40 + "abcdef", "secretword=" + "x" * 90, "one sixsix\0seven777 \U0001f600abcdefg", "AKIA" + "A1" * 10]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:1], TEXTS[::-1], []])
def test_secret_windows(texts):
    base = [secrets.base_values(x) for x in texts]
    laid = secrets.Laid(texts)
    a, b, label = secrets.candidates(laid, base)
    a, b, owner = secrets.split(a, b)
    label = label[owner]
    doc = np.searchsorted(laid.start, a, "right") - 1
    got = [sorted(((int(z), int(x - laid.start[d]), int(y - laid.start[d])) for x, y, z, d in zip(a, b, label, doc) if d == i and z >= 0), key=lambda x: x[1:]) for i in range(len(texts))]
    assert got == [brute_windows(x, s) for x, s in zip(texts, base)]
    assert [laid.around(x, y) for x, y in zip(a, b)] == [
        "\0".join([texts[d][max(0, x - 16) : x].replace("\0", "\1"), texts[d][x:y], texts[d][y : y + 4].replace("\0", "\1")]) for x, y, d in zip((a - laid.start[doc]).tolist(), (b - laid.start[doc]).tolist(), doc)] if len(texts) else True


def test_secret_hashes_tell_windows_apart():
    texts = ["at abcdef gh", "at abcdef gh", "at abcdef gi", "at abcdefg h", "t abcdef gh"]
    laid = secrets.Laid(texts)
    a, b, _ = secrets.candidates(laid, [[] for _ in texts])
    assert len(a) == 5 and len(set(laid.hashes(a, b)[:2])) == 1 and len(set(laid.hashes(a, b))) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*TEXTS, " ", "\n", "token=", "zzzzzz", "q"]), max_size=6).map("".join), max_size=5))
def test_secret_tables_equal_the_network(texts):
    """Lookups by pairs of characters against the network on each window's own features."""
    net = ConvNet(np.arange(secrets.FEATURES, dtype=np.uint64), size=8, widths=(2, 4), filters=8, seed=5, gaps=True)
    net.bias += 0.1
    laid = secrets.Laid(texts)
    a, b, _ = secrets.split(*secrets.candidates(laid, [[] for _ in texts])[:2])
    fast = secrets.Detector(net).logits(laid.symbol, a, b)
    slow = [net.logits(x, np.array([0, len(x)]))[0] for x in (secrets.features(laid.around(s, e)) for s, e in zip(a, b))]
    assert np.allclose(fast, slow, atol=1e-4)


def test_secret_scan(spark):
    docs = spark.createDataFrame(secret_rows(), SCHEMA)
    detector = secrets.train(docs)
    assert detector is not None
    spans = {r.doc_id: r.spans for r in secrets.scan(docs.repartition(5), detector).collect()}
    for i, text, *_ in secret_rows():
        assert [(s.kind, s.start, s.end) for s in spans[i] if s.kind != "cnn"] == secrets.base_spans(text or ""), i
        assert all(not (s.kind == "cnn" and x.kind != "cnn" and s.start < x.end and x.start < s.end) for s in spans[i] for x in spans[i])
    assert sum(s.kind == "cnn" for i in spans for s in spans[i]) <= 0.05 * len(spans)
    clean = {r.doc_id: r for r in secrets.redact(docs, detector).collect()}
    assert clean[0].text == "the [SECRET]\" here" and clean[0].n_chars == len(clean[0].text) and clean[1000].text is None
    assert secrets.train(docs.where("false")) is None and secrets.scan(docs.where("false"), None).count() == 0
    assert secrets.train(docs.where("doc_id % 4 = 2")) is None
    assert {r.doc_id: len(r.spans) for r in secrets.scan(docs.where("doc_id < 2"), None).collect()} == {0: 2, 1: 1}


def test_secret_query_equals_the_patterns(spark, tmp_path):
    """Every column of the base spans, over a whole table, by the contract's own words."""
    rows = secret_rows() + [(2000 + i, x, "en", "s", len(x)) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secrets.op3_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = [("assign", *m.span()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        want.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        names = [f"{k}:{s}:{e}" for k, s, e in want]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[0] == k for x in want) for k in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in spans if not x.startswith("cnn")] == names and [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


def planted_rows():
    """Documents with tokens of kinds that no base pattern matches, with the spans of those tokens, among prose and other long runs."""
    r = random.Random(4)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda n, letters=mixed: "".join(r.choice(letters) for _ in range(n))
    words = ["".join(r.choice("aeiourstlnm") for _ in range(r.randrange(3, 11))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, spans = [], []
    for i in range(1200):
        text = prose(r.randrange(5, 60)) + " "
        if i % 3 == 0:
            kind = r.choice([lambda: "ghq_" + of(36), lambda: "xoxz-" + of(11, "0123456789") + "-" + of(24), lambda: of(40, mixed + "+/")])()
            spans.append((i, len(text), len(text) + len(kind)))
        else:
            kind = r.choice([lambda: f"{r.randrange(10**15, 10**16)}", lambda: f"www.{r.choice(words)}.example/{r.choice(words)}/{r.choice(words)}.html", lambda: f"{r.choice(words)}.{r.choice(words)}@mail.example", lambda: "=" * r.randrange(6, 30), lambda: f"2024-0{r.randrange(1, 10)}-11/{r.randrange(10**6)}"])()
        docs.append((i, text + kind + " " + prose(r.randrange(5, 40)), "en", "s", 0))
    return docs, spans


def test_network_finds_secrets_that_no_pattern_matches(spark):
    """Trained on the labelled findings of one half, it must find those of the other half and little else."""
    rows, spans = planted_rows()
    assert sum(len(secrets.base_spans(x[1])) for x in rows) == 0
    docs = spark.createDataFrame(rows, SCHEMA)
    found = spark.createDataFrame([x for x in spans if x[0] < 600], "doc_id long, start long, end long")
    detector = secrets.train(docs.where("doc_id < 600"), found)
    got = {(r.doc_id, s.start, s.end) for r in secrets.scan(docs.where("doc_id >= 600"), detector).collect() for s in r.spans}
    want = {x for x in spans if x[0] >= 600}
    assert len(want & got) >= 0.95 * len(want) and len(want & got) >= 0.9 * len(got)


def ordinary_rows(secrets_of):
    """Texts with phones, addresses, cards, versions and names; some with what secrets_of gives for their number."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(("athe", "nthe", "Ouel", "sosti", "êlle", "der")) + r.choice(("and", "re", "ing", "a,", "o.")) for _ in range(n))
    octets = lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4))
    plain = (
        lambda: "".join(r.choice("0123456789") for _ in range(16)), octets, lambda: f"{r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
        lambda: f"mail{r.randrange(9)}.example.org", lambda: f"v{r.randrange(9)}.{r.randrange(30)}.{r.randrange(99)}", lambda: f"id-{r.randrange(10**6):06}",
    )
    rows = []
    for i in range(1500):
        more = secrets_of(i, r) or (r.choice(plain)() if i % 4 == 1 else "")
        rows.append((i, f"{say(r.randrange(3, 60))} {more} {say(5)}", "en", "s", 0))
    return rows


HEXES = "0123456789abcdef"


def test_network_leaves_cards_phones_and_addresses_alone(spark):
    """Trained on nothing but base spans, as on documents: it finds tokens that no pattern matches, and no number, address or name."""

    def planted(i, r):
        token = "".join(r.choice(HEXES) for _ in range(40))
        return f'token = "{token}"' if i % 12 == 0 else token if i % 12 == 6 else token[:22] if i % 50 == 7 else None

    docs = spark.createDataFrame(ordinary_rows(planted), SCHEMA).repartition(4)
    detector = secrets.train(docs)
    assert detector.recall.keys() == {"assign", "hex"} and min(detector.recall.values()) >= 0.98 and detector.precision >= 0.6  # all planted ones count against it, of the others a fifth
    added = {r.doc_id for r in secrets.scan(docs, detector).collect() for s in r.spans if s.kind == "cnn"}
    want = {i for i in range(1500) if i % 50 == 7 and i % 6}
    assert len(added & want) >= 0.8 * len(want) and len(added - want) <= 3
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in secrets.redact(docs, detector).collect()}
    assert sum(before[i] != after[i] for i in before if i % 6 and i not in want) <= 3


def test_scan_of_other_ids_and_columns(spark):
    docs = spark.createDataFrame([("a", "token=abc123def", 1), (None, None, 2)], "doc_id string, text string, spans int")
    assert [(r.doc_id, len(r.spans)) for r in secrets.scan(docs, None).orderBy("doc_id").collect()] == [(None, 0), ("a", 1)]


def toxic_rows():
    r = random.Random(2)
    bad = ["vilebeast", "vilething", "rotten", "crud"]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice("ab cd ef gh ij kl mn op qr st uv".split()) + r.choice("xyz") for _ in range(r.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", ".", "!"])
        rows.append((i, " ".join(words), r.choice(["en", "fr"]), "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows + [(2000, None, None, None, None), (2001, "", None, None, 0), (2002, "abx " * 20_000 + "rotten", "en", "s", 0)], labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.where(f"NOT ({toxicity.HELD_OUT})"), marks.where(f"NOT ({toxicity.HELD_OUT})"), most=250)
    out = {r.doc_id: r for r in toxicity.rejected(toxicity.score(docs.withColumn("held", docs.doc_id % 2 == 0), model), model).selectExpr("*", f"{toxicity.HELD_OUT} AS held_out").collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if out[i].held_out]
    assert sum((out[i].score >= 0.7) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[2002].score >= 0.7 and out[2001].score < 0.5
    assert sum(out[i].rejected != bool(truth[i]) for i in held) <= 0.03 * len(held)
    again = toxicity.train(docs.repartition(5).where(f"NOT ({toxicity.HELD_OUT})"), marks.where(f"NOT ({toxicity.HELD_OUT})"), most=250)
    assert again.scores(["crud abx"]) == model.scores(["crud abx"])
    none = toxicity.train(docs.where("false"), marks)
    assert toxicity.score(docs, none).count() == len(rows) and 0 <= none.scores(["x"])[0] <= 1


@pytest.mark.parametrize("most", [100, 3000])
def test_toxicity_is_calibrated_at_the_true_share(spark, most):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(4000):
        unsure = i % 5 == 0  # a quarter of these is toxic, so 5 of 100 texts are
        words = [r.choice("ab cd ef gh ij".split()) + r.choice("xyz") for _ in range(12)] + ["maybe"] * unsure
        rows.append((i, " ".join(words), r.choice(["en", "fr"]), "s", 0))
        labels.append((i, 1, int(unsure and r.random() < 0.25)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, most=most)
    scores = model.scores([r[1] for r in rows[::5]])
    assert 0.15 <= scores.mean() <= 0.35 and (scores >= 0.7).mean() < 0.02
