"""WebP, WARC, top-k and tool calls against exact round trips and brute force."""

import base64
import hashlib
import json
import random
import sys
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dieframe.llm import maxscore, tool_calls, warc, webp

# WebP: a small writer of whole argb images with any transform, for the decoder.


def put_image(out: webp.Out, argb: np.ndarray, width: int, cache_bits: int = 0, main: bool = False, tiles: int = 0, copies: bool = True) -> None:
    """Pixels as literals, cache hits and back-references, with one group of codes or a group for each of two tiles."""
    px = argb.tolist()
    steps, cache, at = [], {}, 0
    while at < len(px):
        run = 0
        while copies and at >= width and at + run < len(px) and px[at + run] == px[at + run - width] and run < 300:
            run += 1
        place = ((px[at] * webp.CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if run >= 3:
            steps.append(("copy", at, run))
        elif cache_bits and cache.get(place) == px[at]:
            steps.append(("cache", at, place))
            run = 1
        else:
            steps.append(("plain", at, px[at]))
            run = 1
        for k in range(at, at + run):
            if cache_bits:
                cache[((px[k] * webp.CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        at += run
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if main:
        out.put(int(tiles > 0), 1)
        if tiles:
            groups = 2
            across, down = -(-width >> tiles), -(-(len(px) // width) >> tiles)
            out.put(tiles - 2, 3)
            which = np.arange(across * down) % 2
            put_image(out, (which << 8).astype(np.uint32) | np.uint32(0xFF000000), across, copies=False)
    group = lambda k: int(which[(k // width >> tiles) * across + (k % width >> tiles)]) if groups > 1 else 0
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    far = webp.put_value(1)  # the pixel above
    for kind, k, v in steps:
        c = counts[group(k)]
        if kind == "plain":
            for t, s in enumerate(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24)):
                c[t][s] += 1
        elif kind == "cache":
            c[0][280 + v] += 1
        else:
            c[0][256 + webp.put_value(v)[0]] += 1
            c[4][far[0]] += 1
    lengths, codes = [], []
    for c in counts:
        real = [webp.put_prefix(out, webp.lengths_of(x, 15)) for x in c]
        lengths.append(real)
        codes.append([webp.codes_of(x) for x in real])
    for kind, k, v in steps:
        n, c = lengths[group(k)], codes[group(k)]
        if kind == "plain":
            for t, s in enumerate(((v >> 8) & 255, (v >> 16) & 255, v & 255, v >> 24)):
                out.put(c[t][s], n[t][s])
        elif kind == "cache":
            out.put(c[0][280 + v], n[0][280 + v])
        else:
            p, extra, size = webp.put_value(v)
            out.put(c[0][256 + p], n[0][256 + p])
            out.put(extra, size)
            out.put(c[4][far[0]], n[4][far[0]])
            out.put(far[1], far[2])


def predict(argb, width, height, shift, modes):
    """Residuals, pixel by pixel."""
    px = webp._split(argb).T.reshape(height, width, 4)
    flat = px.reshape(-1, 4)
    across = -(-width >> shift)
    out = np.zeros_like(flat)
    for i in range(len(flat)):
        y, x = divmod(i, width)
        if i == 0:
            p = np.array([255, 0, 0, 0])
        elif y == 0:
            p = flat[i - 1]
        elif x == 0:
            p = flat[i - width]
        else:
            mode = int(modes[(y >> shift) * across + (x >> shift)] >> 8) & 15
            p = webp._predicted(mode, flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])
        out[i] = flat[i] - p
    return webp._join(out.T)


def cross(argb, width, height, shift, elements):
    c = webp._split(argb)
    y, x = np.divmod(np.arange(len(argb)), width)
    e = webp._split(elements[(y >> shift) * -(-width >> shift) + (x >> shift)]).astype(np.int8).astype(np.int64)
    s = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    red, green = s(c[1]), s(c[2])
    c[3] -= ((e[2] * green) >> 5) + ((e[1] * red) >> 5)
    c[1] -= (e[3] * green) >> 5
    return webp._join(c)


def degreen(argb):
    c = webp._split(argb)
    c[1] -= c[2]
    c[3] -= c[2]
    return webp._join(c)


@pytest.mark.parametrize("kinds", [(), ("p",), ("c",), ("g",), ("g", "p"), ("p", "c", "g")])
@pytest.mark.parametrize("cache_bits,tiles", [(0, 0), (3, 0), (0, 2), (6, 3)])
def test_decoder_inverts_every_transform(kinds, cache_bits, tiles):
    r = np.random.default_rng(len(kinds) * 10 + cache_bits)
    width, height, shift = 37, 23, 2
    few = r.integers(0, 1 << 32, 9, dtype=np.uint32)
    image = few[r.integers(0, 9, (height, width))]
    image[5:9] = image[4]
    argb = image.ravel()
    out = webp.Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    n = -(-width >> shift) * -(-height >> shift)
    for k in kinds:
        out.put(1, 1)
        if k == "p":
            modes = (np.arange(n) % 14 << 8).astype(np.uint32) | np.uint32(0xFF000000)
            argb = predict(argb, width, height, shift, modes)
            out.put(webp.PREDICTOR, 2)
            out.put(shift - 2, 3)
            put_image(out, modes, -(-width >> shift))
        elif k == "c":
            elements = r.integers(0, 1 << 24, n, dtype=np.uint32) | np.uint32(0xFF000000)
            argb = cross(argb, width, height, shift, elements)
            out.put(webp.CROSS_COLOUR, 2)
            out.put(shift - 2, 3)
            put_image(out, elements, -(-width >> shift))
        else:
            argb = degreen(argb)
            out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    put_image(out, argb, width, cache_bits, True, tiles)
    assert (webp.decode_vp8l(out.bytes()) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    r = np.random.default_rng(colours)
    table = r.integers(0, 1 << 32, colours, dtype=np.uint32)
    width, height = 21, 9
    index = r.integers(0, colours, (height, width))
    out = webp.Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    out.put(1 | webp.PALETTE << 1, 3)
    out.put(colours - 1, 8)
    c = webp._split(table)
    put_image(out, webp._join(np.diff(c, prepend=0, axis=1)), colours)
    packing = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, size = 1 << packing, 8 >> packing
    packed = (np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per) << (np.arange(per) * size)).sum(2) if packing else index
    out.put(0, 1)
    put_image(out, packed.ravel().astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), packed.shape[1], 0, True)
    assert (webp.decode_vp8l(out.bytes()) == table[index]).all()


@pytest.mark.parametrize("text", [None, "", "a", "a" * 575, "ab" * 288, "é" * 289, "".join(map(chr, range(1, 900))), "word " * 4000])
def test_payload_round_trip(text):
    payload, n = webp.payload_of(text)
    assert len(payload) % 576 == 0 and payload and payload[:n].decode() == (text or "") and set(payload[n:]) <= {255}
    media = webp.store(payload)
    assert webp.samples_of(media).tobytes() == payload
    assert media[:4] == b"RIFF" and struct.unpack_from("<I", media, 4)[0] == len(media) - 8


def test_pixel_arrays(spark):
    """A column of coloured images, grey ones that follow each other, nothing and null."""
    image = np.random.default_rng(2).integers(0, 1 << 32, 12, np.uint32)
    out = webp.Out()
    out.put(0x2F, 8)
    out.put(3, 14)
    out.put(2, 14)
    out.put(0, 4)
    out.put(0, 1)
    put_image(out, image, 4, main=True)
    data = out.bytes()
    data += b"\0" * (len(data) % 2)
    colour = struct.pack("<4sI4s4sI", b"RIFF", len(data) + 12, b"WEBP", b"VP8L", len(data)) + data
    grey = bytes(webp.store(b"abc" * 192))
    df = spark.createDataFrame([(1, bytearray(colour)), (2, bytearray(grey + grey)), (3, bytearray()), (4, None)], "id int, media binary")
    got = {r.id: r.images for r in webp.decoded(df.repartition(2)).collect()}
    (one,) = got[1]
    assert (one.width, one.height) == (4, 3) and (np.frombuffer(one.argb, "<u4") == image).all()
    assert [(x.width, x.height) for x in got[2]] == [(576, 1)] * 2 and np.frombuffer(got[2][1].argb, "<u4")[1] == 0xFF626262
    assert got[3] == [] and got[4] is None


def test_damaged_media_raises():
    media = bytearray(webp.store(webp.payload_of("some words of text " * 60)[0]))
    media[20] = 0
    with pytest.raises(ValueError):
        webp.samples_of(bytes(media))
    with pytest.raises(ValueError):
        webp.decode_vp8l(bytes(webp.store(b"x" * 576)[20:24]))


def test_media_query(spark):
    docs = spark.createDataFrame([(1, "abc", 9), (2, None, 9), (2, "", 9), (3, "x" * 10_000_000, 9)], "doc_id long, text string, media long").drop("media")
    out = {(r.doc_id, r.n_bytes): r for r in webp.features(webp.stored(docs)).collect()}
    for (i, n), text in {(1, 3): "abc", (2, 0): "", (3, 10_000_000): "x" * 10_000_000}.items():
        payload = webp.payload_of(text)[0]
        assert out[i, n].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[i, n].payload_bytes == len(payload) and 0 <= out[i, n].tail_crc32 < 1 << 32


# WARC.


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 5000, "<p>a</p>", "x" * 70_000, "x" * 70_000]
    rows = [(9 - k, f"http://h/{k} y\r\nX: z", h, "noise") for k, h in enumerate(html)] + [(None, None, "ü" * 5000, None), (4, "u", "dup", None), (4, "u", "dup", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    warc.write(pages, str(tmp_path / "w"), chunk=4096)
    out = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(out) == len(rows)
    ids: dict[str, list] = {}
    for i, _, h, _ in rows:
        ids.setdefault(h or "", []).append(i)
    by_id = {r.page_id: r for r in out if r.page_id != 4}
    for i, _, h, _ in rows:
        first = min(x for x in ids[h or ""] if x is not None)
        body = (h or "").encode()
        if i != 4:
            r = by_id[i]
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
    assert sorted((r.record_type, str(r.refers_to)) for r in out if r.page_id == 4) == [("response", "None"), ("response", "None"), ("revisit", "4")]
    chunks = spark.read.parquet(str(tmp_path / "w"))
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] < 6000
    one = b"".join(r.data for r in chunks.where(F.col("record").startswith("3-")).orderBy("chunk").collect())
    head, _, body = one.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body.endswith(b"\r\n\r\n")
    chunks.where("chunk <> 1").write.parquet(str(tmp_path / "lost"))
    chunks.withColumn("data", F.when(F.col("chunk") == 1, F.encode(F.translate(F.decode("data", "iso-8859-1"), "x", "y"), "iso-8859-1")).otherwise(F.col("data"))).write.parquet(str(tmp_path / "turned"))
    for name in ("lost", "turned"):
        with pytest.raises(Exception, match="missing or damaged"):
            warc.read(spark, str(tmp_path / name)).collect()
    warc.write(pages.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    big = spark.createDataFrame([(1, "u", "y" * 100)], "page_id long, url string, html string")
    warc.write(big.unionByName(big.selectExpr("page_id + 1 AS page_id", "url", "html")), str(tmp_path / "v"), least=101)
    assert {r.record_type for r in warc.read(spark, str(tmp_path / "v")).collect()} == {"response"}


# Top k.


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, r.gauss(0, 0.2), 0.1]) for _ in range(16)], 1) for i in range(300)]
    rows += [(300, rows[7][1], 1), (301, rows[7][1], 1), (302, None, 1), (350, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [float("inf")] + [0.0] * 15, 1), (305, [0.5, -0.5], 1), (None, rows[3][1], 1), (50, rows[4][1], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], s) for i, v, s in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    out = maxscore.top_k(df, shard=64, block=3).collect()
    good = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v)))).astype(int)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(good):
        if i is not None and i % 50 == 0:
            scored = sorted((-int(q @ v), j if j is not None else 1 << 62) for b, (j, v) in enumerate(good) if a != b)[:5]
            want += [(i, k + 1, None if j == 1 << 62 else j, -s) for k, (s, j) in enumerate(scored)]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert maxscore.top_k(df.where("false")).count() == 0 and maxscore.top_k(df.where("vec_id = 0")).count() == 0
    assert maxscore.top_k(df.where("vec_id IN (0, 1, 2)")).count() == 2


@pytest.mark.parametrize("far", [3.0, 2.0**42, 2.0**44, 6 * 2.0**42])
def test_top_k_is_exact_at_any_size(spark, far):
    """Small vectors and one large query: sums within and beyond what a double holds; ids repeat."""
    r = random.Random(6)
    rows = [(i % 90, [float(r.randrange(200)) / 256 for _ in range(8)]) for i in range(1, 100)] + [(100, [far + r.randrange(256) / 256 for _ in range(8)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = [(r.rank, r.score) for r in maxscore.top_k(df, every=100, shard=16).collect() if r.query_id == 100]
    q = [int(np.floor(256 * x)) for x in rows[-1][1]]
    scores = sorted((sum(a * int(256 * b) for a, b in zip(q, v)) for _, v in rows[:-1]), reverse=True)
    assert sorted(out) == [(i + 1, s) for i, s in enumerate(scores[:5])]


# Tool calls.


def test_tool_calls(spark):
    calls = [(1, 1, "a", "t", '{"n": 1, "s": "x\\u00e9"}', []), (1, 2, "b", "t", '{"s": "y", "n": "no", "z": [1, {"b": 2, "a": 1}]}', ["a", "gone"]), (1, 3, "c", "t", "not json", ["a", "b"]), (2, 1, "d", "nope", "{}", ["e"]), (2, 2, "e", "t", None, ["d"]), (2, 3, None, "t", '{"n": 2, "s": ""}', None), (3, 1, "a", "t", "{}", [])]
    results = [("a", 2, "late"), ("a", 1, "r"), ("lost", 1, "x"), (None, 1, "y"), ("b", 1, None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, waits_for array<string>")
    r = spark.createDataFrame(results, "call_id string, seq long, content string")
    s = spark.sql("SELECT 't' AS name, array(named_struct('key', 'n', 'type', 'integer', 'required', true), named_struct('key', 's', 'type', 'string', 'required', true)) AS fields")
    out = {x.call_id if x.status != "orphan" else ("orphan", x.call_id): x for x in tool_calls.link(c, r, s).collect()}
    assert len(out) == 8
    assert [out[k].level for k in "abcde"] == [0, 1, 2, None, None]
    assert [out[k].status for k in "abc"] == ["linked", "linked", "unanswered"] and out[None].status == "unanswered" and ("orphan", "lost") in out and ("orphan", None) in out
    assert out["a"].valid and out["a"].canonical == '{"arguments":{"n":1,"s":"xé"},"id":"a","name":"t","result":"r"}'
    assert out["b"].errors == ["type n", "unknown z"] and json.loads(out["b"].canonical)["arguments"] == {"n": "no", "s": "y", "z": [1, {"a": 1, "b": 2}]} and '"a":1,"b":2' in out["b"].canonical
    assert out["c"].errors == ["no JSON object"] and out["d"].errors == ["no schema"] and out["e"].errors == ["no JSON object"]
    assert tool_calls.link(c.where("false"), r.where("false"), s).count() == 0


def test_nested_schemas(spark):
    """Parts of objects, items of arrays, what each of them has, listed values, and objects that may hold anything."""
    fields = [("f", "object", True, None), ("f.lang", "string", True, ['"en"', '"fr"']), ("f.n", "integer", False, ["1", "2"]), ("a", "array", False, None), ("a[]", "object", False, None), ("a[].id", "integer", True, None),
              ("a[].t", "array", False, None), ("a[].t[]", "string", False, None), ("any", "object", False, None)]
    cases = {
        "a": ('{"f":{"lang":"en","n":2},"a":[{"id":1,"t":["x"]},{"id":2}],"any":{"z":[1]}}', []),
        "b": ('{"f":{"lang":"de","n":3,"more":1}}', ["unknown f.more", "value f.lang", "value f.n"]),
        "c": ('{"f":{},"a":[{"id":1},{}]}', ["missing a[].id", "missing f.lang"]),
        "d": ('{"f":7,"a":[1,{"id":"x","t":[1]}]}', ["type a[]", "type a[].id", "type a[].t[]", "type f"]),
        "e": ('{"a":{}}', ["missing f", "type a"]),
        "f": ('{"f":{"lang":"fr"},"a":[],"g":1}', ["unknown g"]),
    }
    c = spark.createDataFrame([(1, k, name, "t", x[0], []) for k, (name, x) in enumerate(cases.items())], "conv_id long, turn long, call_id string, name string, arguments string, waits_for array<string>")
    s = spark.createDataFrame([("t", fields), ("flat", [("f", "string", True, None)])], "name string, fields array<struct<key: string, type: string, required: boolean, values: array<string>>>")
    r = spark.createDataFrame([("a", 1, "r")], "call_id string, seq long, content string")
    assert {x.call_id: x.errors for x in tool_calls.link(c, r, s).collect()} == {k: e for k, (_, e) in cases.items()}


def test_tool_calls_beside_other_columns(spark):
    c = spark.createDataFrame([(1, 1, "a", "t", '{"n": 1}', [])], "conv_id long, turn long, call_id string, name string, arguments string, waits_for array<string>")
    c = c.selectExpr("*", "1 AS level", "2 AS status", "3 AS content", "4 AS fields").unionByName(c.selectExpr("conv_id", "3 AS turn", "CAST(NULL AS string) AS call_id", "name", "arguments", "waits_for", "1 AS level", "2 AS status", "3 AS content", "4 AS fields"))
    r = spark.createDataFrame([("a", 1, "r")], "call_id string, seq long, content string").selectExpr("*", "5 AS turn", "6 AS status", "'x' AS name")
    s = spark.sql("SELECT 't' AS name, array(named_struct('key', 'n', 'type', 'integer', 'required', true)) AS fields, 7 AS level, 8 AS errors, 9 AS conv_id")
    assert sorted((str(x.call_id), x.turn, x.status, x.valid) for x in tool_calls.link(c, r, s).collect()) == [("None", 3, "unanswered", True), ("a", 1, "linked", True)]


def test_stored_media_of_nothing_and_beside_other_columns(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert webp.stored(docs.where("false")).count() == 0 and webp.features(webp.stored(docs.where("false"))).count() == 0
    assert webp.decoded(webp.stored(docs.where("false"))).count() == 0
    assert webp.stored(docs.selectExpr("*", "1 AS feature", "2 AS images")).columns == ["doc_id", "feature", "images", "n_bytes", "media"]
    with pytest.raises(ValueError, match="exist already"):
        webp.stored(docs.selectExpr("*", "1 AS Media"))


def test_levels_equal_the_longest_way(spark):
    """Lines of hundreds of calls, calls that wait for several, cycles, and what stands behind them."""
    r = random.Random(8)
    waits = {f"l{i}": [f"l{i - 1}"] for i in range(300)}
    waits |= {f"d{i}": sorted({f"d{r.randrange(i)}" for _ in range(r.randrange(4))} if i else set()) for i in range(60)}
    waits |= {"x": ["y"], "y": ["z", "l5"], "z": ["x"], "behind": ["z"], "both": ["l299", "behind"], "self": ["self"], "top": ["l299", "d59", "gone"]}

    def level(c, path=()):
        if c in path:
            return None
        found = [level(x, (*path, c)) for x in waits[c] if x in waits]
        return None if None in found else max(found, default=-1) + 1

    sys.setrecursionlimit(10_000)
    df = spark.createDataFrame([*waits.items()], "call_id string, waits_for array<string>").repartition(3)
    assert {x.call_id: x.level for x in tool_calls.levels(df).collect()} == {c: level(c) for c in waits}
