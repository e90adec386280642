"""WARC archives as a chunked record table.

A record is its WARC bytes (header, payload, two line ends) cut into rows of (record, chunk, data). Each row carries
where its part of the payload begins and the running SHA-1 of the payload up to its end, so a reader needs one
chunk in memory and knows at each of them that nothing is missing or damaged so far. Payloads go through an
incremental digest and leave their page's row as compressed chunks; from there on no step holds a whole record.

Every step names rows by what they hold, never by their place, so a lost executor's work comes out the same again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, sized, slices, table

CHUNK = 1 << 20
RECORD = "record string, chunk int, begins long, running_sha1 binary, data binary"
END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _views(part: pa.RecordBatch) -> Iterator[memoryview]:
    """The payloads' UTF-8 where it lies in the batch."""
    for x in part.column("payload").cast(pa.binary()):
        yield memoryview(x.as_buffer() or b"")


def _digest(payload: memoryview, chunk: int) -> str:
    sha1 = hashlib.sha1()
    for at in range(0, len(payload), chunk):
        sha1.update(payload[at : at + chunk])
    return base32(sha1.digest())


def _described(chunk: int):
    """Size and digest of each payload in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized(batches, 2, most=16 * chunk):
            size, digest = zip(*((len(x), _digest(x, chunk)) for x in _views(part)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["id", "url", "size", "digest"])

    return run


def _chunks(chunk: int):
    """A row for each chunk of each payload: where it begins, the running digest, and its bytes as zstd for the shuffle."""
    kinds = {"id": pa.int64(), "url": pa.string(), "size": pa.int64(), "digest": pa.string(), "chunk": pa.int32(), "begins": pa.int64(), "running": pa.binary(), "packed": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in sized(batches, 2, most=16 * chunk):
            rows: list[tuple] = []
            held = 0
            for page, url, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _views(part)):
                digest, running = _digest(payload, chunk), hashlib.sha1()
                for k, at in enumerate(range(0, max(1, len(payload)), chunk)):
                    piece = payload[at : at + chunk]
                    running.update(piece)
                    rows.append((page, url, len(payload), digest, k, at, running.digest(), press.compress(piece)))
                    held += len(rows[-1][-1])
                    if held > 8 * chunk:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)

    return run


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=[*kinds])


def header(kind: str, record: str, page: int | None, url: str | None, size: int, digest: str, refers_to: int | None, refers_record: str | None) -> bytes:
    """A WARC 1.1 header. What WARC has no field for (the page's id, the full payload's size) stands in X- fields."""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{record}>", "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "about:blank").split()), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size, "X-Page-ID": "" if page is None else page,
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_record}>", "X-Refers-To-Page": "" if refers_to is None else refers_to}
    fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": 0 if kind == "revisit" else size}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode("utf-8", "surrogatepass")


def _written(chunk: int):
    kinds = {"record": pa.string(), "chunk": pa.int32(), "begins": pa.int64(), "running_sha1": pa.binary(), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for part in slices(batches, 64):
            rows: list[tuple] = []
            held = 0
            for p in part.to_pylist():
                piece = open_.decompress(p["packed"]) if p["packed"] else b""
                head = header(p["kind"], p["record"], p["id"], p["url"], p["size"], p["digest"], p["first_id"], p["first_record"]) if not p["chunk"] else b""
                last = p["kind"] == "revisit" or p["begins"] + chunk >= p["size"]
                rows.append((p["record"], p["chunk"], p["begins"], p["running"], head + piece + (END if last else b"")))
                held += len(rows[-1][-1])
                if held > 8 * chunk:
                    yield _batch(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)

    return run


def _record(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    return F.concat_ws("-", F.coalesce(page.cast("string"), F.lit("none")), F.hex(F.xxhash64(url)), digest, copy.cast("string"))


def _copies(many: Column, since: Column) -> Column:
    """Numbers since..many; none if there are none."""
    return F.explode(F.when(many >= since, F.sequence(since, many)).otherwise(F.array().cast("array<long>")))


def write(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Writes a record per row of pages (page_id, url, html; any other columns are left aside) as a chunk table at path.

    Of rows whose payloads are equal and of `least` bytes or more, the one with the smallest page_id (then url)
    becomes a response and the others revisit it; of rows that agree in all three, one is it. A null id comes
    last, a null html is an empty payload. Payloads are equal if size and SHA-1 are.

    A payload that many rows share is combined before the shuffle; revisits never carry theirs.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("payload"))
    page = F.struct(F.col("id").isNull().alias("late"), "id", "url")
    parts = rows.mapInArrow(_chunks(chunk), "id long, url string, size long, digest string, chunk int, begins long, running binary, packed binary")
    short = F.col("size") < least
    alone = F.when(short, page).alias("alone")  # short payloads are not shared
    parts = parts.groupBy("digest", "size", "chunk", "begins", alone).agg(F.first("running").alias("running"), F.first("packed").alias("packed"), F.min(page).alias("page"), F.count("*").alias("many"))
    parts = parts.withColumn("copy", _copies(F.when(short, F.col("many")).otherwise(F.lit(1).cast("long")), F.lit(1).cast("long")))
    record = _record(F.col("page.id"), F.col("page.url"), F.col("digest"), F.col("copy")).alias("record")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_id", "long"), ("first_record", "string"))]
    responses = parts.select(record, F.lit("response").alias("kind"), F.col("page.id").alias("id"), F.col("page.url").alias("url"), "size", "digest", *none, "chunk", "begins", "running", "packed")

    keyed = rows.mapInArrow(_described(chunk), "id long, url string, size long, digest string").where(~short).groupBy("digest", "size", "id", "url").agg(F.count("*").alias("many"))
    first = keyed.groupBy("digest", "size").agg(F.min(page).alias("first"), F.sum("many").alias("all")).where("all > 1").drop("all")
    again = keyed.join(first, ["digest", "size"])
    since = F.when(F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url")), 2).otherwise(1).cast("long")
    again = again.withColumn("copy", _copies(F.col("many"), since))
    origin = _record(F.col("first.id"), F.col("first.url"), F.col("digest"), F.lit(1)).alias("first_record")
    record = _record(F.col("id"), F.col("url"), F.col("digest"), F.col("copy")).alias("record")
    empty = [F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("begins"), F.lit(hashlib.sha1().digest()).alias("running"), F.lit(None).cast("binary").alias("packed")]
    revisits = again.select(record, F.lit("revisit").alias("kind"), "id", "url", "size", "digest", F.col("first.id").alias("first_id"), origin, *empty)
    responses.unionByName(revisits).mapInArrow(_written(chunk), RECORD).write.option("compression", "zstd").parquet(path)


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for part in slices(batches, 64):
        packed = pa.array([press.compress(x.as_buffer()) for x in part.column(4)], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:4], packed], names=part.schema.names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to one row a record; raises on a missing or damaged chunk or a wrong digest or length."""
    done: list[tuple] = []
    now, fields, digest, size, k = None, {}, hashlib.sha1(), 0, 0

    def close() -> None:
        if now is None:
            return
        if size != int(fields["Content-Length"]) + len(END):
            raise ValueError(f"{now}: {size - len(END)} bytes instead of {fields['Content-Length']}")
        if fields["WARC-Type"] == "response" and (fields["X-Payload-Length"] != fields["Content-Length"] or fields["WARC-Payload-Digest"] != f"sha1:{base32(digest.digest())}"):
            raise ValueError(f"{now}: wrong digest or length")
        refers = fields.get("X-Refers-To-Page")
        done.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(refers) if refers else None))

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    open_ = zstandard.ZstdDecompressor()
    for part in slices(batches, 64):
        for record, chunk, begins, running, packed in zip(*(c.to_pylist() for c in part.columns[:4]), part.column(4)):
            data = open_.decompress(packed.as_buffer())
            if record != now:
                close()
                head, _, data = data.partition(b"\r\n\r\n")
                now, fields, digest, size, k = record, _parsed(head), hashlib.sha1(), 0, 0
            size += len(data)
            piece = data[: max(0, int(fields["Content-Length"]) - begins)]
            digest.update(piece)
            if chunk != k or digest.digest() != running:
                raise ValueError(f"{record}: chunk {k} is missing or damaged")
            k += 1
        if done:
            yield _batch(done, kinds)
            done.clear()
    close()
    if done:
        yield _batch(done, kinds)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record at path, its digests checked.

    Chunks cross the shuffle as zstd.
    """
    chunks = spark.read.schema(RECORD).parquet(path).mapInArrow(_shrunk, RECORD)
    return chunks.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as an archive table and returns what reading it back gives, a row a page."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)
