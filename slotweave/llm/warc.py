"""WARC archives through a chunked record table.

A payload is cut into chunks: rows of record number, chunk number, bytes, and the SHA-1 and length of the payload so far. Every chunk becomes one
WARC 1.1 record, the first one of type response and later ones of type continuation, as the format's segmentation has it, so neither
writer nor reader holds a whole payload. Archives are plain WARC files that Spark's text sink writes and its text source splits at version
lines; no chunk holds the bytes that begin a record. Reading back orders the chunks of a record and carries the digest from one to the next.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slotweave.session import cut_lineage, work_path

#: Bytes of a chunk, and the least payload that is stored once only.
CHUNK, LEAST = 1 << 20, 1000
#: Fixed values of the format: the version line begins a record, two line ends close it.
VERSION, LINE = b"WARC/1.1", "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: What the reader splits at. No part of it is both its beginning and the end of another part: Spark's line reader does not go back into a
#: buffer it has left, and would miss a separator that begins inside a failed match.
BETWEEN = "\n" + VERSION.decode() + LINE
#: What follows a block: the closing line ends, without the byte that the separator took if another record follows.
CLOSING = (b"\r\n\r", b"\r\n\r\n")
#: Bytes gathered before rows are handed on.
_BATCH = 1 << 22
_CHUNKS = {"record": pa.string(), "chunk": pa.int32(), "data": pa.string(), "digest": pa.string(), "bytes": pa.int64(), "last": pa.bool_()}


def cut_points(payload: bytes | memoryview, size: int) -> list[int]:
    """Ends of the chunks of UTF-8 text: about ``size`` bytes each, no character cut, none holding VERSION; no text is one empty chunk."""
    points, at, n = [], 0, len(payload)
    while True:
        end = min(at + max(size, 8), n)
        while end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        found = bytes(payload[at:end]).find(VERSION)
        if found >= 0:
            end = at + found + 4  # in the middle of it
        points.append(end)
        at = end
        if at >= n:
            return points


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages`` (record, payload): record, chunk, data, and SHA-1 and length of the payload so far, with all
    other columns of ``pages`` on the first chunk and null on later ones."""
    keep = [c for c in pages.columns if c not in ("record", "payload")]
    types = dict(pages.dtypes)

    def cut(batches):
        for batch in batches:
            rows, held = [], 0

            def made():
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_CHUNKS.values())]
                at = pa.array([r[6] for r in rows], pa.int32())
                return pa.RecordBatch.from_arrays(own + [batch.column(c).take(at) for c in keep], names=[*_CHUNKS, *keep])

            for i, (record, payload) in enumerate(zip(batch.column("record").to_pylist(), batch.column("payload"))):
                raw = memoryview(payload.as_buffer() or b"") if payload.is_valid else memoryview(b"")
                running, at, points = hashlib.sha1(), 0, cut_points(raw, size)
                for k, end in enumerate(points):
                    running.update(raw[at:end])
                    rows.append((record, k, bytes(raw[at:end]).decode(), running.hexdigest(), end, k == len(points) - 1, i if k == 0 else None))
                    held, at = held + end - at, end
                    if held > _BATCH:
                        yield made()
                        rows, held = [], 0
            if rows:
                yield made()

    schema = "record string, chunk int, data string, digest string, bytes bigint, last boolean"
    return pages.select("record", "payload", *keep).mapInArrow(cut, ", ".join([schema, *(f"`{c}` {types[c]}" for c in keep)]))


def _head(lines: dict[str, Column]) -> Column:
    """Header lines and the empty line after them; a line without a value is left out."""
    return F.concat(F.concat_ws("", *[F.when(v.isNotNull(), F.concat(F.lit(name + ": "), v, F.lit(LINE))) for name, v in lines.items()]), F.lit(LINE))


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the pages that revisit another one: of equal payloads of ``least`` bytes or more, all but
    those with the largest page_id."""
    slim = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").alias("bytes"))
    slim = slim.filter(F.col("page_id").isNotNull() & (F.col("bytes") >= least)).select("page_id", "digest")
    newest = slim.groupBy(F.struct("digest").alias("k")).agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    newest = newest.filter("least < refers_to").select("k.digest", "refers_to")
    return slim.join(newest, "digest").filter("page_id < refers_to").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", size: int = CHUNK, least: int = LEAST) -> int:
    """Write a record of every row of ``pages`` (page_id, url, html) as gzipped WARC files to the folder ``path``; their number.

    Revisits have no payload, but its digest and length. Line ends in a URL are escaped.
    """
    number = F.monotonically_increasing_id().cast("string")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    full = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    both = full.join(decide(pages, least), ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    rows = both.select(
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), number, F.lit(">")).alias("record"),
        F.when(~again, F.col("html")).alias("payload"), F.col("url").alias("uri"), F.col("digest").alias("whole"), F.octet_length("html").cast("string").alias("whole_bytes"),
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    c, first, lit = F.col, F.col("chunk") == 0, F.lit
    parts = chunk_table(rows, size).withColumn("block", F.concat(F.when(first, F.lit(HTTP)).otherwise(""), "data"))
    segmented = ~(first & c("last"))
    head = _head({
        "WARC-Type": F.when(~first, "continuation").when(c("refers_to").isNotNull(), "revisit").otherwise("response"),
        "WARC-Record-ID": F.when(first, c("record")).otherwise(F.concat(F.expr("substring(record, 1, length(record) - 1)"), lit(":"), c("chunk").cast("string"), lit(">"))),
        "WARC-Date": lit(date),
        "WARC-Target-URI": c("uri"),
        "WARC-Payload-Digest": F.when(first, F.concat(lit("sha1:"), "whole")),
        "WARC-Refers-To": F.when(first & c("refers_to").isNotNull(), F.concat(lit("<urn:page:"), "refers_to", lit(">"))),
        "WARC-Profile": F.when(first & c("refers_to").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "WARC-Segment-Number": F.when(segmented, (c("chunk") + 1).cast("string")),
        "WARC-Segment-Origin-ID": F.when(~first, c("record")),
        "WARC-Segment-Total-Length": F.when(segmented & c("last"), c("bytes").cast("string")),
        "X-Payload-So-Far": F.concat(lit("sha1:"), "digest", lit(" "), c("bytes").cast("string")),
        "X-Payload-Length": F.when(first, c("whole_bytes")),
        "Content-Type": F.when(first, "application/http; msgtype=response"),
        "Content-Length": F.octet_length("block").cast("string"),
    })
    value = F.concat(lit(VERSION.decode() + LINE), head, "block", lit(LINE)).alias("value")
    written = Observation()
    parts.observe(written, F.count_if(first).alias("n")).select(value).write.option("lineSep", LINE).option("compression", "gzip").text(path)
    return written.get["n"]


def _parsed(value: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = value.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split(LINE) if ": " in x)
    n = int(fields["Content-Length"])
    if rest[n:] not in CLOSING:
        raise ValueError(f"a record of {n} bytes has {len(rest)} bytes up to the next one: {fields['WARC-Record-ID']}")
    return fields, rest[:n]


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``, chunk by chunk: record, uri, page_id (text), chunk, kind, payload_bytes, payload_digest, refers_to.

    One row per record, from its last chunk; with ``keep_payload`` one row per chunk with ``data``. A digest that differs from the
    one written, a block that is not as long as its head says, or a missing chunk, be it the last one, raises an error. Chunks of a record meet in one task, in order, and are let go one by one;
    records of one chunk are verified where they are read, and only their results move.
    """
    source = spark.read.option("lineSep", BETWEEN).text(path)
    fields = "origin string, chunk int, uri string, kind string, refers_to string, declared string, declared_bytes bigint, total bigint, digest string, bytes bigint, data binary"
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parse(batches):
        for batch in batches:
            rows, held = [], 0

            def made():
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

            for value in batch.column("value"):
                h, block = _parsed(bytes(value.as_buffer()))
                first = "WARC-Segment-Origin-ID" not in h
                payload = block.partition(b"\r\n\r\n")[2] if first else block
                single = first and "WARC-Segment-Number" not in h
                total = len(payload) if single else int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None
                data = payload if keep_payload or not single else None
                rows.append((
                    h["WARC-Record-ID"] if first else h["WARC-Segment-Origin-ID"], int(h.get("WARC-Segment-Number", 1)) - 1, h.get("WARC-Target-URI"), h["WARC-Type"],
                    h.get("WARC-Refers-To"), h["WARC-Payload-Digest"][5:] if first else None, int(h["X-Payload-Length"]) if first else None, total,
                    hashlib.sha1(payload).hexdigest() if single else None, len(payload), data,
                ))
                held += len(payload)
                if held > _BATCH:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

    out = "record string, uri string, page_id string, chunk int, kind string, payload_bytes bigint, payload_digest string, refers_to string, data binary"
    out_names = [f.split()[0] for f in out.split(", ")]
    out_types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def follow(batches):
        origin = running = head = None
        at, size, last = 0, 0, True
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["origin"] != origin:
                    if not last:
                        raise ValueError(f"the last chunk of {origin} is missing")
                    origin, running, head, at, size = r["origin"], hashlib.sha1(), r, 0, 0
                if r["chunk"] != at:
                    raise ValueError(f"chunk {at} of {origin} is missing")
                at, size = at + 1, size + r["bytes"]
                if r["digest"] is None:
                    running.update(r["data"])
                last = r["total"] is not None
                if last:
                    revisit = head["kind"] == "revisit"
                    digest = r["digest"] or running.hexdigest()
                    if not revisit and (digest != head["declared"] or size != r["total"] or size != head["declared_bytes"]):
                        raise ValueError(f"the payload of {origin} is not what was written")
                if last or keep_payload:
                    page, refers = origin[1:-1].split(":")[2], head["refers_to"]
                    rows.append((
                        origin, head["uri"], page or None, r["chunk"], head["kind"], head["declared_bytes"], head["declared"],
                        refers[1:-1].split(":")[2] if refers else None, r["data"] if keep_payload else None,
                    ))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(out_types)], names=out_names)
        if not last:
            raise ValueError(f"the last chunk of {origin} is missing")

    return source.mapInArrow(parse, fields).repartition("origin").sortWithinPartitions("origin", "chunk").mapInArrow(follow, out)


def round_trip(pages: DataFrame, path: str | None = None, size: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to archives and read them back; another number of records than written raises an error.

    Returns page_id, payload_bytes, payload_digest, record_type (response or revisit) and refers_to.

    Null html: an empty payload. Null url: no target line. Null page_id: a record of its own that is never a revisit nor referred to.
    Rows that repeat page_id and payload: equal types, as each has the largest page_id or not. Empty table: no rows. Very long payloads: in
    chunks of ``size`` bytes. Other columns are not written. Archives go to ``path``, a new folder; default: under spark.checkpoint.dir.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    written = write_archives(pages.select("page_id", "url", "html"), path, size=size, least=least)
    kind = pages.schema["page_id"].dataType
    back = cut_lineage(read_archives(spark, path, keep_payload=False))
    if (n := back.count()) != written:
        raise ValueError(f"{written} records were written to {path}, {n} read back")
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
