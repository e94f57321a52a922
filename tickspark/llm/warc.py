"""WARC archives with segmented records: written, read back, and reassembled.

A response whose block is longer than a segment continues in `continuation` records, which may lie in the next file.
Reading parses files independently; whole records are decoded in place, and only segments are shuffled: grouped by
origin record, ordered by segment number, checked against the total length, and joined before the chunked transfer
framing is removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.bpe import blocks, lengths
from tickspark.llm.common import WIDE_ROWS, batch_rows, filesystem, lean, shared_path, split_by, written

#: Bytes of block per segment, of payload per transfer chunk, and of file after which a new one begins.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 16 << 10, 4 << 10, 64 << 20
#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
ROW = "page string, record string, revisit_of string, segment int, total long, digest string, block binary"


def marked(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages' id, url, payload, its digest and length n, and `original`: the smallest id with this payload, where it is another's.

    Payloads stand where they are unless their digest may be one that several pages share. Of those, the revisits are
    found from ids and digests alone and have no payload here; the responses then move by their own id and digest, so
    pages of one digest never meet in a task.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    plain = pages.select(F.col(id_col).alias("k"), url.alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload")})
    shared = plain.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("k").alias("original"), F.count("*").alias("copies"))
    shared = written(shared.filter("copies > 1 AND original IS NOT NULL").select("digest", "original"), "shared")
    some, rest = split_by(plain, F.xxhash64("digest"), shared.select(F.xxhash64("digest")))
    revisits = some.drop("payload").join(shared, "digest").filter(~F.col("k").eqNullSafe(F.col("original")))
    revisits = written(revisits.select("k", "url", F.lit(b"").alias("payload"), "digest", "n", "original"), "revisits")
    # what names the revisits is all that is read from here on
    gone = revisits.select(F.col("k").alias("r_k"), F.col("digest").alias("r_digest")).distinct()
    responses = some.join(gone, (F.col("digest") == F.col("r_digest")) & F.col("k").eqNullSafe(F.col("r_k")), "left_anti").unionByName(rest)
    return responses.withColumn("original", F.lit(None).cast(pages.schema[id_col].dataType)).unionByName(revisits)


def http_block(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """HTTP response with chunked transfer framing."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for i in range(0, len(payload), chunk_bytes):
        piece = payload[i : i + chunk_bytes]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response; decodes chunked framing, and raises when it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    if b"\r\ntransfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2 + size
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : at])
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        at += 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One compressed record; fields with no value are left out."""
    lines = "".join(f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in fields if v is not None)
    return _gzip(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(page: str | None, url: str | None, payload: bytes, digest: str, length: int, original: str | None, name: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit (which needs its payload's length only), or a response and its continuations."""
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page", page)]
    if original is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:record:{name}>"), ("WARC-Profile", profile), ("WARC-Refers-To-Page", original), *common], head)
        return
    block = http_block(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Segment-Number", 1)] if len(pieces) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:record:{name}>"), *first, *common], pieces[0])
    for i, piece in enumerate(pieces[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(pieces) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{name}/{i}>"), ("WARC-Segment-Origin-ID", f"<urn:record:{name}>"), ("WARC-Segment-Number", i), *total], piece)


class _File:
    """One archive while it is written. Its name is used by one attempt only; the manifest alone says which files count."""

    def __init__(self, folder: str, part: int, roll: int) -> None:
        import uuid

        self.name, self.at, self.count = f"{folder}/part-{part:06d}-{roll:04d}-{uuid.uuid4().hex}.warc.gz", 0, 0
        fs, target = filesystem(self.name)
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(target, compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.count += 1

    def close(self):
        import pyarrow as pa

        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.count], pa.int64()), pa.array([self.at], pa.int64())], names=["file", "records", "bytes"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", file_bytes: int = FILE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages as WARC files below path; returns the manifest (file, records, bytes)."""
    batch_rows(pages.sparkSession, WIDE_ROWS)
    rows = marked(pages, id_col, html_col).select(F.col("k").cast("string"), "url", "payload", "digest", "n", F.col("original").cast("string"))

    def run(batches):
        from pyspark import TaskContext

        part, roll, n, out = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            for a, b in blocks(lengths(batch.column(2)), 16 << 20):
                for row in zip(*(x.to_pylist() for x in batch.slice(a, b - a).columns), strict=True):
                    n += 1
                    for data in records(*row, name=f"{part}-{n}", segment_bytes=segment_bytes):
                        if out is not None and out.at >= file_bytes:
                            yield out.close()
                            roll, out = roll + 1, None
                        out = out or _File(path, part, roll)
                        out.add(data)
        if out is not None:
            yield out.close()

    return written(rows.mapInArrow(lean(run), "file string, records long, bytes long"), "manifest")


def parse(stream, read_bytes: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open compressed file, one member at a time."""
    left = b""
    while left or (left := stream.read(read_bytes)):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof:
            if not left and not (left := stream.read(read_bytes)):
                raise EOFError("a record is cut off")
            parts.append(opener.decompress(left))
            left = opener.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a record: {version[:20]}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(fields["content-length"])
        if len(rest) < size:
            raise EOFError("a block is cut off")
        yield fields, rest[:size]


def parsed(manifest: DataFrame) -> DataFrame:
    """Rows of ROW from the manifest's files: whole records with segment 0 and their payload, segments with their raw block."""
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = filesystem(name)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, block in parse(stream):
                        kind, segment, total = fields["warc-type"], int(fields.get("warc-segment-number", 0)), fields.get("warc-segment-total-length")
                        if kind == "response" and not segment:
                            block = http_payload(block)
                        origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append((fields.get("warc-page"), origin, fields.get("warc-refers-to-page"), segment, total and int(total), digest, block))
                        held += len(block) + 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file").repartition(width, "file").mapInArrow(lean(run), ROW)


def joined(origin: str, pieces: list[tuple[int, int | None, bytes]]) -> bytes:
    """Block of one origin from its (number, total, block) in order; missing, repeated or short segments raise."""
    total = pieces[-1][1]
    block = b"".join(x[2] for x in pieces)
    if [x[0] for x in pieces] != list(range(1, len(pieces) + 1)) or total != len(block):
        raise ValueError(f"{origin}: segments {[x[0] for x in pieces]} with {len(block)} of {total} bytes")
    return block


def reassembled(segments: DataFrame) -> DataFrame:
    """Segments grouped by origin and ordered by number, as whole records of ROW with their payload."""
    width = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(width, "record").sortWithinPartitions("record", "segment")

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in ROW.split(", ")]
        schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()], strict=True)))

        def whole(rows):
            first = rows[0]
            payload = http_payload(joined(first[1], [(x[3], x[4], x[6]) for x in rows]))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first[0], first[1], None, 0, None, first[5], payload), schema.types, strict=True)], schema=schema)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0][1] != row[1]:
                    yield whole(held)
                    held = []
                held.append(row)
        if held:
            yield whole(held)

    return ordered.mapInArrow(lean(run), ROW)


def read(manifest: DataFrame, id_type: str = "long", id_col: str = "page_id") -> DataFrame:
    """(id_col, record_type, payload binary, payload_bytes, payload_digest, refers_to) per page from the files.

    A revisit has a null payload; its length and digest are those that its record states. A response whose payload does
    not have the digest that its record states raises.
    """
    rows = written(parsed(manifest), "records")
    done = rows.filter("segment = 0").unionByName(reassembled(rows.filter("segment > 0")))
    revisit = F.col("revisit_of").isNotNull()
    length = F.regexp_extract(F.decode("block", "UTF-8"), r"Content-Length: (\d+)", 1)
    found = F.sha2("block", 256)
    checked = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record"))).cast("string"))
    return done.select(
        F.col("page").cast(id_type).alias(id_col),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(~revisit, F.col("block")).alias("payload"),
        F.when(revisit, length.cast("long")).otherwise(F.length("block").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(checked).alias("payload_digest"),
        F.col("revisit_of").cast(id_type).alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """write() to the shared folder, then read().

    Null and empty html give an empty payload; null urls and ids are left out of the record; equal payloads of fewer
    than REVISIT_BYTES bytes are all stored; rows that repeat the smallest id of a payload are responses like the
    first; a payload that only null ids share is stored each time; other columns are ignored; an empty table writes no
    file and gives no rows.
    """
    manifest = write(pages, shared_path(pages.sparkSession, "warc"), id_col, html_col)
    return read(manifest, pages.schema[id_col].dataType.simpleString(), id_col)
