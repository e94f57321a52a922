"""Media columns: payloads stored as 8-bit greyscale images in archives, read through a Spark data source.

write() packs each partition's images into archive files in the shared folder. The data source plans byte ranges over
the archives of a folder from their manifest and file sizes alone; a task reads the directory at the end of its archive, takes the members
that begin in its range, reads each by its own offset (again, on a fresh handle, when that fails) and streams them as
Arrow batches of bounded size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickspark.llm.bpe import blocks, lengths
from tickspark.llm.common import WIDE_ROWS, batch_rows, filesystem, lean, shared_path

#: Samples in an image row; payloads are padded to a positive multiple of it.
WIDTH = 64
#: Bytes or members after which a new archive begins (both below the plain zip limits).
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 64 << 20, 50_000
#: Bytes of archive per planned task, and of payload per Arrow batch.
RANGE_BYTES, BATCH_BYTES = 16 << 20, 2 << 20
#: Folder, beside the archives, of the table that lists them.
MANIFEST = "manifest"
PNG = b"\x89PNG\r\n\x1a\n"
#: Zip records: local header, directory entry, end of directory.
LOCAL, ENTRY, END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")


def pad(data: bytes) -> bytes:
    """Append bytes 0 up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def to_image(data: bytes) -> bytes:
    """Lossless greyscale PNG of the padded data; its unpadded length is kept in a text chunk."""
    import numpy as np

    samples = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # byte 0 of a row: no filter
    rows[:, 1:] = samples
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"Length\0%d" % len(data)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """(padded payload, unpadded length) of to_image()'s result; a damaged image raises."""
    import numpy as np

    if image[:8] != PNG:
        raise ValueError("not an image")
    at, parts, length, width, height = 8, [], 0, 0, 0
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            length = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Sum of all samples, and their counts in eight equal ranges."""
    import numpy as np

    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    return f"sum={int(counts @ np.arange(256))};hist={','.join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))}"


class ArchiveWriter:
    """A stored (uncompressed) zip file while it is written."""

    def __init__(self, name: str) -> None:
        self.name, self.at, self.entries = name, 0, []
        fs, target = filesystem(name)
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(target, compression=None)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        named, crc = name.encode(), zlib.crc32(data)
        self.entries.append((named, crc, len(data), self.at))
        self._put(LOCAL.pack(0x04034B50, 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(named), 0) + named)
        self._put(data)

    def close(self) -> None:
        start = self.at
        for named, crc, size, at in self.entries:
            self._put(ENTRY.pack(0x02014B50, 20, 20, 0x800, 0, 0, 0x21, crc, size, size, len(named), 0, 0, 0, 0, 0, at) + named)
        self._put(END.pack(0x06054B50, 0, 0, len(self.entries), len(self.entries), self.at - start, start, 0))
        self.out.close()


def directory(file) -> list[tuple[int, int, int, str]]:
    """(offset, size, crc, name) of each member, from the directory at the end of an open archive."""
    size = file.size()
    fields = END.unpack(file.read_at(END.size, size - END.size))
    if fields[0] != 0x06054B50:
        raise ValueError("no directory at the end of the archive")
    data, at, out = file.read_at(fields[5], fields[6]), 0, []
    for _ in range(fields[4]):
        entry = ENTRY.unpack_from(data, at)
        crc, length, named, extra, comment, offset = entry[7], entry[9], entry[10], entry[11], entry[12], entry[16]
        out.append((offset, length, crc, data[at + ENTRY.size : at + ENTRY.size + named].decode()))
        at += ENTRY.size + named + extra + comment
    return out


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges over the archives that the folder's manifest lists, or over all its archives if it has none."""
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = filesystem(self.path)
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else "file://"
        host = "" if scheme == "file://" else self.path.split("/")[2] if root.startswith("/") else ""
        listed = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        sizes = {f"{scheme}{host}{x.path}": x.size for x in listed if x.type == fs.FileType.File and x.path.endswith(".zip")}
        if any(x.path.endswith(f"/{MANIFEST}/_SUCCESS") for x in listed):
            parts = [x.path for x in listed if f"/{MANIFEST}/" in x.path and x.path.endswith(".parquet")]
            names = [n for p in parts for n in pq.read_table(p, columns=["archive"], filesystem=store).column(0).to_pylist()]
            sizes = {n: sizes[n if "://" in n else f"file://{n}"] for n in names}
        out = [ByteRange(n, a, min(a + self.range_bytes, size)) for n, size in sorted(sizes.items()) for a in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator:
        import pyarrow as pa

        if not partition.archive:
            return
        store, at = filesystem(partition.archive)
        file = store.open_input_file(at)
        try:
            rows, held = [], 0
            for offset, size, crc, name in directory(file):
                if not partition.start <= offset < partition.end:
                    continue
                media, error = None, None
                for attempt in range(self.retries + 1):
                    try:
                        media = self.member(file, offset, size, crc)
                        break
                    except Exception as failed:  # this member alone is read again; the others go on
                        error = f"{type(failed).__name__}: {failed}"
                        if attempt < self.retries:
                            file.close()
                            file = store.open_input_file(at)
                rows.append((partition.archive, offset, name, media, None if media is not None else error))
                held += size
                if held >= BATCH_BYTES:
                    yield self.batch(pa, rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(pa, rows)
        finally:
            file.close()

    @staticmethod
    def member(file, offset: int, size: int, crc: int) -> bytes:
        head = LOCAL.unpack(file.read_at(LOCAL.size, offset))
        data = file.read_at(size, offset + LOCAL.size + head[9] + head[10])
        if head[0] != 0x04034B50 or len(data) != size or zlib.crc32(data) != crc:
            raise OSError(f"member at {offset} is damaged")
        return data

    @staticmethod
    def batch(pa, rows: list[tuple]):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "media", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): one row per member of every archive below the folder.

    A member that cannot be read after `retries` further attempts has a null media and an error; others are not affected.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each row's text as an image in archives below path; returns the manifest (archive, members, bytes).

    A retried task writes archives of new names; the manifest, kept beside them, lists those of the attempt that counts.
    """
    plain = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    batch_rows(docs.sparkSession, WIDE_ROWS)

    def run(batches):
        from uuid import uuid4

        import pyarrow as pa
        from pyspark import TaskContext

        part, roll, out = TaskContext.get().partitionId(), 0, None

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([len(out.entries)], pa.int64()), pa.array([out.at], pa.int64())], names=["archive", "members", "bytes"])

        for batch in batches:
            for a, b in blocks(lengths(batch.column(1)), 4 * BATCH_BYTES):
                for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if out is not None and (out.at >= ARCHIVE_BYTES or len(out.entries) >= ARCHIVE_MEMBERS):
                        yield closed()
                        roll, out = roll + 1, None
                    if out is None:
                        out = ArchiveWriter(f"{path}/part-{part:06d}-{roll:04d}-{uuid4().hex}.zip")
                    out.add(f"{len(out.entries):08d}{'' if key is None else '-' + key}.png", to_image((text or "").encode("utf-8", "surrogatepass")))
        if out is not None:
            yield closed()

    made = plain.mapInArrow(lean(run), "archive string, members long, bytes long")
    made.write.parquet(f"{path}/{MANIFEST}")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{path}/{MANIFEST}")


def read(spark: SparkSession, path: str, retries: int = 3) -> DataFrame:
    """Members of the archives below path; see ArchiveSource."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("retries", retries).load(path)


def features(members: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Decode each member's image and describe payload and image. A member that could not be read raises here."""
    schema = "k string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, image, error in zip(*(batch.column(i) for i in range(3)), strict=True):
                if error.as_py() is not None:
                    raise OSError(f"{name.as_py()}: {error.as_py()}")
                data = image.as_py()
                payload, length = from_image(data)
                key = name.as_py()[8:-4]
                rows.append((key[1:] if key else None, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    found = members.select("name", "media", "error").mapInArrow(lean(run), schema)
    return found.select(F.col("k").cast(id_type).alias(id_col), *found.columns[1:])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() to the shared folder, read() through the data source, features().

    Null texts are empty (one row of zero samples); null ids come back null; repeated rows give repeated rows; other
    columns are ignored; an empty table writes no archive and gives no rows.
    """
    path = shared_path(docs.sparkSession, "media")
    write(docs, path, id_col, text_col)
    return features(read(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString(), id_col)
