"""Token-id files: one concatenated id array per file, document boundaries in Elias-Fano form.

File: ids (2 bytes each, 4 if the vocabulary needs it), document ids (compressed Arrow), boundaries, then a fixed-size footer. Boundary i is the end of
document i. Its low bits are packed; its high part is a unary bit vector, and every 256th set bit has a 32-bit sample,
so select(i) reads one sample and a few bytes. A file holds fewer than 2**31 ids, so no 64-bit table exists; a
document's global start is its file's base plus select(i - 1).
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.llm.bpe import blocks, lengths
from tickspark.llm.common import WIDE_ROWS, batch_rows, filesystem, lean, shared_path, written

MAGIC = b"TSIDS001"
FOOTER = struct.Struct("<8sBQQQQQ")
#: Ids and documents after which a new file begins (a single longer document stays whole).
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 21
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 6_000_000
SAMPLE = 256


class EliasFano:
    """Non-decreasing integers below 2**31 in about 2 + log2(universe / n) bits each, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        import numpy as np

        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values) -> EliasFano:
        import numpy as np

        v = np.asarray(values, np.int64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        where = (v >> bits) + np.arange(n)
        unary = np.zeros((int(where[-1]) if n else 0) + 1, np.uint8)
        unary[where] = 1
        packed = (np.packbits(x, bitorder="little").tobytes() for x in (low.ravel(), unary))
        return cls(n, bits, *packed, where[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return struct.pack("<IBIII", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, *sizes = struct.unpack_from("<IBIII", data)
        at, parts = struct.calcsize("<IBIII"), []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, bits, *parts)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        b = a + self.low_bits
        word = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return word >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: the sample below it, then whole bytes by their bit counts, then bits."""
        import numpy as np

        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        rest = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= (ones := rest.bit_count()):
            left -= ones
            byte += 1
            rest = int(self.high[byte])
        where = byte * 8 + int(np.flatnonzero(np.unpackbits(np.uint8(rest).reshape(1), bitorder="little"))[left])
        return (where - i) << self.low_bits | self._low(i)

    def all(self):
        """Every value, in one vectorised pass."""
        import numpy as np

        where = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        if not self.low_bits or not self.n:
            return (where - np.arange(self.n)) << self.low_bits
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (where - np.arange(self.n)) << self.low_bits | bits @ (1 << np.arange(self.low_bits))


def word_by_word(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes blank-free stretches of a text apart, as WordEncoder's memo needs.

    It has to compose, turn blanks into one and lower-case, in this order; to cut into contractions, runs of letters,
    digits and runs of other signs, none holding a blank; to end each piece with a mark; and to add no token that reaches beyond its own text.
    """
    forms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = cuts[0] if cuts else {}
    plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and t["content"].isascii() and len(t["content"].split()) == 1 for t in spec.get("added_tokens", []))
    return (
        forms == ["NFC", "Replace", "Lowercase"]
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and not cuts[1].get("add_prefix_space")
        and (spec["model"].get("type"), spec["model"].get("end_of_word_suffix"), spec["model"].get("dropout")) == ("BPE", "</w>", None)
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
        and plain
    )


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each blank-free stretch that the memo lacks.

    A tokenizer that word_by_word() refuses gets whole texts.
    """

    #: Bytes that the memo takes at most, words that the library is given at once, and characters of a text that are looked at together.
    MEMO_BYTES, AT_ONCE, LONG = 80 << 20, 256, 4 << 20

    def __init__(self, path: str) -> None:
        import json
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = word_by_word(spec)
        self.added = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        vocabulary = self.library.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def lowered(self, texts):
        """An Arrow string array with A-Z in lower case, as the normaliser has them too, so that more stretches are equal.

        Not where that shows: beside combining marks (U+0300 to U+037F), which compose with some letters of one case only, and
        in texts with an added token in any case, since only its exact form is one.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        lower = pc.ascii_lower(texts)
        odd = [b"\xcc" in x or b"\xcd" in x or any(t in x for t in self.added) for x in lower.cast(pa.binary()).to_pylist()]
        return pc.if_else(pa.array(odd), texts, lower) if any(odd) else lower

    def ask(self, units: list[bytes]) -> dict[bytes, bytes]:
        """Units as the library encodes them. Runs of letters are joined by blanks and told apart by their last tokens."""
        import numpy as np

        found: dict[bytes, bytes] = {}
        texts = b"\n".join(units).decode().split("\n") if units else []  # no unit holds a line end
        letters = [k for k, x in enumerate(texts) if x.isalpha()]
        rest = [k for k, x in enumerate(texts) if not x.isalpha()]
        parts = [letters[i : i + self.AT_ONCE] for i in range(0, len(letters), self.AT_ONCE)]
        for i in range(0, len(parts), 64):
            some = parts[i : i + 64]
            for part, made in zip(some, self.library.encode_batch_fast([" ".join([texts[k] for k in part]) for part in some], add_special_tokens=False), strict=True):
                ids = np.array(made.ids, self.kind)
                ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
                if len(ends) != len(part):
                    rest += part
                    continue
                data = ids.tobytes()
                found.update(zip([units[k] for k in part], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for k, made in zip(some, self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                found[units[k]] = np.array(made.ids, self.kind).tobytes()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian. A long text goes through in parts that end at blanks."""
        import numpy as np
        import pyarrow as pa

        if not self.by_word:
            return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = self.block(pa.array([x if len(x) <= self.LONG else "" for x in texts], pa.string()))
        for i, text in enumerate(texts):
            if len(text) > self.LONG:
                out[i] = b"".join(self.block(pa.array([part], pa.string()))[0] for part in parts_of(text, self.LONG))
        return out

    def block(self, texts) -> list[bytes]:
        """Ids of an Arrow array of texts: its distinct stretches are looked up, and their ids gathered by place."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(self.lowered(texts))
        told = split.flatten().dictionary_encode()
        units = told.dictionary.cast(pa.binary()).to_pylist()  # an empty one stands before and behind blanks
        found = self.looked_up(units)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // int(self.kind[-1])
        pool, first = np.frombuffer(b"".join(found), self.kind), np.cumsum(sizes) - sizes
        at = told.indices.to_numpy()
        counts = sizes[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], counts)
        data = pool[places].tobytes()
        cuts = (ends[split.offsets.to_numpy()] * int(self.kind[-1])).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def looked_up(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct stretches; an empty one has none."""
        memo = self.memo
        found = list(map(memo.get, units))
        missing = [u for u, x in zip(units, found, strict=True) if x is None and u]
        # a run of ASCII letters and the points after it are pieces of their own
        stems = {u: u.rstrip(b".,") for u in missing if u[-1] in b".,"}
        stems = {u: s for u, s in stems.items() if s.isalpha()}
        parts = {*stems.values(), *(u[len(s) :] for u, s in stems.items())}
        fresh = self.ask(list({u for u in missing if u not in stems}.union(parts).difference(memo)))
        known = {u: memo[u] for u in parts if u in memo} | fresh
        fresh |= {u: known[s] + known[u[len(s) :]] for u, s in stems.items()}
        found = [fresh.get(u, b"") if x is None else x for u, x in zip(units, found, strict=True)]
        cost = _cost(fresh)
        if self.held + cost > self.MEMO_BYTES:  # bounded before anything is added: start again from this block
            fresh = {u: x for u, x in zip(units, found, strict=True) if u}
            self.memo, self.held, cost = {}, 0, _cost(fresh)
        if self.held + cost <= self.MEMO_BYTES:
            self.memo.update(fresh)
            self.held += cost
        return found


def parts_of(text: str, most: int) -> list[str]:
    """A text in parts of about `most` characters that end before an ASCII blank (a longer stretch without one stays whole)."""
    import re

    out, at, blank = [], 0, re.compile(r"[ \t\n\r\x0b\x0c]")
    while len(text) - at > most and (cut := blank.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process: its bounded memo serves all tasks that run there."""
    return WordEncoder(path)


def _cost(table: dict[bytes, bytes]) -> int:
    """Bytes that entries of a memo take, about: two objects and a slot each."""
    return 200 * len(table) + sum(map(len, table)) + sum(map(len, table.values()))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs' ids in ascending id order to files under `path`; returns their manifest (part, roll, file, docs, ids).

    Texts are range-partitioned and sorted by id (nulls first; equal ids by text) and each partition writes its files in
    order. A retried task writes files of new names; only those of the attempt that counts are in the manifest.
    """
    plain = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    batch_rows(docs.sparkSession, WIDE_ROWS)
    ordered = plain.repartitionByRange("k").sortWithinPartitions("k", "t")

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), word_encoder(tokenizer_path)
        end = end_id.to_bytes(int(encoder.kind[-1]), "little")
        width, out, roll = len(end), None, 0
        for keys, texts in blocks_of(batches):
            made, begin = encoder.encode(texts), 0
            while begin < len(made):
                if out is None:
                    out = _File(path, part, roll, width)
                stop = begin + out.room([len(x) // width + 1 for x in made[begin:]], file_ids)
                out.add(keys.slice(begin, stop - begin), [x + end for x in made[begin:stop]])
                begin = stop
                if begin < len(made):
                    yield out.close()
                    out, roll = None, roll + 1
        if out is not None:
            yield out.close()

    made = ordered.mapInArrow(lean(run), "part int, roll int, file string, docs long, ids long")
    return written(made, "manifest")


def blocks_of(batches):
    """(ids column, texts) of blocks of whole rows, across batches; a null text is an empty one."""
    import pyarrow as pa

    def whole():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return table.column(0), [x or "" for x in table.column(1).to_pylist()]

    held, size = [], 0
    for batch in batches:
        sizes = lengths(batch.column(1))
        for a, b in blocks(sizes, BLOCK_BYTES):
            more = sum(sizes[a:b])
            if held and size + more > BLOCK_BYTES:
                yield whole()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += more
    if held:
        yield whole()


class _File:
    """One file while it is written. Its name is used by one attempt only; the manifest alone says which files count."""

    def __init__(self, folder: str, part: int, roll: int, width: int) -> None:
        import uuid
        from array import array

        self.name = f"{folder}/part-{part:06d}-{roll:04d}-{uuid.uuid4().hex}.ids"
        self.part, self.roll, self.width, self.ids, self.ends, self.keys = part, roll, width, 0, array("q"), []
        fs, target = filesystem(self.name)
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(target)

    def room(self, sizes: list[int], most: int) -> int:
        """How many of the next documents go into this file: one at least if it is empty."""
        total = self.ids
        for n, size in enumerate(sizes):
            total += size
            if (total > most or len(self.ends) + n >= FILE_DOCS) and (n or self.ends):
                return n
        return len(sizes)

    def add(self, keys, made: list[bytes]) -> None:
        """Documents with their ids."""
        for ids in made:
            self.out.write(ids)
            self.ids += len(ids) // self.width
            self.ends.append(self.ids)
        if len(keys):
            self.keys.append(keys)

    def close(self):
        import pyarrow as pa

        keys = pa.concat_arrays(self.keys)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("k", keys.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([keys], names=["k"]))
        named, bounds = sink.getvalue().to_pybytes(), EliasFano.of(self.ends).to_bytes()
        self.out.write(named)
        self.out.write(bounds)
        self.out.write(FOOTER.pack(MAGIC, self.width, self.ids, len(self.ends), len(named), len(bounds), zlib.crc32(bounds)))
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), pa.array([self.roll], pa.int32()), pa.array([self.name]), pa.array([len(self.ends)]), pa.array([self.ids])], names=["part", "roll", "file", "docs", "ids"])


class TokenFile:
    """Random and sequential access to one file."""

    def __init__(self, name: str) -> None:
        import pyarrow as pa

        fs, at = filesystem(name)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        magic, self.width, self.ids, self.docs, named, bounds, crc = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        data = self.file.read_at(bounds, size - FOOTER.size - bounds)
        if magic != MAGIC or zlib.crc32(data) != crc:
            raise ValueError(f"{name} is damaged")
        self.ends = EliasFano.from_bytes(data)
        self.keys = pa.ipc.open_stream(self.file.read_at(named, size - FOOTER.size - bounds - named)).read_all().column(0)

    def document(self, i: int):
        """Ids of document i of the file, found by select."""
        a = self.ends.select(i - 1) if i else 0
        return self.read(a, self.ends.select(i))

    def read(self, a: int, b: int):
        import numpy as np

        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


def read(spark: SparkSession, manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids binary) per document from the files: start counts the ids of all documents before it.

    The manifest has one row per file; its running sum gives each file's base.
    """
    based = manifest.select("part", "roll", "file", (F.sum("ids").over(Window.orderBy("part", "roll")) - F.col("ids")).alias("base"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = based.repartition(width, "part", "roll").select("file", "base")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stored = TokenFile(name)
                ends = stored.ends.all()
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                i = 0
                while i < stored.docs:  # about 4 million ids at a time
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 22))))
                    a = int(starts[i])
                    ids = stored.read(a, int(ends[j - 1])).astype("<u4")
                    out = [ids[s - a : e - a].tobytes() for s, e in zip(starts[i:j], ends[i:j], strict=True)]
                    yield pa.RecordBatch.from_arrays([stored.keys.slice(i, j - i).combine_chunks(), pa.array(starts[i:j] + base), pa.array(out, pa.binary())], names=["k", "start", "ids"])
                    i = j

    return dealt.mapInArrow(lean(run), f"k {id_type}, start long, ids binary").toDF(id_col, "start", "ids")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() to the shared folder, then read().

    Null and empty texts give the end id alone; null ids come first; repeated rows each keep their place; other
    columns are ignored; an empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    manifest = write(docs, shared_path(spark, "tokens"), tokenizer_path, end_id, id_col, text_col)
    return read(spark, manifest, docs.schema[id_col].dataType.simpleString(), id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of read()'s rows."""
    return found.select(id_col, "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
