"""Byte-level BPE by corpus-level merge replay.

A block of the corpus (an Arrow batch of whole texts) is cut into pieces; the pieces that the task has not met yet form
one word table. An inverted index over its token pairs applies the merges to the whole table in rank order, updating only
the neighbours of each merged position. The index key is the rank: pairs that make the same token share it, so overlapping
ones merge from left to right as the library does. No shuffle: blocks are independent, and a bounded memo carries pieces
from block to block.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import WIDE_ROWS, batch_rows, lean

#: Bytes that a task's memo of pieces takes at most.
MEMO_BYTES = 48 << 20
#: Characters of text that one block holds at most (a longer text is a block of its own, RUN_PIECES pieces at a time).
BLOCK_CHARS, RUN_PIECES = 1_000_000, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64(token) rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """The merges of one vocabulary, as a sorted table of token pairs and the ranks that they merge to."""

    #: Rank of pairs that do not merge, and bytes of a piece from which on it goes through the index one by one.
    NEVER, LONG = 2**31 - 1, 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import numpy as np

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.first = np.full((256, 256), -1, np.int32)
        for token, i in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = i
        get = ranks.get
        splits = ((get(token[:k]), get(token[k:]), i) for token, i in ranks.items() for k in range(1, len(token)))
        made = np.array([(left << 32 | right, i) for left, right, i in splits if left is not None and right is not None], np.int64).reshape(-1, 2)
        made = made[np.argsort(made[:, 0])]
        self.keys, self.merged = made[:, 0].copy(), made[:, 1].astype(np.int32)

    def rank(self, left, right):
        """Ranks of pairs of tokens (arrays); NEVER where they do not merge."""
        import numpy as np

        if not len(self.keys):
            return np.full(len(left), self.NEVER, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.NEVER)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit) of each piece.

        A piece that is itself a token is that token. Others are merged pair by pair: always the lowest rank in the
        piece, leftmost first.
        """
        out = [b""] * len(pieces)
        short, long = [], []
        for w, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
            elif piece:
                (long if len(piece) >= self.LONG else short).append(w)
        for some, merge in ((short, self.waves), (long, self.ordered)):
            for w, ids in zip(some, merge([pieces[w] for w in some]) if some else (), strict=True):
                out[w] = ids
        return out

    def waves(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces at once: the index holds every position's rank, and a wave applies the lowest posting of each piece.

        Pieces do not touch each other, so each sees its merges in rank order; only the neighbours of merged positions
        are looked up anew, and pieces without postings leave the table.
        """
        import numpy as np

        out = [b""] * len(pieces)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes, words = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.arange(len(pieces))
        part, rank = self.of_byte[raw], np.full(len(raw), -1, np.int32)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[rank < 0] = self.NEVER
        starts = np.cumsum(sizes) - sizes
        rank[starts + sizes - 1] = self.NEVER
        while len(words):
            low = np.minimum.reduceat(rank, starts)
            over = low == self.NEVER
            if over.any():
                gone = np.repeat(over, sizes)
                ids, ends = part[gone].astype("<u4").tobytes(), 4 * np.cumsum(sizes[over])
                for w, a, b in zip(words[over].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    out[w] = ids[a:b]
                part, rank, words, sizes, low = part[~gone], rank[~gone], words[~over], sizes[~over], low[~over]
                if not len(words):
                    break
            owner = np.repeat(np.arange(len(words)), sizes)
            hit = np.flatnonzero(rank == low[owner])
            hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]  # the leftmost of each piece
            part[hit] = low
            stay = np.ones(len(part), bool)
            stay[hit + 1] = False
            part, rank = part[stay], rank[stay]
            sizes -= 1
            starts = np.cumsum(sizes) - sizes
            at = hit - np.arange(len(hit))  # one position has gone before each
            inner = at < starts + sizes - 1
            rank[at] = self.NEVER
            rank[at[inner]] = self.rank(part[at[inner]], part[at[inner] + 1])
            left = at[at > starts]
            rank[left - 1] = self.rank(part[left - 1], part[left])
        return out

    def ordered(self, pieces: list[bytes]) -> list[bytes]:
        """Long pieces: one inverted index from rank to positions applies each merge to all pieces, rank by rank.

        When a merge creates a pair of a lower rank, the rest of that piece waits until this pair has been merged.
        """
        import numpy as np

        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum([0, *map(len, pieces)])
        after = np.arange(1, len(raw) + 1)
        after[starts[1:] - 1] = -1
        prior = np.arange(-1, len(raw) - 1)
        prior[starts[:-1]] = -1
        # the index: rank -> positions in ascending order
        at_rank = self.first[raw[:-1], raw[1:]]
        at_rank[starts[1:-1] - 1] = -1
        order = np.argsort(at_rank, kind="stable")
        listed, where = np.unique(at_rank[order], return_index=True)
        cuts = [*where.tolist(), len(order)]
        index = {r: order[a:b].tolist() for r, a, b in zip(listed.tolist(), cuts, cuts[1:], strict=False) if r >= 0}
        part = self.of_byte[raw].tolist()
        after, prior, starts = after.tolist(), prior.tolist(), starts.tolist()
        queue = list(index)
        heapq.heapify(queue)
        get, token, push = self.ranks.get, self.bytes_of, heapq.heappush
        while queue:
            r = heapq.heappop(queue)
            posted = index.pop(r)
            posted.sort()
            waiting: set[int] = set()
            for i in posted:
                left, j = part[i], after[i]
                if left < 0 or j < 0:
                    continue
                if get(token[left] + token[part[j]]) != r:
                    continue
                if waiting and bisect_right(starts, i) in waiting:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(queue, r)
                    continue
                part[i] = r
                part[j] = -1
                after[i] = k = after[j]
                if k >= 0:
                    prior[k] = i
                    new = get(token[r] + token[part[k]])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(queue, new)
                        if new < r:
                            waiting.add(bisect_right(starts, i))
                p = prior[i]
                if p >= 0:
                    new = get(token[part[p]] + token[r])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            push(queue, new)
                        if new < r:
                            waiting.add(bisect_right(starts, i))
        left = np.array(part, np.int64)
        alive = left >= 0
        ids = left[alive].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(alive)))[starts].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]


class Encoder:
    """Encodes blocks of texts; holds the ranks and the memo of one task.

    The memo maps pieces to their ids. It is bounded in bytes before anything is added: pieces that do not fit are
    kept for their block alone, and a full memo starts again from what the current block uses.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.replay = replay(ranks_path)
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def ids(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces."""
        memo = self.memo
        words = set().union(*cut)
        missing = list(words.difference(memo))
        fresh = dict(zip(missing, self.replay([w.encode("utf-8", "surrogatepass") for w in missing]), strict=True))
        cost = _cost(fresh)
        if self.held + cost <= MEMO_BYTES:
            memo.update(fresh)
            self.held += cost
            table = memo
        else:
            table = {w: memo[w] for w in words.difference(fresh)} | fresh
            cost = _cost(table)
            self.memo, self.held = (table, cost) if cost <= MEMO_BYTES else ({}, 0)
        at = table.__getitem__
        return [b"".join(map(at, x)) for x in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. A long text goes through in runs of pieces."""
        short = [self.pattern.findall(x) if len(x) <= BLOCK_CHARS else [] for x in texts]
        out = self.ids(short)
        for i, text in enumerate(texts):
            if len(text) > BLOCK_CHARS:
                pieces = (m.group() for m in self.pattern.finditer(text))
                out[i] = b"".join(self.ids([part])[0] for part in iter(lambda p=pieces: list(islice(p, RUN_PIECES)), []))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an unknown id raises."""
        import numpy as np

        return b"".join(map(self.replay.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def replay(ranks_path: str) -> Replay:
    """The merges of a vocabulary, read once by each worker process."""
    return Replay(load_ranks(ranks_path))


def _cost(table: dict[str, bytes]) -> int:
    """Bytes that entries of a memo take, about: two objects and a slot each."""
    return 230 * len(table) + 2 * sum(map(len, table)) + sum(map(len, table.values()))


def lengths(column) -> list[int]:
    """Bytes of each value of an Arrow string or binary column; null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def blocks(sizes: list[int], most: int = BLOCK_CHARS) -> Iterable[tuple[int, int]]:
    """Index ranges whose sizes sum to at most `most`, each of one value at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def _texts(batches):
    """(ids column, texts) of blocks of whole rows; a null text is an empty one."""
    for batch in batches:
        for a, b in blocks(lengths(batch.column(1))):
            yield batch.column(0).slice(a, b - a), [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary) per row of docs: ids of the whole text as little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids; null ids, repeated rows and ties pass through; other columns are ignored.
    Stretches without a blank may be of any length. An empty table gives an empty table.
    """
    plain = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    batch_rows(docs.sparkSession, WIDE_ROWS)

    def run(batches):
        import pyarrow as pa

        made = Encoder(ranks_path, pattern)
        for keys, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(made.encode(texts), pa.binary())], names=["k", "ids"])

    return plain.mapInArrow(lean(run), f"k {plain.schema['k'].dataType.simpleString()}, ids binary").toDF(id_col, "ids")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded binary): the bytes that the ids stand for. Null ids decode to no bytes; an unknown id raises."""
    plain = encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids"))

    def run(batches):
        import pyarrow as pa

        made = Encoder(ranks_path, "")
        for batch in batches:
            for a, b in blocks(lengths(batch.column(1)), 4 * BLOCK_CHARS):
                part = batch.slice(a, b - a)
                out = [made.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["k", "ids", "decoded"])

    return plain.mapInArrow(lean(run), f"k {plain.schema['k'].dataType.simpleString()}, ids binary, decoded binary").toDF(id_col, "ids", "decoded")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) per row: digest(decode(encode(docs))) in one pass.

    One worker per core encodes a text, decodes the ids and digests both, so neither ids nor bytes leave it. Rows are
    treated as by encode().
    """
    plain = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    batch_rows(docs.sparkSession, WIDE_ROWS)

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        made = Encoder(ranks_path, pattern)
        for keys, texts in _texts(batches):
            ids = made.encode(texts)
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([sha256(made.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"k {plain.schema['k'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain.mapInArrow(lean(run), schema).withColumnRenamed("k", id_col)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of decode()'s rows."""
    return decoded.select(
        id_col,
        (F.coalesce(F.length("ids"), F.lit(0)) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
