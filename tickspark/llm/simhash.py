"""SimHash near-duplicates through vantage-point trees.

Equal fingerprints collapse to one. Distinct ones are partitioned by their Hamming distances to a few vantage
fingerprints: each distance is a ring, and a tuple of rings is a shard. By the triangle inequality two fingerprints
within `radius` lie in rings that differ by `radius` at most, so each fingerprint is stored in its own shard and
queries the shards that its ball overlaps; of two neighbouring shards only one is asked. Inside a shard the same rule
prunes branches of a local tree, and the leaves compare exactly. Rings are not equally full: a shard with too many
fingerprints is split by the rings around one of them, and so on. A shard returns a spanning forest of its links, not its
pairs, so a large group of near copies stays linear.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import MADE, WIDE_ROWS, batch_rows, connected_components, forget, lean, written

#: Fingerprints that a shard stores at most: a fuller one is split by the rings around one of its own, down to MOST_LEVELS rings in all.
SHARD_ROWS, MOST_LEVELS = 20_000, 10
#: Vantage points that all fingerprints are dealt by.
VANTAGE = 2
#: Fingerprints from which vantage points are chosen.
VANTAGE_SAMPLE = 256
#: Pairs that a leaf compares in one step.
LEAF_PAIRS = 400_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the whole text, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as they occur; fewer words
    than a shingle make one shingle, none make fingerprint zero.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(2048, np.int64)
    lane = (np.arange(8) * 256).astype(np.int64)
    for at in range(0, len(first), 100_000):  # bounds the memory of very long texts
        a, b = first[at : at + 100_000].tolist(), last[at : at + 100_000].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)), np.dtype("<u8"), len(a))
        ones += np.bincount((h.view(np.uint8).reshape(-1, 8) + lane).ravel(), minlength=2048)
    set_bits = ones.reshape(8, 256) @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    bits = (set_bits.ravel() * 2 > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long: the 64 bits as a signed number) per row of docs. A null text counts as empty."""
    plain = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    batch_rows(docs.sparkSession, WIDE_ROWS)
    id_type = plain.schema["k"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["k", "fp"])

    return plain.mapInArrow(lean(run), f"k {id_type}, fp long").toDF(id_col, "fp")


class Links:
    """Gathers links between positions 0..n-1 and keeps only a spanning forest of them."""

    def __init__(self, n: int, held: int = 1_000_000) -> None:
        import numpy as np

        self.np, self.label, self.parts, self.count, self.held = np, np.arange(n), [], 0, held

    def add(self, a, b) -> None:
        if len(a):
            self.parts.append((a, b))
            self.count += len(a)
            if self.count > self.held:
                self.fold()

    def fold(self) -> None:
        """Labels become the smallest position reachable."""
        np, label = self.np, self.label
        if not self.parts:
            return
        a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.count = [], 0
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            for x in (a, b):
                np.minimum.at(label, before[x], low)
                np.minimum.at(label, x, low)
            while not np.array_equal(label, up := label[label]):
                label[:] = up
            if np.array_equal(before, label) and np.array_equal(label[a], label[b]):
                return

    def edges(self):
        self.fold()
        at = self.np.flatnonzero(self.label != self.np.arange(len(self.label)))
        return at, self.label[at]


def near(queries, stored, values, radius: int, links: Links, depth: int = 0) -> None:
    """Link each position of `queries` to the positions of `stored` within `radius` of it, by a tree of rings."""
    import numpy as np

    if not len(queries) or not len(stored):
        return
    if len(queries) * len(stored) > LEAF_PAIRS and depth < 12:
        vantage = values[stored[(len(stored) * 7 // 16 + depth) % len(stored)]]
        of_query, of_stored = (np.bitwise_count(values[x] ^ vantage).astype(np.int16) for x in (queries, stored))
        order = np.argsort(of_stored, kind="stable")
        stored, of_stored = stored[order], of_stored[order]
        cuts = np.searchsorted(of_stored, np.arange(66))
        if np.diff(cuts).max() <= 0.8 * len(stored):
            order = np.argsort(of_query, kind="stable")
            queries, of_query = queries[order], of_query[order]
            for ring in np.unique(of_stored).tolist():
                a, b = np.searchsorted(of_query, (ring - radius, ring + radius + 1))
                near(queries[a:b], stored[cuts[ring] : cuts[ring + 1]], values, radius, links, depth + 1)
            return
    step = max(1, LEAF_PAIRS // len(stored))
    kept = values[stored]
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        x, y = np.nonzero(np.bitwise_count(values[q][:, None] ^ kept[None, :]) <= radius)
        a, b = q[x], stored[y]
        other = values[a] != values[b]
        links.add(a[other], b[other])


def dealt(fp, vantage: list[int], fat: dict[int, int], radius: int, own: bool):
    """(position, shard, stored) arrays of fingerprints (unsigned array): own shards, and unless `own` the later ones that a ball overlaps.

    A shard is a path of rings: first those of the vantage points, then, while the path is that of a fat shard, the ring
    around the fingerprint that splits it. Of two shards of linked fingerprints the later one, where the paths part, is asked.
    """
    import numpy as np

    places, path, later = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), bool)

    def step(some, points):
        nonlocal places, path, later
        rings = np.bitwise_count(fp[places[some]] ^ points).astype(np.int64)
        parts = [(places[~some], path[~some], later[~some])]
        for shift in (0,) if own else range(-radius, radius + 1):
            ring = rings + shift
            ok = (ring >= 0) & (ring <= 64) & ((shift >= 0) | later[some])
            parts.append((places[some][ok], path[some][ok] * 66 + ring[ok] + 1, later[some][ok] | (shift > 0)))
        places, path, later = (np.concatenate(x) for x in zip(*parts, strict=True))

    for point in vantage:
        step(np.ones(len(path), bool), np.int64(point).view(np.uint64))
    keys = np.array(sorted(fat), np.int64)
    points = np.array([fat[k] for k in keys.tolist()], np.int64).view(np.uint64)
    while len(keys):
        at = np.minimum(np.searchsorted(keys, path), len(keys) - 1)
        some = keys[at] == path
        if not some.any():
            break
        step(some, points[at[some]])
    return places, path, ~later


def shards(distinct: DataFrame, vantage: list[int], fat: dict[int, int], radius: int, own: bool = False) -> DataFrame:
    """(shard, fp, stored): each fingerprint in its own shard, and unless `own` as a query in those that its ball overlaps."""

    def run(batches: Iterable) -> Iterable:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            places, path, stored = dealt(fp.view(np.uint64), vantage, fat, radius, own)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(fp[places]), pa.array(stored)], names=["shard", "fp", "stored"])

    return distinct.select("fp").mapInArrow(lean(run), "shard long, fp long, stored boolean")


def fat_shards(distinct: DataFrame, vantage: list[int], radius: int, shard_rows: int) -> dict[int, int]:
    """Shards that store more than shard_rows fingerprints, each with one of them that splits it, level by level.

    At most one entry for each shard_rows fingerprints and level reaches the driver.
    """
    fat: dict[int, int] = {}
    for _ in range(MOST_LEVELS - len(vantage)):
        sizes = shards(distinct, vantage, fat, radius, own=True).groupBy("shard").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp"), "fp")).alias("x"))
        new = {r.shard: r.fp for r in sizes.filter(F.col("n") > shard_rows).select("shard", "x.fp").collect()}
        if not new:
            break
        fat |= new
    return fat


def links(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(src, dst): a spanning forest per shard of all links between distinct fingerprints (fp long) within radius."""
    spark = distinct.sparkSession
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(VANTAGE_SAMPLE).collect()]
    vantage = spread_out(sample, VANTAGE)
    fat = fat_shards(distinct, vantage, radius, shard_rows)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def local(table):
        import numpy as np
        import pyarrow as pa

        values = table.column("fp").to_numpy().view(np.uint64)
        found = Links(len(values))
        near(np.arange(len(values)), np.flatnonzero(table.column("stored").to_numpy(zero_copy_only=False)), values, radius, found)
        a, b = found.edges()
        signed = values.view(np.int64)
        return pa.table({"src": pa.array(signed[a], pa.int64()), "dst": pa.array(signed[b], pa.int64())})

    return shards(distinct, vantage, fat, radius).repartition(width, "shard").groupBy("shard").applyInArrow(local, "src long, dst long")


def spread_out(sample: list[int], count: int) -> list[int]:
    """Vantage points from the sample: in turn the one whose distances to the sample vary most, far from those chosen."""
    import numpy as np

    if not sample:
        return [0] * count
    x = np.array(sample, np.int64).view(np.uint64)
    apart = np.bitwise_count(x[:, None] ^ x[None, :]).astype(float)
    chosen: list[int] = []
    for _ in range(count):
        # a point opposite to a chosen one has the same rings: prefer distances to the chosen ones near 32
        near_half = -np.abs(apart[:, chosen] - 32).max(axis=1) if chosen else np.zeros(len(x))
        score = apart.std(axis=1) + near_half
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()) if len(chosen) < len(x) else chosen[0])
    return [sample[i] for i in chosen]


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, fp, component_id) per row: component_id is the smallest id reachable by links of `radius` bits or fewer.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part; component_id is
    the smallest id that is not null, or null if there is none. Repeated rows each get their row. Ids are compared as
    numbers; other columns are ignored. An empty table gives an empty table.
    """
    spark, made = docs.sparkSession, list(MADE)
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    prints_at = MADE[-1]
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    found = connected_components(links(classes.select("fp"), radius, shard_rows))
    # written tables on both sides: adaptive execution splits the hot keys of these joins (a giant component, a print of many copies)
    labelled = written(classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp")), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = written(labelled.join(least, "label").select("fp", "component_id"), "named")
    forget(spark, made, prints_at, MADE[-1])
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
