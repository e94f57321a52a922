"""Embedding near-duplicates by NN-descent.

Equal vectors collapse to one class. A neighbour graph over the classes starts from short windows of random orders,
more of them for a larger table, and is refined by joins of neighbours with neighbours of neighbours, on 8-bit codes.
Lists that hold nothing but near neighbours are saturated: they are enlarged and refined again until no group grows.
Query vectors, compared with all rows until enough true links are seen, audit the recall after each search; a low recall
costs more searches, and one that stays low has everything compared with everything. Edges near the threshold make groups;
inside a group every pair of vectors is compared exactly, block by block (a vector goes to as many tasks as its group has
blocks), and each vector gets the number of its links and each block a spanning forest of them.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import MADE, NARROW_ROWS, batch_rows, connected_components, forget, lean, written
from tickspark.llm.simhash import Links

log = logging.getLogger(__name__)

#: Neighbours per list, least orders and window of the first graph, least rounds, and changed entries (share) below which rounds end.
NEIGHBOURS, ORDERS, WINDOW, ROUNDS, STILL = 10, 8, 64, 6, 0.01
#: Searches after which groups have to be settled; lists double with each, so only an error needs as many.
MOST_ATTEMPTS = 30
#: A neighbourhood longer than this is dealt into random parts, anew in each round.
HUB = 512
#: 8-bit codes change a cosine by less than this.
MARGIN = 0.03
#: Share of the pairs at the threshold that the first graph's orders should bring together.
MEET = 0.999
#: The audit asks AUDIT query vectors, then four times as many and so on, until it has seen LINKS true links or asked
#: MOST_AUDIT vectors (they go through the driver). Recall that it asks for, and extra searches that a low recall may
#: cost before everything is compared with everything.
AUDIT, LINKS, MOST_AUDIT, RECALL, TRIES = 512, 2_000, 8_192, 0.99, 6
#: Rows of a group that are compared with as many others at once.
BLOCK = 4096
GRAPH = "id long, nbr long, sim float, old boolean, full boolean"


def runs(batches: Iterable, arrays: Callable) -> Iterator[tuple]:
    """Arrays over whole runs of equal keys (arrays(batch)[0]) of a partition sorted by key; several runs at a time."""
    import numpy as np

    held: list[tuple] = []  # parts of the last run
    join = lambda parts: parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    for batch in batches:
        if not batch.num_rows:
            continue
        new = arrays(batch)
        keys = new[0]
        if held and held[0][0][0] != keys[0]:
            yield join(held)
            held = []
        earlier = np.flatnonzero(keys != keys[-1])
        last = int(earlier[-1]) + 1 if len(earlier) else 0
        if last:
            yield join([*held, tuple(x[:last] for x in new)])
            held = []
        held.append(tuple(x[last:] for x in new))
    if held:
        yield join(held)


def bounds(keys) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    import numpy as np

    return [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]


def matrix(column, width: int, kind: str):
    """Rows of an Arrow binary column of equal lengths as one array."""
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def units(vectors: DataFrame) -> DataFrame:
    """(cid, dim, unit binary: doubles of length 1, code binary: the same in 8 bits, copies, least) of classes (cid, v, copies, least)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            unit, code, dims = [], [], []
            for x in batch.column(1):
                v = np.asarray(x.values, dtype=np.float64)
                v = v / np.abs(v).max()
                v = v / np.sqrt(v @ v)
                unit.append(v.tobytes())
                dims.append(len(v))
                code.append(np.round(v * (127 / np.abs(v).max())).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(unit, pa.binary()), pa.array(code, pa.binary()), batch.column(2), batch.column(3)], names=["cid", "dim", "unit", "code", "copies", "least"])

    return vectors.select("cid", "v", "copies", "least").mapInArrow(lean(run), "cid long, dim int, unit binary, code binary, copies long, least long")


def cosines(code):
    """All cosines between rows of 8-bit codes; a row's with itself is -2."""
    import numpy as np

    x = code.astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    return sims


def proposals(ids, code, kth, most: int):
    """(id, nbr, sim) for pairs within a small group that improve the id's list: at most `most` per id, the nearest."""
    import numpy as np

    ids, first = np.unique(ids, return_index=True)
    code, kth = code[first], kth[first]
    if len(ids) < 2:
        return ids[:0], ids[:0], np.zeros(0, np.float32)
    sims = cosines(code)
    most = min(most, len(ids) - 1)
    near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    found = np.take_along_axis(sims, near, axis=1)
    a, b = np.nonzero(found > kth[:, None])
    return ids[a], ids[near[a, b]], found[a, b]


def nearest(ids, nbrs, sims, old, k: int):
    """(ids, nbrs, sims, old, full) of the k nearest distinct neighbours of each id; `full` says that the list has k."""
    import numpy as np

    order = np.lexsort((~old, nbrs, ids))  # a pair's old row first
    ids, nbrs, sims, old = ids[order], nbrs[order], sims[order], old[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, sims, old = ids[fresh], nbrs[fresh], sims[fresh], old[fresh]
    order = np.lexsort((nbrs, -sims, ids))
    ids, nbrs, sims, old = ids[order], nbrs[order], sims[order], old[order]
    starts = np.array(bounds(ids))
    sizes = np.diff(starts)
    kept = np.arange(len(ids)) - np.repeat(starts[:-1], sizes) < k
    return tuple(x[kept] for x in (ids, nbrs, sims, old, np.repeat(sizes >= k, sizes)))


def _graph_batch(parts: list[tuple], k: int):
    """Proposals of a task, an id's k nearest alone: what a hub is proposed shrinks before it moves."""
    import numpy as np
    import pyarrow as pa

    ids, nbrs, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, nbrs, sims, _, _ = nearest(ids, nbrs, sims, np.zeros(len(ids), bool), k)
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nbrs, pa.int64()), pa.array(sims, pa.float32()), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, bool))], names=["id", "nbr", "sim", "old", "full"])


def cell_bits(count: int) -> int:
    return max(2, math.ceil(math.log2(max(4, count / WINDOW))))


def orders_of(count: int, threshold: float) -> int:
    """Random orders so that MEET of the pairs at the threshold meet in a cell: a bit parts a pair with its angle / pi."""
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** cell_bits(count)
    return ORDERS if meet >= 1 else max(ORDERS, math.ceil(math.log(1 - MEET) / math.log1p(-meet)))


def first_graph(codes: DataFrame, dim: int, count: int, k: int, seed: int, orders: int = ORDERS) -> DataFrame:
    """Candidates from windows of random orders: by the signs of random projections, then by one more projection."""
    bits = cell_bits(count)
    width = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        planes = np.random.default_rng(seed).standard_normal((orders, bits + 1, dim)).astype(np.float32)
        for batch in batches:
            x = matrix(batch.column(1), dim, np.int8).astype(np.float32)
            for t in range(orders):
                y = x @ planes[t].T
                cell = ((y[:, :bits] > 0) @ (1 << np.arange(bits))) * orders + t
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(y[:, bits]), batch.column(0), batch.column(1)], names=["cell", "at", "id", "code"])

    def join(batches):
        import numpy as np

        few = max(2, math.ceil(3 * k / orders))
        for cells, ids, code in runs(batches, lambda b: (b.column(0).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), dim, np.int8))):
            cuts, out = bounds(cells), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2):  # windows overlap by half
                    part = slice(i, min(b, i + WINDOW))
                    out.append(proposals(ids[part], code[part], np.full(part.stop - part.start, -2, np.float32), few))
            yield _graph_batch(out, k)

    dealt = codes.select("id", "code").mapInArrow(lean(deal), "cell long, at float, id long, code binary")
    # by ranges: a cell that holds many vectors is spread over as many partitions as it fills
    return dealt.repartitionByRange(width, "cell", "at").sortWithinPartitions("cell", "at", "id").mapInArrow(lean(join), GRAPH)


def best(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each id; `full` says that the list has k."""
    width = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        get = lambda b: tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for part in runs(batches, get):
            ids, nbrs, sims, old, full = nearest(*part, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nbrs), pa.array(sims, pa.float32()), pa.array(old), pa.array(full)], names=["id", "nbr", "sim", "old", "full"])

    return candidates.repartition(width, "id").sortWithinPartitions("id").mapInArrow(lean(run), GRAPH)


def refine(graph: DataFrame, codes: DataFrame, dim: int, k: int, turn: int) -> DataFrame:
    """One NN-descent round: members of each neighbourhood (forward and reverse) are compared with each other."""
    spark = graph.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = graph.select(F.col("id").alias("pivot"), F.col("nbr").alias("member")).union(graph.select("nbr", "id"))
    hubs = both.groupBy("pivot").agg(F.count("*").alias("n")).filter(F.col("n") > HUB)
    salted = both.join(hubs, "pivot", "left").select(
        F.when(F.col("n").isNull(), F.xxhash64("pivot")).otherwise(F.xxhash64("pivot", F.pmod(F.xxhash64("member", F.lit(turn)), F.ceil(F.col("n") / HUB)))).alias("pivot"), "member"
    )
    kth = graph.groupBy("id").agg(F.when(F.first("full"), F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("kth"))
    known = written(codes.join(kth, "id", "left").select(F.col("id").alias("member"), "code", F.coalesce("kth", F.lit(-2.0)).cast("float").alias("kth")), "known")
    dealt = salted.join(known, "member").select("pivot", "member", "code", "kth").repartition(width, "pivot").sortWithinPartitions("pivot")

    def run(batches):
        import numpy as np

        get = lambda b: (b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dim, np.int8), b.column(3).to_numpy())
        for pivots, members, code, least in runs(batches, get):
            cuts = bounds(pivots)
            yield _graph_batch([proposals(members[a:b], code[a:b], least[a:b], k) for a, b in zip(cuts, cuts[1:], strict=False)], k)

    new = dealt.mapInArrow(lean(run), GRAPH)
    return best(graph.withColumn("old", F.lit(True)).unionByName(new), k)


def descend(graph: DataFrame, codes: DataFrame, dim: int, k: int, rounds: int, turn: int) -> DataFrame:
    """Refine until few entries change or `rounds` have run."""
    for i in range(rounds):
        graph = written(refine(graph, codes, dim, k, turn + i), "graph")
        total, new = graph.agg(F.count("*"), F.count_if(~F.col("old"))).first()
        if new <= STILL * total:
            break
    return graph


def audit(classes: DataFrame, dim: int, threshold: float, skip: int = 0, queries: int = AUDIT) -> DataFrame:
    """(src, dst): all links of `queries` classes in order of their hashes, after the first `skip`, by comparing them with every class."""
    asked = [(r.cid, bytes(r.unit)) for r in classes.orderBy(F.xxhash64("cid"), "cid").select("cid", "unit").limit(skip + queries).collect()[skip:]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = np.array([c for c, _ in asked], np.int64)
        q = np.frombuffer(b"".join(u for _, u in asked)).reshape(-1, dim)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim, np.float64)
            for i in range(0, len(q), AUDIT):
                a, b = np.nonzero(q[i : i + AUDIT] @ x.T >= threshold)
                other = ids[i + a] != own[b]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + a][other]), pa.array(own[b][other])], names=["src", "dst"])

    return classes.select("cid", "unit").mapInArrow(lean(run), "src long, dst long")


def audited(classes: DataFrame, dim: int, count: int, threshold: float) -> tuple[DataFrame, int]:
    """True links of more and more query vectors, and how many vectors were asked."""
    most = min(count, MOST_AUDIT)
    asked, true = 0, None
    while True:
        more = min(most, max(AUDIT, 4 * asked)) - asked
        part = written(audit(classes, dim, threshold, asked, more), "audit")
        asked, true = asked + more, part if true is None else true.union(part)
        if asked >= most or true.count() >= LINKS:
            return true, asked


def groups(classes: DataFrame, dim: int, count: int, threshold: float, k: int = NEIGHBOURS) -> tuple[DataFrame, dict]:
    """((id, component) of the classes that have a near neighbour, figures of the search)."""
    codes = classes.select(F.col("cid").alias("id"), "code")
    orders, rounds = orders_of(count, threshold), max(ROUNDS, cell_bits(count))
    graph = written(best(first_graph(codes, dim, count, k, 1, orders), k), "graph")
    graph = descend(graph, codes, dim, k, rounds, turn=1)
    true, queries = audited(classes, dim, count, threshold)
    near = lambda g: g.filter(F.col("sim") >= threshold - MARGIN).select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    edges = written(near(graph), "near")
    turn, before, attempt, tries = 100, None, 0, 0
    while True:
        attempt += 1
        # recall of the graph alone: all pairs inside a group are compared, so a true link is found if its ends share one
        own = written(connected_components(edges), "found")
        both = true.join(own.toDF("src", "a"), "src", "left").join(own.toDF("dst", "b"), "dst", "left")
        asked, got = both.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
        recall = got / asked if asked else None  # None: no link was seen, so nothing is known
        crowded = graph.groupBy("id").agg((F.first("full") & (F.min("sim") >= threshold - MARGIN)).alias("all")).filter("all").select("id")
        state = tuple(own.agg(F.count("*"), F.countDistinct("component")).first())
        low = recall is not None and recall < RECALL and tries < TRIES
        grows = state != before and crowded.limit(1).count() > 0
        if not low and not grows:
            break
        if attempt == MOST_ATTEMPTS:
            raise RuntimeError(f"groups still grow after {attempt} searches")
        before, turn, tries = state, turn + 100, tries + low
        k = 2 * k if grows else k
        some = codes if low else codes.join(crowded, "id", "left_semi")
        start = first_graph(some, dim, count, k, turn, orders).unionByName(graph)
        graph = written(best(start, k), "graph")
        graph = descend(graph, codes, dim, k, 2 if low else 1, turn)
        edges = written(edges.union(near(graph)), "near")
    figures = {"recall": recall, "audited": asked, "queries": queries, "attempts": attempt, "k": k}
    figures["exact"] = recall is not None and recall < RECALL
    (log.warning if recall is None or figures["exact"] else log.info)("nearest-neighbour search over %d vectors: %s", count, figures)
    if figures["exact"]:  # the search does not do: everything is one group, compared block by block
        return codes.select("id", F.lit(0).cast("long").alias("component")), figures
    return written(connected_components(edges.union(true)), "found"), figures


def compare(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, links, other): exact links inside groups (cid, unit, copies, component, size); other: an edge of a spanning forest, or null."""
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "peer"), F.greatest("own", "peer")
    dealt = dealt.select(F.xxhash64("component", low, high).alias("task"), (F.col("own") > F.col("peer")).alias("right"), (F.col("own") == F.col("peer")).alias("inner"), "cid", "unit", "copies")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        get = lambda b: (*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3)), matrix(b.column(4), dim, np.float64), b.column(5).to_numpy())
        for tasks, right, inner, ids, x, copies in runs(batches, get):
            cuts, out = bounds(tasks), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = slice(a, b)
                n, count, links = b - a, np.zeros(b - a, np.int64), Links(b - a)
                left = np.arange(n) if inner[a] else np.flatnonzero(~right[here])
                other = left if inner[a] else np.flatnonzero(right[here])
                for i in range(0, len(left), 512):
                    p, q = np.nonzero(x[here][left[i : i + 512]] @ x[here][other].T >= threshold)
                    p, q = left[i : i + 512][p], other[q]
                    apart = p != q
                    p, q = p[apart], q[apart]
                    np.add.at(count, p, copies[here][q])
                    if not inner[a]:
                        np.add.at(count, q, copies[here][p])
                    links.add(p, q)
                u, v = links.edges()
                peer = np.full(n, -1)
                peer[u] = v
                out.append((ids[here], count, np.where(peer >= 0, ids[here][peer], 0), peer >= 0))
            own, count, peer, has = (np.concatenate(z) for z in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count), pa.array(peer, pa.int64(), mask=~has)], names=["id", "links", "other"])

    return dealt.repartition(width, "task").sortWithinPartitions("task", "cid").mapInArrow(lean(run), "id long, links long, other long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", report: list | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row. report, if given, gets the figures of each search (recall and so on).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    lengths do not link. Equal vectors link, also under one id. component_id is the smallest id reachable; rows with a
    null id are linked like others but have no component of their own. Other columns are ignored; an empty table gives
    an empty table.
    """
    batch_rows(rows.sparkSession, NARROW_ROWS)
    spark, made = rows.sparkSession, list(MADE)
    plain = written(rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")), "vectors")
    plain_at = MADE[-1]
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = plain.filter(F.coalesce(sound, F.lit(False)))
    grouped = valid.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    seed = 0
    while True:  # class ids are hashes; a collision asks for another seed
        classes = written(units(grouped.withColumn("cid", F.xxhash64("v", F.lit(seed)))), "classes")
        total, distinct = classes.agg(F.count("*"), F.countDistinct("cid")).first()
        if total == distinct:
            break
        seed += 1
    per_class = classes.select("cid", "copies", "least")
    found = None
    for dim, count in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = classes.filter(F.col("dim") == dim)
        grouped_by, figures = groups(own, dim, count, threshold)
        if report is not None:
            report.append({"dim": dim, "vectors": count, **figures})
        # written tables on both sides of a join: adaptive execution splits its hot keys
        sizes = written(grouped_by.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        members = own.join(grouped_by.join(sizes, "component").withColumnRenamed("id", "cid"), "cid").select("cid", "unit", "copies", "component", "size")
        part = compare(members, dim, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = plain.sparkSession.createDataFrame([], "id long, links long, other long")
    found = written(found, "links")
    components = connected_components(found.filter("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))).toDF("cid", "component")
    counted = found.groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"))
    labelled = written(per_class.join(components, "cid", "left").withColumn("component", F.coalesce("component", "cid")).join(counted, "cid", "left"), "labelled")
    least = written(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    done = written(labelled.join(least, "component").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "done")
    forget(spark, made, plain_at, MADE[-1])
    keyed = plain.select("id", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("v", F.lit(seed))).alias("cid"))
    out = keyed.join(done, "cid", "left")
    component = F.coalesce("component_id", F.when(F.col("cid").isNull(), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
