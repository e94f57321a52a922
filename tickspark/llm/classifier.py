"""Quality classifier by co-training on two views of a document.

The text view sees hashed character trigrams and words of the whole text and how it is written; the metadata view sees
language, source and length. Both start from a bounded sample of the labelled rows. In each round both score all other
documents, and of those that a view is surest of the first few per class join the other view's training rows. At the end
each view is calibrated on labelled rows that neither was fitted on, a last model weighs the calibrated views, and every
document is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import WIDE_ROWS, batch_rows, lean, written

#: Most labelled rows that the models are fitted on, and rows that a view hands to the other in a round, both classes together.
LABELLED, EXCHANGED = 20_000, 1_000
ROUNDS = 4
#: A view hands on only rows that it is this sure of.
SURE = 0.95
#: Share of labelled rows kept for calibration.
HELD_OUT = 0.25
#: Documents with a lower score are rejected.
THRESHOLD = 0.3
#: Buckets of hashed trigrams, and of hashed words; places for sources and languages. Steps of a stored logarithm.
GRAMS, SOURCES, LANGS, STEPS = 128, 64, 16, 32
STYLE = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "other_signs", "signs_per_word", "not_ascii", "distinct_words", "repeated_neighbours", "distinct_lines")
#: Bytes of a text that are looked at together (cuts are at blanks), and rows of a matrix that are squared together.
WINDOW, CHUNK = 4 << 20, 4096
#: One document's features, as fixed bytes.
ROW = [("grams", "u1", 2 * GRAMS), ("style", "<f4", len(STYLE)), ("size", "<f4"), ("lang", "u1"), ("source", "u1")]


def windows(data: bytes) -> list[bytes]:
    """data in pieces of about WINDOW bytes that end before a blank (a longer stretch without one stays whole)."""
    import re

    out, at = [], 0
    while len(data) - at > WINDOW:
        cut = re.compile(rb"[ \t\n\r\x0b\x0c]").search(data, at + WINDOW)
        if cut is None:
            break
        out.append(data[at : cut.start()])
        at = cut.start()
    return [*out, data[at:]]


def text_features(text: str | None) -> tuple[list[int], list[float]]:
    """(stored logarithms of frequencies per thousand of 2 GRAMS buckets, STYLE) of the whole text; a null text is an empty one."""
    import math
    from operator import eq

    import numpy as np

    data = (text or "").encode("utf-8", "surrogatepass")
    grams, counts = np.zeros(2 * GRAMS), np.zeros(256, np.int64)
    bucket = lambda h: (h * np.uint32(2654435761)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    total = length = again = 0
    words: set[int] = set()
    for part in windows(data):
        b = np.frombuffer(part, np.uint8).astype(np.uint32)
        counts += np.bincount(b, minlength=256)
        if len(b) > 2:
            grams[:GRAMS] += np.bincount(bucket((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]), minlength=GRAMS)
        here = part.lower().split()
        if here:
            hashes = list(map(zlib.crc32, here))
            grams[GRAMS:] += np.bincount(bucket(np.array(hashes, np.uint32)), minlength=GRAMS)
            words.update(hashes)
            total, length, again = total + len(here), length + sum(map(len, here)), again + sum(map(eq, hashes, hashes[1:]))
    lines = data.split(b"\n")
    n, w = max(1, len(data)), max(1, total)
    lower, upper, digits = (int(counts[i:j].sum()) for i, j in ((97, 123), (65, 91), (48, 58)))
    others = int(counts[33:127].sum()) - lower - upper - digits
    style = [
        math.log1p(len(data)), math.log1p(total), length / w, upper / max(1, upper + lower), digits / n, others / n, others / w,
        int(counts[128:].sum()) / n, len(words) / w, again / w, len(set(lines)) / len(lines),
    ]
    grams[:GRAMS] *= 1000 / n
    grams[GRAMS:] *= 1000 / w
    return np.rint(np.log1p(grams) * STEPS).astype(np.uint8).tolist(), style


def stored(text: str | None, lang: str | None, source: str | None, length: int | None) -> tuple:
    """One document's ROW; null languages and sources have a place of their own."""
    import math

    place = lambda x, most: zlib.crc32(x.encode()) % (most - 1) if x is not None else most - 1
    return (*text_features(text), math.log1p(max(0, length or 0)), place(lang, LANGS), place(source, SOURCES))


def views(rows):
    """(text, metadata) matrices of an array of ROW."""
    import numpy as np

    text = np.concatenate([rows["grams"] / np.float32(STEPS), rows["style"]], axis=1, dtype=np.float32)
    size = rows["size"][:, None]
    return text, np.concatenate([size, size * size / 10, np.eye(LANGS)[rows["lang"]], np.eye(SOURCES)[rows["source"]]], axis=1, dtype=np.float32)


class Logistic:
    """Logistic regression on standardised columns, fitted by Newton steps with a ridge."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.ridge = ridge

    def fit(self, x, y, start: Logistic | None = None):
        """start: a model of the same columns whose weights the steps begin from."""
        import numpy as np

        self.mean = x.mean(axis=0, dtype=float)
        spread = x.std(axis=0, dtype=float)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self._columns(x)
        self.w = np.zeros(z.shape[1]) if start is None else start.w.copy()
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = _sigmoid(z @ self.w)
            curve = np.diag(penalty)
            for i in range(0, len(z), CHUNK):  # in pieces: no second matrix of all rows
                part = z[i : i + CHUNK]
                curve += (part * (p * (1 - p))[i : i + CHUNK, None]).T @ part
            step = np.linalg.solve(curve, z.T @ (p - y) + penalty * self.w)
            self.w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        return self

    def _columns(self, x):
        import numpy as np

        out = np.ones((len(x), x.shape[1] + 1))
        some = out[:, :-1]
        np.subtract(x, self.mean, out=some)
        some /= self.scale
        np.clip(some, -8, 8, out=some)
        return out

    def logit(self, x):
        return self._columns(x) @ self.w


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """The two views, their calibrations (slope and offset on the logit) and the weights of the calibrated logits."""

    text: Logistic
    meta: Logistic
    calibrations: tuple
    last: Logistic
    exchanged: tuple[int, int]

    def scores(self, text, meta):
        """(text view, metadata view, combined) probabilities of good quality."""
        import numpy as np

        calm = [c.logit(v.logit(x)[:, None]) for v, x, c in zip((self.text, self.meta), (text, meta), self.calibrations, strict=True)]
        return (*map(_sigmoid, calm), _sigmoid(self.last.logit(np.column_stack(calm))))


class Training:
    """The bounded rows that both views are fitted on, and what the views have handed to each other."""

    def __init__(self, text, meta, y) -> None:
        import numpy as np

        self.views, self.y = (text, meta), np.asarray(y, float)
        held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
        if len(set(self.y[held])) < 2 or len(set(self.y[~held])) < 2:
            held = np.zeros(len(y), bool)
        self.own, self.check = ~held, held if held.any() else ~held
        self.given: tuple[list, list] = ([], [])  # for each view: (matrix, labels) of each exchange
        self.models: list[Logistic | None] = [None, None]
        self.fit()

    def fit(self) -> None:
        import numpy as np

        for k in (0, 1):
            x = np.concatenate([self.views[k][self.own], *(x for x, _ in self.given[k])])
            y = np.concatenate([self.y[self.own], *(y for _, y in self.given[k])])
            self.models[k] = Logistic().fit(x, y, self.models[k])

    def quotas(self) -> dict[float, int]:
        """Rows per class that a view hands on in a round, in the classes' proportion."""
        prior = self.y[self.own].mean()
        return {label: max(1, round(EXCHANGED * share)) for label, share in ((1.0, prior), (0.0, 1 - prior))}

    def hand_over(self, view: int, label: float, rows) -> None:
        """Rows that `view` is sure of go to the other view."""
        import numpy as np

        if len(rows):
            self.given[1 - view].append((views(rows)[1 - view], np.full(len(rows), label)))

    def model(self) -> Model:
        import numpy as np

        logits = [m.logit(v[self.check]) for m, v in zip(self.models, self.views, strict=True)]
        calibrations = tuple(Logistic(0.1).fit(z[:, None], self.y[self.check]) for z in logits)
        calm = np.column_stack([c.logit(z[:, None]) for c, z in zip(calibrations, logits, strict=True)])
        last = Logistic(0.1).fit(calm, self.y[self.check])
        return Model(*self.models, calibrations, last, tuple(sum(len(y) for _, y in g) for g in self.given))


def _view(names: list[str], id_col: str, text_col: str) -> list[Column]:
    """What both views read, as columns k, t, lang, source, n of a table with these column names."""
    have = lambda c, kind: F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
    length = F.coalesce(have("n_chars", "long"), F.length(text_col).cast("long"))
    return [F.col(id_col).alias("k"), F.col(text_col).alias("t"), have("lang", "string").alias("lang"), have("source", "string").alias("source"), length.alias("n")]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, x binary: a ROW, h: its hash) per row of docs."""
    plain = docs.select(*_view(docs.columns, id_col, text_col))
    batch_rows(docs.sparkSession, WIDE_ROWS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _rows(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "x"])

    made = plain.mapInArrow(lean(run), f"k {plain.schema['k'].dataType.simpleString()}, x binary")
    return written(made.withColumn("h", F.xxhash64("x")), "features")


def _rows(batch):
    """An array of ROW from columns k, t, lang, source, n."""
    import numpy as np

    parts = zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
    return np.array([stored(t.as_py(), *meta) for t, *meta in parts], np.dtype(ROW))


def _array(binary):
    import numpy as np

    return np.frombuffer(b"".join(binary), np.dtype(ROW))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """Co-train on featured() rows: at most `labelled` rows of labels, those of the smallest hashes of their ids, and all other documents.

    What reaches the driver is bounded by `labelled` and, in each round, by EXCHANGED rows per view. None if the labelled
    rows do not show both classes.
    """
    import numpy as np

    spark, kind = features.sparkSession, features.schema["k"].dataType
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(kind).alias("k")).agg(F.max(label_col).cast("double").alias("y"))
    marks = {r.k: float(r.y > 0) for r in known.orderBy(F.xxhash64("k"), "k").limit(labelled).collect()}
    if not marks:
        return None
    # bounded by `labelled` ids
    ids = F.broadcast(spark.createDataFrame([(x,) for x in marks], f"k {kind.simpleString()}"))
    sample = features.join(ids, "k", "left_semi").groupBy("k").agg(F.min(F.struct("h", "x")).alias("x")).orderBy(F.xxhash64("k"), "k").select("k", "x.x").collect()
    y = [marks[r.k] for r in sample]
    if len(set(y)) < 2:
        return None
    training = Training(*views(_array(bytes(r.x) for r in sample)), y)
    others = features.join(ids, "k", "left_anti").select("x", "h")
    done: set[tuple[int, int]] = set()  # (view, hash) of the rows that a view has handed on
    for _ in range(rounds):
        quotas = training.quotas()
        found = written(surest(others, tuple(training.models), quotas, done), "surest")
        asked = [(view, label, n) for view in (0, 1) for label, n in quotas.items()]
        first = lambda view, label, n: found.filter((F.col("view") == view) & (F.col("label") == label)).dropDuplicates(["h"]).orderBy(F.desc("p"), "h").limit(n)
        rows = reduce(DataFrame.union, [first(*x) for x in asked]).collect()
        for view, label, _ in asked:
            mine = sorted((r for r in rows if (r.view, r.label) == (view, label)), key=lambda r: (-r.p, r.h))
            training.hand_over(view, label, _array(bytes(r.x) for r in mine))
            done.update((view, r.h) for r in mine)
        if not rows:
            break
        training.fit()
    return training.model()


def surest(others: DataFrame, models: tuple[Logistic, Logistic], quotas: dict[float, int], done: set[tuple[int, int]]) -> DataFrame:
    """(view, label, p, h, x): of each partition's rows (x, h) those that a view is surest of, equal ones once, as many as may be handed on.

    What goes to the executors is the models' weights and the hashes of what has been handed on.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: dict[tuple[int, float], dict[int, tuple[float, bytes]]] = {(v, c): {} for v in (0, 1) for c in quotas}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            good = [_sigmoid(m.logit(v)) for m, v in zip(models, views(_array(x)), strict=True)]
            for view, label in best:
                p, held = np.round(good[view] if label else 1 - good[view], 9), best[view, label]
                for i in np.flatnonzero(p >= SURE)[np.lexsort((hashes[p >= SURE], -p[p >= SURE]))].tolist():
                    h = int(hashes[i])
                    if (view, h) not in done:
                        held[h] = (float(p[i]), x[i])
                    if len(held) >= 2 * quotas[label]:
                        break
                best[view, label] = dict(sorted(held.items(), key=lambda z: (-z[1][0], z[0]))[: quotas[label]])
        rows = [(v, c, p, h, x) for (v, c), held in best.items() for h, (p, x) in held.items()]
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["view", "label", "p", "h", "x"])

    return others.mapInArrow(lean(run), "view int, label double, p double, h long, x binary")


def score(features: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """featured() rows as (id_col, text_score, meta_score, score, keep): probabilities of good quality, and score >= threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            three = (np.full(n, 0.5),) * 3 if model is None or not n else model.scores(*views(_array(batch.column(1).to_pylist())))
            three = [np.round(s, 6) for s in three]
            keep = three[2] >= threshold if model is not None else np.ones(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, three), pa.array(keep)], names=["k", "text_score", "meta_score", "score", "keep"])

    schema = f"k {features.schema['k'].dataType.simpleString()}, text_score double, meta_score double, score double, keep boolean"
    return features.select("k", "x").mapInArrow(lean(run), schema).withColumnRenamed("k", id_col)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fit(), then score() of every row.

    Null texts count as empty, null languages and sources as a value of their own, a null n_chars is measured. Labels
    that are null or of unknown documents are ignored; of several labels of one document the best counts, of several
    rows of one id any one does. Labels of one class only, or none, give every row 0.5 and keep it. Repeated rows get equal
    scores and are handed over once; other columns are ignored.
    """
    features = featured(docs, id_col, text_col)
    return score(features, fit(features, labels, id_col), threshold, id_col)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows, all columns, whose score reaches the threshold: scored where they stand, without a join. Rows as in classify()."""
    if model is None:
        return docs
    inputs = ["k", "t", "lang", "source", "n"]
    batch_rows(docs.sparkSession, WIDE_ROWS)
    both = docs.select(F.struct(*docs.columns).alias("row"), *_view(docs.columns, id_col, text_col))
    schema = both.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            view = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in inputs], names=inputs)
            yield batch.filter(pa.array(model.scores(*views(_rows(view)))[2].round(6) >= threshold))

    return both.mapInArrow(lean(run), schema).select("row.*")
