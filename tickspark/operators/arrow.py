"""Runs of equal keys in the Arrow batches of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """(piece, first, last) with one key value each, in order; a run may come in several pieces."""
    held: pa.RecordBatch | None = None
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            if held is not None:
                same = held.column(key)[0].as_py() == piece.column(key)[0].as_py()
                yield held, not begun, not same
                begun = same
            held = piece
    if held is not None:
        yield held, not begun, True


def whole(pieces: Iterable[tuple[pa.RecordBatch, bool, bool]]) -> Iterator[pa.Table]:
    """Whole runs as tables; the caller bounds their size."""
    parts: list[pa.RecordBatch] = []
    for piece, _, last in pieces:
        parts.append(piece)
        if last:
            yield pa.Table.from_batches(parts).combine_chunks()
            parts = []


def numpy_of(data, name: str) -> np.ndarray:
    """A column as numpy; nulls of numbers become NaN."""
    column = data.column(name)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def map_arrow(df, run, schema: str):
    """df.mapInArrow(run, schema) for column names that hold dots: they are set aside on the way in."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)
