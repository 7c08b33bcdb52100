"""Arrow batches in small parts, so that a Python worker holds few rows as objects at a time, whatever a batch's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Values of about so many bytes are Python objects (several times as large) at a time.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch | pa.Array, size: int = PART_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """Slices of about `size` bytes, of a row at least."""
    rows = max(1, len(batch) * size // max(1, batch.nbytes))
    for begin in range(0, len(batch), rows):
        yield batch.slice(begin, rows)


def by_parts(values: pa.Array, made: Callable[[pa.Array], pa.Array], size: int = 4 * PART_BYTES) -> pa.Array:
    """`made` of slices, end to end: what it needs besides its result is some slices large."""
    if values.nbytes <= size:
        return made(values)
    return pa.concat_arrays([made(part) for part in parts(values, size)])


def mapped(values: pa.Array, one: Callable, kind: pa.DataType) -> pa.Array:
    """`one` of each value; null stays."""
    made = [pa.array([None if v is None else one(v) for v in part.to_pylist()], kind) for part in parts(values)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
