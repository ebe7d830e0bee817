"""What the operators share: durable checkpoints and walking over Arrow columns in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import durable

#: Bytes of text that one vectorised step works on.
BLOCK_BYTES = 1 << 18


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: later reads survive lost executors and never recompute."""
    return durable(df)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def is_space(data: np.ndarray) -> np.ndarray:
    """Mask of ASCII white space (9 to 13 and 32)."""
    return _SPACE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """Split rows into blocks of about ``size`` bytes: (first byte, last byte, row starts inside the block as positions).

    Rows longer than a block are cut at white space, right before a run of it, so no unit that ends there is divided; the parts after the
    first carry on the same row. Yields (begin, end, row_of_part, part_starts) with one part for each row touched.
    """
    row, n = 0, len(offsets) - 1
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        last = min(max(last, row + 1), n)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= 2 * size:
            yield begin, end, np.arange(row, last), np.asarray(offsets[row:last])
        else:  # one long row
            at = begin
            while at < end:
                stop = min(at + size, end)
                while stop < end:
                    high = min(stop + size, end)
                    near = np.flatnonzero(_SPACE[data[stop:high]] & ~_SPACE[data[stop - 1 : high - 1]])
                    if len(near):
                        stop += int(near[0])
                        break
                    stop = min(stop + size, end)
                yield at, stop, np.array([row]), np.array([at])
                at = stop
        row = last
