"""Arrow batches with a bounded number of bytes, for tasks that make Python objects of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def portions(batches, column: int, most: int = 2_000_000):
    """The rows of Arrow batches in order, as batches of at most ``most`` bytes in one string column, one row at least.

    Spark counts a batch by its rows, so batches of long texts are large.
    """
    for batch in batches:
        held = batch.column(column)
        width = np.int64 if pa.types.is_large_string(held.type) or pa.types.is_large_binary(held.type) else np.int32
        ends = np.frombuffer(held.buffers()[1], width)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, width)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch, held, ends  # else it stays while the next one is read
