"""Arrow helpers shared by the text operators.

``add_columns`` appends columns computed from a few input columns by a function
on Arrow arrays.  Every other column passes through unchanged, no row is moved
and no row is lost, so nulls, repeated rows and duplicate ids need no care.  A
column of ``df`` whose name equals (in any case) an added one is replaced.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a per-batch function sees at once (one longer text still comes whole).
SLICE_BYTES = 4 << 20
#: Entries of a per-worker memo before it is emptied.
MEMO_ENTRIES = 500_000


def add_columns(df: DataFrame, inputs: list, fields: str | T.StructType,
                make: Callable[[], Callable[..., list]]) -> DataFrame:
    """``df`` plus the columns ``fields``.

    ``inputs`` are columns or expressions; ``make()`` runs once per task and gives
    ``fn(*arrays) -> list of arrays`` for slices of the rows.  ``inputs[0]`` is the
    (non-null) text whose bytes bound a slice.
    """
    fields = fields if isinstance(fields, T.StructType) else T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f"__in{i}" for i in range(len(inputs))]
    src = df.select(*[F.col(f"`{f.name}`") for f in kept],
                    *[c.alias(n) for c, n in zip(inputs, names)])
    n_kept, out_names = len(kept), [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, n_kept):
                cols = part.columns
                new = fn(*cols[n_kept:])
                yield pa.RecordBatch.from_arrays(cols[:n_kept] + list(new), out_names)
        give_back()

    return src.mapInArrow(run, T.StructType(kept + list(fields)))


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``SLICE_BYTES`` of text each."""
    n = batch.num_rows
    if n == 0:
        return
    ends = np.asarray(offsets_of(batch.column(text_at)), dtype=np.int64)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi


_RESIDENT: dict[str, object] = {}


def resident(key: str, build: Callable[[], object]) -> object:
    """The one large model that this worker holds between tasks; loading another drops it."""
    if key not in _RESIDENT:
        forget()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def forget() -> None:
    """Drop the worker's model: an operator without one needs the memory itself."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits, or goes on with other work, keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def offsets_of(a: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a string or binary array."""
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], dtype=kind)[a.offset:a.offset + len(a) + 1]


def bytes_of(a: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text."""
    data, offs = a.buffers()[2], offsets_of(a)
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[offs[i]:offs[i + 1]]) for i in range(len(a))]


def text_col(df: DataFrame, name: str = "text"):
    """The text as a non-null string column."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, part: compressed uint32 counters) of one partition, summed per ``at``."""
    import zlib
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.int64)
            sums[at] = sums[at] + v if at in sums else v
    for at, v in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()),
             pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1)],
                      pa.binary())], ["at", "part"])


VECTOR_CHUNK = 1 << 16


def vector_rows(v: np.ndarray) -> list[tuple[int, bytes]]:
    """A counter vector cut into compressed chunks (at, part)."""
    import zlib
    return [(i // VECTOR_CHUNK, zlib.compress(v[i:i + VECTOR_CHUNK].astype(np.uint32).tobytes(), 1))
            for i in range(0, len(v), VECTOR_CHUNK) if v[i:i + VECTOR_CHUNK].any()]


def summed_vector(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of all chunk rows (at long, part binary) as one vector of fixed ``width``.

    Chunks are summed where ``repartition`` puts them, in streams; the driver gets
    ``width`` counters, whatever the number of rows or tasks.
    """
    import zlib
    n = max(1, -(-width // VECTOR_CHUNK))
    rows = (parts.select("at", "part").repartition(n, "at")
            .mapInArrow(sum_vectors, "at long, part binary").collect())
    out = np.zeros(width, np.int64)
    for r in rows:
        v = np.frombuffer(zlib.decompress(r.part), np.uint32)
        out[r.at * VECTOR_CHUNK:r.at * VECTOR_CHUNK + len(v)] += v
    return out
