"""Arrow helpers shared by the operators: columns computed per batch in bounded slices, and a bounded memo."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one slice of a batch holds at most (a longer single row is a slice of its own).
SLICE_BYTES = 4 << 20


class Memo(dict):
    """A dict that computes what is missing and starts again when it holds ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class TextMemo(Memo):
    """A memo of parts of texts that also starts again at CHARS characters per entry of its limit.

    Parts longer than LONGEST are computed each time, so neither long parts nor many wide ones fill a worker.
    """

    CHARS, LONGEST = 12, 64

    def __init__(self, compute: Callable, limit: int):
        super().__init__(compute, limit)
        self.held = 0

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        if len(self) >= self.limit or self.held + len(key) > self.CHARS * self.limit:
            self.clear()
            self.held = 0
        self.held += len(key)
        value = self[key] = self.compute(key)
        return value


_held: dict = {}


def worker_model(name, build: Callable):
    """The model of that name in this Python worker, built when it is first asked for. A worker holds one model at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay near SLICE_BYTES."""
    column = batch.column(batch.schema.get_field_index(text))
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if size and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(df: DataFrame, text: str, fields: dict[str, T.DataType], compute: Callable[[list], list[list]]) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the list of texts; a column of that name is replaced.

    ``compute`` gets texts (None where null) and returns one list or Arrow array per field.
    """
    kept = df.drop(*[c for c in df.columns if c.lower() in {f.lower() for f in fields} and c != text])
    clash = text if text in fields else None
    schema = T.StructType([f for f in kept.schema.fields if f.name != clash] + [T.StructField(k, v) for k, v in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                old = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != clash]
                made = compute(part.column(part.schema.get_field_index(text)).to_pylist())
                arrays = [c for _, c in old] + [v if isinstance(v, pa.Array) else pa.array(v, arrow_type(fields[k])) for k, v in zip(fields, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in old] + list(fields))

    return kept.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of a Spark type used by the operators."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]
