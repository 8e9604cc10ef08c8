"""Models in tasks: loaded once in each Python worker, applied to batches of rows of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a model is given at a time.
BATCH = 256
#: Models that this worker has loaded, by name.
_loaded: dict[str, Callable] = {}


class ModelError(RuntimeError):
    """A model can't be loaded, or fails on a batch."""


@dataclass(frozen=True)
class Model:
    """name: what it is known by, one model for each name; load: returns the function that is applied to a list of inputs,
    as strings or tuples, and returns one output for each. It is called in the workers, so what it needs is read there."""

    name: str
    load: Callable[[], Callable[[list], list]]

    def get(self) -> Callable[[list], list]:
        if self.name not in _loaded:
            try:
                _loaded[self.name] = self.load()
            except (OSError, ValueError) as e:
                raise ModelError(f"failed to load model {self.name!r}: {type(e).__name__}: {e}") from e
        return _loaded[self.name]

    def run(self, inputs: list, batch: int = BATCH) -> list:
        """All outputs, by batches. Running out of memory isn't the model's failure and passes as it is."""
        out, apply = [], self.get()
        for i in range(0, len(inputs), batch):
            some = inputs[i : i + batch]
            try:
                made = list(apply(some))
            except MemoryError:
                raise
            except Exception as e:
                raise ModelError(f"model {self.name!r} failed on {len(some)} inputs: {type(e).__name__}: {e}") from e
            if len(made) != len(some):
                raise ModelError(f"model {self.name!r} returned {len(made)} outputs for {len(some)} inputs")
            out += made
        return out


def applied(rows: DataFrame, model: Model, inputs: list[str], output: str, kind: T.DataType, batch: int = BATCH) -> DataFrame:
    """rows with the model's output; a row with a null input gets null and isn't given to the model."""
    places = [rows.columns.index(c) for c in inputs]
    schema = T.StructType([*rows.schema.fields, T.StructField(output, kind)])
    arrow = to_arrow_schema(schema).field(output).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in places]
            given = list(zip(*columns, strict=True)) if len(places) > 1 else columns[0]
            whole = [x is not None and (len(places) == 1 or None not in x) for x in given]
            made = iter(model.run([x for x, w in zip(given, whole, strict=True) if w], batch))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([next(made) if w else None for w in whole], arrow)], names=[*b.schema.names, output])

    return rows.mapInArrow(run, schema)


def normal(vectors: list) -> list[list[float]]:
    """Vectors as lists of finite numbers of one length; else an error."""
    m = np.asarray(vectors, np.float64)
    if m.ndim != 2 or not np.isfinite(m).all():
        raise ValueError("vectors must be finite and of one length")
    return m.tolist()
