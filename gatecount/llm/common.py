"""What the operators share: written intermediate tables, free column names, Arrow helpers, strings met before."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecount.session import checkpoint_root

#: Texts are taken from an Arrow batch this many at a time, so that few exist as Python strings at once.
ROWS_AT_ONCE = 256


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: lost executors do not lose it, and its lineage ends here."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/gatecount-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted(names: list[str]) -> list:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column, a slice at a time; null counts as empty."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        for text in column.slice(at, ROWS_AT_ONCE).to_pylist():
            yield text or ""


def text_groups(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """The rows of an Arrow column of texts, so many at a time that they hold `size` bytes or one text; null is empty."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(np.asarray(pc.binary_length(column)), dtype=np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, end - at)
        at = end


def binaries(data, ends: np.ndarray) -> pa.Array:
    """An Arrow array of the byte strings that lie in `data` one after the other, from each of `ends` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def inside(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of byte strings, as they lie, and where each begins and the last ends."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def joined(values: pa.Array, places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values at `places`, joined from each of `ends` to the next."""
    data, at = inside(values.take(pa.array(places)))
    return binaries(data, at[ends])


class Met:
    """Strings met so far and some values of bytes for each, as Arrow columns: no Python object per entry.

    Beyond `most` entries or `most_bytes`, only the ones in use stay.
    """

    def __init__(self, most: int, values: int, most_bytes: int = 128_000_000):
        self.most, self.most_bytes = most, most_bytes
        self.columns = [pa.array([], pa.binary())] * (1 + values)

    def places(self, keys: pa.Array, learn: Callable[[pa.Array], list[pa.Array]]) -> np.ndarray:
        """Where in `columns` each of the distinct `keys` lies; `learn` gives the values of those not met yet."""
        at = pc.index_in(keys, value_set=self.columns[0])
        new = np.asarray(pc.is_null(at))
        places = np.zeros(len(keys), np.int32)
        places[~new] = np.asarray(at.drop_null())
        if new.any():
            missing = keys.filter(pa.array(new))
            learnt = [missing, *learn(missing)]
            held = sum(c.nbytes for c in [*self.columns, *learnt])
            if len(self.columns[0]) + len(missing) > self.most or held > self.most_bytes:
                self.columns = [c.take(pa.array(places[~new])) for c in self.columns]
                places[~new] = np.arange(len(keys) - len(missing))
            places[new] = np.arange(len(missing)) + len(self.columns[0])
            self.columns = [pa.concat_arrays(c) for c in zip(self.columns, learnt)]
        return places
