"""Work on whole frames or whole sequences, many a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of whole sequences that one call takes together.
_ROWS = 150_000


def per_frame(df: DataFrame, keys: Sequence[str], columns: Sequence[str], f: Callable[..., np.ndarray], out: str) -> DataFrame:
    """df with an integer column out: f takes the arrays of columns of one frame and returns a number for each row, -1 for null.

    Frames are brought together by one shuffle and come sorted, so a task walks over its frames batch by batch and calls f on slices; a frame that
    two batches share is held until it is whole. Rows with a null key stand alone.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])
    keys, columns = list(keys), list(columns)

    def solve(b: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        arrays = [b[c].to_numpy() for c in columns]
        got = np.concatenate([f(*[a[i:j] for a in arrays]) for i, j in zip(edges, edges[1:], strict=False)])
        return b.assign(**{out: pd.array(np.where(got < 0, 0, got), dtype="Int32")}).assign(**{out: lambda x: x[out].mask(got < 0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            change = np.zeros(len(b), bool)
            change[0] = True
            for k in keys:
                v = b[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            last = starts[-1]
            if last:
                yield solve(b.iloc[:last], np.append(starts[:-1], last))
            rest = b.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield solve(rest, np.array([0, len(rest)]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def per_sequences(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What f makes of the rows (seq, frame, id and more), taken in pieces of many whole sequences: a piece is in the order of seq, frame and id and has about _ROWS rows, or one longer sequence. Rows without a frame are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, n = [], 0
        for b in batches:
            if not len(b):
                continue
            rest.append(b)
            n += len(b)
            # whole are the rows before those of the last sequence, which may go on and may have begun batches ago
            if n >= _ROWS and (rest[0]["seq"].iloc[0] != b["seq"].iloc[-1]):
                every = pd.concat(rest, ignore_index=True)
                cut = int(np.searchsorted(codes := codes_of(every["seq"]), codes[-1]))
                yield f(every.iloc[:cut])
                rest, n = [every.iloc[cut:].reset_index(drop=True)], len(every) - cut
        if n:
            yield f(pd.concat(rest, ignore_index=True))

    return df.filter("frame IS NOT NULL").withColumn("seq", F.col("seq").cast("string")).repartition("seq").sortWithinPartitions("seq", "frame", "id").mapInPandas(run, schema)


def codes_of(seq: pd.Series) -> np.ndarray:
    """Numbers from 0 of the sequences of rows that come sequence by sequence."""
    v = seq.to_numpy(object)
    return np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))
