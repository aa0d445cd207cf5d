"""Documents dealt into groups of a bounded size, and packed messages between groups and hash shards.

Instead of one row per word or window, each group sends one packed message to each shard of the hash space; shards answer
with one packed message per group. Messages are small because sorted hashes of a narrow range compress well. A group holds the
texts of one hash bucket of ids, rows without an id by their text; there are as many groups as shuffle partitions, so size
spark.sql.shuffle.partitions for 16-64 MB of text each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm import _words as w
from clausework.llm._store import partitions

MESSAGE = "g int, s int, data binary, more binary"
Message = tuple[int, int, bytes, bytes | None]


def grouped(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> tuple[DataFrame, int]:
    """(doc_id, text, more, g) with g a hash bucket of doc_id, partitioned by g; rows of one id share a group."""
    n = partitions(docs.sparkSession)
    one, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.pmod(F.when(one.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(one)), F.lit(n)).cast("int")
    return docs.select(one.alias("doc_id"), text.alias("text"), *(c.alias(x) for x, c in more.items()), key.alias("g")).repartition(n, "g"), n


def shards(h: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Sorted 64-bit hashes cut into n equal ranges of the hash space."""
    return cut(h, (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64))


def cut(values: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Sorted values cut at the edges; (number, slice) of each part that holds any."""
    at = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
    for s in range(len(at) - 1):
        if at[s + 1] > at[s]:
            yield s, slice(int(at[s]), int(at[s + 1]))


def messages(rows: list[Message]) -> pa.Table:
    g, s, data, more = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"g": pa.array(g, pa.int32()), "s": pa.array(s, pa.int32()), "data": pa.array(data, pa.binary()), "more": pa.array(more, pa.binary())})


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers, packed by their steps."""
    return w.pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(w.unpack(data, np.uint64), dtype=np.uint64)
