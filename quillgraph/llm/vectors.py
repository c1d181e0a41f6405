"""Reading vector columns: which vectors count, and how they travel between stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) as stored doubles in binary, of the usable vectors only, and their dimension.

    Usable: an id, the commonest length, no null or non-finite component, not all zero. A repeated id keeps the
    smallest of its vectors.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    base = base.where("id is not null and v is not null and size(v) > 0")
    common = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(common["d"]) if common else 1
    base = base.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            flat = np.asarray(batch.column("v").flatten(), dtype="<f8").reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "vec"])

    return base.mapInArrow(run, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec")), dim


def matrix(column, dim: int) -> np.ndarray:
    """A binary column (Arrow or pandas) as rows of doubles."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sample(vectors: DataFrame, limit: int, dim: int, seed: int) -> np.ndarray:
    """At most `limit` vectors, chosen by a hash of the id: a bounded sample to fit an index on."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(limit).select("vec").collect()
    return np.frombuffer(b"".join(bytes(r[0]) for r in rows), "<f8").reshape(-1, dim)
