"""What both vector operators share: usable vectors, tiles of rows and int8 products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES, FEWEST = 1 << 21, 1024  # components of a block at most; rows below which a block isn't split for more tasks
EXACT_DIMS = 1000  # 1000 * 127 * 127 < 2 ** 24: sums of int8 products are whole in float32


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def prepared(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> usable rows (vec_id long, v, dim, k1, k2); k1 and k2 identify v.

    v is array<float> where embedding is, which loses nothing and halves what travels, else array<double>.
    """
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 becomes 0.0
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumns({"dim": F.size("v"), "k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), F.col("v"))})


def block_count(n: int, dim: int, enough: int) -> int:
    """Blocks of about VALUES components at most; more, up to ``enough``, while they have FEWEST rows."""
    return max(1, -(-n * dim // VALUES), min(-(-n // FEWEST), enough))


def exponents(x: np.ndarray) -> np.ndarray:
    """For each row the power of two that, taken out of it, leaves its largest component in [0.5, 1); 0 for rows of zeros."""
    return np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row without its power of two: squares neither overflow nor vanish, and cosines are the same."""
    return np.ldexp(x, -exponents(x)[:, None])


def matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    """The rows' vectors in double precision."""
    column = table.column(name).combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values of each row (as floats for the product), the row's scale, and the length of what rounding lost."""
    scale = np.abs(x).max(axis=1, initial=0.0) / 127
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None])
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, lost


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    kind = np.float32 if a.shape[1] <= EXACT_DIMS else np.float64
    return a.astype(kind) @ b.astype(kind).T
