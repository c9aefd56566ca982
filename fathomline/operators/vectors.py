"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def embed(docs, key: str, text: str, dim: int = 384, idf=None):
    """(key, embedding array<float>): hashed term frequencies, signed, of length 1; idf is a bounded dict of term weights (1 when absent).

    Terms hash by FNV-1a over code points; each distinct term is hashed once a task.
    """
    weights = docs.sparkSession.sparkContext.broadcast(idf or {})

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa

        word, seen = re.compile(r"[^\W_]+"), {}

        def place(t: str) -> tuple[int, float]:
            h = 0xCBF29CE484222325
            for c in t:
                h = (h ^ ord(c)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            if len(seen) > 200_000:
                seen.clear()
            seen[t] = at = (h % dim, (-1.0 if h >> 32 & 1 else 1.0) * weights.value.get(t, 1.0))
            return at

        for b in batches:
            out = np.zeros((b.num_rows, dim), np.float64)
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in word.findall((t or "").lower()):
                    k, v = seen.get(w) or place(w)
                    out[i, k] += v
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = (out / np.where(norm == 0, 1, norm)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))], ["k", "embedding"])

    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("k", key)
