"""Text to vectors by hash expansion: no model, every token's lanes come from its digest."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def lane(token: Column, i: Column | int) -> Column:
    """A number in [0, 2 pi) from the md5 of ``token#i``."""
    h = F.md5(F.concat(token, F.lit("#"), (F.lit(i) if isinstance(i, int) else i).cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32) * (2 * math.pi)


def token_vectors(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def encode_lanes(df: DataFrame, text: str, dims: int, by: str) -> DataFrame:
    """``by, re, im``: cosines and sines of each token's lanes, summed over tokens, at unit length.

    Tokens are counted first, so a word that repeats is expanded once a row.
    """
    words = df.select(by, F.explode(token_vectors(F.col(text))).alias("w")).groupBy(by, "w").agg(F.count("*").alias("n"))
    at = words.select(by, "w", "n", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("i"))
    s = at.groupBy(by, "i").agg(F.sum(F.col("n") * F.cos(lane(F.col("w"), F.col("i")))).alias("re"), F.sum(F.col("n") * F.sin(lane(F.col("w"), F.col("i")))).alias("im"))
    g = s.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "re", "im"))).alias("v"))
    z = V.zunit(V.Z(F.transform("v", lambda x: x["re"]), F.transform("v", lambda x: x["im"])))
    return g.select(by, z.re.alias("re"), z.im.alias("im"))


def expand_token(token: str, dims: int) -> np.ndarray:
    """Complex lanes of one token from an extendable digest (SHAKE-256), four bytes a component."""
    raw = np.frombuffer(hashlib.shake_256(token.encode()).digest(4 * dims), "<u4") / 2.0**32 * 2 * np.pi
    return np.exp(1j * raw)


def encode_xof(dims: int):
    """A Pandas UDF: interleaved real and imaginary parts of the summed token lanes, at unit length."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        out = []
        for t in text.fillna(""):
            v = np.zeros(dims, complex)
            for w in t.lower().split():
                if w not in known:
                    known[w] = expand_token(w, dims)
                v += known[w]
            n = np.linalg.norm(v)
            v = v / n if n > 1e-8 else v
            out.append(np.stack((v.real, v.imag), axis=1).ravel().astype(np.float32))
        return pd.Series(out, dtype=object)

    return run


def unit_phase(dims: int):
    """A Pandas UDF: the whole text's lanes on the unit circle, so that unbinding is exact."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        v = [expand_token(t, dims) / np.sqrt(dims) for t in text.fillna("")]
        return pd.Series([np.stack((z.real, z.imag), axis=1).ravel().astype(np.float32) for z in v], dtype=object)

    return run
