"""Vector kernels as Column expressions: normalise, binarise, Hamming, int8 codes.

Sums fold left to right in double precision, so another engine that does so
gets the same numbers. None of these is a UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(of: Column | str) -> Column:
    return F.col(of) if isinstance(of, str) else of


def literal(vector: Sequence[float], kind: str = "double") -> Column:
    """A vector as an array literal."""
    return F.array(*[F.lit(float(x)) for x in vector]).cast(f"array<{kind}>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(v)
    # Beside the components: inside the lambda, the length would be computed again for each of them.
    lengths = F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(_c(v)))
    return F.zip_with(_c(v), lengths, lambda x, n: x / n)


def binarize(v: Column | str) -> Column:
    """Sign bits (1 for x > 0) in 64-bit words, the first dimension highest; zeros fill the last word."""
    v = _c(v)
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(v, w * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(v) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two binary codes (int)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8_encode(v: Column | str, minimum: Column | str, scale: Column | str) -> Column:
    """rint((x - min) / scale * 255) - 128, held to [-128, 127]; halves go to the even number."""
    steps = F.zip_with(F.zip_with(_c(v), _c(minimum), lambda x, m: x.cast("double") - m.cast("double")), _c(scale), lambda x, s: x / s.cast("double") * 255.0)
    return F.transform(steps, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x) - 128.0)).cast("tinyint"))


def int8_decode(code: Column | str, minimum: Column | str, scale: Column | str) -> Column:
    """(code + 128) / 255 * scale + min."""
    part = F.zip_with(_c(code), _c(scale), lambda c, s: (c.cast("double") + 128.0) / 255.0 * s.cast("double"))
    return F.zip_with(part, _c(minimum), lambda x, m: x + m.cast("double"))


def rescore(code: Column | str, weights: Column | str, bias: Column | float) -> Column:
    """Inner product of a query with a decoded code, by weights and bias that are folded beforehand."""
    return dot(code, weights) + bias


def fold_query(query: Sequence[float], minimum: Sequence[float], scale: Sequence[float]) -> tuple[list[float], float]:
    """Weights and bias with: sum(code * weight) + bias = query . decoded."""
    weights = [float(q) * float(s) / 255.0 for q, s in zip(query, scale, strict=True)]
    bias = 0.0
    for q, m, s in zip(query, minimum, scale, strict=True):
        bias += float(q) * (128.0 * float(s) / 255.0 + float(m))
    return weights, bias
