"""Pair features.  Those that Column expressions can state stay in the JVM; the others come from one Arrow function."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linkwell.functions import kernels as K


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def array_stats(a: Column) -> dict[str, Column]:
    """Mean, population deviation and linear quartiles of an array of doubles; null for an empty one."""
    n = F.size(a).cast("double")
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), n)
    variance = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n)
    ordered = F.array_sort(a)

    def quantile(p: float) -> Column:
        at = (n - 1) * p
        low = F.floor(at).cast("int")
        below, above = F.get(ordered, low), F.coalesce(F.get(ordered, low + 1), F.get(ordered, low))
        return below + (above - below) * (at - low)

    return {"1": mean, "2": F.sqrt(variance), "3": quantile(0.25), "4": quantile(0.5), "5": quantile(0.75)}


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(first, 0) - 1, n))


def _prefix_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - common_prefix(a, b) / longest)


def _grams(s: Column, q: int) -> Column:
    n = F.length(s) - (q - 1)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(q))))


def qgram_distance(a: Column, b: Column, q: int = 2) -> Column:
    x, y = _grams(a, q), _grams(b, q)
    count = lambda arr, g: F.size(F.filter(arr, lambda e: e == g))
    return F.aggregate(F.array_union(x, y), F.lit(0.0), lambda s, g: s + F.abs(count(x, g) - count(y, g)).cast("double"))


def length_features(q: Column, d: Column) -> dict[str, Column]:
    qt, dt = F.array_join(q, " "), F.array_join(d, " ")
    return {"q_len": F.size(q), "d_len": F.size(d), "q_per_d": _share(F.size(q), F.size(d)), "q_clen": F.length(qt), "d_clen": F.length(dt), "c_q_per_d": _share(F.length(qt), F.length(dt))}


def token_set_features(q: Column, d: Column) -> dict[str, Column]:
    x, y = F.array_distinct(q), F.array_distinct(d)
    both, n, m = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
    none = (n == 0) & (m == 0)
    of = lambda share: F.when(none, F.lit(1.0)).otherwise(share)
    return {"jaccard_tok": of(_share(both, n + m - both)), "tversky_tok": of(_share(2 * both, n + m)), "overlap_tok": of(_share(both, F.least(n, m)))}


def edit_matrix(q: Column, d: Column) -> dict[str, Column]:
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: edit_similarity(a, b))))
    return {f"lvn_{k}": v for k, v in array_stats(best).items()}


def text_features(q: Column, d: Column) -> dict[str, Column]:
    a, b = F.array_join(q, " "), F.array_join(d, " ")
    return {"qgram": qgram_distance(a, b), "prefix": _prefix_distance(a, b), "postfix": _prefix_distance(F.reverse(a), F.reverse(b))}


#: Matrix features by the measure of their cells, then features of token lists and of joined texts; those of the second line are not in use by default.
MATRICES = ("jaro", "jaro_win", "lcsseq")
EXTRA_MATRICES, EXTRA_TEXTS = ("bag", "ratcliff"), ("editex", "affine")
TOKENS = {
    "genjack_tok": lambda b: b.generalised_jaccard("jaro", 0.5),
    "me_tok": lambda b: b.monge_elkan("jaro_win"),
    "menw_tok": lambda b: b.monge_elkan("needleman_wunsch"),
    "genjack_jw_tok": lambda b: b.generalised_jaccard("jaro_win", 0.8),
    "seqratio_tok": K.Batch.sequence_ratio,
    "setratio_tok": K.Batch.set_ratio,
}
TEXTS = {
    "lcsseq": lambda b: K.lcs_similarities(*b.text),
    "lcsstr": lambda b: K.PAIRS["lcsstr"](*b.text),
    "fuzz_ratio": lambda b: K.percent(K.ratios(*b.text)),
    "fuzz_partial_ratio": lambda b: K.percent(b.partial_ratio()),
    "fuzz_token_sort_ratio": lambda b: K.percent(b.token_sort_ratio()),
    "fuzz_token_set_ratio": lambda b: K.percent(b.token_set_ratio()),
    "editex": lambda b: K.PAIRS["editex"](*b.text),
    "affine": lambda b: K.PAIRS["affine"](*b.text),
}
ARROW_NAMES = [*(f"{m}_{k}" for m in MATRICES for k in range(1, 6)), *TOKENS, *(t for t in TEXTS if t not in EXTRA_TEXTS)]
EXTRA_NAMES = [*(f"{m}_{k}" for m in EXTRA_MATRICES for k in range(1, 6)), *EXTRA_TEXTS]


def batch_features(names: list[str]):
    """A function of two columns of token arrays to a struct of the named features; only these are computed.

    Null arrays count as empty; matrix features are null where a side has no tokens.
    """
    matrix = {f"{m}_{k}": (m, k - 1) for m in (*MATRICES, *EXTRA_MATRICES) for k in range(1, 6)}
    if unknown := [n for n in names if n not in matrix and n not in TOKENS and n not in TEXTS]:
        raise ValueError(f"no such features: {unknown}")

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def found(q: pd.Series, d: pd.Series) -> pd.DataFrame:
        batch = K.Batch(*([list(x) if x is not None else [] for x in side] for side in (q, d)))
        tables = {m: batch.statistics(m) for m in {matrix[n][0] for n in names if n in matrix}}
        return pd.DataFrame({n: tables[matrix[n][0]][:, matrix[n][1]] if n in matrix else (TOKENS.get(n) or TEXTS[n])(batch) for n in names}, dtype="float64")

    return found


def arrow_features(q: Column | str, d: Column | str) -> Column:
    """All features without a native form that are in use by default, of token arrays."""
    return batch_features(ARROW_NAMES)(q, d)


#: Name to builder of {feature: Column}; users may add their own.
NATIVE = {"length": length_features, "edit": edit_matrix, "token_set": token_set_features, "text": text_features}


def pair_features(pairs: DataFrame, q: str = "q_terms", d: str = "d_terms", native: dict | None = None, arrow: bool = True) -> DataFrame:
    """``pairs`` with the 44 similarity features of two token arrays.  Filter noise before: filters do not pass Python functions."""
    built = reduce(lambda a, b: a | b, (f(F.col(q), F.col(d)) for f in (native or NATIVE).values()), {})
    out = pairs.select("*", *[c.cast("double").alias(n) for n, c in built.items()])
    if arrow:
        out = out.withColumn("_arrow", arrow_features(F.col(q), F.col(d))).select(*out.columns, *[F.col(f"_arrow.{n}").alias(n) for n in ARROW_NAMES])
    return out
