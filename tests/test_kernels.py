"""Batch kernels against the functions for one pair, brute force and published values; the features they feed."""

import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.functions import kernels as K
from linkwell.functions import similarity
from linkwell.functions import strings as S


def pairs(n=600, seed=1):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("abcdhwё日") for _ in range(r.choice((0, 1, 3, 7, 8, 9, 15, 20, 33, 64, 65, 90)) if r.random() < 0.5 else r.randint(0, 9)))
    out = [(text(), text()) for _ in range(n)]
    for a, b in out[: n // 3]:  # near ones too
        i = r.randint(0, len(a))
        out.append((a, a[:i] + b[:2] + a[i + 1 :]))
    return [*zip(*out, strict=True)]


ONE = {"jaro": S.jaro, "jaro_win": S.jaro_winkler, "lcs": S.lcs_length, "needleman_wunsch": S.needleman_wunsch, "lcsstr": S.common_substring}


@pytest.mark.parametrize("name", ONE)
def test_kernels_equal_the_functions_for_one_pair(name):
    a, b = pairs()
    assert K.PAIRS[name](list(a), list(b)) == pytest.approx([ONE[name](x, y) for x, y in zip(a, b, strict=True)], abs=1e-12)


def slow_affine(a, b, opened=1.0, longer=0.5):
    """The best alignment by its definition: every way to pair letters in order, gaps on one side at a time."""
    @lru_cache(None)
    def best(i, j, gap):  # gap: which side the last column left empty
        if i == len(a) and j == len(b):
            return 0.0
        ways = []
        if i < len(a) and j < len(b):
            ways.append((a[i] == b[j]) + best(i + 1, j + 1, 0))
        if i < len(a) and gap != 2:
            ways.append(-(longer if gap == 1 else opened) + best(i + 1, j, 1))
        if j < len(b) and gap != 1:
            ways.append(-(longer if gap == 2 else opened) + best(i, j + 1, 2))
        return max(ways, default=-np.inf)

    return best(0, 0, 0)


def slow_editex(a, b):
    cost = lambda x, y: 0 if x == y else 1 if any(x in g and y in g for g in K.SOUNDS) else 2
    step = lambda x, y: 1 if x != y and x in K.SILENT else cost(x, y)

    @lru_cache(None)
    def e(i, j):
        if not i and not j:
            return 0
        ways = []
        if i:
            ways.append(e(i - 1, j) + step(a[i - 2] if i > 1 else " ", a[i - 1]))
        if j:
            ways.append(e(i, j - 1) + step(b[j - 2] if j > 1 else " ", b[j - 1]))
        if i and j:
            ways.append(e(i - 1, j - 1) + cost(a[i - 1], b[j - 1]))
        return min(ways)

    return 1 - e(len(a), len(b)) / (2 * max(len(a), len(b))) if a or b else 1.0


def slow_blocks(a, b):
    """Letters of matching blocks."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
    k, i, j = best[0], -best[1], -best[2]
    return k + slow_blocks(a[:i], b[:j]) + slow_blocks(a[i + k :], b[j + k :]) if k else 0


def test_measures_that_are_not_in_use_by_default():
    a, b = pairs(200, 2)
    a, b = [x[:40] for x in a], [x[:40] for x in b]
    assert K.PAIRS["affine"](a, b) == pytest.approx([slow_affine(x, y) for x, y in zip(a, b, strict=True)])
    assert K.PAIRS["editex"](a, b) == pytest.approx([slow_editex(x, y) for x, y in zip(a, b, strict=True)])
    bag = [1 - max((Counter(x) - Counter(y)).total(), (Counter(y) - Counter(x)).total()) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)]
    assert K.PAIRS["bag"](a, b) == pytest.approx(bag)
    assert K.PAIRS["ratcliff"](a, b) == pytest.approx([2 * slow_blocks(x, y) / (len(x) + len(y)) if x or y else 1 for x, y in zip(a, b, strict=True)])
    long = ["ab" * 50, "hw" * 40], ["ba" * 45, "wh" * 45]
    assert K.PAIRS["editex"](*long) == pytest.approx([slow_editex(x, y) for x, y in zip(*long, strict=True)])


def test_published_values():
    one = lambda name, a, b: K.PAIRS[name]([a], [b])[0]
    assert one("affine", "dva", "deeva") == 1.5
    assert one("editex", "cat", "hat") == pytest.approx(1 - 2 / 6) and one("editex", "Niall", "Neil") == pytest.approx(1 - 2 / 10)
    assert one("bag", "abc", "bcd") == pytest.approx(2 / 3) and one("bag", "aab", "abb") == pytest.approx(2 / 3) and one("bag", "", "") == 1
    assert one("ratcliff", "WIKIMEDIA", "WIKIMANIA") == pytest.approx(14 / 18)
    assert one("jaro", "MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)


def test_features_equal_the_functions_for_one_pair(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(0, 9)))
    rows = [(i, [word() for _ in range(r.randint(0, 5))], [word() for _ in range(r.randint(0, 5))]) for i in range(150)]
    rows += [(900, None, ["a"]), (901, None, None), (902, ["long" * 40, "x"], ["long" * 41, "x", "x"]), (903, ["a", "a", "b"], ["a"])]
    df = spark.createDataFrame(rows, "i int, q array<string>, d array<string>").repartition(3)
    got = {x.i: x.f for x in df.select("i", similarity.arrow_features("q", "d").alias("f")).collect()}
    matrices = {"jaro": S.jaro, "jaro_win": S.jaro_winkler, "lcsseq": S.lcs_similarity}
    tokens = {
        "genjack_tok": S.generalised_jaccard, "me_tok": S.monge_elkan, "menw_tok": lambda a, b: S.monge_elkan(a, b, S.needleman_wunsch),
        "genjack_jw_tok": lambda a, b: S.generalised_jaccard(a, b, S.jaro_winkler, 0.8), "seqratio_tok": S.sequence_ratio, "setratio_tok": S.set_ratio}
    texts = {
        "lcsseq": S.lcs_similarity, "lcsstr": S.common_substring, "fuzz_ratio": lambda a, b: S.percent(S.ratio(a, b)), "fuzz_partial_ratio": lambda a, b: S.percent(S.partial_ratio(a, b)),
        "fuzz_token_sort_ratio": lambda a, b: S.percent(S.token_sort_ratio(a, b)), "fuzz_token_set_ratio": lambda a, b: S.percent(S.token_set_ratio(a, b))}
    for i, q, d in rows:
        a, b = q or [], d or []
        for m, fn in matrices.items():
            expected = S.best_matches(a, b, fn) if a and b else [None] * 5
            assert [got[i][f"{m}_{k}"] for k in range(1, 6)] == (pytest.approx(expected) if a and b else expected), (i, m)
        for n, fn in tokens.items():
            assert got[i][n] == pytest.approx(fn(a, b)), (i, n)
        for n, fn in texts.items():
            assert got[i][n] == pytest.approx(fn(" ".join(a), " ".join(b))), (i, n)
    few = df.select(similarity.batch_features(["bag_1", "editex"])("q", "d").alias("f")).select("f.*")
    assert few.columns == ["bag_1", "editex"] and few.where(F.col("bag_1").isNull()).count() == sum(not (q and d) for _, q, d in rows)
    with pytest.raises(ValueError):
        similarity.batch_features(["nothing"])
