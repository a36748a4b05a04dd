import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.functions import similarity
from linkwell.functions import strings as S


def slow_lcs(a, b):
    c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            c[i + 1][j + 1] = c[i][j] + 1 if x == y else max(c[i][j + 1], c[i + 1][j])
    return c[-1][-1]


def test_lcs_and_ratios():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert S.lcs_length(a, b) == slow_lcs(a, b)
        assert 0 <= S.ratio(a, b) <= 1 and S.ratio(a, b) == S.ratio(b, a) and S.ratio(a, a) == 1
        assert 0 <= S.jaro(a, b) <= 1 and S.jaro(a, b) == pytest.approx(S.jaro(b, a))


def test_published_values():
    assert S.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert S.needleman_wunsch("dva", "deeva") == 1.0
    assert S.needleman_wunsch("dva", "deeve") == 0.0
    assert S.qgram_distance("ABCD", "ABCE") == 2
    assert S.common_substring("abcdef", "zabcy") == pytest.approx(0.5)
    assert S.percent(S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear")) == 100
    assert S.percent(S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear")) == 100
    assert S.percent(S.partial_ratio("this is a test", "this is a test!")) == 100
    assert S.monge_elkan(["Niall"], ["Neal"]) == pytest.approx(S.jaro_winkler("Niall", "Neal"))
    assert S.generalised_jaccard(["data", "science"], ["data"]) == 0.5


def test_assignment_is_the_best():
    from itertools import permutations

    g = np.random.default_rng(2).random((3, 4))
    assert S._assignment(g) == pytest.approx(max(sum(g[i, p[i]] for i in range(3)) for p in permutations(range(4), 3)))


def test_native_features(spark):
    q = "мнямс конс соб телятина ветчина 200.0 грамм мнямс".split()
    d = "200.0 грамм конс тел ветчин мнямс мнямс".split()
    rows = spark.createDataFrame([(0, q, d), (1, ["ab", "cd"], ["ab", "xx"]), (2, [], []), (3, [], ["a"])], "i int, q_terms array<string>, d_terms array<string>")
    got = {r.i: r for r in similarity.pair_features(rows).collect()}
    assert got[0].jaccard_tok == pytest.approx(4 / 9) and got[0].overlap_tok == pytest.approx(4 / 6) and got[0].tversky_tok == pytest.approx(8 / 13)
    assert [got[1][f"lvn_{k}"] for k in range(1, 6)] == pytest.approx([0.5, 0.5, 0.25, 0.5, 0.75])
    assert got[1].qgram == S.qgram_distance("ab cd", "ab xx") and got[1].prefix == pytest.approx(1 - 3 / 5) and got[1].postfix == 1
    assert got[2].jaccard_tok == 1 and got[2].q_per_d == 0 and got[2].lvn_1 is None and got[3].overlap_tok == 0
    assert len([c for c in similarity.pair_features(rows).columns if c not in ("i", "q_terms", "d_terms")]) == 44


def test_quartiles_are_linear(spark):
    values = [[0.1, 0.7, 0.2], [0.5], [0.3, 0.9, 0.1, 0.4]]
    rows = spark.createDataFrame([(v,) for v in values], "a array<double>").select(*[c.alias(k) for k, c in similarity.array_stats(F.col("a")).items()]).collect()
    for v, r in zip(values, rows):
        assert list(r) == pytest.approx([np.mean(v), np.std(v), *np.quantile(v, [0.25, 0.5, 0.75])])
