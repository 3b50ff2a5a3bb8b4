import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foldwise.operators import encode as E
from foldwise.operators import roles as R


def test_numeric_stats_policies(spark):
    rows = [(1, "1.0", 5.0, None), (2, "3", 5.0, None), (3, "x", 5.0, None), (4, None, 5.0, None),
            (5, "NaN", 5.0, None), (6, "Infinity", 5.0, None)]
    df = spark.createDataFrame(rows, "id int, a string, const double, allnull double")
    s = E.fit_numeric_stats(df, ["a", "const", "allnull"], "nan")
    assert s["a"] == (2.0, 1.0)           # NaN / inf / text / null ignored
    assert s["const"] == (5.0, 1.0)       # zero variance -> std 1
    assert s["allnull"] == (0.0, 1.0)     # all-null -> (0, 1)
    z = E.fit_numeric_stats(df, ["a"], "zero")["a"]
    vals = np.array([1.0, 3.0, 0.0, 0.0, float("nan"), float("inf")])
    # N1 fills null/uncastable with 0; NaN and inf are numbers and stay
    assert math.isnan(z[0]) or z[0] == np.mean(vals)
    out = df.select("id", E.numeric_policy("a", s["a"], "impute_mean").alias("n3"),
                    E.numeric_policy("a", s["a"], "std_then_zero").alias("n4")).orderBy("id").collect()
    assert [r.n3 for r in out] == [-1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.n4 for r in out] == [-1.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def _counts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return E.value_counts([df], ["c"])


def test_vocab_alpha_topk_ties_and_other(spark):
    vals = ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + ["d", "e", None]
    v = {r.value: (r.n, r.code) for r in E.vocab_alpha(_counts(spark, vals), 3).collect()}
    # top 3 by count, ties by value: a(3), b(3), c(2); rest -> __OTHER__
    assert set(v) == {"a", "b", "c", "__OTHER__"}
    assert v["__OTHER__"][0] == 3
    assert [k for k, _ in sorted(v.items(), key=lambda kv: kv[1][1])] == ["__OTHER__", "a", "b", "c"]


def test_vocab_alpha_no_other_when_small(spark):
    v = E.vocab_alpha(_counts(spark, ["x", "y", None]), 10).collect()
    assert {r.value for r in v} == {"x", "y", "__MISSING__"}


def test_vocab_freq_reserved_slots(spark):
    vals = ["b"] * 5 + ["a"] * 5 + [None] * 7 + ["c"] * 2 + ["d"]
    v = {r.value: r.code for r in E.vocab_freq(_counts(spark, vals), 4).collect()}
    # k = 2 most frequent are __MISSING__ (7) and a (5, beats b on the tie): only a is kept
    assert v == {"__MISSING__": 0, "__OTHER__": 1, "a": 2}


def test_lookup_unseen_gets_default(spark):
    vocab = E.vocab_freq(_counts(spark, ["a", "a", "b"]), 10)
    df = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, c string")
    got = dict(E.lookup_codes(df, vocab, ["c"], 1, 10).select("id", "c_code").collect())
    assert got == {1: 2, 2: 1, 3: 0}


def test_fold_medians_and_modes(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"fold": rng.integers(0, 3, 300), "x": np.round(rng.normal(size=300), 1),
                        "c": rng.choice(["p", "q", "r"], 300)})
    df = spark.createDataFrame(pdf)
    med = {(r.fold, r.feature): r.median for r in E.fold_medians(df, ["x"], "fold", 3).collect()}
    mode = {(r.fold, r.feature): r.mode for r in E.fold_modes(df, ["c"], "fold", 3).collect()}
    for k in range(3):
        tr = pdf[pdf.fold != k]
        assert abs(med[(k, "x")] - float(np.median(tr.x))) < 1e-12
        vc = tr.c.value_counts()
        assert mode[(k, "c")] == sorted(vc[vc == vc.max()].index)[0]


def test_roles_and_low_card(spark):
    df = spark.createDataFrame([(1, 0, "a", 3, 1.5), (2, 1, None, 4, 2.5)],
                               "id int, diagnosed_diabetes int, s string, k int, f double")
    r = R.infer_roles(df)
    assert (r.id_col, r.target_col, r.features) == ("id", "diagnosed_diabetes", ["s", "k", "f"])
    num, cat = R.split_low_card(df, df, r.features, threshold=16)
    assert num == ["f"] and cat == ["s", "k"]
    try:
        R.require_columns(df.select("id"), {"id", "y"}, exact=True)
        raise AssertionError("expected a column error")
    except ValueError:
        pass


def test_prefix_counts_follow_the_order_of_strings(spark):
    from foldwise.operators.rank import range_prefix_sums
    vals = ["", "a", "ab", "Z", "é", "日本", "\u0000x"] + [f"https://example.org/page/{i}" for i in range(3000)]
    df = spark.createDataFrame([("f", v, 1) for v in vals], "feature string, v string, one long")
    rows = range_prefix_sums(df, ["feature"], "v", ["one"]).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.one_before)] == sorted(vals, key=str.encode)


def test_fold_ordinal_vocab_equals_sorted(spark):
    rng = np.random.default_rng(1)
    words = ["w%03d" % i for i in range(300)]
    pdf = pd.DataFrame({"fold": rng.integers(0, 3, 2000), "c": rng.choice(words, 2000)})
    v = E.fold_ordinal_vocab(spark.createDataFrame(pdf), ["c"], "fold", 3).toPandas()
    for k in range(3):
        exp = sorted(set(pdf[pdf.fold != k].c))
        got = v[v.fold == k].sort_values("code")
        assert got.value.tolist() == exp and got.code.tolist() == list(range(len(exp)))
