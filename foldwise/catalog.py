"""Registered queries (Spark) and their DuckDB oracles.

Each query reads the driver tables under ``sf_dir`` through the fixture
builders and runs the library's operators over the whole tables. Oracle SQL
reads the same tables (pre-registered DuckDB views) and recomputes the
answer independently; column names and types match the Spark side.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as H
from .operators import counts
from .session import materialise
from .sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# Fixed parameters of the reference's defaults used by the queries.
SEED = 42
VAL_FRAC = 0.1


def _t1_train(spark, sf_dir):
    return fx.labelled_orders(spark, sf_dir).where(F.col("part") == "train")


# ---------------------------------------------------------------- hold-out
def _holdout_counts(spark, sf_dir, method):
    t = _t1_train(spark, sf_dir).select("id", "y")
    t = H.with_holdout_side(t, "id", VAL_FRAC, SEED, method=method)
    return counts.balanced_weights(counts.class_counts(t, "y", by=["side"]), by=["side"])


def _holdout_sql(bucket_sql: str, cut: int) -> str:
    return f"""
WITH t1 AS ({fx.T1_SQL}),
s AS (SELECT y, CASE WHEN {bucket_sql} < {cut} THEN 'valid' ELSE 'train' END AS side
      FROM t1 WHERE part = 'train'),
c AS (SELECT side, y, count(*) AS n FROM s GROUP BY side, y)
SELECT side, y, n, (sum(n) OVER (PARTITION BY side))::DOUBLE / (2.0 * greatest(n, 1)) AS bal_weight FROM c
"""


@register("holdout_split_counts",
          _holdout_sql(H.sql_mul_bucket("id", SEED), H.holdout_cut(VAL_FRAC, H.MUL_BUCKETS)))
def holdout_split_counts(spark, sf_dir):
    """H1 multiplicative id hash -> train/valid side; class counts and balanced weights per side."""
    return _holdout_counts(spark, sf_dir, "mul")


@register("holdout_mix_counts",
          _holdout_sql(H.sql_mix_bucket("id", SEED), H.holdout_cut(VAL_FRAC, H.MIX_BUCKETS)))
def holdout_mix_counts(spark, sf_dir):
    """H2 murmur-mixed id hash -> train/valid side; class counts and balanced weights per side."""
    return _holdout_counts(spark, sf_dir, "mix")


# ---------------------------------------------------------------- helpers
def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _t1(spark, sf_dir):
    return fx.labelled_orders(spark, sf_dir)


T1_CATS = ["price_txt", "priority", "segment"]
MAX_CATS = 2000
N_FOLDS = 5

_SQL_LONG_CATS = " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, coalesce({c}, '__MISSING__') AS value FROM t1" for c in T1_CATS)


# ---------------------------------------------------------------- numeric policies
from .operators import encode as E  # noqa: E402


@register("coerce_numeric_policies", f"""
WITH t AS (SELECT id, part, TRY_CAST(price_txt AS DOUBLE) AS pr, acctbal FROM ({fx.T1_SQL})),
z AS (SELECT avg(coalesce(pr, 0)) AS m1p, stddev_pop(coalesce(pr, 0)) AS s1p,
             avg(CASE WHEN isfinite(pr) THEN pr END) AS m3p, stddev_pop(CASE WHEN isfinite(pr) THEN pr END) AS s3p,
             avg(coalesce(acctbal, 0)) AS m1a, stddev_pop(coalesce(acctbal, 0)) AS s1a,
             avg(CASE WHEN isfinite(acctbal) THEN acctbal END) AS m3a,
             stddev_pop(CASE WHEN isfinite(acctbal) THEN acctbal END) AS s3a
      FROM t WHERE part = 'train')
SELECT id, part,
  round((coalesce(pr, 0) - m1p) / CASE WHEN s1p = 0 THEN 1 ELSE s1p END, 6) AS n1_price_txt,
  round((coalesce(pr, m3p) - m3p) / CASE WHEN s3p < 1e-6 THEN 1 ELSE s3p END, 6) AS n3_price_txt,
  round(coalesce((pr - m3p) / CASE WHEN s3p < 1e-6 THEN 1 ELSE s3p END, 0), 6) AS n4_price_txt,
  round((coalesce(acctbal, 0) - m1a) / CASE WHEN s1a = 0 THEN 1 ELSE s1a END, 6) AS n1_acctbal,
  round((coalesce(acctbal, m3a) - m3a) / CASE WHEN s3a < 1e-6 THEN 1 ELSE s3a END, 6) AS n3_acctbal,
  round(coalesce((acctbal - m3a) / CASE WHEN s3a < 1e-6 THEN 1 ELSE s3a END, 0), 6) AS n4_acctbal
FROM t, z
""")
def coerce_numeric_policies(spark, sf_dir):
    """PRJ5/PRJ16 coercion and numeric policies N1 (null->0, scale), N3 (mean impute, scale)
    and N4 (scale, then non-finite->0); statistics (AG3/AG4) from train rows only."""
    t = _t1(spark, sf_dir)
    tr = t.where(F.col("part") == "train")
    cols = ["price_txt", "acctbal"]
    s1 = E.fit_numeric_stats(tr, cols, "zero")
    s3 = E.fit_numeric_stats(tr, cols, "nan")
    s4 = E.fit_numeric_stats(tr, cols, "nan_keep_inf")
    out = [F.col("id"), F.col("part")]
    for c in cols:
        out += [_r(E.numeric_policy(c, s1[c], "zero")).alias(f"n1_{c}"),
                _r(E.numeric_policy(c, s3[c], "impute_mean")).alias(f"n3_{c}"),
                _r(E.numeric_policy(c, s4[c], "std_then_zero")).alias(f"n4_{c}")]
    return t.select(*out)


# ---------------------------------------------------------------- vocabularies
def _t1_frames(spark, sf_dir):
    """Train, test and extra rows: one table here, so one frame and one scan."""
    return [_t1(spark, sf_dir).where(F.col("part").isin("train", "test", "extra"))]


_SQL_VC = f"""
t1 AS ({fx.T1_SQL}),
long AS ({_SQL_LONG_CATS}),
vc AS (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2),
nd AS (SELECT feature, count(*) AS nd FROM vc GROUP BY 1),
rk AS (SELECT vc.*, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS r FROM vc)"""

_SQL_ALPHA = f"""{_SQL_VC},
kept AS (SELECT feature, value, n FROM rk WHERE r <= {MAX_CATS}),
oth AS (SELECT rk.feature, '__OTHER__' AS value, sum(n) AS n FROM rk JOIN nd USING (feature)
        WHERE nd > {MAX_CATS} AND r > {MAX_CATS} GROUP BY 1),
v AS (SELECT feature, value, sum(n)::BIGINT AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM oth) GROUP BY 1, 2),
va AS (SELECT feature, value, n, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INTEGER AS code FROM v)"""


@register("vocab_alpha", f"WITH {_SQL_ALPHA} SELECT * FROM va")
def vocab_alpha(spark, sf_dir):
    """C2 vocabulary: value counts over train+test+extra (AG5, ST3), top-K by count with
    ties by value (TK1), rest -> __OTHER__, codes by sorted value (WN2a)."""
    counts = E.value_counts(_t1_frames(spark, sf_dir), T1_CATS)
    return E.vocab_alpha(counts, MAX_CATS)


@register("vocab_freq", f"""WITH {_SQL_VC},
top AS (SELECT * FROM rk WHERE r <= {MAX_CATS - 2}),
rl AS (SELECT feature, value, n::BIGINT AS n,
              (row_number() OVER (PARTITION BY feature ORDER BY r) + 1)::INTEGER AS code
       FROM top WHERE value NOT IN ('__MISSING__', '__OTHER__')),
sp AS (SELECT f.feature, s.value, vc.n::BIGINT AS n, s.code::INTEGER AS code
       FROM (SELECT DISTINCT feature FROM vc) f CROSS JOIN (VALUES ('__MISSING__', 0), ('__OTHER__', 1)) s(value, code)
       LEFT JOIN vc ON vc.feature = f.feature AND vc.value = s.value)
SELECT * FROM rl UNION ALL SELECT * FROM sp""")
def vocab_freq(spark, sf_dir):
    """C4 vocabulary with reserved slots: 0 __MISSING__, 1 __OTHER__, then the
    max_categories-2 most frequent values by count (WN2b)."""
    counts = E.value_counts(_t1_frames(spark, sf_dir), T1_CATS)
    return E.vocab_freq(counts, MAX_CATS)


@register("encode_topk_other", f"""WITH {_SQL_ALPHA},
oc AS (SELECT feature, code FROM va WHERE value = '__OTHER__'),
coded AS (SELECT l.id, l.feature, coalesce(va.code, oc.code) AS code
          FROM long l LEFT JOIN va ON va.feature = l.feature AND va.value = l.value
          LEFT JOIN oc ON oc.feature = l.feature)
SELECT id,
  max(CASE WHEN feature = 'price_txt' THEN code END)::INTEGER AS price_txt_code,
  max(CASE WHEN feature = 'priority' THEN code END)::INTEGER AS priority_code,
  max(CASE WHEN feature = 'segment' THEN code END)::INTEGER AS segment_code
FROM coded GROUP BY id""")
def encode_topk_other(spark, sf_dir):
    """C2 transform (JN6): every T1 row's categories -> codes; values outside the top-K
    take the __OTHER__ code. One broadcast lookup per column, no shuffle of the rows."""
    t = _t1(spark, sf_dir)
    counts = E.value_counts([t], T1_CATS)
    vocab = E.vocab_alpha(counts, MAX_CATS)
    oc = E.other_code(vocab)
    default = {c: oc.get(c, -1) for c in T1_CATS}
    coded = E.lookup_codes(t.select("id", *T1_CATS), vocab, T1_CATS, default, MAX_CATS)
    return coded.select("id", *[f"{c}_code" for c in T1_CATS])


# ---------------------------------------------------------------- types
from .operators import roles as R  # noqa: E402


@register("low_card_types", f"""
WITH tr AS (SELECT * FROM ({fx.T1_SQL}) WHERE part = 'train'),
nn AS (SELECT (count(DISTINCT nation) + max(CASE WHEN nation IS NULL THEN 1 ELSE 0 END))::BIGINT AS n FROM tr)
SELECT 'price_txt' AS feature, 'string' AS kind, NULL::BIGINT AS n_unique, 'cat' AS role_16, 'cat' AS role_32
UNION ALL SELECT 'acctbal', 'float', NULL::BIGINT, 'num', 'num'
UNION ALL SELECT 'nation', 'int', n, CASE WHEN n <= 16 THEN 'cat' ELSE 'num' END,
                 CASE WHEN n <= 32 THEN 'cat' ELSE 'num' END FROM nn
UNION ALL SELECT 'priority', 'string', NULL::BIGINT, 'cat', 'cat'
UNION ALL SELECT 'segment', 'string', NULL::BIGINT, 'cat', 'cat'""")
def low_card_types(spark, sf_dir):
    """PRJ3c/AG6: string in train or test -> categorical; integer columns with at most
    `threshold` distinct values (null counted) -> categorical, at thresholds 16 and 32."""
    t = _t1(spark, sf_dir)
    tr, te = t.where(F.col("part") == "train"), t.where(F.col("part") == "test")
    prof = R.low_card_profile(tr, te, fx.T1_FEATURES)
    return prof.select("feature", "kind", "n_unique", R.role_at(16).alias("role_16"), R.role_at(32).alias("role_32"))


# ---------------------------------------------------------------- per-fold imputation
@register("median_mode_impute_by_fold", f"""
WITH t AS (SELECT (id % 5)::INTEGER AS fold, TRY_CAST(price_txt AS DOUBLE) AS price, acctbal, priority, segment
           FROM ({fx.T1_SQL}) WHERE part = 'train'),
k AS (SELECT range::INTEGER AS k FROM range(5)),
med AS (SELECT k, 'price_txt' AS feature, quantile_cont(price, 0.5) AS fill_num FROM t JOIN k ON t.fold <> k.k
        WHERE price IS NOT NULL AND isfinite(price) GROUP BY k
        UNION ALL
        SELECT k, 'acctbal', quantile_cont(acctbal, 0.5) FROM t JOIN k ON t.fold <> k.k
        WHERE acctbal IS NOT NULL AND isfinite(acctbal) GROUP BY k),
lc AS (SELECT fold, 'priority' AS feature, priority AS v FROM t UNION ALL SELECT fold, 'segment', segment FROM t),
cnt AS (SELECT k, feature, v, count(*) AS c FROM lc JOIN k ON lc.fold <> k.k WHERE v IS NOT NULL GROUP BY 1, 2, 3),
md AS (SELECT k, feature, v FROM (SELECT *, row_number() OVER (PARTITION BY k, feature ORDER BY c DESC, v) AS r FROM cnt) WHERE r = 1)
SELECT k AS fold, feature, round(fill_num, 6) AS fill_num, NULL::VARCHAR AS fill_str FROM med
UNION ALL SELECT k, feature, NULL::DOUBLE, v FROM md""")
def median_mode_impute_by_fold(spark, sf_dir):
    """AG11/N6 exact median and AG12 mode (ties -> smallest) of each fold's training
    rows, for all folds in one pass over distinct values (no per-fold rescans)."""
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    med = E.fold_medians(t, ["price_txt", "acctbal"], "fold", N_FOLDS)
    mode = E.fold_modes(t, ["priority", "segment"], "fold", N_FOLDS)
    return (med.select("fold", "feature", _r("median").alias("fill_num"), F.lit(None).cast("string").alias("fill_str"))
            .unionByName(mode.select("fold", "feature", F.lit(None).cast("double").alias("fill_num"),
                                     F.col("mode").alias("fill_str"))))


# ---------------------------------------------------------------- folds and samples
from .operators import rank as RK  # noqa: E402

_SQL_FOLDS = f"""
t AS (SELECT id, y FROM ({fx.T1_SQL}) WHERE part = 'train'),
f AS (SELECT id, y, ((row_number() OVER (PARTITION BY y ORDER BY {H.sql_mix64('id', SEED)}, id) - 1) % {N_FOLDS})::INTEGER AS fold FROM t)"""


def _folds(spark, sf_dir):
    t = _t1_train(spark, sf_dir).select("id", "y")
    return RK.stratified_folds(t, "id", "y", N_FOLDS, SEED)


@register("stratified_folds", f"WITH {_SQL_FOLDS} SELECT * FROM f")
def stratified_folds(spark, sf_dir):
    """WN1: per class, rows in hash order dealt round-robin into 5 folds (two-level rank)."""
    return _folds(spark, sf_dir)


@register("fold_balance", f"WITH {_SQL_FOLDS} SELECT fold, y, count(*) AS n FROM f GROUP BY fold, y")
def fold_balance(spark, sf_dir):
    """WN1 + PRJ9 check: rows per (fold, class); balanced to within one row."""
    return _folds(spark, sf_dir).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@register("sample_n", f"""SELECT id, y, part FROM ({fx.T1_SQL}) ORDER BY {H.sql_mix64('id', SEED)}, id LIMIT 1000""")
def sample_n(spark, sf_dir):
    """TK4: exactly min(1000, rows) rows, reproducible by id hash order."""
    t = _t1(spark, sf_dir).select("id", "y", "part")
    return RK.sample_n(t, 1000, "id", SEED)


# ---------------------------------------------------------------- extra rows
from .operators import joins as J  # noqa: E402


@register("extra_union_weights", f"""
WITH t3 AS ({fx.T3_SQL}),
u AS (SELECT fold, coalesce(weight, 1.0) AS w, 0 AS is_extra FROM t3 WHERE part = 'train'
      UNION ALL SELECT -1, 0.3, 1 FROM t3 WHERE part = 'extra'),
k AS (SELECT range::INTEGER AS k FROM range(5))
SELECT k AS fold, count(*) AS n_rows, sum(is_extra)::BIGINT AS n_extra, round(sum(w), 6) AS sum_weight
FROM u JOIN k ON u.fold <> k.k GROUP BY k""")
def extra_union_weights(spark, sf_dir):
    """ST2: extra labelled rows join every fold's training side (never validation) at
    weight 0.3; base rows keep their weight (1.0 when absent). Per-fold totals come
    from one aggregation by fold (total minus own fold), not K filtered copies."""
    t3 = fx.closed_form_scores(_t1(spark, sf_dir))
    tr = t3.where(F.col("part") == "train").select("fold", F.coalesce("weight", F.lit(1.0)).alias("w"))
    ex = t3.where(F.col("part") == "extra").select(F.lit(1).alias("_"))
    u = J.union_extra(tr, ex.drop("_"), fold="fold", weight="w", extra_weight=0.3)
    return J.fold_train_totals(u, "fold", "w", N_FOLDS).select(
        "fold", "n_rows", "n_extra", _r("sum_weight").alias("sum_weight"))


# ---------------------------------------------------------------- metrics
from .operators import metrics as M  # noqa: E402

_SQL_LONG_MODELS = " UNION ALL ".join(
    f"SELECT id, y, fold, weight, '{m}' AS model, {m} AS p FROM t3 WHERE part = 'train'" for m in fx.MODELS)


def _long_scores(spark, sf_dir):
    t3 = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    return t3.unpivot(["id", "y", "fold", "weight"], fx.MODELS, "model", "p")


def _sql_auc(src: str, g: str) -> str:
    return f"""
s AS (SELECT {g}, p, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)::DOUBLE AS pos,
             sum(CASE WHEN y > 0 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM {src} GROUP BY {g}, p),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {g} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s),
a AS (SELECT {g}, sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY {g})"""


@register("logloss_weighted", f"""
WITH t3 AS ({fx.T3_SQL}), l AS ({_SQL_LONG_MODELS}),
x AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS q, coalesce(weight, 1.0) AS w FROM l)
SELECT model, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS logloss,
       round(sum(w * -(y * ln(q) + (1 - y) * ln(1 - q))) / sum(w), 6) AS logloss_w, count(*) AS n
FROM x GROUP BY model""")
def logloss_weighted(spark, sf_dir):
    """AG13: per model, mean log-loss and weight-weighted log-loss (absent weight -> 1.0)."""
    x = _long_scores(spark, sf_dir).withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return x.groupBy("model").agg(_r(M.logloss_expr("y", "p")).alias("logloss"),
                                  _r(M.logloss_expr("y", "p", "w")).alias("logloss_w"), F.count(F.lit(1)).alias("n"))


@register("auc_exact", f"""WITH t3 AS ({fx.T3_SQL}), l AS ({_SQL_LONG_MODELS}), {_sql_auc('l', 'model')}
SELECT model, round(auc, 6) AS auc FROM a""")
def auc_exact(spark, sf_dir):
    """AG14/WN4: exact ROC AUC per model with ties counted half (p2 has heavy ties)."""
    a = M.auc(_long_scores(spark, sf_dir), "y", "p", ["model"])
    return a.select("model", _r("auc").alias("auc"))


@register("cv_metrics", f"""
WITH t3 AS ({fx.T3_SQL}), l AS (SELECT id, y, fold, p1 AS p FROM t3 WHERE part = 'train'
  UNION ALL SELECT id, y, -1, p1 FROM t3 WHERE part = 'train'),
{_sql_auc('l', 'fold')},
ll AS (SELECT fold, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS logloss,
              count(*) AS n FROM l GROUP BY fold)
SELECT ll.fold::INTEGER AS fold, round(logloss, 6) AS logloss, round(auc, 6) AS auc, n FROM ll JOIN a USING (fold)""")
def cv_metrics(spark, sf_dir):
    """AG15: log-loss and AUC of the p1 OOF scores per fold and overall (fold -1)."""
    t3 = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    m = M.cv_metrics(t3, "y", "p1", "fold")
    return m.select("fold", _r("logloss").alias("logloss"), _r("auc").alias("auc"), "n")


_SEEDS = (42, 43, 44)
_SQL_SEED_ROWS = f"""t3 AS ({fx.T3_SQL}),
sc AS ({" UNION ALL ".join(f"SELECT id, y, {s} AS seed, ((id // {i + 1}) % 5)::INTEGER AS fold, {m} AS p FROM t3 WHERE part = 'train'"
                           for i, (s, m) in enumerate(zip(_SEEDS, fx.MODELS, strict=True)))}),
l AS (SELECT seed, fold, y, p FROM sc UNION ALL SELECT seed, -1, y, p FROM sc
      UNION ALL SELECT -1, -1, max(y), avg(p) FROM sc GROUP BY id)"""


@register("cv_metrics_seeds", f"""WITH {_SQL_SEED_ROWS},
{_sql_auc('l', 'seed, fold')},
ll AS (SELECT seed, fold, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS logloss,
              count(*) AS n FROM l GROUP BY seed, fold)
SELECT seed::INTEGER AS seed, fold::INTEGER AS fold, round(logloss, 6) AS logloss, round(auc, 6) AS auc, n
FROM ll JOIN a USING (seed, fold)""")
def cv_metrics_seeds(spark, sf_dir):
    """AG15 + ML16: three seeds' OOF scores with folds of their own: a line per (seed, fold), per seed, and
    for the scores averaged over the seeds (seed -1)."""
    t3 = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), F.pmod(F.floor(F.col("id") / (i + 1)), F.lit(5)).cast("int").alias("fold"),
                              F.col(m).alias("p")) for i, (s, m) in enumerate(zip(_SEEDS, fx.MODELS, strict=True))])
    scored = t3.select("id", "y", F.inline(runs))
    m = M.cv_metrics_seeds(scored, "y", "p", "fold", "seed", "id")
    return m.select("seed", "fold", _r("logloss").alias("logloss"), _r("auc").alias("auc"), "n")


# ---------------------------------------------------------------- distribution features
from .operators import dist as D  # noqa: E402
from .operators import fold_dist as FD  # noqa: E402

NUM = ["price_txt", "acctbal"]
CAT = ["priority", "segment"]
NB = D.NUM_BINS
_PROBS_SQL = "[" + ", ".join(repr(q) for q in D.quantile_probs(NB)) + "]"


def _sql_t1num(where: str, extra: str = "") -> str:
    return f"""
t AS (SELECT id, y, part, {extra} TRY_CAST(price_txt AS DOUBLE) AS price, acctbal, priority, segment
      FROM ({fx.T3_SQL}) WHERE {where}),
m AS (SELECT avg(CASE WHEN isfinite(price) THEN price END) AS mp,
             avg(CASE WHEN isfinite(acctbal) THEN acctbal END) AS ma FROM t WHERE part = 'train'),
nl AS (SELECT id, y, part, {extra} 'price_txt' AS feature, coalesce(CASE WHEN isfinite(price) THEN price END, mp) AS x FROM t, m
       UNION ALL SELECT id, y, part, {extra} 'acctbal', coalesce(CASE WHEN isfinite(acctbal) THEN acctbal END, ma) FROM t, m)"""


def _num_long(spark, sf_dir, parts, keep):
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part").isin(*parts))
    tr = t.where(F.col("part") == "train")
    mean = {c: v[0] for c, v in E.fit_numeric_stats(tr, NUM, "nan").items()}
    return t, D.numeric_long(t, keep, NUM, mean)


@register("quantile_edges", f"""WITH {_sql_t1num("part = 'train'")},
s AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i FROM nl),
n AS (SELECT feature, count(*) AS n FROM nl GROUP BY feature),
q AS (SELECT feature, k, n, (n - 1)::DOUBLE * ((k + 1)::DOUBLE / {NB}::DOUBLE) AS h
      FROM n, (SELECT range AS k FROM range({NB - 1}))),
w AS (SELECT q.feature, q.k, q.h - floor(q.h) AS t, a.x AS a, b.x AS b FROM q
      JOIN s a ON a.feature = q.feature AND a.i = floor(q.h)::BIGINT
      JOIN s b ON b.feature = q.feature AND b.i = least(floor(q.h)::BIGINT + 1, q.n - 1))
SELECT feature, k::INTEGER AS k, CASE WHEN t < 0.5 THEN a + (b - a) * t ELSE b - (b - a) * (1 - t) END AS edge FROM w""")
def quantile_edges(spark, sf_dir):
    """AG8: exact linear-interpolated 127 inner quantiles (numpy's interpolation) of each
    numeric column over all training rows (non-finite -> train mean first), made
    monotone by a running max (WN5). Values are exact doubles, not rounded."""
    _, nl = _num_long(spark, sf_dir, ["train"], ["id"])
    e = D.fit_edges(nl, NB, n_features=len(NUM))
    return e.select("feature", F.posexplode("edges").alias("k", "edge")).select(
        "feature", F.col("k").cast("int").alias("k"), "edge")


@register("digitize", f"""WITH {_sql_t1num("true")},
ed AS (SELECT feature, quantile_cont(x, {_PROBS_SQL}) AS e FROM nl WHERE part = 'train' GROUP BY feature)
SELECT id, nl.feature, len(list_filter(e, lambda v: v <= x))::INTEGER AS cell FROM nl JOIN ed ON nl.feature = ed.feature""")
def digitize(spark, sf_dir):
    """JN7: every row's bin under the training edges: number of edges <= x (0..127)."""
    _, nl = _num_long(spark, sf_dir, ["train", "test", "extra"], ["id", "part"])
    e = D.fit_edges(nl.where(F.col("part") == "train"), NB, n_features=len(NUM))
    return D.digitize(nl, e, NB, max_rows=len(NUM)).select("id", "feature", F.col("cell").cast("int"))




_SQL_LLR = f"""WITH {_sql_t1num("part IN ('train', 'test')")},
ed AS (SELECT feature, quantile_cont(x, {_PROBS_SQL}) AS e FROM nl WHERE part = 'train' GROUP BY feature),
cells AS (SELECT id, y, part, nl.feature, CAST(len(list_filter(e, lambda v: v <= x)) AS VARCHAR) AS cell
          FROM nl JOIN ed ON nl.feature = ed.feature
          UNION ALL SELECT id, y, part, 'priority', coalesce(priority, '__MISSING__') FROM t
          UNION ALL SELECT id, y, part, 'segment', coalesce(segment, '__MISSING__') FROM t),
nc AS (SELECT 'price_txt' AS feature, {float(NB)} AS cells UNION ALL SELECT 'acctbal', {float(NB)}
       UNION ALL SELECT feature, count(DISTINCT cell) + 1.0 FROM cells WHERE feature IN ('priority', 'segment') GROUP BY feature),
cc AS (SELECT feature, cell, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::DOUBLE AS c0,
              sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::DOUBLE AS c1 FROM cells WHERE part = 'train' GROUP BY 1, 2),
tot AS (SELECT feature, sum(c0) AS n0, sum(c1) AS n1 FROM cc GROUP BY 1),
l AS (SELECT c.id, c.feature, ln((coalesce(cc.c1, 0) + 0.5) / (n1 + 0.5 * nc.cells))
                              - ln((coalesce(cc.c0, 0) + 0.5) / (n0 + 0.5 * nc.cells)) AS llr
      FROM cells c LEFT JOIN cc ON c.feature = cc.feature AND c.cell = cc.cell
      JOIN tot ON c.feature = tot.feature JOIN nc ON c.feature = nc.feature)"""


def _llr_long(spark, sf_dir):
    t, nl = _num_long(spark, sf_dir, ["train", "test"], ["id", "y", "part"])
    e = D.fit_edges(nl.where(F.col("part") == "train"), NB, n_features=len(NUM))
    ncell = D.digitize(nl, e, NB, max_rows=len(NUM)).select("id", "y", "part", "feature", F.col("cell").cast("string"))
    cells = ncell.unionByName(D.cat_long(t, ["id", "y", "part"], CAT))
    counts = D.cell_counts(cells.where(F.col("part") == "train"), "y")
    ncells = D.numeric_cells(spark, NUM, NB).unionByName(
        D.categorical_cells([t.where(F.col("part") == "train"), t.where(F.col("part") == "test")], CAT))
    return D.apply_cell_ratio(cells, counts, D.class_totals(counts), ncells, D.ALPHA,
                              max_features=len(NUM) + len(CAT))


@register("llr_features", f"{_SQL_LLR} SELECT id, feature, round(llr, 6) AS llr FROM l")
def llr_features(spark, sf_dir):
    """AG9 + SC12 + JN8: per-feature smoothed log-likelihood ratio of each row's cell
    (binned numeric, raw categorical), counts from training rows, alpha 0.5."""
    return _llr_long(spark, sf_dir).select("id", "feature", _r("llr").alias("llr"))


@register("nb_logit", f"{_SQL_LLR} SELECT id, round(sum(llr), 6) AS nb_logit FROM l GROUP BY id")
def nb_logit(spark, sf_dir):
    """SC13: naive-Bayes logit = sum of the per-feature LLRs of a row, looked up on the wide row."""
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part").isin("train", "test"))
    model = FD.fit_fold_dist(t, NUM, CAT, n_folds=0, shift=False)
    return model.features(t, keep=["id"]).select("id", _r("nb_logit").alias("nb_logit"))


@register("llr_cross_fit", f"""WITH {_sql_t1num("part IN ('train', 'test')", "fold,")},
k AS (SELECT range::INTEGER AS k FROM range({N_FOLDS})),
ed AS (SELECT k.k, feature, quantile_cont(x, {_PROBS_SQL}) AS e FROM nl JOIN k ON nl.fold <> k.k
       WHERE part = 'train' GROUP BY k.k, feature
       UNION ALL SELECT -1, feature, quantile_cont(x, {_PROBS_SQL}) FROM nl WHERE part = 'train' GROUP BY feature),
kk AS (SELECT k FROM k UNION ALL SELECT -1),
cells AS (SELECT id, y, part, fold, ed.k, nl.feature, CAST(len(list_filter(e, lambda v: v <= x)) AS VARCHAR) AS cell
          FROM nl JOIN ed ON nl.feature = ed.feature
          UNION ALL SELECT id, y, part, fold, kk.k, 'priority', coalesce(priority, '__MISSING__') FROM t, kk
          UNION ALL SELECT id, y, part, fold, kk.k, 'segment', coalesce(segment, '__MISSING__') FROM t, kk),
nc AS (SELECT 'price_txt' AS feature, {float(NB)} AS cells UNION ALL SELECT 'acctbal', {float(NB)}
       UNION ALL SELECT feature, count(DISTINCT cell) + 1.0 FROM cells WHERE feature IN ('priority', 'segment') GROUP BY feature),
cc AS (SELECT k, feature, cell, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::DOUBLE AS c0,
              sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::DOUBLE AS c1
       FROM cells WHERE k >= 0 AND part = 'train' AND fold <> k GROUP BY 1, 2, 3),
tot AS (SELECT k, feature, sum(c0) AS n0, sum(c1) AS n1 FROM cc GROUP BY 1, 2),
sc AS (SELECT feature, cell, sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END)::DOUBLE AS c0,
              sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END)::DOUBLE AS c1 FROM cells WHERE k = -1 GROUP BY 1, 2),
st AS (SELECT feature, sum(c0) AS n0, sum(c1) AS n1 FROM sc GROUP BY 1),
sh AS (SELECT id, c.feature, ln((sc.c1 + 0.5) / (n1 + 0.5 * nc.cells)) - ln((sc.c0 + 0.5) / (n0 + 0.5 * nc.cells)) AS s
       FROM cells c JOIN sc ON c.feature = sc.feature AND c.cell = sc.cell JOIN st ON st.feature = c.feature
       JOIN nc ON c.feature = nc.feature WHERE c.k = -1),
l AS (SELECT r.id, r.k, CASE WHEN part = 'test' THEN 'test' WHEN fold = r.k THEN 'held' ELSE 'in_sample' END AS kind, r.feature,
             ln((coalesce(cc.c1, 0) + 0.5) / (n1 + 0.5 * nc.cells))
             - ln((coalesce(cc.c0, 0) + 0.5) / (n0 + 0.5 * nc.cells)) AS llr
      FROM cells r LEFT JOIN cc ON r.k = cc.k AND r.feature = cc.feature AND r.cell = cc.cell
      JOIN tot ON r.k = tot.k AND r.feature = tot.feature JOIN nc ON r.feature = nc.feature WHERE r.k >= 0)
SELECT l.id, k AS fold, kind,
  {", ".join(f"round(max(CASE WHEN l.feature = '{c}' THEN llr END), 6) AS llr_{c}" for c in ("price_txt", "acctbal", "priority", "segment"))},
  round(sum(llr), 6) AS nb_logit,
  {", ".join(f"round(max(CASE WHEN sh.feature = '{c}' THEN s END), 6) AS shift_{c}" for c in ("price_txt", "acctbal", "priority", "segment"))}
FROM l JOIN sh ON l.id = sh.id AND l.feature = sh.feature GROUP BY l.id, k, kind""")
def llr_cross_fit(spark, sf_dir):
    """ML15: cross-fitted distribution features. Under each fold's fit (edges and cell counts of
    the other folds' training rows, as total less own) every row gets its ratios by column, their sum and
    the train-versus-test shift; ``kind`` tells in-sample, held and test rows apart."""
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part").isin("train", "test"))
    model = FD.fit_fold_dist(t, NUM, CAT, n_folds=N_FOLDS)
    out = None
    for k in range(N_FOLDS):
        x = model.fold_frame(t, "part", "fold", k, shift=True, keep=["id"]).withColumn("fold", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out.select("id", "fold", "kind", *[_r(c).alias(c) for c in out.columns if c.startswith(("llr_", "shift_", "nb_"))])


@register("shift_features", f"""
WITH t AS ({fx.T2_SQL}),
nl AS (SELECT doc_id, part, 'n_chars' AS feature, n_chars::DOUBLE AS x FROM t),
ed AS (SELECT feature, quantile_cont(x, {_PROBS_SQL}) AS e FROM nl WHERE part = 'train' GROUP BY feature),
cells AS (SELECT doc_id, part, nl.feature, CAST(len(list_filter(e, lambda v: v <= x)) AS VARCHAR) AS cell
          FROM nl JOIN ed ON nl.feature = ed.feature
          UNION ALL SELECT doc_id, part, 'lang', coalesce(lang, '__MISSING__') FROM t
          UNION ALL SELECT doc_id, part, 'source', coalesce(source, '__MISSING__') FROM t),
nc AS (SELECT 'n_chars' AS feature, {float(NB)} AS cells
       UNION ALL SELECT feature, count(DISTINCT cell) + 1.0 FROM cells WHERE feature IN ('lang', 'source') GROUP BY feature),
cc AS (SELECT feature, cell, sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END)::DOUBLE AS c0,
              sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END)::DOUBLE AS c1 FROM cells GROUP BY 1, 2),
tot AS (SELECT feature, sum(c0) AS n0, sum(c1) AS n1 FROM cc GROUP BY 1)
SELECT c.doc_id, c.feature, round(ln((coalesce(cc.c1, 0) + 0.5) / (n1 + 0.5 * nc.cells))
                                  - ln((coalesce(cc.c0, 0) + 0.5) / (n0 + 0.5 * nc.cells)), 6) AS shift
FROM cells c LEFT JOIN cc ON c.feature = cc.feature AND c.cell = cc.cell
JOIN tot ON c.feature = tot.feature JOIN nc ON c.feature = nc.feature""")
def shift_features(spark, sf_dir):
    """AG10 + SC14: per-feature log p(cell | test) / p(cell | train) on labelled (train)
    vs unlabelled (test) documents; numeric edges from train rows only."""
    t = fx.labelled_documents(spark, sf_dir).withColumn("domain", (F.col("part") == "test").cast("int"))
    nl = D.numeric_long(t, ["doc_id", "domain"], ["n_chars"])
    e = D.fit_edges(nl.where(F.col("domain") == 0), NB, n_features=1)
    ncell = D.digitize(nl, e, NB, max_rows=1).select("doc_id", "domain", "feature", F.col("cell").cast("string"))
    cells = ncell.unionByName(D.cat_long(t, ["doc_id", "domain"], ["lang", "source"]))
    counts = D.cell_counts(cells, "domain")
    ncells = D.numeric_cells(spark, ["n_chars"], NB).unionByName(D.categorical_cells([t], ["lang", "source"]))
    s = D.apply_cell_ratio(cells, counts, D.class_totals(counts), ncells, D.ALPHA, out="shift", max_features=3)
    return s.select("doc_id", "feature", _r("shift").alias("shift"))


# ---------------------------------------------------------------- ensembles
from .operators import ensemble as EN  # noqa: E402


def _t3(spark, sf_dir):
    return fx.closed_form_scores(_t1(spark, sf_dir))


def _aligned_oof(spark, sf_dir):
    t3 = _t3(spark, sf_dir)
    tabs = {m: EN.read_oof_values(fx.oof_table(t3, m)) for m in fx.MODELS}
    return EN.align_predictions(tabs, "oof_pred", "y")


def _aligned_subs(spark, sf_dir):
    t3 = _t3(spark, sf_dir)
    tabs = {m: EN.read_submission_values(fx.submission_table(t3, m)) for m in fx.MODELS}
    return EN.align_predictions(tabs, "diagnosed_diabetes")


def _sql_logit(p: str) -> str:
    q = f"greatest(1e-15, least(1 - 1e-15, {p}))"
    return f"(ln({q}) - ln(1 - {q}))"


def _sql_sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END)"


@register("align_predictions", f"""SELECT id, y, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3
FROM ({fx.T3_SQL}) WHERE part = 'train'""")
def align_predictions(spark, sf_dir):
    """JN5 + SRC4: three OOF tables (id, y, oof_pred) coerced and aligned by id into one
    row per id; missing/duplicate ids or disagreeing y fail the job."""
    a = _aligned_oof(spark, sf_dir)
    return a.select("id", "y", *[_r(m).alias(m) for m in fx.MODELS])


BLEND_W = [0.5, 0.3, 0.2]


@register("blend_prob", f"""SELECT id, round(greatest(0, least(1, {BLEND_W[0]} * p1 + {BLEND_W[1]} * p2 + {BLEND_W[2]} * p3)), 6)
  AS diagnosed_diabetes FROM ({fx.T3_SQL}) WHERE part = 'test'""")
def blend_prob(spark, sf_dir):
    """SC16 + SRC5: weighted probability blend of three submissions (weights 0.5/0.3/0.2)."""
    b = EN.blend(_aligned_subs(spark, sf_dir), fx.MODELS, BLEND_W, "prob")
    return b.select("id", _r("diagnosed_diabetes").alias("diagnosed_diabetes"))


_Z_EQ = " + ".join(f"(1.0/3) * {_sql_logit(m)}" for m in fx.MODELS)


@register("blend_logit", f"""SELECT id, round(greatest(0, least(1, {_sql_sigmoid(_Z_EQ)})), 6) AS diagnosed_diabetes
FROM ({fx.T3_SQL}) WHERE part = 'test'""")
def blend_logit(spark, sf_dir):
    """SC1 + SC2 + SC17: equal-weight blend in logit space, mapped back by a stable sigmoid."""
    b = EN.blend(_aligned_subs(spark, sf_dir), fx.MODELS, None, "logit")
    return b.select("id", _r("diagnosed_diabetes").alias("diagnosed_diabetes"))


GRID = EN.weight_grid(3, 0.25)
_GRID_SQL = ", ".join(f"({i}, {w[0]}, {w[1]}, {w[2]})" for i, w in enumerate(GRID))


def _sql_trials() -> str:
    z = " + ".join(f"w{j} * {_sql_logit(m)}" for j, m in enumerate(fx.MODELS))
    p = f"greatest(1e-15, least(1 - 1e-15, greatest(0, least(1, {_sql_sigmoid(z)}))))"
    return f"""
WITH d AS (SELECT y, p1, p2, p3 FROM ({fx.T3_SQL}) WHERE part = 'train'),
g AS (SELECT * FROM (VALUES {_GRID_SQL}) g(trial, w0, w1, w2)),
s AS (SELECT trial, w0, w1, w2, avg(-(y * ln({p}) + (1 - y) * ln(1 - {p}))) AS loss FROM d, g GROUP BY trial, w0, w1, w2)"""


@register("score_trials", _sql_trials() + """
SELECT trial::INTEGER AS trial, w0::DOUBLE AS w_p1, w1::DOUBLE AS w_p2, w2::DOUBLE AS w_p3, round(loss, 6) AS loss FROM s""")
def score_trials(spark, sf_dir):
    """JN9: OOF log-loss of every weight vector of a fixed simplex grid (step 0.25, 15
    trials) in logit mode, all trials in one aggregation scan."""
    r = EN.score_trials(_aligned_oof(spark, sf_dir), "y", fx.MODELS, GRID, "logit")
    return r.select("trial", "w_p1", "w_p2", "w_p3", _r("loss").alias("loss"))


@register("best_trial", _sql_trials() + """
SELECT trial::INTEGER AS trial, w0::DOUBLE AS w_p1, w1::DOUBLE AS w_p2, w2::DOUBLE AS w_p3, round(loss, 6) AS loss
FROM s ORDER BY loss, trial LIMIT 1""")
def best_trial(spark, sf_dir):
    """TK6: the lowest-loss trial of the grid (first trial wins ties)."""
    r = EN.score_trials(_aligned_oof(spark, sf_dir), "y", fx.MODELS, GRID, "logit")
    return EN.best_trial(r).select("trial", "w_p1", "w_p2", "w_p3", _r("loss").alias("loss"))


@register("base_losses", f"""
WITH t3 AS ({fx.T3_SQL}), l AS ({_SQL_LONG_MODELS}), {_sql_auc('l', 'model')},
ll AS (SELECT model, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS logloss,
              count(*) AS n FROM l GROUP BY model)
SELECT model, round(logloss, 6) AS logloss, round(auc, 6) AS auc, n FROM ll JOIN a USING (model)""")
def base_losses(spark, sf_dir):
    """AG22: each base model's own OOF log-loss and AUC, from the long score table."""
    b = M.base_losses(_long_scores(spark, sf_dir), "y", "p", "model")
    return b.select("model", _r("logloss").alias("logloss"), _r("auc").alias("auc"), "n")


# ---------------------------------------------------------------- side-table joins
@register("weights_join_strict", f"""SELECT id, round(0.5 + (id % 7)::DOUBLE / 7.0, 6) AS weight
FROM ({fx.T1_SQL}) WHERE part = 'train'""")
def weights_join_strict(spark, sf_dir):
    """JN1 + SRC6: every training id must find its weight (else the job fails); ids in
    the weight table must be unique."""
    t3 = _t3(spark, sf_dir)
    rows = t3.where(F.col("part") == "train").select("id")
    w = J.read_weight_values(fx.weights_table(t3, complete=True))
    return J.attach_strict(rows, w, "id", "weight", "train weights").select("id", _r("weight").alias("weight"))


@register("weights_join_default", f"""SELECT id, round(greatest(0, coalesce(weight, 1.0)), 6) AS weight
FROM ({fx.T3_SQL}) WHERE part = 'train'""")
def weights_join_default(spark, sf_dir):
    """JN2: weights looked up by id; ids without a weight get 1.0; clipped at >= 0."""
    t3 = _t3(spark, sf_dir)
    rows = t3.where(F.col("part") == "train").select("id")
    w = J.read_weight_values(fx.weights_table(t3, complete=False))
    return J.attach_default(rows, w, "id", "weight", 1.0, lo=0.0).select("id", _r("weight").alias("weight"))


@register("teacher_join", f"""SELECT id, y, round(greatest(0, least(1, p1)), 6) AS teacher
FROM ({fx.T3_SQL}) WHERE part = 'train'""")
def teacher_join(spark, sf_dir):
    """JN3 + SRC7: the teacher's OOF score attached strictly by id (missing -> error)."""
    t3 = _t3(spark, sf_dir)
    rows = t3.where(F.col("part") == "train").select("id", "y")
    j = J.distill_targets(rows, fx.oof_table(t3, "p1"), "id", "y", alpha=1.0, smoothing=0.0)
    return j.select("id", "y", _r("teacher").alias("teacher"))


SOFT_ALPHA, SOFT_EPS = 0.7, 0.02


@register("soft_targets", f"""
WITH t AS (SELECT id, y, greatest(1e-6, least(1 - 1e-6, greatest(0, least(1, p1)))) AS teacher
           FROM ({fx.T3_SQL}) WHERE part = 'train')
SELECT id, y, round(teacher, 6) AS teacher,
  round((1 - {SOFT_EPS}) * greatest(1e-6, least(1 - 1e-6, (1 - {SOFT_ALPHA}) * y + {SOFT_ALPHA} * teacher)) + {SOFT_EPS / 2}, 6) AS y_soft
FROM t""")
def soft_targets(spark, sf_dir):
    """ML11/SC5/SC6 (NN variant): teacher joined with default 0.5 and clipped, soft target
    (1-a) y + a t with a = 0.7, clipped, then label smoothing eps = 0.02."""
    t3 = _t3(spark, sf_dir)
    rows = t3.where(F.col("part") == "train").select("id", "y")
    j = J.distill_targets(rows, fx.oof_table(t3, "p1"), "id", "y", SOFT_ALPHA, SOFT_EPS,
                          strict=False, nn_variant=True)
    return j.select("id", "y", _r("teacher").alias("teacher"), _r("y_soft").alias("y_soft"))


from .functions.scalar import odds_weight  # noqa: E402

_SQL_ODDS = f"""
WITH t AS (SELECT id, greatest(1e-6, least(1 - 1e-6, p1)) AS q FROM ({fx.T3_SQL}) WHERE part = 'train'),
w AS (SELECT id, greatest(0.1, least(10.0, q / (1 - q))) AS w FROM t),
n AS (SELECT id, w / ((SELECT avg(w) FROM w) + 1e-12) AS weight FROM w)"""


@register("odds_weights", _SQL_ODDS + " SELECT id, round(weight, 6) AS weight FROM n")
def odds_weights(spark, sf_dir):
    """SC4 + AG18: importance weights p/(1-p) of a test-vs-train probability (p1 here),
    clipped to [0.1, 10] before being normalised to mean 1."""
    t3 = _t3(spark, sf_dir).where(F.col("part") == "train")
    w = t3.select("id", odds_weight(F.col("p1"), 1e-6, 0.1, 10.0).alias("weight"))
    return counts.normalise_mean(w, "weight").select("id", _r("weight").alias("weight"))


@register("weight_stats", _SQL_ODDS + """ SELECT round(avg(weight), 6) AS weight_mean, round(min(weight), 6) AS weight_min,
  round(max(weight), 6) AS weight_max, count(*) AS n FROM n""")
def weight_stats(spark, sf_dir):
    """AG19: mean / min / max of the normalised importance weights."""
    t3 = _t3(spark, sf_dir).where(F.col("part") == "train")
    w = counts.normalise_mean(t3.select("id", odds_weight(F.col("p1"), 1e-6, 0.1, 10.0).alias("weight")), "weight")
    s = counts.weight_stats(w, "weight")
    return s.select(*[_r(c).alias(c) for c in ("weight_mean", "weight_min", "weight_max")], "n")


# ---------------------------------------------------------------- training logs
from .operators import logs as LG  # noqa: E402

_PRE = LG.PREFIX_RE
_SQL_PARSED = f"""
l AS ({fx.T4_SQL}),
p AS (SELECT trim(value) AS s FROM l WHERE regexp_matches(trim(value), '{_PRE}')),
x AS (SELECT regexp_extract(s, '{_PRE}', 1)::BIGINT AS seed, regexp_extract(s, '{_PRE}', 2)::BIGINT AS fold,
             regexp_extract(s, '{_PRE}', 3)::BIGINT AS epoch, trim(regexp_extract(s, '{_PRE}', 4)) AS rest FROM p),
t AS (SELECT seed, fold, epoch, unnest(string_split_regex(rest, '\\s+')) AS tok FROM x),
kv AS (SELECT seed, fold, epoch, split_part(tok, '=', 1) AS metric,
              regexp_replace(substr(tok, position('=' IN tok) + 1), ',+$', '') AS v FROM t WHERE position('=' IN tok) > 0),
parsed AS (SELECT seed, fold, epoch, metric, TRY_CAST(v AS DOUBLE) AS value FROM kv
           WHERE metric <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL)"""


def _parsed(spark, sf_dir):
    return LG.parse_metric_lines(fx.metric_log_lines(spark, sf_dir))


@register("parse_logs", f"WITH {_SQL_PARSED} SELECT * FROM parsed")
def parse_logs(spark, sf_dir):
    """SRC9 + SC20 + SC21: training-log lines -> (seed, fold, epoch, metric, value) rows;
    noise lines dropped, trailing commas stripped, non-numeric tokens ignored."""
    return _parsed(spark, sf_dir)


@register("best_metric", f"""WITH {_SQL_PARSED},
dd AS (SELECT *, CASE WHEN lower(metric) LIKE '%auc%' THEN 'max' ELSE 'min' END AS direction FROM parsed),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN direction = 'max' THEN -value ELSE value END,
                                   seed, fold, epoch) AS rn FROM dd)
SELECT metric, direction, value AS best_value, epoch AS best_epoch, seed AS best_seed, fold AS best_fold FROM r WHERE rn = 1""")
def best_metric(spark, sf_dir):
    """AG21 + SC22: best value of each metric (min for losses, max for AUC) and where it occurred."""
    return LG.best_metric(_parsed(spark, sf_dir))


@register("epoch_mean", f"""WITH {_SQL_PARSED}
SELECT metric, epoch, round(avg(value), 6) AS mean_value, count(*) AS n FROM parsed GROUP BY metric, epoch""")
def epoch_mean(spark, sf_dir):
    """AG20: mean of each metric per epoch across seeds and folds."""
    e = LG.epoch_mean(_parsed(spark, sf_dir))
    return e.select("metric", "epoch", _r("mean_value").alias("mean_value"), "n")


@register("log_folder_report", """WITH e AS (SELECT event_id, floor(event_id / 10)::BIGINT + 1 AS epoch, value,
  event_id % 50 = 0 AS broken FROM events WHERE event_type <> 'error')
SELECT epoch, round(avg(CASE WHEN NOT broken THEN value END), 6) AS train_bce, round(avg(value + 0.5), 6) AS val_logloss FROM e GROUP BY epoch""")
def log_folder_report(spark, sf_dir):
    """SRC9 + SNK6 + AG20: a folder of log files with CRLF ends, bytes that are not UTF-8 and ``nan`` values, written to the
    shared folder and read as text; parsed metrics stored by metric, train and validation epochs side by side."""
    i = F.col("event_id")
    lines = fx.metric_log_lines(spark, sf_dir, "event_id")
    nan = F.regexp_replace("value", "train_bce=[^,]*", "train_bce=nan")
    text = F.when(i % 50 == 0, nan).otherwise(F.col("value")).cast("binary")
    text = F.when(i % 7 == 0, F.concat(text, F.unhex(F.lit("206E6F74653DFF8041")))).otherwise(text)  # " note=", two stray bytes, "A"
    text = F.when(i % 3 == 0, F.concat(text, F.unhex(F.lit("0D")))).otherwise(text)
    path = scratch_path(spark, "logs")
    lines.repartition(4).select(text.cast("string").alias("value")).write.text(path)
    metrics = SK.write_metrics(LG.parse_metric_lines(RD.read_log_lines(spark, path)), scratch_path(spark, "metrics"))
    x = LG.epoch_mean_side_by_side(spark.read.parquet(metrics), ["train_bce", "val_logloss"])
    return x.select("epoch", _r("train_bce").alias("train_bce"), _r("val_logloss").alias("val_logloss"))


PATIENCE, MIN_DELTA = 5, 1e-6


@register("patience_pick")
def patience_pick(spark, sf_dir):
    """WN3: replay early stopping (patience 5, min_delta 1e-6) over each (seed, fold)
    validation-loss history: best epoch, best value, stop epoch. Rows-only check; the
    unit tests compare it with a plain Python loop."""
    return LG.patience_pick(_parsed(spark, sf_dir), "val_logloss", PATIENCE, MIN_DELTA)


# ---------------------------------------------------------------- tokens, hashing, one-hot
from .functions.scalar import cat_tokens as _cat_tokens  # noqa: E402
from .operators import features as FT  # noqa: E402

_SQL_TOK = " || ".join(f"'{c}=' || coalesce({c}, '__MISSING__') || ' '" for c in T1_CATS)


@register("cat_tokens", f"SELECT id, {_SQL_TOK} AS tokens FROM ({fx.T1_SQL})")
def cat_tokens(spark, sf_dir):
    """SC7: one ``col=value `` token per categorical column (missing -> __MISSING__)."""
    return _t1(spark, sf_dir).select("id", _cat_tokens(T1_CATS).alias("tokens"))


@register("hash_features")
def hash_features(spark, sf_dir):
    """SC8/C1: token counts hashed into 2^18 buckets (no sign, no norm), in long form
    (id, bucket, n) -- the sparse vector's non-zeros. Rows-only: bucket numbers follow
    Spark SQL's murmur3 ``hash``, not the reference's hash."""
    return FT.hashed_token_counts(_t1(spark, sf_dir), "id", T1_CATS, 1 << 18)


@register("one_hot", f"""WITH {_SQL_VC},
top AS (SELECT * FROM rk WHERE r <= {MAX_CATS - 2}),
rl AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY r) + 1)::INTEGER AS code
       FROM top WHERE value NOT IN ('__MISSING__', '__OTHER__')),
sp AS (SELECT feature, value, code FROM (SELECT DISTINCT feature FROM vc) f
       CROSS JOIN (VALUES ('__MISSING__', 0), ('__OTHER__', 1)) s(value, code)),
v AS (SELECT * FROM rl UNION ALL SELECT * FROM sp),
c AS (SELECT l.id, l.feature, coalesce(v.code, 1) AS code FROM long l LEFT JOIN v ON v.feature = l.feature AND v.value = l.value),
m AS (SELECT feature, max(code) AS mx FROM c GROUP BY feature)
SELECT id, c.feature, code AS slot, (mx + 2)::INTEGER AS size FROM c JOIN m ON c.feature = m.feature
WHERE c.feature IN ('priority', 'segment')""")
def one_hot(spark, sf_dir):
    """SC9: C4 codes of priority and segment one-hot encoded with Spark ML's
    OneHotEncoder (dropLast off, unknown codes kept in an extra slot); reported as
    (id, feature, slot, size) so the vectors can be checked exactly."""
    t = _t1(spark, sf_dir)
    cols = ["priority", "segment"]
    vocab = E.vocab_freq(E.value_counts([t], cols), MAX_CATS)
    coded = E.lookup_codes(t.select("id", *cols), vocab, cols, 1, MAX_CATS)
    oh = FT.one_hot(coded, [f"{c}_code" for c in cols])
    return FT.one_hot_slots(oh, "id", {c: f"{c}_code_oh" for c in cols})


# ---------------------------------------------------------------- models (rows-only checks)
from .plans import crossfit as CF  # noqa: E402
from .plans import fold_preprocess as FP  # noqa: E402
from .plans import sgd as SG  # noqa: E402
from .plans import tabular as TB  # noqa: E402
from .session import scratch_path  # noqa: E402
from .sources import readers as RD  # noqa: E402
from .sources import sinks as SK  # noqa: E402

GBT_ITER, GBT_DEPTH = 10, 4


@register("gbt_cv")
def gbt_cv(spark, sf_dir):
    """ML1 + ML2 + ML16: 5-fold cross-fitted gradient-boosted trees on the encoded T1
    frame (N3 numerics, C4 codes, stratified folds); OOF table ``id, y, oof_pred``."""
    fr = TB.encode_frame(spark, sf_dir)
    return CF.cross_fit(fr.train, lambda s: CF.gbt(s, max_iter=GBT_ITER, max_depth=GBT_DEPTH)).oof


def _label_sql(where: str = "part = 'train'") -> str:
    """T1 rows with the models' label and the stratified fold, as ``s``."""
    return f"""
t AS (SELECT id, part, CASE WHEN acctbal + 100.0 * (id % 37)::DOUBLE > 6000.0 THEN 1 ELSE 0 END AS y FROM ({fx.T1_SQL}) WHERE {where}),
s AS (SELECT id, part, y, CASE WHEN part = 'train' THEN ((row_number() OVER (PARTITION BY part, y ORDER BY {H.sql_mix64('id', SEED)}, id) - 1)
             % {N_FOLDS})::INTEGER END AS fold FROM t)"""


def _prior_loss(pos: str, n: str) -> str:
    return f"-({pos} * ln({pos} / {n}) + ({n} - {pos}) * ln(1 - {pos} / {n})) / {n}"


def score_facts(scored: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """What must hold of model scores whatever the model: rows, ids, positives, scores inside [0, 1], loss under the prior's."""
    n, pos = F.count(F.lit(1)).cast("double"), F.sum(y).cast("double")
    prior = -(pos * F.log(pos / n) + (n - pos) * F.log(1 - pos / n)) / n
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.sum(y).cast("bigint").alias("n_pos"),
        F.bool_and((F.col(p) >= 0) & (F.col(p) <= 1)).alias("in_range"), (M.logloss_expr(y, p) < prior).alias("beats_prior"))


_GBT_ROUNDS, _GBT_PATIENCE = 15, 15  # patience for all rounds: the kept loss is the least of all


def _early_stopped(spark, sf_dir, **kw):
    fr = TB.encode_frame(spark, sf_dir, write=True)
    mk = lambda s: CF.gbt(s, max_iter=_GBT_ROUNDS, max_depth=GBT_DEPTH)
    return fr, CF.cross_fit(fr.train, mk, test=fr.test, early=CF.EarlyStop(_GBT_PATIENCE), **kw)


@register("gbt_best_iteration")
def gbt_best_iteration(spark, sf_dir):
    """ML17: per fold, the rounds kept (of 15, up to the least loss) and the held fold's loss with them and with all."""
    _, res = _early_stopped(spark, sf_dir)
    return spark.createDataFrame([(m["fold"], m["rounds"], m["loss"], m["full_loss"]) for m in res.fold_metrics],
                                 "fold int, n_trees int, logloss double, full_logloss double")


@register("gbt_early_stopped", f"""WITH {_label_sql("part IN ('train', 'test')")}
SELECT part, coalesce(fold, -1) AS fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_pos, true AS in_range, true AS beats_prior
FROM s GROUP BY part, fold""")
def gbt_early_stopped(spark, sf_dir):
    """ML2 + ML17: OOF and test scores of cross-fitted trees, each fold's model cut to its best rounds on the held
    fold; what must hold of the scores by part and fold."""
    fr, res = _early_stopped(spark, sf_dir)
    test = res.test.join(fr.test.select("id", "y"), "id").select(F.lit("test").alias("part"), F.lit(-1).alias("fold"), "id", "y", F.col("pred").alias("p"))
    rows = res.scored.select(F.lit("train").alias("part"), "fold", "id", "y", "p").unionByName(test)
    return score_facts(rows, ["part", "fold"])


_TWO_SEEDS = (42, 43)


@register("gbt_seeds", f"""WITH t AS (SELECT id, CASE WHEN acctbal + 100.0 * (id % 37)::DOUBLE > 6000.0 THEN 1 ELSE 0 END AS y FROM ({fx.T1_SQL}) WHERE part = 'train'),
s AS ({" UNION ALL ".join(f"SELECT {s} AS seed, ((row_number() OVER (PARTITION BY y ORDER BY {H.sql_mix64('id', s)}, id) - 1) % {N_FOLDS})::INTEGER AS fold FROM t" for s in _TWO_SEEDS)}),
g AS (SELECT seed, fold, count(*) AS n FROM s GROUP BY seed, fold
      UNION ALL SELECT seed, -1, count(*) FROM s GROUP BY seed UNION ALL SELECT -1, -1, count(*) FROM t)
SELECT seed::INTEGER AS seed, fold, n, true AS better_than_chance, true AS average_no_worse FROM g""")
def gbt_seeds(spark, sf_dir):
    """ML16 + AG15: two seeds, each with its own stratified folds; the report by (seed, fold), by seed and of the
    averaged scores, whose loss is at most the seeds' mean loss (log-loss is convex)."""
    fr = TB.encode_frame(spark, sf_dir)
    tr = fr.train.drop("fold")
    for s in _TWO_SEEDS:
        tr = RK.stratified_folds(tr, "id", "y", N_FOLDS, s, out=f"fold_{s}")
    res = CF.cross_fit(tr, lambda s: CF.gbt(s, max_iter=5, max_depth=3, subsample=0.7), seeds=_TWO_SEEDS,
                       fold={s: f"fold_{s}" for s in _TWO_SEEDS})
    m = M.cv_metrics_seeds(res.scored, "y", "p", "fold", "seed", "id")
    m = materialise(m, "seed-report")
    mean = m.where((F.col("fold") == -1) & (F.col("seed") >= 0)).agg(F.avg("logloss")).first()[0]
    no_worse = (F.col("seed") >= 0) | (F.col("logloss") <= F.lit(mean + 1e-12))
    return m.select("seed", "fold", "n", (F.col("auc") > 0.5).alias("better_than_chance"), no_worse.alias("average_no_worse"))


@register("rf_fold_frame", f"""
WITH t AS (SELECT id, (id % 5)::INTEGER AS fold, CASE WHEN isfinite(TRY_CAST(price_txt AS DOUBLE)) THEN TRY_CAST(price_txt AS DOUBLE) END AS price,
                  CASE WHEN isfinite(acctbal) THEN acctbal END AS acctbal, priority, segment FROM ({fx.T1_SQL}) WHERE part = 'train'),
k AS (SELECT range::INTEGER AS k FROM range({N_FOLDS})),
med AS (SELECT k, quantile_cont(price, 0.5) AS mp, quantile_cont(acctbal, 0.5) AS ma FROM t JOIN k ON t.fold <> k.k GROUP BY k),
lc AS (SELECT fold, 'priority' AS feature, priority AS v FROM t UNION ALL SELECT fold, 'segment', segment FROM t),
cnt AS (SELECT k, feature, v, count(*) AS c FROM lc JOIN k ON lc.fold <> k.k WHERE v IS NOT NULL GROUP BY 1, 2, 3),
md AS (SELECT k, feature, v FROM (SELECT *, row_number() OVER (PARTITION BY k, feature ORDER BY c DESC, v) AS r FROM cnt) WHERE r = 1),
cd AS (SELECT k, feature, v, (row_number() OVER (PARTITION BY k, feature ORDER BY v) - 1)::INTEGER AS code FROM cnt)
SELECT t.id, t.fold, round(coalesce(price, mp), 6) AS price_txt_filled, round(coalesce(t.acctbal, ma), 6) AS acctbal_filled,
       coalesce(c1.code, -1) AS priority_code, coalesce(c2.code, -1) AS segment_code
FROM t JOIN med ON med.k = t.fold JOIN md m1 ON m1.k = t.fold AND m1.feature = 'priority' JOIN md m2 ON m2.k = t.fold AND m2.feature = 'segment'
LEFT JOIN cd c1 ON c1.k = t.fold AND c1.feature = 'priority' AND c1.v = coalesce(priority, m1.v)
LEFT JOIN cd c2 ON c2.k = t.fold AND c2.feature = 'segment' AND c2.v = coalesce(segment, m2.v)""")
def rf_fold_frame(spark, sf_dir):
    """N6 + C6: every training row filled (median, mode) and coded by its own fold's fit, saved and loaded again."""
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    path = scratch_path(spark, "fold-preprocessor")
    FP.FoldPreprocessor(numCols=NUM, catCols=CAT, numFolds=N_FOLDS).fit(t).write().overwrite().save(path)
    x = FP.FoldPreprocessorModel.load(path).transform(t)
    return x.select("id", "fold", *[_r(f"{c}_filled").alias(f"{c}_filled") for c in NUM], *[f"{c}_code" for c in CAT])


@register("rf_cv", f"""WITH {_label_sql("part IN ('train', 'test')")}
SELECT part, coalesce(fold, -1) AS fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_pos, true AS in_range, true AS beats_prior
FROM s GROUP BY part, fold""")
def rf_cv(spark, sf_dir):
    """ML5: cross-fitted random forest (50 trees, sqrt features, leaves >= 2), filled and coded by each fold's own
    preprocessor; what must hold of its OOF and test scores by part and fold."""
    t = materialise(TB.signal_label(_t1(spark, sf_dir)).where(F.col("part").isin("train", "test"))
                    .withColumn("label", F.col("y_sig").cast("double")), "rf-rows")
    tr = RK.stratified_folds(t.where(F.col("part") == "train"), "id", "y_sig", N_FOLDS, SEED)
    tr = materialise(tr, "rf-train")
    pre = FP.FoldPreprocessor(numCols=TB.NUM, catCols=TB.CAT, numFolds=N_FOLDS).fit(tr)

    def frame(df, seed, k):
        return FT.assemble(pre.frame(df, k).drop("features"), pre.outputs(), "features")

    res = CF.cross_fit(tr, lambda s: CF.random_forest(s, trees=50, max_depth=8), test=t.where(F.col("part") == "test"), frame=frame)
    test = res.test.join(t.where(F.col("part") == "test").select("id", F.col("y_sig").alias("y")), "id").select(
        F.lit("test").alias("part"), F.lit(-1).alias("fold"), "id", "y", F.col("pred").alias("p"))
    rows = res.scored.select(F.lit("train").alias("part"), "fold", "id", "y", "p").unionByName(test)
    return score_facts(rows, ["part", "fold"])


@register("linear_tune")
def linear_tune(spark, sf_dir):
    """ML7 + ML8 + PRJ8: the 22-point L2/elastic-net grid fitted on the id-hash training
    side and scored on the hold-out side; ``trial, alpha, l1_ratio, balanced, val_logloss``."""
    fr = TB.encode_frame(spark, sf_dir)
    x = materialise(H.with_holdout_side(fr.train, "id", VAL_FRAC, SEED), "linear-rows")
    best, res = CF.tune_linear(x.where(F.col("side") == "train"), x.where(F.col("side") == "valid"),
                               CF.linear_grid())
    return spark.createDataFrame([(r["trial"], r["alpha"], r["l1_ratio"], r["balanced"], r["val_logloss"]) for r in res],
                                 "trial int, alpha double, l1_ratio double, balanced boolean, val_logloss double")


_SGD_PASSES, _SGD_CHUNK = 3, 2_000


def _token_rows(spark, sf_dir):
    """Train and test rows as hashed tokens of the categories and scaled numerics, and the train rows' hold-out side."""
    t = TB.signal_label(_t1(spark, sf_dir)).where(F.col("part").isin("train", "test")).drop("y").withColumnRenamed("y_sig", "y")
    features = SG.TokenFeatures.fit(t.where(F.col("part") == "train"), TB.CAT, TB.NUM)
    x = H.with_holdout_side(t, "id", VAL_FRAC, SEED)
    return features, materialise(features.rows(x, "id", "part", "side", "y"), "token-rows")


@register("sgd_tune", f"""WITH g AS (SELECT a AS alpha, r AS l1_ratio, 'optimal' AS schedule, 0.0 AS eta0, b AS balanced
  FROM (VALUES {", ".join(f"({c.alpha!r}, {c.l1_ratio!r})" for c in SG.sgd_grid()[:22:2])}) v(a, r), (VALUES (false), (true)) w(b)
  UNION ALL SELECT 1e-05, 0.0, 'constant', 0.02, false UNION ALL SELECT 1e-05, 0.0, 'constant', 0.05, true)
SELECT CASE WHEN l1_ratio > 0 THEN 'elasticnet' ELSE 'l2' END AS penalty, alpha::DOUBLE AS alpha, l1_ratio::DOUBLE AS l1_ratio, schedule,
       eta0::DOUBLE AS eta0, balanced, true AS finite_loss, 1::BIGINT AS n_best FROM g""")
def sgd_tune(spark, sf_dir):
    """ML7 + ML8 + SNK5: the 24 points of averaged proximal SGD on hashed tokens, fitted together on the id-hash
    training side and scored on the hold-out side; trials and best written and read back."""
    _, x = _token_rows(spark, sf_dir)
    x = x.where(F.col("part") == "train")
    best, trials = SG.tune_sgd(x.where(F.col("side") == "train"), x.where(F.col("side") == "valid"), SG.sgd_grid(),
                               passes=_SGD_PASSES, chunk_rows=_SGD_CHUNK)
    path = scratch_path(spark, "sgd-trials")
    loss = trials.where("best").first()["val_logloss"]
    SK.write_trials(trials, SG.best_row(best, loss), path)
    back = spark.read.schema(trials.schema).json(f"{path}/trials")
    kept = json.loads(spark.read.text(f"{path}/best").first()[0])
    n_best = back.where((F.col("val_logloss") == kept["val_logloss"]) & F.col("best")).count()
    return back.select("penalty", "alpha", "l1_ratio", "schedule", "eta0", "balanced",
                       (F.col("val_logloss") >= F.lit(kept["val_logloss"])).alias("finite_loss"), F.lit(n_best).cast("bigint").alias("n_best"))


@register("sgd_refit", f"""WITH {_label_sql("part IN ('train', 'test')")}
SELECT part, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_pos, true AS in_range, true AS beats_prior FROM s GROUP BY part""")
def sgd_refit(spark, sf_dir):
    """ML7 + ML8: the best of the 24 points fitted again on all training rows; its test scores written as a
    submission (SNK1) and read back (SRC5), and what must hold of them and of the training scores."""
    features, x = _token_rows(spark, sf_dir)
    tr = x.where(F.col("part") == "train")
    best, _ = SG.tune_sgd(tr.where(F.col("side") == "train"), tr.where(F.col("side") == "valid"), SG.sgd_grid(),
                          passes=_SGD_PASSES, chunk_rows=_SGD_CHUNK)
    model = SG.fit_sgd(tr, [best], passes=2 * _SGD_PASSES, chunk_rows=_SGD_CHUNK).models()[0]
    path = scratch_path(spark, "sgd-submission")
    SK.write_submission(SG.sgd_scores(x.where(F.col("part") == "test"), model), path)
    test = RD.read_submission(spark, path, fmt="csv").withColumnRenamed("diagnosed_diabetes", "p")
    rows = SG.sgd_scores(tr, model).unionByName(test).join(x.select("id", "part", "y"), "id")
    return score_facts(rows, ["part"])


@register("mlp_fit", f"""WITH {_label_sql("part IN ('train', 'test')")}
SELECT CASE WHEN part = 'test' THEN 'test' ELSE 'valid' END AS part, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_pos,
       true AS in_range, true AS beats_prior, true AS best_round
FROM s WHERE part = 'test' OR {H.sql_mul_bucket('id', SEED)} < {H.holdout_cut(VAL_FRAC, H.MUL_BUCKETS)} GROUP BY 1""")
def mlp_fit(spark, sf_dir):
    """ML9: multilayer perceptron on one-hot codes + standardised numerics, fitted on the id-hash training side in
    warm-started rounds with patience on the hold-out side; facts of the hold-out and test scores."""
    fr = TB.encode_frame(spark, sf_dir, write=True)
    rows = fr.train.drop("fold").withColumn("part", F.lit("train")).unionByName(fr.test.withColumn("part", F.lit("test")))
    x = FT.one_hot(rows, [f"{c}_code" for c in TB.CAT])
    inputs = [f"{c}_z" for c in TB.NUM] + [f"{c}_code_oh" for c in TB.CAT]
    x = materialise(H.with_holdout_side(FT.assemble(x.drop("features"), inputs, "features"), "id", VAL_FRAC, SEED), "mlp-rows")
    n_in = len(x.select("features").first()[0])
    tr = x.where(F.col("part") == "train")
    valid = tr.where(F.col("side") == "valid")
    m, best, losses = CF.mlp_patient(tr.where(F.col("side") == "train"), valid, SEED, n_in, rounds=8, round_iter=10)
    scored = m.transform(valid.unionByName(x.where(F.col("part") == "test"))).select(
        F.when(F.col("part") == "test", "test").otherwise("valid").alias("part"), "id", "y", CF.prob1().alias("p"))
    return score_facts(scored, ["part"]).withColumn("best_round", F.lit(losses[best - 1] == min(losses[:best])))


def _assembler(inputs):
    from pyspark.ml.feature import VectorAssembler
    return lambda u: VectorAssembler(inputCols=inputs, outputCol="features").transform(u)


@register("adv_weights")
def adv_weights(spark, sf_dir):
    """ML10a: train-vs-test GBT domain classifier cross-fitted on stratified folds;
    out-of-fold p(test) of training rows -> odds clipped to [0.1, 10] -> mean 1."""
    fr = TB.encode_frame(spark, sf_dir)
    return CF.adversarial_weights(fr.train, fr.test, fr.inputs,
                                  make=lambda s: CF.gbt(s, max_iter=GBT_ITER, max_depth=3, label="label"),
                                  assemble=_assembler(fr.inputs))


@register("student")
def student(spark, sf_dir):
    """ML4 + ML11: distilled student: soft targets from a teacher's OOF scores (p1,
    strict join, alpha 1) regressed by cross-fitted GBT; predictions clipped to [0, 1];
    OOF table with the hard label."""
    from pyspark.ml.regression import GBTRegressor
    fr = TB.encode_frame(spark, sf_dir)
    teacher = fx.oof_table(_t3(spark, sf_dir), "p1")
    rows = J.distill_targets(fr.train, teacher, "id", "y", 1.0, 0.0)
    res = CF.cross_fit(rows, lambda s: GBTRegressor(labelCol="y_soft", maxIter=GBT_ITER, maxDepth=GBT_DEPTH, seed=s),
                       score=lambda df: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))),
                       hard_label="y")
    return res.oof


@register("stack")
def stack(spark, sf_dir):
    """ML12 + SC19: L2 logistic regression (C = 1) on the logits of three aligned OOF
    tables, applied to the aligned test submissions; ``id, diagnosed_diabetes``."""
    oof_w, test_w = _aligned_oof(spark, sf_dir), _aligned_subs(spark, sf_dir)
    mo, cols = EN.meta_features(oof_w, fx.MODELS, ["logit"])
    mt, _ = EN.meta_features(test_w, fx.MODELS, ["logit"])
    _, sub, _ = CF.stack(mo, mt, cols, C=1.0)
    return sub


@register("optimise_blend")
def optimise_blend(spark, sf_dir):
    """ML13: Dirichlet random search (500 trials, alpha 1) plus 200 batched refinement
    moves for logit-blend weights on the OOF tables, applied to the test submissions."""
    w, loss, _ = EN.optimise_blend(_aligned_oof(spark, sf_dir), "y", fx.MODELS, "logit", trials=500,
                                   refine_steps=200)
    return EN.blend(_aligned_subs(spark, sf_dir), fx.MODELS, w, "logit", strict=False)


@register("monotone_audit")
def monotone_audit(spark, sf_dir):
    """ML14: a logistic model's monotonicity on each standardised numeric feature:
    mean relu(-sign * logit change) after raising the feature by 0.5 (signs +1)."""
    fr = TB.encode_frame(spark, sf_dir)
    tr = fr.train.persist()
    m = CF.linear(SEED, alpha=1e-4).fit(tr)
    feats = [f"{c}_z" for c in TB.NUM]
    return CF.monotone_audit(m, tr, feats, {f: 1 for f in feats}, 0.5, fr.inputs)


@register("stage_graph_base_to_stack", f"""WITH t AS (SELECT id, part FROM ({fx.T1_SQL}))
SELECT id, true AS in_range, true AS blend_between_members, 3 AS n_coef, true AS stack_beats_prior FROM t WHERE part = 'test'""")
def stage_graph_base_to_stack(spark, sf_dir):
    """ML18: base GBT, second family, adversarial weights, weighted GBT, distilled student, logit blend and stack, end to
    end on DataFrames; both submissions written (SNK1) and read back, and what must hold of them for every test row."""
    g = TB.base_to_stack(spark, sf_dir, gbt_iter=6)
    subs = {}
    for name, sub in (("stack", g.stack), ("blend", g.blend)):
        path = SK.write_submission(sub.withColumnRenamed("diagnosed_diabetes", "p"), scratch_path(spark, f"sub-{name}"), fmt="parquet")
        subs[name] = RD.read_submission(spark, path, fmt="parquet").withColumnRenamed("diagnosed_diabetes", name)
    x = g.test.join(subs["stack"], "id").join(subs["blend"], "id")
    members = [F.col(m) for m in TB.BLEND]
    p = g.oof.agg(F.avg("y")).first()[0]
    prior = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    return x.select("id", F.col("stack").between(0, 1).alias("in_range"),
                    F.col("blend").between(F.least(*members) - 1e-9, F.greatest(*members) + 1e-9).alias("blend_between_members"),
                    F.lit(len(g.report["coef"])).alias("n_coef"), F.lit(g.report["logloss"] < prior).alias("stack_beats_prior"))


# ---------------------------------------------------------------- streaming
from .streaming import stream_ops as SO  # noqa: E402


def _event_stream(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/events*.parquet"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    return SO.file_stream(spark, path, schema)


@register("stream_scaler", """SELECT count(*) AS n, round(avg(coalesce(value, 0)), 6) AS mean_value,
  round(stddev_pop(coalesce(value, 0)), 6) AS std_value FROM events""")
def stream_scaler(spark, sf_dir):
    """SM1: running count / mean / population std of ``value`` over a file stream of
    events (complete-mode aggregation, checkpointed), equal to the batch answer."""
    r = SO.run_to_table(SO.stream_scaler(_event_stream(spark, sf_dir), ["value"]), "stream-scaler")
    return r.select("n", _r("mean_value").alias("mean_value"), _r("std_value").alias("std_value"))


@register("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    """SM2: running row counts per class (event type) over the event stream."""
    r = SO.run_to_table(SO.stream_class_counts(_event_stream(spark, sf_dir), "event_type"), "stream-counts")
    return r.select(F.col("y").alias("event_type"), "n")


def _event_score():
    return (d_(1.0) / (d_(1.0) + F.exp(-(F.col("value") - d_(50.0)) / d_(25.0))))


from .functions.scalar import d as d_  # noqa: E402


@register("stream_logloss", f"""
WITH e AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
                  greatest(1e-15, least(1 - 1e-15, 1 / (1 + exp(-(value - 50) / 25.0)))) AS q
           FROM events WHERE {H.sql_mul_bucket('event_id', SEED)} < {H.holdout_cut(VAL_FRAC, H.MUL_BUCKETS)})
SELECT count(*) AS n, round(sum(-(y * ln(q) + (1 - y) * ln(1 - q))) / count(*), 6) AS logloss FROM e""")
def stream_logloss(spark, sf_dir):
    """SM4 + PRJ8: hold-out log-loss accumulated over the stream: rows on the id-hash
    validation side, label purchase, score sigmoid((value - 50) / 25)."""
    s = H.with_holdout_side(_event_stream(spark, sf_dir), "event_id", VAL_FRAC, SEED)
    s = s.where(F.col("side") == "valid").select((F.col("event_type") == "purchase").cast("int").alias("y"),
                                                _event_score().alias("p"))
    r = SO.run_to_table(SO.stream_logloss(s, "y", "p"), "stream-logloss")
    return r.select("n", _r(F.col("loss_sum") / F.col("n")).alias("logloss"))


@register("stream_score")
def stream_score(spark, sf_dir):
    """SM3 + SM5 + SM6: logistic model fitted by one gradient step per micro-batch over
    two replays of the event stream (features: standardised value, label purchase),
    then the stream scored into an append-mode Parquet sink; ``event_id, p``."""
    st = SO.run_to_table(SO.stream_scaler(_event_stream(spark, sf_dir), ["value"]), "score-scaler").first()
    mean, std = st["mean_value"], st["std_value"] or 1.0

    def src():
        s = _event_stream(spark, sf_dir)
        return s.select(((F.col("value") - d_(mean)) / d_(std)).alias("z"),
                        (F.col("event_type") == "purchase").cast("int").alias("y"))
    w, b = SO.stream_sgd_logistic(spark, src, ["z"], "y", passes=2)
    scored = SO.score_linear(_event_stream(spark, sf_dir).select(
        "event_id", ((F.col("value") - d_(mean)) / d_(std)).alias("z")), ["z"], w, b)
    return SO.append_to_table(scored.select("event_id", "p"), "stream-score")


_STREAM_FILES, _STREAM_BATCHES, _STREAM_PASSES = 12, 6, 2


@register("stream_sgd", f"""SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids, true AS in_range, true AS better_than_start,
  true AS a_step_a_batch FROM events""")
def stream_sgd(spark, sf_dir):
    """SRC2 + SM3 + SM6: elastic-net averaged SGD with balanced weights over two replays of a folder of files, read in
    micro-batches bounded by bytes, one gradient step each; then the stream scored."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    path = scratch_path(spark, "event-files")
    events.repartition(_STREAM_FILES, "event_id").write.parquet(path)
    files = materialise(spark.read.format("binaryFile").load(path).select("length"), "sizes").agg(F.sum("length"), F.max("length")).first()
    bound = max(int(files[0]) // _STREAM_BATCHES, int(files[1]))

    def read() -> DataFrame:
        return RD.chunk_scan(spark, path, ["event_id", "event_type", "value"], events.schema, bound, "parquet")

    label = (F.col("event_type") == "purchase").cast("int").alias("y")
    counts = {r["y"]: r["n"] for r in SO.run_to_table(SO.stream_class_counts(read(), label), "sgd-classes").collect()}
    n, n1 = sum(counts.values()), counts.get(1, 0)
    features = SG.TokenFeatures.fit(events.withColumn("size", F.floor("value")), ["size"], ["value"])
    rows = lambda df: features.rows(df.withColumn("size", F.floor("value")).withColumn("y", label), "event_id", "y")
    config = SG.SgdConfig(alpha=1e-5, l1_ratio=0.15, balanced=True)
    state = SG.AveragedSgd([config], features.dim, 1.0, (n / (2 * max(1, n - n1)), n / (2 * max(1, n1))))
    batches = SO.stream_passes(lambda: rows(read()), state.step, _STREAM_PASSES)
    model = state.models()[0]
    scored = SO.append_to_table(SG.sgd_scores(rows(read()), model, "event_id"), "sgd-scores").join(events.select("event_id", label), "event_id")
    weight = F.when(F.col("y") == 1, n / (2 * max(1, n1))).otherwise(n / (2 * max(1, n - n1)))
    return scored.withColumn("w", weight).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_ids"),
        F.bool_and((F.col("p") >= 0) & (F.col("p") <= 1)).alias("in_range"),
        (M.logloss_expr("y", "p", "w") <= F.log(F.lit(2.0)) + 1e-3).alias("better_than_start"),
        F.lit(state.steps == batches > 2 * _STREAM_PASSES).alias("a_step_a_batch"))


# ---------------------------------------------------------------- sources and sinks
from .plans import preprocess as PP  # noqa: E402


@register("oof_csv_roundtrip", f"""SELECT id, y, round(greatest(0, least(1, p1)), 6) AS oof_pred
FROM ({fx.T3_SQL}) WHERE part = 'train'""")
def oof_csv_roundtrip(spark, sf_dir):
    """SNK2 + SNK4 + SRC4: an OOF table written as gzip CSV (a directory, one file per
    task) under the shared folder and read back with the strict, coercing reader."""
    path = scratch_path(spark, "oof-csv")
    SK.write_oof(fx.oof_table(_t3(spark, sf_dir), "p1"), path, compression="gzip")
    r = RD.read_oof(spark, path, fmt="csv")
    return r.select("id", "y", _r("oof_pred").alias("oof_pred"))


_PP_NUM = ["acctbal", "nation"]
_SQL_PP_VC = _SQL_VC.replace(f"t1 AS ({fx.T1_SQL})", f"t1 AS (SELECT * FROM ({fx.T1_SQL}) WHERE part IN ('train', 'test'))")


@register("preprocessor_roundtrip", f"""WITH {_SQL_PP_VC},
top AS (SELECT * FROM rk WHERE r <= {MAX_CATS - 2}),
rl AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY r) + 1)::INTEGER AS code
       FROM top WHERE value NOT IN ('__MISSING__', '__OTHER__')),
sp AS (SELECT feature, value, code FROM (SELECT DISTINCT feature FROM vc)
       CROSS JOIN (VALUES ('__MISSING__', 0), ('__OTHER__', 1)) s(value, code)),
v AS (SELECT * FROM rl UNION ALL SELECT * FROM sp),
c AS (SELECT l.id, l.feature, coalesce(v.code, 1) AS code FROM long l LEFT JOIN v ON v.feature = l.feature AND v.value = l.value),
w AS (SELECT id, max(CASE WHEN feature = 'price_txt' THEN code END)::INTEGER AS price_txt_code,
             max(CASE WHEN feature = 'priority' THEN code END)::INTEGER AS priority_code,
             max(CASE WHEN feature = 'segment' THEN code END)::INTEGER AS segment_code FROM c GROUP BY id),
z AS (SELECT avg(acctbal) AS ma, stddev_pop(acctbal) AS sa, avg(nation) AS mn, stddev_pop(nation) AS sn
      FROM t1 WHERE part = 'train')
SELECT t1.id, t1.y, round((acctbal - ma) / CASE WHEN sa < 1e-6 THEN 1 ELSE sa END, 6) AS acctbal,
       round((nation - mn) / CASE WHEN sn < 1e-6 THEN 1 ELSE sn END, 6) AS nation,
       price_txt_code, priority_code, segment_code
FROM t1 JOIN w ON t1.id = w.id, z""")
def preprocessor_roundtrip(spark, sf_dir):
    """SNK7 + SRC10 + PRJ1/PRJ3b: fit the preprocessor (train-only N3 statistics,
    train+test reserved-slot vocabulary), save it to the shared folder, load it back
    and transform the train and test rows."""
    t = _t1(spark, sf_dir).where(F.col("part").isin("train", "test"))
    feats = ["id", "y", "price_txt", "acctbal", "nation", "priority", "segment"]
    tr, te = t.where(F.col("part") == "train").select(*feats), t.where(F.col("part") == "test").select(*feats)
    path = scratch_path(spark, "preprocessor")
    PP.fit_preprocessor(tr, te, "id", "y", MAX_CATS).save(path)
    pp = PP.load_preprocessor(spark, path)
    out = pp.transform(t.select(*feats))
    return out.select("id", "y", *[_r(c).alias(c) for c in _PP_NUM],
                      "price_txt_code", "priority_code", "segment_code")


# ---------------------------------------------------------------- more encoders and reports
_SQL_TT = f"t1 AS (SELECT * FROM ({fx.T1_SQL}) WHERE part IN ('train', 'test'))"


@register("vocab_first_seen", f"""WITH {_SQL_TT}, long AS ({_SQL_LONG_CATS}),
f AS (SELECT feature, value, min(id) AS first FROM long GROUP BY 1, 2)
SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY first, value))::INTEGER AS code FROM f""")
def vocab_first_seen(spark, sf_dir):
    """C5 + WN2c + AG7: codes from 1 in order of first appearance (smallest id) over
    train + test, 0 reserved for unknown; ranks come from the two-level row number."""
    t = _t1(spark, sf_dir)
    frames = [t.where(F.col("part") == "train"), t.where(F.col("part") == "test")]
    return E.vocab_first_seen(frames, T1_CATS, "id")


@register("fold_ordinal_vocab", f"""
WITH t AS (SELECT (id % 5)::INTEGER AS fold, priority, segment FROM ({fx.T1_SQL}) WHERE part = 'train'),
k AS (SELECT range::INTEGER AS k FROM range(5)),
lc AS (SELECT fold, 'priority' AS feature, priority AS v FROM t UNION ALL SELECT fold, 'segment', segment FROM t),
s AS (SELECT DISTINCT k.k, feature, v FROM lc JOIN k ON lc.fold <> k.k WHERE v IS NOT NULL)
SELECT k AS fold, feature, v AS value, (row_number() OVER (PARTITION BY k, feature ORDER BY v) - 1)::INTEGER AS code
FROM s""")
def fold_ordinal_vocab(spark, sf_dir):
    """C6: per fold, alphabetic ordinal codes of the categories seen in that fold's
    training rows (after mode imputation); unseen values map to -1 at lookup."""
    t = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    return E.fold_ordinal_vocab(t, ["priority", "segment"], "fold", N_FOLDS)


@register("dataset_profile", f"""WITH p AS (SELECT part, count(*) AS n_rows, count(DISTINCT id) AS n_ids,
  count(DISTINCT priority) AS nd_priority, count(DISTINCT segment) AS nd_segment, count(DISTINCT price_txt) AS nd_price_txt FROM ({fx.T1_SQL}) GROUP BY part)
SELECT *, least(nd_priority, nd_segment, nd_price_txt) AS cat_min,
       (nd_priority + nd_segment + nd_price_txt - least(nd_priority, nd_segment, nd_price_txt) - greatest(nd_priority, nd_segment, nd_price_txt))::DOUBLE AS cat_median,
       greatest(nd_priority, nd_segment, nd_price_txt) AS cat_max FROM p""")
def dataset_profile(spark, sf_dir):
    """AG23: rows, distinct ids, distinct categories per part (train/test/extra), and their least, median and greatest number."""
    return counts.dataset_profile(_t1(spark, sf_dir), "part", "id", ["priority", "segment", "price_txt"])


# Exact oracle for patience_pick: the same state machine as a recursive CTE.
ORACLES["patience_pick"] = f"""WITH RECURSIVE {_SQL_PARSED},
s AS (SELECT seed, fold, epoch, value, row_number() OVER (PARTITION BY seed, fold ORDER BY epoch, value) AS rn
      FROM parsed WHERE metric = 'val_logloss'),
r(seed, fold, rn, best, be, bad, stop, n) AS (
  SELECT seed, fold, rn, value, epoch, 0, NULL::BIGINT, 1 FROM s WHERE rn = 1
  UNION ALL
  SELECT s.seed, s.fold, s.rn,
         CASE WHEN s.value < r.best - {MIN_DELTA} THEN s.value ELSE r.best END,
         CASE WHEN s.value < r.best - {MIN_DELTA} THEN s.epoch ELSE r.be END,
         CASE WHEN s.value < r.best - {MIN_DELTA} THEN 0 ELSE r.bad + 1 END,
         CASE WHEN NOT (s.value < r.best - {MIN_DELTA}) AND r.bad + 1 >= {PATIENCE} THEN s.epoch END,
         r.n + 1
  FROM r JOIN s ON s.seed = r.seed AND s.fold = r.fold AND s.rn = r.rn + 1
  WHERE r.stop IS NULL),
fin AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY seed, fold ORDER BY rn DESC) = 1),
lst AS (SELECT seed, fold, max(epoch) AS le FROM s GROUP BY 1, 2)
SELECT fin.seed, fin.fold, be AS best_epoch, best AS best_value, coalesce(stop, le) AS stop_epoch, n::INTEGER AS n_evals
FROM fin JOIN lst ON fin.seed = lst.seed AND fin.fold = lst.fold"""


@register("adv_weights_linear")
def adv_weights_linear(spark, sf_dir):
    """ML10c: linear (not cross-fitted) train-vs-test classifier on at most 250,000
    hash-sampled rows per side; every training row's clipped odds [0.2, 5], mean 1."""
    fr = TB.encode_frame(spark, sf_dir)
    return CF.adversarial_weights_linear(fr.train, fr.test, [f"{c}_z" for c in TB.NUM],
                                         [f"{c}_code" for c in TB.CAT])


@register("fold_mean_loss", f"""
WITH t3 AS ({fx.T3_SQL}),
f AS (SELECT fold, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p1))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p1))))) AS l
      FROM t3 WHERE part = 'train' GROUP BY fold)
SELECT round(avg(l), 6) AS fold_mean_loss, count(*) AS n_folds FROM f""")
def fold_mean_loss(spark, sf_dir):
    """AG17: mean of the per-fold OOF log-losses of the p1 scores (from AG15's table)."""
    t3 = fx.closed_form_scores(_t1(spark, sf_dir)).where(F.col("part") == "train")
    m = M.cv_metrics(t3, "y", "p1", "fold")
    r = CF.fold_mean_loss(m)
    return r.select(_r("fold_mean_loss").alias("fold_mean_loss"), "n_folds")


@register("top_weights", _sql_trials() + """,
b AS (SELECT * FROM s ORDER BY loss, trial LIMIT 1),
w AS (SELECT 'p1' AS model, w0::DOUBLE AS weight FROM b UNION ALL SELECT 'p2', w1::DOUBLE FROM b
      UNION ALL SELECT 'p3', w2::DOUBLE FROM b)
SELECT model, weight FROM w WHERE weight > 1e-4 ORDER BY weight DESC, model LIMIT 10""")
def top_weights(spark, sf_dir):
    """TK3: the best grid trial's blend weights above 1e-4, largest first (at most 10)."""
    r = EN.score_trials(_aligned_oof(spark, sf_dir), "y", fx.MODELS, GRID, "logit")
    best = EN.best_trial(r)
    w = best.select(F.expr("stack(3, 'p1', w_p1, 'p2', w_p2, 'p3', w_p3) as (model, weight)"))
    return EN.top_weights(w, 10, 1e-4)


@register("gbt_c3_cv")
def gbt_c3_cv(spark, sf_dir):
    """ML3 + C3: a second boosted-tree family for diversity: raw categories (missing token)
    indexed by frequency with StringIndexer, shallower trees, another seed, row
    subsampling 0.7; 5-fold OOF table."""
    from pyspark.ml.feature import VectorAssembler
    fr = TB.encode_frame(spark, sf_dir)
    t = _t1(spark, sf_dir).where(F.col("part") == "train").select("id", *TB.CAT)
    x = FT.string_index(fr.train.join(t, "id"), TB.CAT)
    inputs = [f"{c}_z" for c in TB.NUM] + [f"{c}_idx" for c in TB.CAT]
    x = VectorAssembler(inputCols=inputs, outputCol="features_c3").transform(x.drop("features"))
    x = x.withColumnRenamed("features_c3", "features")
    return CF.cross_fit(x, lambda s: CF.gbt(s + 7, max_iter=GBT_ITER, max_depth=3, subsample=0.7)).oof


# ---------------------------------------------------------------- remaining forms
@register("numeric_policies_raw", f"""
WITH t AS (SELECT id, part, CASE WHEN isfinite(TRY_CAST(price_txt AS DOUBLE)) THEN TRY_CAST(price_txt AS DOUBLE) END AS pr, acctbal FROM ({fx.T1_SQL})),
z AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS s FROM t WHERE part = 'train')
SELECT id, round(coalesce(pr, 0), 6) AS n2_price_txt, CASE WHEN pr IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n2_price_txt_isnull,
       round(coalesce((acctbal - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END, 0), 6) AS n5_acctbal FROM t, z""")
def numeric_policies_raw(spark, sf_dir):
    """N2 (missing kept as an indicator beside the filled value) and N5 (scaled without text coercion, then gaps to 0)."""
    t = _t1(spark, sf_dir)
    st = E.fit_numeric_stats(t.where(F.col("part") == "train"), ["acctbal"], "nan_keep_inf")["acctbal"]
    x = E.keep_null_with_indicator(t, "price_txt")
    return x.select("id", _r("price_txt").alias("n2_price_txt"), F.col("price_txt_isnull").alias("n2_price_txt_isnull"),
                    _r(E.numeric_policy("acctbal", st, "std_then_zero_raw")).alias("n5_acctbal"))


@register("encode_first_seen", f"""WITH {_SQL_TT}, long AS ({_SQL_LONG_CATS}),
f AS (SELECT feature, value, min(id) AS first FROM long GROUP BY 1, 2),
v AS (SELECT feature, value, (row_number() OVER (PARTITION BY feature ORDER BY first, value))::INTEGER AS code FROM f),
a AS (SELECT * FROM ({fx.T1_SQL}))
SELECT id, {", ".join(f"coalesce((SELECT code FROM v WHERE feature = '{c}' AND value = coalesce(a.{c}, '__MISSING__')), 0) AS {c}_code" for c in T1_CATS)} FROM a""")
def encode_first_seen(spark, sf_dir):
    """C5 transform: codes by first appearance in train and test looked up for all rows; values only extra rows have are 0."""
    t = _t1(spark, sf_dir)
    vocab = E.vocab_first_seen([t.where(F.col("part").isin("train", "test"))], T1_CATS, "id")
    coded = E.lookup_codes(t.select("id", *T1_CATS), vocab, T1_CATS, 0)
    return coded.select("id", *[f"{c}_code" for c in T1_CATS])


@register("balanced_row_weights", f"""
WITH t AS (SELECT id, y, {H.sql_mul_bucket('id', SEED)} < {H.holdout_cut(VAL_FRAC, H.MUL_BUCKETS)} AS valid FROM ({fx.T1_SQL}) WHERE part = 'train'),
c AS (SELECT count(*) AS n, sum(y) AS n1 FROM t WHERE NOT valid)
SELECT id, y, round(CASE WHEN y > 0 THEN n / (2.0 * greatest(n1, 1)) ELSE n / (2.0 * greatest(n - n1, 1)) END, 9) AS w FROM t, c WHERE NOT valid""")
def balanced_row_weights(spark, sf_dir):
    """AG1 + AG2 row form: every training-side row with its class's n / (2 n_c), class counts from that side."""
    t = H.with_holdout_side(_t1_train(spark, sf_dir).select("id", "y"), "id", VAL_FRAC, SEED).where(F.col("side") == "train")
    w = {r["y"]: r["bal_weight"] for r in counts.balanced_weights(counts.class_counts(t, "y")).collect()}
    return counts.weight_with_balance(t, w).select("id", "y", _r("w", 9).alias("w"))


@register("class_counts_capped", f"""
WITH t AS (SELECT id, y FROM ({fx.T1_SQL}) WHERE part = 'train' ORDER BY {H.sql_mix64('id', SEED)}, id LIMIT 2000)
SELECT v.y::INTEGER AS y, (SELECT count(*) FROM t WHERE t.y = v.y) AS n FROM (VALUES (0), (1)) v(y)""")
def class_counts_capped(spark, sf_dir):
    """AG1 with a row cap (through TK4): class counts of the first 2,000 training rows in hash order."""
    return counts.class_counts(RK.sample_n(_t1_train(spark, sf_dir).select("id", "y"), 2000, "id", SEED), "y")


@register("submission_roundtrip", f"""SELECT id, round(greatest(0, least(1, 3 * p1 - 1)), 6) AS diagnosed_diabetes
FROM ({fx.T3_SQL}) WHERE part = 'test'""")
def submission_roundtrip(spark, sf_dir):
    """SNK1 + SNK4 + SRC5b: a submission, clipped to [0, 1], as gzip CSV and read back as stored."""
    sub = fx.submission_table(_t3(spark, sf_dir), "p1").select("id", (3 * F.col("diagnosed_diabetes") - 1).alias("p"))
    path = SK.write_submission(sub, scratch_path(spark, "submission"), compression="gzip")
    x = RD.read_submission_raw(spark, path, fmt="csv")
    return x.select("id", _r("diagnosed_diabetes").alias("diagnosed_diabetes"))


@register("series_summary", f"""WITH {_SQL_PARSED}
SELECT metric, count(DISTINCT (seed, fold)) AS n_series, count(*) AS n_rows, count(DISTINCT epoch) AS n_epochs FROM parsed GROUP BY metric""")
def series_summary(spark, sf_dir):
    """ST5 + AG23: series, rows and epochs of each metric of the logs."""
    m = materialise(_parsed(spark, sf_dir), "metrics")
    sizes = m.groupBy("metric").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("epoch").alias("n_epochs"))
    return LG.series_count(m).join(sizes, "metric")


@register("metrics_sorted", f"""WITH {_SQL_PARSED},
r AS (SELECT *, row_number() OVER (ORDER BY metric, seed, fold, epoch, value) - 1 AS place FROM parsed)
SELECT metric, min(place) AS first_place, max(place) AS last_place FROM r GROUP BY metric""")
def metrics_sorted(spark, sf_dir):
    """TK2 + SNK6: metric rows written in metric, seed, fold, epoch order; where each metric's rows stand in the files."""
    path = SK.write_metrics_sorted(_parsed(spark, sf_dir), scratch_path(spark, "sorted-metrics"))
    x = spark.read.parquet(path)
    return x.groupBy("metric").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@register("loss_summary", f"""WITH t3 AS ({fx.T3_SQL}), l AS ({_SQL_LONG_MODELS}),
x AS (SELECT model, avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS l FROM l GROUP BY model)
SELECT round(min(l), 6) AS loss_min, round(avg(l), 6) AS loss_mean, round(max(l), 6) AS loss_max FROM x""")
def loss_summary(spark, sf_dir):
    """AG22: least, mean and greatest of the models' own losses."""
    r = M.loss_summary(M.base_losses(_long_scores(spark, sf_dir)))
    return r.select(*[_r(c).alias(c) for c in r.columns])


@register("kept_categories", f"""WITH {_SQL_VC},
k AS (SELECT value FROM rk WHERE feature = 'price_txt' AND r <= 500)
SELECT id, coalesce(price_txt, '__MISSING__') IN (SELECT value FROM k) AS kept, CASE WHEN y::DOUBLE * 0.9 > 0.5 THEN 1 ELSE 0 END AS label FROM t1""")
def kept_categories(spark, sf_dir):
    """ST4 + TK1 + PRJ2 + PRJ7b: whether a row's price text is among the 500 most frequent, roles taken by column names,
    a real-valued target cut at 0.5."""
    from .functions import scalar as S
    t = _t1(spark, sf_dir)
    roles = R.infer_roles_by_name(t)
    top = E.vocab_alpha(E.value_counts([t], ["price_txt"]), 500).where(F.col("value") != S.OTHER_TOKEN).select(F.col("value").alias("text"))
    x = t.select(roles.id_col, S.fill_missing_token("price_txt").alias("text"), (F.col(roles.target_col) * 0.9).alias("soft"))
    return J.keep_if_in(x, top, "text").select("id", "kept", S.label_threshold("soft").alias("label"))


@register("train_valid_epochs", f"""WITH {_SQL_PARSED}
SELECT epoch, round(avg(CASE WHEN metric = 'train_bce' THEN value END), 6) AS train_bce,
       round(avg(CASE WHEN metric = 'val_logloss' THEN value END), 6) AS val_logloss FROM parsed
WHERE metric IN ('train_bce', 'val_logloss') GROUP BY epoch""")
def train_valid_epochs(spark, sf_dir):
    """AG20 report: epoch means of training and validation loss side by side."""
    x = LG.epoch_mean_side_by_side(_parsed(spark, sf_dir), ["train_bce", "val_logloss"])
    return x.select("epoch", _r("train_bce").alias("train_bce"), _r("val_logloss").alias("val_logloss"))


@register("stream_side_counts", f"""SELECT CASE WHEN {H.sql_mul_bucket('event_id', SEED)} < {H.holdout_cut(VAL_FRAC, H.MUL_BUCKETS)} THEN 'valid' ELSE 'train' END AS side,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_side_counts(spark, sf_dir):
    """SM2 + PRJ8: running class counts by hold-out side over the event stream."""
    s = H.with_holdout_side(_event_stream(spark, sf_dir), "event_id", VAL_FRAC, SEED)
    return SO.run_to_table(SO.stream_class_counts(s, (F.col("event_type") == "purchase").cast("int"), "side"), "side-counts")


@register("hist_gbt_cv", f"""WITH {_label_sql()}
SELECT fold, count(*) AS n_rows, count(DISTINCT id) AS n_ids, sum(y)::BIGINT AS n_pos, true AS in_range, true AS beats_prior FROM s GROUP BY fold""")
def hist_gbt_cv(spark, sf_dir):
    """ML6: histogram trees (255 bins) that stop early by themselves: a tenth of each fold's training side, chosen by
    id hash, is Spark's validation side (``validationIndicatorCol``)."""
    fr = TB.encode_frame(spark, sf_dir)
    tr = H.with_holdout_side(fr.train, "id", VAL_FRAC, SEED + 1).withColumn("is_valid", F.col("side") == "valid").drop("side")
    mk = lambda s: CF.gbt(s, max_iter=GBT_ITER, max_depth=GBT_DEPTH, valid="is_valid")
    return score_facts(CF.cross_fit(tr, mk).scored, ["fold"])


@register("adv_weights_b", f"""SELECT count(*) AS n, count(DISTINCT id) AS n_ids, true AS in_range, true AS finite FROM ({fx.T1_SQL}) WHERE part = 'train'""")
def adv_weights_b(spark, sf_dir):
    """ML10b: a neural train-versus-test classifier cross-fitted; odds clipped to [0.2, 5], not normalised."""
    fr = TB.encode_frame(spark, sf_dir)
    make = lambda s: CF.mlp(s, len(fr.inputs), (8,), max_iter=20)
    w = CF.adversarial_weights(fr.train, fr.test, fr.inputs, make=make, clip_range=(0.2, 5.0), normalise=False, assemble=_assembler(fr.inputs))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"),
                 F.bool_and(F.col("weight").between(0.2, 5.0)).alias("in_range"), F.bool_and(~F.isnan("weight")).alias("finite"))


_STACK_SQL = f"""WITH b AS (SELECT min(l) AS l FROM (SELECT avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))) AS l
  FROM (SELECT y, unnest([p1, p2, p3]) AS p, unnest(['p1', 'p2', 'p3']) AS m FROM ({fx.T3_SQL}) WHERE part = 'train') GROUP BY m))
SELECT form, (SELECT count(*) FROM ({fx.T3_SQL}) WHERE part = 'train') AS n_oof, (SELECT count(*) FROM ({fx.T3_SQL}) WHERE part = 'test') AS n_test,
  6 AS n_coef, true AS in_range, true AS no_worse_than_members, true AS auc_known FROM (VALUES ('1/(Cn)'), ('1/C')) v(form), b"""


@register("stack_report", _STACK_SQL)
def stack_report(spark, sf_dir):
    """ML12 + SC19: both penalties of the stack (per row 1/(C n); on the mean loss 1/C), on logits and probabilities of
    three aligned tables; coefficients, OOF loss and AUC reported. The first is no worse than its best member."""
    oof_w, test_w = materialise(_aligned_oof(spark, sf_dir), "stack-oof"), materialise(_aligned_subs(spark, sf_dir), "stack-test")
    mo, cols = EN.meta_features(oof_w, fx.MODELS, ["logit", "prob"])
    mt, _ = EN.meta_features(test_w, fx.MODELS, ["logit", "prob"])
    best = M.base_losses(oof_w.unpivot(["id", "y"], fx.MODELS, "model", "p")).agg(F.min("logloss")).first()[0]
    prior = oof_w.agg(F.avg("y")).first()[0]
    top = max(best, -(prior * math.log(prior) + (1 - prior) * math.log(1 - prior)))
    rows = []
    for form, mean_loss, bound in (("1/(Cn)", False, best), ("1/C", True, top)):
        _, sub, rep = CF.stack(mo, mt, cols, C=1.0, mean_loss=mean_loss)
        r = sub.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("diagnosed_diabetes").between(0, 1)).alias("ok")).first()
        rows.append((form, rep["n"], r["n"], len(rep["coef"]), r["ok"], rep["logloss"] <= bound + 1e-6, rep["auc"] is not None))
    return spark.createDataFrame(rows, "form string, n_oof bigint, n_test bigint, n_coef int, in_range boolean, "
                                       "no_worse_than_members boolean, auc_known boolean")


_SQL_TOKENS = " + ".join(f"len(list_filter(string_split('{c}=' || coalesce({c}, '__MISSING__'), ' '), lambda t: t <> ''))" for c in ("priority", "segment"))


@register("hash_totals", f"""SELECT id, ({_SQL_TOKENS})::BIGINT AS n_long, ({_SQL_TOKENS})::DOUBLE AS n_vector FROM ({fx.T1_SQL})""")
def hash_totals(spark, sf_dir):
    """SC8 + C1: both hashed forms, rows of (bucket, n) and a vector column, hold every token of a row once."""
    t = _t1(spark, sf_dir)
    long = FT.hashed_token_counts(t, "id", CAT, 1 << 18).groupBy("id").agg(F.sum("n").alias("n_long"))
    vector = F.aggregate(vector_to_array("cat_hash"), F.lit(0.0), lambda s, x: s + x)
    return FT.hashed_vector(t, CAT, 64).select("id", vector.alias("n_vector")).join(long, "id").select("id", "n_long", "n_vector")


@register("soft_label_rows", f"""WITH t AS (SELECT id, 0.7 * p1 + 0.3 * y AS s FROM ({fx.T3_SQL}) WHERE part = 'train')
SELECT id, 1.0::DOUBLE AS label, round(s, 9) AS sw FROM t WHERE s > 0 UNION ALL SELECT id, 0.0::DOUBLE, round(1 - s, 9) FROM t WHERE s < 1""")
def soft_label_rows(spark, sf_dir):
    """ML11 for weighted classifiers: each training row as label 1 with its soft target's weight and label 0 with the rest."""
    t3 = _t3(spark, sf_dir)
    rows = J.distill_targets(t3.where(F.col("part") == "train").select("id", "y"), fx.oof_table(t3, "p1"), "id", "y", 0.7, 0.0)
    return J.soft_label_rows(rows).select("id", "label", _r("sw", 9).alias("sw"))
