"""Reproducible id hashing in exact unsigned 64-bit arithmetic.

Spark has no unsigned 64-bit type and ANSI mode raises on ``bigint``
overflow, so a 64x64-bit product is formed from four 16-bit limbs whose
partial products never exceed 2^35. The bit pattern of a ``bigint`` column is
treated as the uint64 value (negative ids wrap, as a C cast would).

Each step is added as its own projected column: Catalyst keeps a projection
whose expensive result is referenced more than once instead of inlining it,
so chained multiplies do not grow into an exponentially large expression.
The finished hash leaves through a one-element ``explode``: a predicate on it
(a user filter, or the ``isnotnull`` Catalyst infers for a join key) then
stops at the generator instead of being rewritten through every alias below
it, which would again inline the chain and overflow the 64 KB codegen method
limit. Whole-stage codegen still fuses the steps and the generator.

Two hashes are provided:

* ``with_mul_bucket`` (H1): ``((id xor seed) * K) >> 32`` mod 1,000,000.
* ``with_mix_bucket`` (H2): xor with seed and K, murmur3 64-bit finaliser
  (two multiplies, three xor-shifts), unsigned mod 10,000. The full mixed
  64-bit value doubles as the row-order key for folds and sampling.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical splits:
#   multiplicative constant K (2^64 / golden ratio) = 0x9E3779B97F4A7C15
#   murmur3 finaliser multipliers                  = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#   finaliser shift                                = 33
#   H1 bucket space                                = 1,000,000 (high 32 bits of the product)
#   H2 bucket space                                = 10,000
GOLDEN = 0x9E3779B97F4A7C15
MIX_MUL_1 = 0xFF51AFD7ED558CCD
MIX_MUL_2 = 0xC4CEB9FE1A85EC53
MIX_SHIFT = 33
MUL_BUCKETS = 1_000_000
MIX_BUCKETS = 10_000

_MASK16 = 0xFFFF
_U64 = 1 << 64


def _signed(v: int) -> int:
    """uint64 constant -> the signed bigint with the same bits."""
    v %= _U64
    return v - _U64 if v >= (1 << 63) else v


def _lit64(v: int) -> Column:
    return F.lit(_signed(v)).cast("bigint")


def _tmp() -> str:
    return f"__h{uuid.uuid4().hex[:8]}"


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(_MASK16).cast("bigint"))
            for i in range(4)]


def _mul_expr(x: Column, const: int) -> Column:
    """``(x * const) mod 2^64`` with x read as uint64 bits, as one expression.

    Limb products are at most 2^32 and carries stay below 2^20, so no step
    can overflow a signed bigint. Repeated sub-terms are shared by Catalyst's
    subexpression elimination inside the single projection.
    """
    m = [(const >> (16 * j)) & _MASK16 for j in range(4)]
    a = _limbs(x)
    mask = F.lit(_MASK16).cast("bigint")
    out, carry = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for k in range(4):
        r = carry
        for i in range(k + 1):
            if m[k - i]:
                r = r + a[i] * F.lit(m[k - i]).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(r.bitwiseAND(mask), 16 * k))
        carry = F.shiftright(r, 16)
    return out


def _mul_const(df: DataFrame, src: str, const: int, dst: str) -> DataFrame:
    return df.select("*", _mul_expr(F.col(src), const).alias(dst))


def _xorshift(df: DataFrame, src: str, shift: int, dst: str) -> DataFrame:
    x = F.col(src)
    return df.select("*", x.bitwiseXOR(F.shiftrightunsigned(x, shift)).alias(dst))


def _fence(df: DataFrame, expr: Column, dst: str) -> DataFrame:
    """Add ``expr`` as ``dst`` behind a Generate node (an optimizer barrier, see module doc)."""
    return df.select("*", F.explode(F.array(expr)).alias(dst))


def _id_bits(id_col: str) -> Column:
    """The id as bigint bits; null -> 0 as in the reference's id coercion."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint"))


def _unsigned_mod(x: Column, m: int) -> Column:
    """(x as uint64) mod m, for m < 2^31, without overflow."""
    hi = F.shiftrightunsigned(x, 32)
    lo = x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    two32 = (1 << 32) % m
    return F.pmod(F.pmod(hi, F.lit(m)) * F.lit(two32) + F.pmod(lo, F.lit(m)), F.lit(m))


def with_mul_bucket(df: DataFrame, id_col: str, seed: int, out: str = "bucket") -> DataFrame:
    """Add H1: ``((id ^ seed) * K >> 32) mod 1e6`` as ``out`` (bigint in [0, 1e6))."""
    t0, t1 = _tmp(), _tmp()
    df = df.select("*", _id_bits(id_col).bitwiseXOR(_lit64(seed)).alias(t0))
    df = _mul_const(df, t0, GOLDEN, t1)
    b = F.pmod(F.shiftrightunsigned(F.col(t1), 32), F.lit(MUL_BUCKETS))
    return _fence(df, b, out).drop(t0, t1)


def with_mix64(df: DataFrame, id_col: str, seed: int, out: str = "mix64") -> DataFrame:
    """Add the murmur-finalised 64-bit mix of ``id`` (uint64 bits in a bigint)."""
    t = [_tmp() for _ in range(5)]
    df = df.select("*", _id_bits(id_col).bitwiseXOR(_lit64(seed ^ GOLDEN)).alias(t[0]))
    df = _xorshift(df, t[0], MIX_SHIFT, t[1])
    df = _mul_const(df, t[1], MIX_MUL_1, t[2])
    df = _xorshift(df, t[2], MIX_SHIFT, t[3])
    df = _mul_const(df, t[3], MIX_MUL_2, t[4])
    x = F.col(t[4])
    return _fence(df, x.bitwiseXOR(F.shiftrightunsigned(x, MIX_SHIFT)), out).drop(*t)


def with_mix_bucket(df: DataFrame, id_col: str, seed: int, out: str = "bucket") -> DataFrame:
    """Add H2: the mixed value mod 10,000 (unsigned)."""
    t = _tmp()
    df = with_mix64(df, id_col, seed, t)
    return df.select("*", _unsigned_mod(F.col(t), MIX_BUCKETS).alias(out)).drop(t)


def unsigned_order_key(x: Column) -> Column:
    """Signed bigint whose natural order equals the uint64 order of ``x``."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def leading_bits(x: Column, bits: int) -> Column:
    """Top ``bits`` bits of uint64 ``x`` -> bucket in [0, 2^bits), monotone in the uint64 order."""
    return F.shiftrightunsigned(x, 64 - bits)


def holdout_cut(frac: float, buckets: int) -> int:
    """Bucket threshold: frac <= 0 keeps nothing out, frac >= 1 everything."""
    if frac <= 0:
        return 0
    if frac >= 1:
        return buckets
    return int(frac * buckets)


def with_holdout_side(df: DataFrame, id_col: str, frac: float, seed: int,
                      method: str = "mul", out: str = "side") -> DataFrame:
    """Label each row ``'valid'`` or ``'train'`` by its id hash (PRJ8).

    A pure per-row predicate: no shuffle, and ``.where(side == 'train')``
    stays a filter in the scan stage.
    """
    if method == "mul":
        cut, tmp = holdout_cut(frac, MUL_BUCKETS), _tmp()
        df = with_mul_bucket(df, id_col, seed, tmp)
    elif method == "mix":
        cut, tmp = holdout_cut(frac, MIX_BUCKETS), _tmp()
        df = with_mix_bucket(df, id_col, seed, tmp)
    else:
        raise ValueError("method must be 'mul' or 'mix'")
    side = F.when(F.col(tmp) < F.lit(cut), F.lit("valid")).otherwise(F.lit("train"))
    return df.select("*", side.alias(out)).drop(tmp)


# ---------------------------------------------------------------- SQL twins
# DuckDB text for the same hashes, used by the oracle queries.

def sql_u64(expr: str) -> str:
    return (f"((({expr})::HUGEINT % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT)"
            f" % 18446744073709551616::HUGEINT)::UBIGINT")


def _sql_mul(expr: str, const: int) -> str:
    return f"((({expr})::UHUGEINT * {const}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _sql_xs(expr: str) -> str:
    return f"xor({expr}, ({expr}) >> {MIX_SHIFT})"


def sql_mul_bucket(id_expr: str, seed: int) -> str:
    return f"(({_sql_mul(f'xor({sql_u64(id_expr)}, {seed}::UBIGINT)', GOLDEN)}) >> 32) % {MUL_BUCKETS}"


def sql_mix64(id_expr: str, seed: int) -> str:
    x = f"xor({sql_u64(id_expr)}, {(seed ^ GOLDEN) % _U64}::UBIGINT)"
    x = _sql_xs(x)
    x = _sql_mul(x, MIX_MUL_1)
    x = _sql_xs(x)
    x = _sql_mul(x, MIX_MUL_2)
    return _sql_xs(x)


def sql_mix_bucket(id_expr: str, seed: int) -> str:
    return f"(({sql_mix64(id_expr, seed)}) % {MIX_BUCKETS})"
