"""Column-expression helpers.  All of them are built-in Spark expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the portable hash (15 hexadecimal digits of MD5) and of a double's fraction.
HASH_BITS = 60
UNIT_BITS = 53


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace of every kind (Python ``str.strip()``);
    Spark's ``trim`` removes spaces only."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def strip_chars(c: Column | str, chars: str) -> Column:
    """Strip a set of literal characters from both ends (``str.strip(chars)``)."""
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(col_(c), f"^[{cls}]+|[{cls}]+$", "")


def doi_journal(doi: Column | str) -> Column:
    """Journal token of a DOI: the text after its 8th character up to the first dot."""
    return F.split_part(F.substr(col_(doi), F.lit(9)), F.lit("."), F.lit(1))


def non_blank(c: Column | str) -> Column:
    """True when the text is neither null nor empty."""
    return col_(c).isNotNull() & (col_(c) != "")


def not_in_keep_null(c: Column | str, values: list) -> Column:
    """pandas ``~s.isin(values)``: nulls are kept (Spark's ``~isin`` drops them)."""
    return col_(c).isNull() | ~col_(c).isin(values)


def cantor_pair(k1: Column | str, k2: Column | str, unordered: bool = False) -> Column:
    """Cantor pairing (k1+k2)(k1+k2+1)/2 + k2 of non-negative ids; the unordered
    variant pairs (max, min) so that (a, b) and (b, a) meet.  Exact while < 2^63."""
    a, b = col_(k1).cast("bigint"), col_(k2).cast("bigint")
    if unordered:
        a, b = F.greatest(a, b), F.least(a, b)
    return _triangle(a + b) + b


def _triangle(s: Column) -> Column:
    """s(s+1)/2 without the overflow of s(s+1)."""
    half, odd = F.shiftright(s, 1), s.bitwiseAND(F.lit(1).cast("bigint"))
    return F.when(odd == 0, half * (s + 1)).otherwise(s * (half + 1))


def cantor_unpair(z: Column | str) -> tuple[Column, Column]:
    """Inverse of :func:`cantor_pair` (ordered form): the square root in doubles is off by
    one at most, which two comparisons of whole numbers put right."""
    zc = col_(z).cast("bigint")
    near = F.floor((F.sqrt(zc.cast("double") * 8 + 1) - 1) / 2).cast("bigint")
    w = F.when(_triangle(near) > zc, near - 1).when(_triangle(near) + near + 1 <= zc, near + 1).otherwise(near)
    k2 = zc - _triangle(w)
    return w - k2, k2


def safe_log(c: Column | str, minval: float = 1e-12) -> Column:
    """Natural log with a floor: ``log(max(x, minval))``."""
    return F.log(F.greatest(col_(c).cast("double"), F.lit(float(minval))))


def hash_int(*parts: Column | str | int) -> Column:
    """Portable mixing hash in [0, 2^60): the first 15 hexadecimal digits of the MD5 of
    the parts as whole numbers, joined by ``|``.  DuckDB computes the same."""
    texts = [F.lit(str(p)) if isinstance(p, int) else col_(p).cast("bigint").cast("string") for p in parts]
    return F.conv(F.substr(F.md5(F.concat_ws("|", *texts)), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("bigint")


def text_hash_int(c: Column | str) -> Column:
    """:func:`hash_int` of a text."""
    return F.conv(F.substr(F.md5(col_(c)), F.lit(1), F.lit(HASH_BITS // 4)), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) from the top 53 bits of :func:`hash_int`."""
    return F.shiftright(hash_int(*parts), HASH_BITS - UNIT_BITS).cast("double") / float(1 << UNIT_BITS)


def hash_sql(*parts: str) -> str:
    """The DuckDB spelling of :func:`hash_int` for the oracle."""
    joined = " || '|' || ".join(f"CAST(CAST({p} AS BIGINT) AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, {HASH_BITS // 4}) AS BIGINT)"


def uniform_sql(*parts: str) -> str:
    return f"(CAST({hash_sql(*parts)} >> {HASH_BITS - UNIT_BITS} AS DOUBLE) / {float(1 << UNIT_BITS)!r})"


# ---- arrays as vectors -------------------------------------------------------

def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm2(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two aligned vectors; null when either has zero norm."""
    den = norm2(a) * norm2(b)
    return F.when(den > 0, dot(a, b) / den)


def l2_normalize(a: Column | str) -> Column:
    """Divide by the L2 norm; a zero vector stays unchanged."""
    n = norm2(a)
    return F.when(n > 0, F.transform(col_(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(col_(a), lambda x: x.cast("double")))
