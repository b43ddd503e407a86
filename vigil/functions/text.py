"""Text and number formatting expressions (Python formatting semantics).

Python's ``round`` / ``f'{x:.nf}'`` round the exact binary value of a double,
half-even only on exact ties.  Spark's ``bround``/``format_number`` round the
shortest decimal representation, which differs when that representation is a
tie but the binary value is not (1.15 is stored as 1.149999…, Python gives
1.1, ``bround`` 1.2).  ``py_round`` detects such representation ties and
decides the side with an error-free product (Dekker split), all in column
arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitter for doubles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_round(x, digits: int) -> Column:
    """Python ``round(x, digits)`` for a DOUBLE column, as DECIMAL(38, digits)."""
    x = _c(x).cast("double")
    ax = F.abs(x)
    s = ax.cast(DecimalType(38, 18))            # shortest repr, exact for short reprs
    scaled = s * F.lit(10 ** (digits + 1))      # decimal, exact
    is_tie = (scaled == F.floor(scaled)) & ((F.floor(scaled) % 10) == 5)
    # tie value t: t * 2 * 10^digits = scaled / 5 = odd integer n
    n = (F.floor(scaled) / 5).cast("long")
    m = float(2 * 10 ** digits)
    # exact product ax * m = p + err
    p = ax * F.lit(m)
    cc = ax * F.lit(_SPLIT)
    hi = cc - (cc - ax)
    lo = ax - hi
    err = (hi * F.lit(m) - p) + lo * F.lit(m)
    side = (p - n.cast("double")) + err        # sign of (ax - t)
    k_low = ((n - 1) / 2).cast("long")          # lower neighbour (in units of 10^-digits)
    tie_units = (F.when(side > 0, k_low + 1)
                 .when(side < 0, k_low)
                 .otherwise(F.when(k_low % 2 == 0, k_low).otherwise(k_low + 1)))
    scale = F.lit(10 ** digits).cast(DecimalType(38, 0))
    tie_val = (tie_units.cast(DecimalType(38, 0)) / scale).cast(DecimalType(38, digits))
    plain = F.bround(s, digits).cast(DecimalType(38, digits))
    mag = F.when(is_tie, tie_val).otherwise(plain)
    return F.when(x < 0, -mag).otherwise(mag)


def fmt_fixed(x, digits: int) -> Column:
    """Python ``f'{x:.{digits}f}'`` for finite doubles."""
    if digits == 0:
        return fmt_int0(x)
    return py_round(x, digits).cast("string")


def fmt_int0(x) -> Column:
    """Python ``f'{x:.0f}'``: ties at .5 are exact doubles, so ``bround`` agrees."""
    return F.bround(_c(x).cast("double"), 0).cast("long").cast("string")


def py_dict_text(m) -> Column:
    """``str(dict)`` of a map<string, number> in its entry order: ``{'a': 1}``."""
    entries = F.transform(F.map_entries(_c(m)),
                          lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def bar(n) -> Column:
    """Text bar of ``n`` blocks (n < 0 gives an empty bar)."""
    return F.repeat(F.lit("█"), F.greatest(_c(n).cast("int"), F.lit(0)))


def ljust(x, width: int) -> Column:
    """Python ``f'{x:<w}'`` (pads, never cuts)."""
    x = _c(x).cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, " "))


def rjust(x, width: int) -> Column:
    """Python ``f'{x:>w}'`` (pads, never cuts)."""
    x = _c(x).cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, " "))


def iso_text(ts) -> Column:
    """Python ``datetime.isoformat()``: 'T' separator, 6 fraction digits only
    when the microseconds are non-zero."""
    ts = _c(ts)
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def report_file_name(kind: str, ts, report_type: str | None = None, user=None) -> Column:
    """E5: report ids — ``threat_report_<type>_<yyyyMMdd_HHmmss>.txt`` or
    ``investigation_<user>_<yyyyMMdd_HHmmss>.txt``."""
    stamp = F.date_format(_c(ts), "yyyyMMdd_HHmmss")
    if kind == "threat":
        return F.concat(F.lit(f"threat_report_{report_type or 'daily'}_"), stamp, F.lit(".txt"))
    return F.concat(F.lit("investigation_"), _c(user), F.lit("_"), stamp, F.lit(".txt"))


def tmpl(fmt: str, *vals) -> Column:
    """Fill the ``{}`` slots of a fixed text with column values (in order)."""
    parts = fmt.split("{}")
    if len(parts) != len(vals) + 1:
        raise ValueError(f"{fmt!r} has {len(parts) - 1} slots, got {len(vals)} values")
    out = [F.lit(parts[0])]
    for v, p in zip(vals, parts[1:]):
        out += [_c(v).cast("string"), F.lit(p)]
    return F.concat(*out)


def scaled_bar(value: Column, factor: float, longest: int) -> Column:
    """A bar of ``int(value * factor)`` blocks, at most ``longest``."""
    return bar(F.least((value * factor).cast("int"), F.lit(longest)))


def capitalised(x) -> Column:
    """Python ``str.capitalize``: the first letter upper, the rest lower case."""
    x = _c(x).cast("string")
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def slug(x, longest: int = 40) -> Column:
    """A file name part: lower case, blanks as ``_``, without brackets and
    commas, cut at ``longest``."""
    return F.left(F.regexp_replace(F.translate(F.lower(_c(x).cast("string")), " ", "_"), "[(),]", ""), F.lit(longest))
