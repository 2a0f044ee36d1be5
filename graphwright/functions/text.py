"""Text expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, plus the separators that str.strip() removes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip_blanks(col: Column) -> Column:
    """Remove leading and trailing Unicode white space (SQL ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(BLANKS))


def collapse_blanks(col: Column) -> Column:
    """Strip, and turn each inner run of Unicode white space into one space."""
    return strip_blanks(F.regexp_replace(col, f"{WS}+", " "))


def casefold(col: Column) -> Column:
    """Lower case with the full folds that ``lower`` leaves alone (sharp s, ligatures, final sigma)."""
    out = F.lower(col)
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ς", "σ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return col.isNull() | (F.length(strip_blanks(col)) == 0)


def source_of(key: Column) -> Column:
    """The part of a key before its last ``/``; the whole key if it has none; null for null."""
    return F.when(F.instr(key, "/") > 0, F.regexp_replace(key, "/[^/]*$", "")).otherwise(key)


def iso_utc(at: Column) -> Column:
    """Instant as text: date, ``T``, time, microseconds only where there are any, ``+00:00``; null for null (the session's time zone must be UTC)."""
    at = at.cast("timestamp")
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000).cast("bigint"))
    part = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def json_string(col: Column) -> Column:
    """A text as a JSON string with everything outside printable ASCII escaped; null for null."""
    short = F.create_map(*[F.lit(x) for kv in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items() for x in kv])
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escape(ch: Column) -> Column:
        n = F.ascii(ch)
        high = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(short[ch].isNotNull(), short[ch]).when((n >= 32) & (n <= 126), ch).when(n > 0xFFFF, high).otherwise(unit(n))

    plain = F.concat(F.lit('"'), col, F.lit('"'))
    return F.when(col.rlike(r"^[ !#-\[\]-~]*$"), plain).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(col, ""), escape), ""), F.lit('"')))
