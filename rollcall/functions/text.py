"""String functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The title prefixes removed by strip_titles.
TITLES = "gs|pgs|ts|ths|th\\.s|bs|ks|cn|ncs|prof|dr|mr|mrs|ms|ong|ba"
UNKNOWN_IDENTITY = "(không rõ)"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(as_column(c), F.lit(""))


def null_to_blank(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def cell(c: Column | str) -> Column:
    """White space collapsed to one blank and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(null_to_blank(c), "\\s+", " "))


@functools.cache
def _accent_map() -> tuple[str, str]:
    """Every BMP letter that decomposes to one base letter, and that letter; made from the Unicode data."""
    source, target = [], []
    for code in range(0xA0, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


def strip_diacritics(c: Column | str) -> Column:
    """Base letters only, đ to d; combining marks go."""
    source, target = _accent_map()
    return F.regexp_replace(F.translate(as_column(c), source, target), "\\p{Mn}", "")


def strip_titles(c: Column | str) -> Column:
    """Up to four leading titles removed; a text made of titles only stays."""
    one = f"(?i)^({TITLES})(?=[^A-Za-z0-9_]|$)[.\\s]*"
    out = whole = cell(c)
    for _ in range(4):
        out = F.regexp_replace(out, one, "")
    return F.when(F.trim(out) == "", whole).otherwise(F.trim(out))


def blocking_key(c: Column | str) -> Column:
    """Lower-case ASCII words of a name without titles and accents."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(strip_titles(c))), "[^a-z0-9]+", " "))


def email(c: Column | str) -> Column:
    """Lower-case address, '' if it isn't one."""
    v = F.lower(cell(c))
    return F.when(v.rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), v).otherwise(F.lit(""))


def phone(c: Column | str) -> Column:
    """Digits; the country code 84 becomes 0 in numbers of more than nine digits."""
    v = F.regexp_replace(F.regexp_replace(null_to_blank(c), "[^0-9+]", ""), "^\\+", "")
    return F.when(v.startswith("84") & (F.length(v) > 9), F.concat(F.lit("0"), F.substring(v, 3, 1 << 20))).otherwise(v)


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), "[^0-9]", "")


def identity(name: Column | str, organization: Column | str, role: Column | str) -> Column:
    """'name | organization | role' of the parts that aren't blank."""
    joined = F.concat_ws(" | ", *(F.nullif(cell(x), F.lit("")) for x in (name, organization, role)))
    return F.when(joined == "", F.lit(UNKNOWN_IDENTITY)).otherwise(joined)


def join_values(values: Column) -> Column:
    """Values of several columns that feed one field, joined by ' / '."""
    return F.array_join(F.filter(values, lambda x: x != ""), " / ")


def trim_extension(c: Column | str) -> Column:
    """File name without an extension of up to six characters."""
    return F.regexp_replace(as_column(c), "\\.[^./\\\\]{0,6}$", "")


def truncate(c: Column | str, n: int) -> Column:
    v = as_column(c)
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n - 1), F.lit("…"))).otherwise(v)


def trim_lower(c: Column | str) -> Column:
    return F.lower(F.trim(null_to_blank(c)))


def split_list(c: Column | str) -> Column:
    """Non-blank parts of a comma list."""
    return F.filter(F.transform(F.split(null_to_blank(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def tenant_key(claim: Column | str, second_claim: Column | str, uid: Column | str) -> Column:
    """The first claim that is a valid key, else org_user_ and 24 hex digits of the user's hash."""
    ok = "^[a-zA-Z0-9._-]{1,128}$"
    own = F.concat(F.lit("org_user_"), F.substring(F.sha2(as_column(uid), 256), 1, 24))
    return F.coalesce(*(F.when(as_column(x).rlike(ok), as_column(x)) for x in (claim, second_claim)), own)


def number_text(c: Column | str) -> Column:
    """A sheet's number as text: its shortest decimal without an exponent, whole numbers without a point."""
    v = as_column(c).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    shown = v.cast("string")
    sign, digits = F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(F.regexp_extract(shown, "^-?([0-9.]+)", 1), "\\.0$|\\.", "")
    power = F.regexp_extract(shown, "E(-?[0-9]+)$", 1).try_cast("int")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    point = F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substr(digits, power + 2))).otherwise(F.lit(""))
    large = F.concat(sign, F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0")), point)
    return F.when(whole, v.cast("bigint").cast("string")).when(power < 0, small).when(power >= 0, large).otherwise(F.regexp_replace(shown, "\\.0$", ""))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def version_at_least(version: str, wanted: tuple[int, int, int] = (0, 8, 0)) -> bool:
    """Numeric comparison of dotted versions; anything else is not enough."""
    parts = version.split(".")
    if len(parts) < 2 or not all(p.isdigit() for p in parts[:3]):
        return False
    return tuple(map(int, (parts + ["0", "0"])[:3])) >= wanted


def stable_id(*parts: Column | str) -> Column:
    """An id that a repeated task makes again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(null_to_blank(p) for p in parts)), 256), 1, 32)
