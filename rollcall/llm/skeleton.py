"""Problem 5: one consistent form for text that looks the same.

Skeleton: decompose (NFKD and canonical order), drop what can't be seen, replace every character by its prototype from
the look-alike table, decompose again; equal skeletons look equal. The table is the public confusables table that comes
with Spark's own ICU library: it is asked once on the driver, in some dozen calls, and travels to the tasks (some thousand
entries, whatever the data). Originals are grouped by equal skeleton; the usual form of a group is its most frequent
member that is written as usual, and a member is unusual if it isn't written as the usual form of its group.

Written as usual means: composed (NFC), usual spaces and widths, letters of one script per word. A word keeps its
script if it is written wholly in it: look-alike letters are only replaced in words that mix scripts, or in words made
of nothing but look-alikes standing beside words of the other script.

Defined results: null gives null, '' gives '', white space other than U+0020 becomes U+0020 (edges and runs stay as
typed), texts of any length are handled whole, other columns are passed by; members of a group that occur equally often:
the smaller one is its usual form; a group without a member written as usual has its own reading as usual form.

Scale: spellings are counted before their skeleton is made, so a value that fills a third of the table is one row; rows
whose value has only plain characters are set aside by a JVM expression and never meet the groups.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rollcall.session import broadcast_if_small

# Letters whose prototype in the public table isn't the letter they are taken for in a name, each with that letter.
BESIDES = dict("кk κk τt υu χx ωw ðđ ÐĐ ɖđ ƉĐ ʋv ſs".split())
_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"


def _plain_letters() -> str:
    """Composed Latin letters of the usual form up to U+1EFF, from the Unicode data."""
    inside = (*range(0xC0, 0x180), *range(0x1A0, 0x1B1), *range(0x1EA0, 0x1EFA))
    return "".join(c for c in map(chr, inside) if unicodedata.category(c) in ("Ll", "Lu") and unicodedata.normalize("NFKC", c) == c and c not in BESIDES and c != "ı")


_USUAL = _plain_letters()
PLAIN = "^[ -~" + _USUAL + "]*$"
_plain = re.compile(PLAIN).match


@functools.lru_cache(1 << 16)
def _script(ch: str) -> str:
    """LATIN, GREEK, CYRILLIC and so on for letters, '' for everything else."""
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    if not unicodedata.category(ch).startswith("L"):
        return ""
    return unicodedata.name(ch, "").split(" ")[0].replace("MICRO", "GREEK")


class LookAlikes:
    """The look-alike table. prototype: character to prototype; latin: letters and signs to the usual characters they are taken for; back: by script, Latin letters to that script's own."""

    def __init__(self, prototype: dict[str, str]):
        self.prototype = dict(prototype)
        usual = {c: unicodedata.name(c)[-1].lower() for c in map(chr, range(0x250, 0xA800)) if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", unicodedata.name(c, ""))}
        self.latin: dict[str, str] = dict(usual)
        for c in _USUAL:
            usual.setdefault(unicodedata.normalize("NFD", self._mapped(unicodedata.normalize("NFD", c))), c)
        for c, p in prototype.items():
            if c in _USUAL or c.isascii():
                continue
            taken = self._taken(c, p, usual)
            if taken:
                self.latin[c] = taken
        self.latin |= BESIDES
        # What is taken for a letter has that letter's prototype, so that readings keep the skeleton.
        for c, taken in self.latin.items():
            self.prototype[c] = self._mapped(unicodedata.normalize("NFD", taken))
        self.back: dict[str, dict[str, str]] = {}
        for c in sorted(self.latin, reverse=True):
            taken = self.latin[c]
            if len(taken) == 1 and _script(c) not in ("", "LATIN"):
                self.back.setdefault(_script(c), {})[taken] = c

    @staticmethod
    def _taken(c: str, p: str, usual: dict[str, str]) -> str:
        """The usual letter or sign a character is taken for, in its own case; '' if it isn't a look-alike of one."""
        kind = unicodedata.category(c)
        if kind in ("Lu", "Ll", "Lo", "Lm"):
            if p == "l":
                return "I" if kind == "Lu" else "l"
            if p == "rn":
                return "m"
            if len(p) == 1 and p.isascii() and (p.isalpha() or (kind == "Lm" and not p.isalnum())):
                return p
            return usual.get(unicodedata.normalize("NFD", p), "") if kind in ("Lu", "Ll") else ""
        return p if kind[0] in "PS" and kind != "Sc" and len(p) == 1 and p.isascii() and not p.isalnum() else ""

    def _mapped(self, text: str) -> str:
        return "".join(self.prototype.get(c, c) for c in text)

    def skeleton(self, text: str) -> str:
        """Decomposed, every character replaced by its prototype, decomposed again."""
        return unicodedata.normalize("NFD", self._mapped(unicodedata.normalize("NFKD", _visible(text))))

    def _word(self, word: str, scripts: set[str], latin: bool) -> str:
        """A decomposed word with look-alikes replaced where it mixes scripts; latin: other words are Latin, and none shows another script."""
        if scripts <= {"LATIN"}:
            return word
        read = self.latin
        foreign = [c for c in word if _script(c) not in ("", "LATIN")]
        if "LATIN" not in scripts:
            return "".join(read.get(c, c) for c in word) if latin and all(c in read for c in foreign) else word
        shown = {_script(c) for c in foreign if c not in read}
        borrowed = [c for c in word if _script(c) == "LATIN"]
        own = {_script(c) for c in foreign}
        if len(own) == 1 and (shown or (not latin and len(foreign) > len(borrowed))):
            back = self.back.get(next(iter(own)), {})
            if all(c in back for c in borrowed):
                return "".join(back.get(c, c) for c in word)
        return "".join(read.get(c, c) for c in word)

    def reading(self, text: str) -> str:
        """The text as it is usually written; the text itself if nothing in it is unusual."""
        if _plain(text):
            return text
        plain = unicodedata.normalize("NFKD", _visible(text))
        same = {c: t for c in set(plain) if (t := self.latin.get(c)) and _script(c) in ("", "LATIN")}
        words = "".join(same.get(c, c) for c in plain).split(" ")
        scripts = [{s for c in w if (s := _script(c))} for w in words]
        shows = any(_script(c) not in ("", "LATIN") and c not in self.latin for w, s in zip(words, scripts) if "LATIN" not in s for c in w)
        latin = not shows and any("LATIN" in s for s in scripts)
        return unicodedata.normalize("NFC", " ".join(self._word(w, s, latin) for w, s in zip(words, scripts)))


def _visible(text: str) -> str:
    """Without characters that take no room; every space as U+0020."""
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if kind == "Zs" or ch in "\t\n\r\v\f\x85  ":
            out.append(" ")
        elif kind in ("Cf", "Cc") or ch in _INVISIBLE or "︀" <= ch <= "️":
            continue
        else:
            out.append(ch)
    return "".join(out)


_table: LookAlikes | None = None
_shared: dict[str, Broadcast] = {}


def use(table: LookAlikes) -> None:
    """Makes a table the one consistent_form() and skeleton() of this process use."""
    global _table
    if _table is not table:
        _table = table
        consistent_form.cache_clear()


def look_alike_table(spark: SparkSession) -> Broadcast:
    """The public look-alike table, read once per application from Spark's ICU library (its size doesn't depend on the data); also used in this process."""
    known = _shared.get(spark.sparkContext.applicationId)
    if known is None:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        prototypes = {}
        for start in range(0, 0x30000, 1 << 12):
            letters = [c for c in map(chr, range(max(start, 0x21), start + (1 << 12))) if unicodedata.category(c)[0] not in "CZ"]
            if letters:
                found = checker.getSkeleton("\n".join(letters)).split("\n")
                prototypes |= {c: p for c, p in zip(letters, found, strict=True) if p != unicodedata.normalize("NFD", c)}
        table = LookAlikes(prototypes)
        _shared.clear()
        known = _shared[spark.sparkContext.applicationId] = spark.sparkContext.broadcast(table)
        use(table)
    return known


def skeleton(text: str | None) -> str | None:
    return None if text is None else _table.skeleton(text)


@functools.lru_cache(1 << 15)
def consistent_form(text: str | None) -> str | None:
    """The value as it is usually written, by the table in use."""
    return text if text is None or _plain(text) else _table.reading(text)


def _read(spark: SparkSession) -> Callable[[Column], Column]:
    """A function that gives a value's skeleton and reading."""
    table = look_alike_table(spark)

    @F.pandas_udf(StructType().add("skeleton", StringType()).add("reading", StringType()))
    def read(values: pd.Series) -> pd.DataFrame:
        use(table.value)
        return pd.DataFrame({"skeleton": values.map(skeleton, na_action="ignore"), "reading": values.map(consistent_form, na_action="ignore")})

    return read


def _values(df: DataFrame, fields: tuple[str, ...], key: str | None = None) -> DataFrame:
    """([record_id,] field_name, value) of the values that aren't null."""
    own = [F.col(key).alias("record_id")] if key else []
    values = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(*own, F.explode(values).alias("v")).select(*(["record_id"] if key else []), "v.field_name", "v.value").filter("value is not null")


def spellings(df: DataFrame, fields: tuple[str, ...] = ("full_name", "organization")) -> DataFrame:
    """(field_name, value, n, skeleton, reading, usual): every stored spelling, its rows, and the usual form of its skeleton group."""
    counted = _values(df, fields).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("r", _read(df.sparkSession)("value")).select("field_name", "value", "n", "r.skeleton", "r.reading")
    best = F.min(F.when(F.col("value") == F.col("reading"), F.struct((-F.col("n")).alias("n"), F.col("value").alias("form"))))
    group = Window.partitionBy("field_name", "skeleton")
    usual = F.when(F.col("value") == F.col("reading"), F.col("value")).otherwise(F.coalesce(best.over(group)["form"], F.col("reading")))
    return keyed.withColumn("usual", usual)


def unusual_values(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("full_name", "organization")) -> DataFrame:
    """(record_id, field_name, value, consistent, skeleton) of values that aren't written as the usual form of their skeleton group."""
    odd = spellings(df, fields).filter("value <> usual").select("field_name", "value", F.col("usual").alias("consistent"), "skeleton")
    rows = _values(df, fields, key).filter(~F.col("value").rlike(PLAIN))
    return rows.join(broadcast_if_small(odd), ["field_name", "value"]).select("record_id", "field_name", "value", "consistent", "skeleton")


def consistent_columns(df: DataFrame, fields: tuple[str, ...] = ("full_name", "organization")) -> DataFrame:
    """df with each field in its consistent form, read value by value."""
    read = _read(df.sparkSession)
    return df.withColumns({f: F.when(F.col(f).rlike(PLAIN), F.col(f)).otherwise(read(F.when(~F.col(f).rlike(PLAIN), F.col(f)))["reading"]) for f in fields})


def look_alikes(df: DataFrame, fields: tuple[str, ...] = ("full_name", "organization")) -> DataFrame:
    """(field_name, skeleton, consistent, n_rows, n_spellings) of skeletons with more than one stored spelling."""
    form = F.min_by("usual", F.struct((-F.col("n")).alias("n"), F.col("usual").alias("form")))
    groups = spellings(df, fields).groupBy("field_name", "skeleton").agg(form.alias("consistent"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"))
    return groups.filter("n_spellings > 1")
