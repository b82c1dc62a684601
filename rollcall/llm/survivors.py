"""Problem 1: the best representative of each duplicate group, field by field.

Members of a group are ranked per field by completeness (is the value usable), trust (optional) and recency with
the member's id as the last tie-break; the top row is kept. The rank-one filter over the window makes Spark keep one
row per group and field in every map task before the shuffle (WindowGroupLimit), so a group that holds a third of all
rows sends a handful of rows to its reducer.

Defined results: null, blank, stand-in, cut-off or malformed values are never chosen; no row for a group and field
without a usable value; repeated membership rows count once; members without an entity and null groups are left out;
equal updated_at: the smaller id wins; null updated_at ranks last; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.text import as_column, cell, strip_diacritics

FIELDS = ("primary_email", "primary_phone", "primary_role", "display_name")

# Texts that stand for "unknown" or repeat a column title, without accents and in lower case.
STAND_INS = (
    "n/a", "na", "none", "null", "nil", "unknown", "no name", "noname", "tbd", "tba", "khong", "khong ro", "khong co", "khongco",
    "chua ro", "chua co", "chua biet", "khach", "khach moi", "guest", "dai bieu", "anonymous", "an danh", "test", "xxx", "x",
)
COLUMN_TITLES = (
    "ho ten", "ho va ten", "ten", "full name", "name", "attendee", "chuc vu", "chuc danh", "role", "title", "job title", "position",
    "email", "e-mail", "email address", "phone", "so dien thoai", "dien thoai", "mobile", "don vi", "company", "organization",
)
MAILBOX_STAND_INS = ("noemail", "no-email", "none", "test", "unknown", "x", "xxx", "na", "khongco", "null", "noreply", "no-reply")


def _folded(c: Column) -> Column:
    """Lower case without accents, brackets and edge punctuation."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(cell(c))), "^[\\s()\\[\\]?.*_-]+|[\\s()\\[\\]?.*_-]+$", ""))


def usable_text(c: Column | str) -> Column:
    """Holds letters and is neither a stand-in, a column title nor a numbered stand-in such as 'Guest 12'."""
    v = _folded(as_column(c))
    bare = F.trim(F.regexp_replace(v, "[\\s#._-]*\\d+$", ""))
    return F.coalesce(v.rlike("\\p{L}") & ~v.isin(*STAND_INS, *COLUMN_TITLES) & ~bare.isin(*STAND_INS, *COLUMN_TITLES), F.lit(False))


def usable_name(c: Column | str) -> Column:
    return usable_text(c) & ~F.contains(F.coalesce(as_column(c), F.lit("")), F.lit("@"))


def usable_email(c: Column | str) -> Column:
    """A complete address; the same word as mailbox and host, or a mailbox called 'noemail', is a stand-in."""
    v = F.lower(F.trim(as_column(c)))
    whole = v.rlike("^[\\p{L}0-9._%+'-]*[\\p{L}0-9_+-]@([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,}$")
    box, host = F.split(v, "@")[0], F.split(F.split(v, "@")[1], "\\.")[0]
    return F.coalesce(whole & ~box.isin(*MAILBOX_STAND_INS) & (box != host), F.lit(False))


def national_number(c: Column | str) -> Column:
    """The ten-digit national number a text states, else null: digits with any separators, 84, +84 or 0084 for the leading 0."""
    v = F.trim(as_column(c))
    digits = F.regexp_replace(v, "[^0-9]", "")
    national = F.when(digits.rlike("^0[1-9][0-9]{8}$"), digits)
    national = national.when(digits.rlike("^(00)?84[1-9][0-9]{8}$"), F.concat(F.lit("0"), F.right(digits, F.lit(9))))
    return F.when(~v.rlike("[?*xX]"), national)


def usable_phone(c: Column | str) -> Column:
    n = national_number(c)
    filler = n.rlike("^0(\\d)\\1{8}$") | n.isin("0123456789", "0987654321")
    return F.coalesce(n.isNotNull() & ~filler, F.lit(False))


USABLE = {"primary_email": usable_email, "primary_phone": usable_phone, "primary_role": usable_text, "display_name": usable_name}


def best_values(groups: DataFrame, entities: DataFrame, fields: dict = USABLE, trust: Column | None = None) -> DataFrame:
    """(group_id, field_name, canonical_entity_id, field_value): the top-ranked usable value of every group and field.

    trust: a number of the entity's columns; higher ranks before recency. None: all alike.
    """
    member = groups.select("group_id", F.col("canonical_entity_id").alias("_member")).filter(F.col("group_id").isNotNull())
    values = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("field_value"), usable(F.col(n)).alias("ok")) for n, usable in fields.items()))
    kept = entities.select(F.col("id").alias("_member"), "updated_at", (F.lit(0) if trust is None else trust).alias("_trust"), F.filter(values, lambda x: x["ok"]).alias("_values"))
    long = member.join(kept, "_member").select("group_id", "_member", "updated_at", "_trust", F.explode("_values").alias("v"))
    order = Window.partitionBy("group_id", "v.field_name").orderBy(F.desc_nulls_last("_trust"), F.desc_nulls_last("updated_at"), "_member")
    return long.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("group_id", "v.field_name", F.col("_member").alias("canonical_entity_id"), "v.field_value")


def golden_entities(groups: DataFrame, entities: DataFrame, fields: dict = USABLE) -> DataFrame:
    """One surviving row per group: the best value of each field and the entity it comes from. Groups without any usable value stay, with nulls."""
    best = best_values(groups, entities, fields)
    pick = [F.max(F.when(F.col("field_name") == n, F.col(c))).alias(n + end) for n in fields for c, end in (("field_value", ""), ("canonical_entity_id", "_from"))]
    every = groups.filter(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.countDistinct("canonical_entity_id").alias("n_members"))
    return every.join(best.groupBy("group_id").agg(*pick), "group_id", "left")
