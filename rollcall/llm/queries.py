"""Queries of the problems in this subpackage, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import encoding, history, neighbours, packing, people, skeleton, subjects, survivors
from rollcall.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = survivors.best_values(table(spark, sf_dir, "entity_groups"), table(spark, sf_dir, "canonical_entities"))
    return best.select("group_id", "field_name", "canonical_entity_id")


def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.golden_entities(table(spark, sf_dir, "entity_groups"), table(spark, sf_dir, "canonical_entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "raw_records", "id", "embedding"))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records of every record, over the whole table."""
    return neighbours.nearest(table(spark, sf_dir, "raw_records", "id", "embedding"), 5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.variant_pairs(table(spark, sf_dir, "raw_records", "id", "organization_id", "full_name", "organization", "email", "phone"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's person or organisation and the number of records that spell it differently."""
    return people.class_members(people.as_rows(table(spark, sf_dir, "raw_records", "id", "organization_id", "full_name", "organization", "email", "phone")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "organization_id", "full_name", "organization", "email", "phone")
    return history.batch_pairs(table(spark, sf_dir, "raw_records", *columns), table(spark, sf_dir, "incoming_records", *columns, "batch_no"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full copies among the incoming rows, and how much of each text history has."""
    columns = ("id", "organization_id", "normalized_text")
    return history.copies(table(spark, sf_dir, "raw_records", *columns), table(spark, sf_dir, "incoming_records", *columns, "batch_no"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.unusual_values(table(spark, sf_dir, "raw_records")).select("record_id", "field_name")


def p5_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.look_alikes(table(spark, sf_dir, "raw_records"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "pack_sizes"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.assign_subjects(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))
    return found.select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of the whole corpus by subject."""
    mixed = subjects.subject_mixtures(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))
    return subjects.composition(mixed)


QUERIES = {f.__name__: f for f in (p1_found, p1_golden, p2_found, p2_nearest, p3_found, p3_classes, p4_found, p4_copies, p5_found, p5_look_alikes, p8_ids, p9_containers, p9_report, p10_found, p10_composition)}


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_EDGE = "[\\s()\\[\\]?.*_-]+"


def _usable_text(c: str) -> str:
    v = f"trim(regexp_replace(lower(replace(replace(strip_accents(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))), 'đ', 'd'), 'Đ', 'D')), '^{_EDGE}|{_EDGE}$', '', 'g'))"
    bare = f"trim(regexp_replace({v}, '[\\s#._-]*\\d+$', '', 'g'))"
    words = _list((*survivors.STAND_INS, *survivors.COLUMN_TITLES))
    return f"regexp_matches({v}, '\\p{{L}}') AND {v} NOT IN ({words}) AND {bare} NOT IN ({words})"


_MAIL = "lower(trim(coalesce(primary_email, '')))"
_DIGITS = "regexp_replace(coalesce(primary_phone, ''), '[^0-9]', '', 'g')"
_NATIONAL = f"CASE WHEN regexp_matches({_DIGITS}, '^0[1-9][0-9]{{8}}$') THEN {_DIGITS} WHEN regexp_matches({_DIGITS}, '^(00)?84[1-9][0-9]{{8}}$') THEN '0' || right({_DIGITS}, 9) ELSE '' END"
_NINES = _list(tuple("0" + d * 9 for d in "0123456789") + ("0123456789", "0987654321"))
_USABLE_SQL = {
    "primary_email": f"regexp_matches({_MAIL}, '^[\\p{{L}}0-9._%+''-]*[\\p{{L}}0-9_+-]@([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z]{{2,}}$') AND split_part({_MAIL}, '@', 1) NOT IN ({_list(survivors.MAILBOX_STAND_INS)}) AND split_part({_MAIL}, '@', 1) <> split_part(split_part({_MAIL}, '@', 2), '.', 1)",
    "primary_phone": f"NOT regexp_matches(coalesce(primary_phone, ''), '[?*xX]') AND ({_NATIONAL}) <> '' AND ({_NATIONAL}) NOT IN ({_NINES})",
    "primary_role": _usable_text("primary_role"),
    "display_name": _usable_text("display_name") + " AND NOT contains(coalesce(display_name, ''), '@')",
}
SQL: dict[str, str] = {
    "p1_found": "WITH m AS (SELECT DISTINCT group_id, canonical_entity_id AS id FROM entity_groups WHERE group_id IS NOT NULL), e AS (SELECT m.group_id, c.* FROM m JOIN canonical_entities c ON c.id = m.id), f AS ("
    + " UNION ALL ".join(f"SELECT group_id, '{n}' AS field_name, id, updated_at FROM e WHERE {ok}" for n, ok in _USABLE_SQL.items())
    + ") SELECT group_id, field_name, id AS canonical_entity_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY updated_at DESC NULLS LAST, id) AS k FROM f) WHERE k = 1",
}

_TEXT = "lower(trim(regexp_replace(coalesce(normalized_text, ''), '\\s+', ' ', 'g')))"
_PARTS = "unnest(list_filter(list_distinct(string_split({0}, ' | ')), lambda x: x <> ''))"
SQL["p4_copies"] = f"""WITH o AS (SELECT organization_id AS o, -2 AS b, {_TEXT} AS t FROM raw_records UNION ALL SELECT organization_id, coalesce(batch_no, -1), {_TEXT} FROM incoming_records),
c AS (SELECT o, t, min(b) AS c FROM o GROUP BY ALL), p AS (SELECT o, part, min(b) AS p FROM (SELECT o, b, {_PARTS.format("t")} AS part FROM o) GROUP BY ALL),
m AS (SELECT id, organization_id AS o, batch_no, coalesce(batch_no, -1) AS b, {_TEXT} AS t FROM incoming_records),
s AS (SELECT x.id, x.b, count_if(p.p < x.b)::DOUBLE / count(*) AS v FROM (SELECT id, o, b, {_PARTS.format("t")} AS part FROM m) x JOIN p ON p.o = x.o AND p.part = x.part GROUP BY ALL)
SELECT m.id AS record_id, m.batch_no, c.c < m.b AS is_copy, round(coalesce(s.v, 0), 6) AS coverage FROM m JOIN c ON c.o = m.o AND c.t = m.t LEFT JOIN s ON s.id = m.id AND s.b = m.b"""
