"""Read models: entity directory, histories, review queue, statistics.

Derived counts are aggregated once per entity and joined, never re-evaluated per row. of_tenant() narrows every table to a
tenant, so all reads over its result scan that tenant only; a lookup by id narrows links and records before it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.dates import display_date
from rollcall.functions.scores import percent, score_band
from rollcall.functions.text import as_column, null_to_blank
from rollcall.operators.search import Predicate

PAGE, QUEUE = 25, 50
# Labels of sources, of fields that differ, and of fields to choose from.
SOURCE_LABELS = {"google_sheets": "Google Sheets", "google_drive_xlsx": "Drive (.xlsx)", "local_upload": "Tải lên"}
FIELD_LABELS = {"full_name": "Họ và tên", "organization": "Đơn vị", "role_title": "Chức danh", "email": "Email", "phone": "Điện thoại"}
FIELD_OPTIONS = {
    "full_name": "Họ và tên", "organization": "Đơn vị / Công ty", "role_title": "Chức danh / Vai trò", "email": "Địa chỉ Email", "phone": "Số điện thoại",
    "event_name": "Tên sự kiện", "event_date": "Ngày diễn ra", "notes": "Ghi chú", "ignore": "Bỏ qua cột này",
}


def label(c: Column | str, labels: dict[str, str]) -> Column:
    """The label of a value, the value itself if it has none."""
    v = as_column(c)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[v], v)


def of_tenant(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """The tables of one tenant; the condition reaches the scan of each."""
    return {n: df.filter(F.col("organization_id") == tenant) for n, df in tables.items()}


def links(tables: dict[str, DataFrame]) -> DataFrame:
    """Each record's entity once, whatever the table repeats."""
    return tables["raw_to_canonical"].select("raw_record_id", "canonical_entity_id").distinct()


def entity_counts(tables: dict[str, DataFrame], flags: dict[str, Column] | None = None) -> DataFrame:
    """(entity_id, event_count, source_count, record_count, *flags): distinct non-blank events, distinct sources, records, and whether some record satisfies each flag's condition."""
    records = tables["raw_records"].select(F.col("id").alias("raw_record_id"), "event_name", "source_id", F.year("event_date").alias("event_year"))
    return links(tables).join(records, "raw_record_id").groupBy(F.col("canonical_entity_id").alias("entity_id")).agg(
        F.countDistinct(F.when(F.col("event_name") != "", F.col("event_name"))).alias("event_count"),
        F.countDistinct("source_id").alias("source_count"),
        F.count(F.lit(1)).alias("record_count"),
        *(F.max(condition).alias(name) for name, condition in (flags or {}).items()),
    )


def entities(tables: dict[str, DataFrame], flags: dict[str, Column] | None = None) -> DataFrame:
    """Entities with their three counts and any flags, blanks for nulls."""
    e = tables["canonical_entities"].select("id", "organization_id", "entity_type", "display_name", *(null_to_blank(c).alias(c) for c in ("primary_email", "primary_phone", "primary_organization", "primary_role")))
    counted = e.join(entity_counts(tables, flags), e["id"] == F.col("entity_id"), "left").drop("entity_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("event_count", "source_count", "record_count")}
    return counted.withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in flags or {}})


def search_entities(tables: dict[str, DataFrame], predicate: Predicate | None = None) -> DataFrame:
    """entities() that satisfy a predicate."""
    if predicate is None:
        return entities(tables)
    return entities(tables, predicate.events).filter(predicate.condition).drop(*predicate.events)


def entity_page(tables: dict[str, DataFrame], predicate: Predicate | None = None, page: int = 1, size: int = PAGE) -> DataFrame:
    """One page, most events first, then by name and id."""
    return search_entities(tables, predicate).orderBy(F.desc("event_count"), "display_name", "id").offset((page - 1) * size).limit(size)


def entity_total(tables: dict[str, DataFrame], predicate: Predicate | None = None) -> DataFrame:
    """(total, pages) of the entities a predicate leaves; without a predicate nothing but the entities is read."""
    found = tables["canonical_entities"] if predicate is None else search_entities(tables, predicate)
    return found.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / PAGE)).cast("bigint"))


def entity_by_id(tables: dict[str, DataFrame], tenant: str, entity_id: str) -> DataFrame:
    """One entity with its counts; no row if the tenant has none of that id."""
    own = of_tenant(tables, tenant)
    own |= {"canonical_entities": own["canonical_entities"].filter(F.col("id") == entity_id), "raw_to_canonical": own["raw_to_canonical"].filter(F.col("canonical_entity_id") == entity_id)}
    return entities(own)


def record_by_id(tables: dict[str, DataFrame], tenant: str, record_id: str) -> DataFrame:
    """One record with its source; no row if the tenant has none of that id."""
    own = of_tenant(tables, tenant)
    return record_details(own | {"raw_records": own["raw_records"].filter(F.col("id") == record_id)})


def as_json(df: DataFrame) -> DataFrame:
    """(json): the rows of a read as the objects an API answers with; blanks and nulls are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def page_count(total: int, size: int = PAGE) -> int:
    return max(1, -(-total // size))


def source_list(tables: dict[str, DataFrame]) -> DataFrame:
    """Sources with their number of records."""
    counts = tables["raw_records"].groupBy("source_id").agg(F.count(F.lit(1)).alias("record_count"))
    s = tables["sources"].select("id", "organization_id", "name", "source_type", "imported_at")
    return s.join(counts, s["id"] == counts["source_id"], "left").select(*s.columns, F.coalesce("record_count", F.lit(0)).alias("record_count"))


def latest_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """source_list(), the latest import first."""
    return source_list(tables).orderBy(F.desc("imported_at"), "id")


def record_details(tables: dict[str, DataFrame]) -> DataFrame:
    """Records with the name and type of their source, blanks for nulls."""
    text = ("full_name", "organization", "role_title", "email", "phone", "event_name", "event_date_raw", "notes")
    r = tables["raw_records"].select("id", "organization_id", "source_id", "row_number", *(null_to_blank(c).alias(c) for c in text), "event_date", "created_at")
    s = tables["sources"].select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    return r.join(s, "source_id").withColumn("event_date_display", display_date("event_date", "event_date_raw"))


def entity_history(tables: dict[str, DataFrame], entity_id: Column | str | None = None) -> DataFrame:
    """Records of one entity, or of every one, latest event first within an entity."""
    linked = links(tables).select(F.col("canonical_entity_id").alias("entity_id"), F.col("raw_record_id").alias("id"))
    if entity_id is not None:
        linked = linked.filter(F.col("entity_id") == entity_id)
    out = linked.join(record_details(tables), "id")
    return out.orderBy(F.desc_nulls_last("event_date"), F.desc("created_at"), "id") if entity_id is not None else out


def differing_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, fields): fields with more than one distinct non-blank value, but for case and edges, among an entity's records."""
    fields = ("full_name", "organization", "role_title", "email", "phone")
    r = tables["raw_records"].select(F.col("id").alias("raw_record_id"), *(F.nullif(F.lower(F.trim(c)), F.lit("")).alias(c) for c in fields))
    per = links(tables).join(r, "raw_record_id").groupBy(F.col("canonical_entity_id").alias("entity_id")).agg(*(f(c).alias(n + c) for c in fields for n, f in (("_low_", F.min), ("_high_", F.max))))
    return per.select("entity_id", F.concat_ws(",", *(F.when(F.col("_low_" + c) != F.col("_high_" + c), F.lit(c)) for c in fields)).alias("fields")).filter("fields <> ''")


def pending(tables: dict[str, DataFrame]) -> DataFrame:
    """Undecided suggestions whose entity and record exist, with percentages and band."""
    s = tables["merge_suggestions"].filter("status = 'pending'")
    e = tables["canonical_entities"].select(F.col("id").alias("canonical_entity_id"), "display_name")
    r = tables["raw_records"].select(F.col("id").alias("candidate_raw_record_id"), "full_name", "normalized_text")
    shown = s.join(e, "canonical_entity_id").join(r, "candidate_raw_record_id")
    return shown.select("id", "organization_id", "canonical_entity_id", "candidate_raw_record_id", "display_name", "normalized_text", "combined_confidence", "created_at",
        percent(F.round(F.col("combined_confidence").cast("double"), 6)).alias("combined_percent"), score_band(F.round(F.col("combined_confidence").cast("double"), 6)).alias("band"))


def review_queue(tables: dict[str, DataFrame], tenant: str, size: int = QUEUE) -> DataFrame:
    """The tenant's best undecided suggestions: limited first, then joined with entity and record."""
    s = tables["merge_suggestions"].filter((F.col("status") == "pending") & (F.col("organization_id") == tenant))
    return pending({**tables, "merge_suggestions": s.orderBy(F.desc("combined_confidence"), "created_at", "id").limit(size)})


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per tenant: entities, records, sources, pending suggestions, linked records and the rate of deduplication in percent."""
    parts = {
        "entities": tables["canonical_entities"].groupBy("organization_id").agg(F.count(F.lit(1)).alias("n")),
        "records": tables["raw_records"].groupBy("organization_id").agg(F.count(F.lit(1)).alias("n")),
        "sources": tables["sources"].groupBy("organization_id").agg(F.count(F.lit(1)).alias("n")),
        "pending": tables["merge_suggestions"].filter("status = 'pending'").groupBy("organization_id").agg(F.count(F.lit(1)).alias("n")),
        "linked": tables["raw_to_canonical"].groupBy("organization_id").agg(F.countDistinct("raw_record_id").alias("n")),
    }
    long = None
    for name, df in parts.items():
        one = df.select("organization_id", F.lit(name).alias("what"), "n")
        long = one if long is None else long.unionByName(one)
    wide = long.groupBy("organization_id").agg(*(F.sum(F.when(F.col("what") == n, F.col("n")).otherwise(0)).alias(n) for n in parts))
    l, e = F.col("linked"), F.col("entities")
    return wide.withColumn("dedup_rate", F.when(l > 0, F.round((l - e) / l.cast("double") * 100, 1)).otherwise(F.lit(0.0)))


def statistics_by_type(tables: dict[str, DataFrame]) -> DataFrame:
    """(organization_id, source_type, label, files, records) in order of tenant and type; sources without records count none."""
    s = tables["sources"].select(F.col("id").alias("source_id"), "organization_id", "source_type")
    counts = tables["raw_records"].groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(counts, "source_id", "left").groupBy("organization_id", "source_type").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).withColumn("label", label("source_type", SOURCE_LABELS)).orderBy("organization_id", "source_type")
