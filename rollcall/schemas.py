"""Schemas of the five tables and the invariants they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    """'name type!' with ! for never null."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "t": T.TimestampType(), "d": T.DateType(), "f": T.FloatType(), "b": T.BooleanType(), "m": T.MapType(T.StringType(), T.StringType()), "v": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k[0]], not k.endswith("!")) for n, k in (x.split(":") for x in text.split())])


SOURCES = _schema("id:s! organization_id:s! name:s! source_type:s! external_file_id:s imported_by:s imported_at:t! field_mapping:m!")
RECORDS = _schema(
    "id:s! source_id:s! organization_id:s! row_number:i! raw_data:m! full_name:s organization:s role_title:s email:s phone:s event_name:s event_date:d event_date_raw:s notes:s normalized_text:s! embedding:v created_at:t!"
)
ENTITIES = _schema("id:s! organization_id:s! entity_type:s! display_name:s! primary_email:s primary_phone:s primary_organization:s primary_role:s embedding:v created_at:t! updated_at:t!")
LINKS = _schema("raw_record_id:s! canonical_entity_id:s! organization_id:s! link_method:s! linked_at:t!")
SUGGESTIONS = _schema(
    "id:s! organization_id:s! canonical_entity_id:s! candidate_raw_record_id:s! vector_similarity:f! llm_confidence:f! combined_confidence:f! llm_verdict:b! reasoning:s! status:s! decided_at:t decided_by:s created_at:t!"
)
TABLES = {"sources": SOURCES, "raw_records": RECORDS, "canonical_entities": ENTITIES, "raw_to_canonical": LINKS, "merge_suggestions": SUGGESTIONS}

# The canonical fields, the types of sources, the states of a suggestion.
FIELDS = ("full_name", "organization", "role_title", "email", "phone", "event_name", "event_date", "notes")
SOURCE_TYPES = ("local_upload", "google_sheets", "google_drive_xlsx")
STATES = ("pending", "approved", "rejected")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def invariants(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n): how often each invariant is broken: one entity per record, one suggestion per pair, known states, links and suggestions whose ends exist."""
    links, suggestions = tables["raw_to_canonical"], tables["merge_suggestions"]
    ids = {n: tables[n].select(F.col("id").alias("_id")) for n in ("raw_records", "canonical_entities", "sources")}

    def missing(df: DataFrame, key: str, table: str) -> DataFrame:
        return df.select(key).join(ids[table], F.col(key) == F.col("_id"), "left_anti")

    checks = {
        "record_with_two_entities": repeated(links.select("raw_record_id", "canonical_entity_id").distinct(), "raw_record_id"),
        "repeated_suggestion": repeated(suggestions, "canonical_entity_id", "candidate_raw_record_id"),
        "unknown_state": suggestions.filter(~F.col("status").isin(*STATES)),
        "link_without_record": missing(links, "raw_record_id", "raw_records"),
        "link_without_entity": missing(links, "canonical_entity_id", "canonical_entities"),
        "suggestion_without_entity": missing(suggestions, "canonical_entity_id", "canonical_entities"),
        "suggestion_without_record": missing(suggestions, "candidate_raw_record_id", "raw_records"),
        "record_without_source": missing(tables["raw_records"], "source_id", "sources"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
