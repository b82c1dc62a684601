"""A parsed sheet: headers and rows of text cells, and its turn into records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.dates import event_date
from rollcall.functions.text import blank_to_null, cell, email, identity, join_values, phone, stable_id, trim_extension
from rollcall.schemas import FIELDS

#: Limits of one import.
MAX_ROWS, MAX_BYTES, PREVIEW, FIRST_LINE = 5000, 15 << 20, 5, 2
CELLS = "row_number int, cells array<string>"


def header_names(cells: Sequence[str | None], width: int) -> list[str]:
    """Trimmed names; a blank becomes 'Cột N', the k-th repetition of a name gets ' (k)'."""
    out, seen = [], {}
    for i in range(width):
        name = (cells[i] or "").strip() if i < len(cells) else ""
        name = name or f"Cột {i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def rectangular(rows: DataFrame, width: int) -> DataFrame:
    """Rows (row_number, cells) padded to the width with '', without rows whose cells are all blank."""
    filled = F.transform("cells", lambda x: F.coalesce(x, F.lit("")))
    padded = F.slice(F.concat(filled, F.array_repeat(F.lit(""), width)), 1, width)
    return rows.filter(F.exists("cells", lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))).select("row_number", padded.alias("cells"))


def from_rows(lines: DataFrame) -> tuple[list[str], DataFrame]:
    """(headers, rows) of lines (row_number, cells), the first of which holds the headers."""
    first = lines.orderBy("row_number").limit(1).collect()
    if not first:
        return [], lines
    rest = lines.filter(F.col("row_number") > first[0]["row_number"])
    width = max(len(first[0]["cells"]), rest.agg(F.coalesce(F.max(F.size("cells")), F.lit(0))).first()[0])
    return header_names(first[0]["cells"], width), rectangular(rest, width)


def from_python(spark: SparkSession, headers: Sequence[str], rows: Sequence[Sequence[str]]) -> tuple[list[str], DataFrame]:
    """A grid of Python lists; rows keep their sheet line."""
    width = max([len(headers), *map(len, rows)])
    df = spark.createDataFrame([(i + FIRST_LINE, list(r)) for i, r in enumerate(rows)], CELLS)
    return header_names(headers, width), rectangular(df, width)


def within_limits(rows: DataFrame, limit: int = MAX_ROWS) -> bool:
    """Whether an import has no more rows than allowed; never counts past the limit."""
    return rows.limit(limit + 1).count() <= limit


def preview(rows: DataFrame, n: int = PREVIEW) -> DataFrame:
    return rows.orderBy("row_number").limit(n)


def samples(headers: Sequence[str], rows: DataFrame) -> DataFrame:
    """(header, sample): the first non-blank cell of each column."""
    long = rows.select("row_number", F.posexplode("cells").alias("at", "cell")).filter(F.trim("cell") != "")
    first = long.groupBy("at").agg(F.min_by("cell", "row_number").alias("sample"))
    names = rows.sparkSession.createDataFrame([(i, h) for i, h in enumerate(headers)], "at int, header string")
    return names.join(first, "at", "left").select("header", "sample")


def checked_mapping(headers: Sequence[str], mapping: dict[str, str]) -> dict[str, str]:
    """A confirmed mapping: unknown fields are ignored; at least one field, and one that names somebody, must be left."""
    known = {h: f if (f := mapping.get(h, "ignore")) in FIELDS else "ignore" for h in headers}
    used = set(known.values()) - {"ignore"}
    if not used:
        raise ValueError("no column is mapped")
    if not used & {"full_name", "email", "organization"}:
        raise ValueError("no column names a person or an organisation")
    return known


def raw_data(headers: Sequence[str]) -> Column:
    """Cells as typed, by header."""
    return F.map_from_arrays(F.array(*map(F.lit, headers)), F.col("cells"))


def parse_rows(headers: Sequence[str], rows: DataFrame, mapping: dict[str, str], source_name: str = "") -> DataFrame:
    """Rows as records: several columns of one field are joined by ' / '; the event defaults to the source's name without extension.

    Rows that name nobody are kept, with resolvable false.
    """
    at: dict[str, list[Column]] = {f: [] for f in FIELDS}
    for i, h in enumerate(headers):
        if mapping.get(h) in at:
            at[mapping[h]].append(cell(F.col("cells")[i]))
    value = {f: join_values(F.array(*cs)) if cs else F.lit("") for f, cs in at.items()}
    name, org, role = value["full_name"], value["organization"], value["role_title"]
    mail = email(value["email"])
    person, office = (name != "") | (mail != ""), org != ""
    text = F.when(person, identity(name, org, role)).when(office, identity(org, F.lit(""), role)).otherwise(identity(name, org, role))
    event = F.coalesce(blank_to_null(value["event_name"]), blank_to_null(trim_extension(F.lit(source_name))))
    return rows.select(
        "row_number", raw_data(headers).alias("raw_data"), blank_to_null(name).alias("full_name"), blank_to_null(org).alias("organization"), blank_to_null(role).alias("role_title"), blank_to_null(mail).alias("email"),
        blank_to_null(phone(value["phone"])).alias("phone"), event.alias("event_name"), event_date(value["event_date"]).alias("event_date"), blank_to_null(value["event_date"]).alias("event_date_raw"), blank_to_null(value["notes"]).alias("notes"),
        text.alias("normalized_text"), F.when(person, "person").when(office, "organization").alias("entity_type"), (person | office).alias("resolvable"))


def as_records(parsed: DataFrame, source_id: str, tenant: str, as_of: str) -> DataFrame:
    """Parsed rows as rows of raw_records, without vectors; ids follow from source and line, so a repeated task makes the same."""
    return parsed.withColumns({
        "id": stable_id(F.lit(source_id), F.col("row_number").cast("string")), "source_id": F.lit(source_id), "organization_id": F.lit(tenant),
        "embedding": F.lit(None).cast("array<float>"), "created_at": F.lit(as_of).cast("timestamp")}).drop("entity_type", "resolvable")


def map_json(c: str):
    """A map of texts as a JSON object with its keys in order; mappings and raw rows are stored like this."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"ignoreNullFields": "false"})
