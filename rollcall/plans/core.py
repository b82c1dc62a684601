"""Queries of the core operators over the event tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions import dates, scores, text
from rollcall.operators import reads, retrieval, search, state, tenants
from rollcall.session import table
from rollcall.sources import grid

QUERIES: dict = {}
SQL: dict[str, str] = {}
TENANT = "org-sen-vang"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in schemas.TABLES}


def _state(spark: SparkSession, d: str) -> state.State:
    return state.State(**tables(spark, d))


# Parts of SQL that several queries share.
LINKS = "links AS (SELECT DISTINCT raw_record_id, canonical_entity_id FROM raw_to_canonical)"
ENTITIES = f"""{LINKS},
counts AS (SELECT l.canonical_entity_id AS eid, count(DISTINCT CASE WHEN r.event_name <> '' THEN r.event_name END) AS event_count, count(DISTINCT r.source_id) AS source_count, count(*) AS record_count
  FROM links l JOIN raw_records r ON r.id = l.raw_record_id GROUP BY 1),
entities AS (SELECT e.id, e.organization_id, e.entity_type, e.display_name, coalesce(e.primary_email, '') AS primary_email, coalesce(e.primary_phone, '') AS primary_phone,
  coalesce(e.primary_organization, '') AS primary_organization, coalesce(e.primary_role, '') AS primary_role,
  coalesce(c.event_count, 0) AS event_count, coalesce(c.source_count, 0) AS source_count, coalesce(c.record_count, 0) AS record_count
  FROM canonical_entities e LEFT JOIN counts c ON c.eid = e.id)"""
EVENTS = "SELECT 1 FROM links l JOIN raw_records r ON r.id = l.raw_record_id WHERE l.canonical_entity_id = e.id AND"
KIND = "CASE WHEN coalesce(full_name, '') <> '' OR coalesce(email, '') <> '' THEN 'person' WHEN coalesce(organization, '') <> '' THEN 'organization' END"
BARRED = f"""{LINKS},
gone AS (SELECT raw_record_id AS r, canonical_entity_id AS e FROM links UNION SELECT candidate_raw_record_id, canonical_entity_id FROM merge_suggestions),
late AS (SELECT l.canonical_entity_id AS e, r.source_id AS s, max(r.row_number) AS last_row FROM links l JOIN raw_records r ON r.id = l.raw_record_id GROUP BY 1, 2)"""
DIGITS = "nullif(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g'), '')"
BY_VECTOR = f"""cur AS (SELECT id AS r, organization_id AS o, source_id AS s, row_number AS rn, embedding::DOUBLE[] AS v, {KIND} AS t FROM raw_records WHERE embedding IS NOT NULL AND list_aggregate(embedding, 'max') <> list_aggregate(embedding, 'min')),
ent AS (SELECT id AS e, organization_id AS o, entity_type AS t, embedding::DOUBLE[] AS v FROM canonical_entities WHERE embedding IS NOT NULL AND list_aggregate(embedding, 'max') <> list_aggregate(embedding, 'min')),
pairs AS (SELECT cur.r, ent.e, round(list_inner_product(cur.v, ent.v) / (sqrt(list_inner_product(cur.v, cur.v)) * sqrt(list_inner_product(ent.v, ent.v))), 12) AS sim
  FROM cur JOIN ent ON ent.o = cur.o AND ent.t = cur.t AND len(ent.v) = len(cur.v)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = cur.r AND g.e = ent.e) AND NOT EXISTS (SELECT 1 FROM late x WHERE x.e = ent.e AND x.s = cur.s AND x.last_row >= cur.rn)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY sim DESC, e) AS k FROM pairs),
by_vector AS (SELECT r, e, sim FROM ranked WHERE k <= 5 AND sim >= 0.89)"""
BY_IDENTIFIER = f"""rec AS (SELECT id AS r, organization_id AS o, source_id AS s, row_number AS rn, lower(nullif(email, '')) AS mail, {DIGITS.format("phone")} AS num FROM raw_records),
can AS (SELECT id AS e, organization_id AS o, created_at AS c, lower(nullif(primary_email, '')) AS mail, {DIGITS.format("primary_phone")} AS num FROM canonical_entities),
hits AS (SELECT rec.r, rec.s, rec.rn, can.e, can.c FROM rec JOIN can ON can.o = rec.o AND can.mail = rec.mail UNION SELECT rec.r, rec.s, rec.rn, can.e, can.c FROM rec JOIN can ON can.o = rec.o AND can.num = rec.num),
left_hits AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = h.r AND g.e = h.e) AND NOT EXISTS (SELECT 1 FROM late x WHERE x.e = h.e AND x.s = h.s AND x.last_row >= h.rn)),
by_identifier AS (SELECT r, e FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c, e) AS k FROM left_hits) WHERE k <= 5)"""


@query(f"WITH {ENTITIES} SELECT * FROM entities")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    return reads.search_entities(tables(spark, d))


@query(f"WITH {ENTITIES} SELECT * FROM entities ORDER BY event_count DESC, display_name, id LIMIT 25 OFFSET 25")
def entity_page_2(spark: SparkSession, d: str) -> DataFrame:
    return reads.entity_page(tables(spark, d), page=2)


def _search(spark: SparkSession, d: str, filters: list[dict], logic: str = "AND") -> DataFrame:
    return reads.search_entities(tables(spark, d), search.build(filters, logic))


def _f(column: str, operator: str, value: str) -> dict:
    return {"column": column, "operator": operator, "value": value}


@query(f"WITH {ENTITIES} SELECT * FROM entities WHERE primary_organization ILIKE '%đại học%' AND event_count >= 1 AND primary_role <> 'Sinh viên'")
def entity_search_and(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [_f("primary_organization", "contains", "đại học"), _f("event_count", "gte", "1"), _f("primary_role", "not_equals", "Sinh viên")])


@query(f"WITH {ENTITIES} SELECT e.* FROM entities e WHERE display_name ILIKE '%nguyễn%' OR event_count > 2 OR EXISTS ({EVENTS} year(r.event_date) < 2022)")
def entity_search_or(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [_f("display_name", "contains", "nguyễn"), _f("event_count", "gt", "2"), _f("event_year", "lt", "2022"), _f("event_year", "contains", "20"), _f("secret", "equals", "x")], "OR")


@query(f"WITH {ENTITIES} SELECT e.* FROM entities e WHERE EXISTS ({EVENTS} r.event_name ILIKE '%hội thảo%') AND EXISTS ({EVENTS} year(r.event_date) <= 2023)")
def entity_search_events(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [_f("event_name", "contains", "hội thảo"), _f("event_year", "lte", "2023")])


@query(f"WITH {ENTITIES} SELECT * FROM entities WHERE event_count = 0 OR event_count = 2")
def entity_search_event_count(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [_f("event_count", "equals", "0"), _f("event_count", "equals", "2")], "OR")


@query(rf"WITH {ENTITIES} SELECT * FROM entities WHERE display_name ILIKE '%\_%' ESCAPE '\' OR primary_organization ILIKE '%\_%' ESCAPE '\' OR primary_role ILIKE '%\_%' ESCAPE '\' OR primary_email ILIKE '%\_%' ESCAPE '\'")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return reads.search_entities(tables(spark, d), search.keyword("_"))


@query(f"WITH {ENTITIES} SELECT * FROM entities")
def empty_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [_f("event_count", "gt", "many"), _f("display_name", "gt", "3"), _f("display_name", "equals", " ")])


@query("SELECT s.id, s.organization_id, s.name, s.source_type, s.imported_at, count(r.id) AS record_count FROM sources s LEFT JOIN raw_records r ON r.source_id = s.id GROUP BY ALL")
def source_list(spark: SparkSession, d: str) -> DataFrame:
    return reads.source_list(tables(spark, d))


DETAILS = """SELECT r.id, r.organization_id, r.source_id, r.row_number, coalesce(full_name, '') AS full_name, coalesce(organization, '') AS organization, coalesce(role_title, '') AS role_title, coalesce(email, '') AS email,
  coalesce(phone, '') AS phone, coalesce(event_name, '') AS event_name, coalesce(event_date_raw, '') AS event_date_raw, coalesce(notes, '') AS notes, event_date, created_at, s.name AS source_name, s.source_type,
  CASE WHEN event_date IS NOT NULL THEN strftime(event_date, '%d/%m/%Y') WHEN event_date_raw <> '' THEN event_date_raw || ' (chưa nhận dạng)' ELSE '' END AS event_date_display FROM raw_records r JOIN sources s ON s.id = r.source_id"""


@query(DETAILS)
def record_details(spark: SparkSession, d: str) -> DataFrame:
    return reads.record_details(tables(spark, d))


@query(f"WITH {LINKS}, details AS ({DETAILS}) SELECT l.canonical_entity_id AS entity_id, x.* FROM links l JOIN details x ON x.id = l.raw_record_id")
def entity_history(spark: SparkSession, d: str) -> DataFrame:
    return reads.entity_history(tables(spark, d))


_DIFF = {c: f"count(DISTINCT nullif(lower(trim({c})), ''))" for c in ("full_name", "organization", "role_title", "email", "phone")}


@query(
    f"WITH {LINKS}, per AS (SELECT l.canonical_entity_id AS entity_id, concat_ws(',', {', '.join(f'CASE WHEN {n} > 1 THEN {c!r} END' for c, n in _DIFF.items())}) AS fields FROM links l JOIN raw_records r ON r.id = l.raw_record_id GROUP BY 1) SELECT * FROM per WHERE fields <> ''"
)
def differing_fields(spark: SparkSession, d: str) -> DataFrame:
    return reads.differing_fields(tables(spark, d))


STATS = """t AS (SELECT organization_id FROM canonical_entities UNION SELECT organization_id FROM raw_records UNION SELECT organization_id FROM sources UNION SELECT organization_id FROM merge_suggestions WHERE status = 'pending' UNION SELECT organization_id FROM raw_to_canonical),
n AS (SELECT t.organization_id, (SELECT count(*) FROM canonical_entities x WHERE x.organization_id = t.organization_id) AS entities, (SELECT count(*) FROM raw_records x WHERE x.organization_id = t.organization_id) AS records,
  (SELECT count(*) FROM sources x WHERE x.organization_id = t.organization_id) AS sources, (SELECT count(*) FROM merge_suggestions x WHERE x.organization_id = t.organization_id AND status = 'pending') AS pending,
  (SELECT count(DISTINCT raw_record_id) FROM raw_to_canonical x WHERE x.organization_id = t.organization_id) AS linked FROM t)"""


@query(f"WITH {STATS} SELECT organization_id, entities, records, sources, pending, linked, CASE WHEN linked > 0 THEN round((linked - entities)::DOUBLE / linked * 100, 1) ELSE 0.0::DOUBLE END AS dedup_rate FROM n")
def stats_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return reads.statistics(tables(spark, d))


@query(
    "SELECT s.organization_id, s.source_type, count(DISTINCT s.id) AS files, count(r.id) AS records, CASE s.source_type WHEN 'local_upload' THEN 'Tải lên' WHEN 'google_sheets' THEN 'Google Sheets' WHEN 'google_drive_xlsx' THEN 'Drive (.xlsx)' ELSE s.source_type END AS label FROM sources s LEFT JOIN raw_records r ON r.source_id = s.id GROUP BY 1, 2"
)
def stats_by_source_type(spark: SparkSession, d: str) -> DataFrame:
    return reads.statistics_by_type(tables(spark, d))


PENDING = """SELECT s.id, s.organization_id, s.canonical_entity_id, s.candidate_raw_record_id, e.display_name, r.normalized_text, s.combined_confidence, s.created_at,
  trunc(round(s.combined_confidence::DOUBLE, 6) * 100 + 0.5)::INT AS combined_percent, CASE WHEN trunc(round(s.combined_confidence::DOUBLE, 6) * 100 + 0.5) >= 80 THEN 'high' WHEN trunc(round(s.combined_confidence::DOUBLE, 6) * 100 + 0.5) >= 60 THEN 'medium' ELSE 'low' END AS band
  FROM {0} s JOIN canonical_entities e ON e.id = s.canonical_entity_id JOIN raw_records r ON r.id = s.candidate_raw_record_id"""


@query(f"WITH p AS (SELECT * FROM merge_suggestions WHERE status = 'pending') {PENDING.format('p')}")
def pending_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return reads.pending(tables(spark, d))


@query(f"WITH p AS (SELECT * FROM merge_suggestions WHERE status = 'pending' AND organization_id = '{TENANT}' ORDER BY combined_confidence DESC, created_at, id LIMIT 50) {PENDING.format('p')}")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return reads.review_queue(tables(spark, d), TENANT)


@query(
    "WITH x AS (SELECT id, vector_similarity::DOUBLE AS s, llm_confidence::DOUBLE AS c, llm_verdict AS v FROM merge_suggestions) SELECT id, round(0.35::DOUBLE * least(greatest(s, 0.0), 1.0) + 0.65::DOUBLE * CASE WHEN v THEN least(greatest(c, 0.0), 1.0) ELSE 1.0 - least(greatest(c, 0.0), 1.0) END, 6) AS combined FROM x"
)
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merge_suggestions").select("id", F.round(scores.combine_confidence("vector_similarity", "llm_verdict", "llm_confidence"), 6).alias("combined"))


@query(
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM p) SELECT a, b, similarity, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The five vectors most similar to every fiftieth, against all; the stated queries are broadcast, their share of the table is fixed and checked."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    from pyspark.sql import Window

    from rollcall.session import broadcast_if_small

    asked = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    pairs = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")).join(broadcast_if_small(asked), F.col("a") != F.col("b"))
    ranked = pairs.select("a", "b", F.round(scores.cosine("va", "vb"), 6).alias("similarity"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter("rank <= 5")


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(scores.l2_normalize(scores.checked_vector("embedding", 64)), lambda x: F.round(x, 6)).alias("unit"))


@query(f"WITH {BARRED}, {BY_VECTOR} SELECT r AS record_id, e AS entity_id, round(sim, 6) AS similarity FROM by_vector")
def knn_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return retrieval.candidates_by_vector(t, t["raw_records"]).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {BARRED}, {BY_IDENTIFIER} SELECT r AS record_id, e AS entity_id, 1.0::DOUBLE AS similarity FROM by_identifier")
def identifier_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return retrieval.candidates_by_identifier(t, t["raw_records"])


@query(
    f"""WITH {BARRED}, {BY_VECTOR}, {BY_IDENTIFIER}, both_ AS (SELECT r, e, sim, FALSE AS i FROM by_vector UNION ALL SELECT r, e, 1.0, TRUE FROM by_identifier), one AS (SELECT r, e, max_by(sim, i::INT) AS sim, bool_or(i) AS i FROM both_ GROUP BY 1, 2)
SELECT r AS record_id, e AS entity_id, round(sim, 6) AS similarity, i AS by_identifier, (row_number() OVER (PARTITION BY r ORDER BY sim DESC, e) - 1)::INT AS candidate_index FROM one"""
)
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    r = t["raw_records"]
    return retrieval.shortlist(retrieval.candidates_by_vector(t, r), retrieval.candidates_by_identifier(t, r)).withColumn("similarity", F.round("similarity", 6))


@query()
def resolution(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and outcomes of the offline judge over the whole shortlist."""
    t = tables(spark, d)
    r = t["raw_records"]
    short = retrieval.shortlist(retrieval.candidates_by_vector(t, r), retrieval.candidates_by_identifier(t, r))
    out = retrieval.scored(short, retrieval.adjudicate(short, r, t["canonical_entities"], retrieval.RuleAdjudicator()))
    return out.select("record_id", "entity_id", "verdict", F.round("combined", 6).alias("combined"), "status")


@query(f"WITH {BARRED} SELECT r AS record_id, e AS entity_id FROM gone")
def excluded_pairs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.excluded_pairs(tables(spark, d))


@query(
    f"WITH {LINKS}, x AS (SELECT l.canonical_entity_id AS entity_id, unnest(r.embedding) AS v, generate_subscripts(r.embedding, 1) AS pos FROM links l JOIN raw_records r ON r.id = l.raw_record_id WHERE r.embedding IS NOT NULL), m AS (SELECT entity_id, pos, round(avg(v::DOUBLE), 6) AS v FROM x GROUP BY 1, 2) SELECT entity_id, list(v ORDER BY pos) AS centroid FROM m GROUP BY 1"
)
def entity_centroids(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return state.centroids(t["raw_to_canonical"], t["raw_records"]).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


NEW_LINKS = """SELECT r.id AS raw_record_id, min(e.id) AS canonical_entity_id FROM raw_records r JOIN canonical_entities e ON e.organization_id = r.organization_id AND lower(e.primary_email) = lower(r.email) WHERE r.email <> '' GROUP BY 1"""


@query(f"WITH n AS ({NEW_LINKS}) SELECT raw_record_id, canonical_entity_id FROM raw_to_canonical UNION ALL SELECT raw_record_id, canonical_entity_id FROM n WHERE raw_record_id NOT IN (SELECT raw_record_id FROM raw_to_canonical)")
def link_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Links by address, added for records that have none."""
    t = tables(spark, d)
    r = t["raw_records"].filter("email <> ''").select(F.col("id").alias("raw_record_id"), "organization_id", F.lower("email").alias("m"))
    e = t["canonical_entities"].select("organization_id", F.lower("primary_email").alias("m"), F.col("id").alias("e"))
    new = r.join(e, ["organization_id", "m"]).groupBy("raw_record_id", "organization_id").agg(F.min("e").alias("canonical_entity_id"))
    new = new.withColumns({"link_method": F.lit("identifier"), "linked_at": F.lit("2026-01-01").cast("timestamp")})
    return state.add_links(t["raw_to_canonical"], new).select("raw_record_id", "canonical_entity_id")


@query("SELECT canonical_entity_id, candidate_raw_record_id FROM (SELECT DISTINCT canonical_entity_id, raw_record_id AS candidate_raw_record_id FROM raw_to_canonical) n WHERE NOT EXISTS (SELECT 1 FROM merge_suggestions m WHERE m.canonical_entity_id = n.canonical_entity_id AND m.candidate_raw_record_id = n.candidate_raw_record_id)")
def suggestion_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Which links would be new suggestions: a pair is suggested once, whatever came of it."""
    t = tables(spark, d)
    new = t["raw_to_canonical"].select(F.col("raw_record_id").alias("id"), "organization_id", "canonical_entity_id", F.col("raw_record_id").alias("candidate_raw_record_id"), F.col("linked_at").alias("created_at"))
    put = {"vector_similarity": F.lit(1.0), "llm_confidence": F.lit(1.0), "combined_confidence": F.lit(1.0), "llm_verdict": F.lit(True), "reasoning": F.lit(""), "status": F.lit("pending"), "decided_at": F.lit(None), "decided_by": F.lit(None)}
    return state.new_suggestions(t["merge_suggestions"], new.withColumns(put)).select("canonical_entity_id", "candidate_raw_record_id")


@query(
    "SELECT e.id, " + ", ".join(f"coalesce(nullif(e.{p}, ''), nullif(r.{c}, '')) AS {p}" for p, c in (("primary_email", "email"), ("primary_phone", "phone"), ("primary_organization", "organization"), ("primary_role", "role_title"))) + " FROM canonical_entities e LEFT JOIN (SELECT l.canonical_entity_id AS eid, min(raw_record_id) AS rid FROM raw_to_canonical l GROUP BY 1) l ON l.eid = e.id LEFT JOIN raw_records r ON r.id = l.rid"
)
def enrich_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Blank fields of every entity filled from its first record."""
    t = tables(spark, d)
    first = t["raw_to_canonical"].groupBy("canonical_entity_id").agg(F.min("raw_record_id").alias("_r"))
    values = first.join(t["raw_records"].withColumnRenamed("id", "_r"), "_r").select(F.col("canonical_entity_id").alias("id"), "email", "phone", "organization", "role_title")
    return state.enriched(t["canonical_entities"], values).select("id", "primary_email", "primary_phone", "primary_organization", "primary_role")


CHOSEN = "s AS (SELECT * FROM merge_suggestions WHERE status = 'pending' ORDER BY id LIMIT 1)"


def _chosen(spark: SparkSession, d: str):
    return table(spark, d, "merge_suggestions").filter("status = 'pending'").orderBy("id").limit(1).collect()[0]


@query(
    f"""WITH {CHOSEN}, prev AS (SELECT DISTINCT l.canonical_entity_id AS e FROM raw_to_canonical l, s WHERE l.raw_record_id = s.candidate_raw_record_id AND l.canonical_entity_id <> s.canonical_entity_id),
gone AS (SELECT e FROM prev WHERE NOT EXISTS (SELECT 1 FROM raw_to_canonical l, s WHERE l.canonical_entity_id = prev.e AND l.raw_record_id <> s.candidate_raw_record_id))
SELECT m.id, CASE WHEN m.id = s.id THEN 'approved' WHEN m.candidate_raw_record_id = s.candidate_raw_record_id AND m.status = 'pending' THEN 'rejected' ELSE m.status END AS status,
  CASE WHEN m.id = s.id THEN 'me' WHEN m.candidate_raw_record_id = s.candidate_raw_record_id AND m.status = 'pending' THEN 'superseded' ELSE m.decided_by END AS decided_by FROM merge_suggestions m, s WHERE m.canonical_entity_id NOT IN (SELECT e FROM gone)"""
)
def approve_suggestions(spark: SparkSession, d: str) -> DataFrame:
    s = _chosen(spark, d)
    return state.approve(_state(spark, d), s["id"], s["organization_id"], "me", "2026-01-01").merge_suggestions.select("id", "status", "decided_by")


@query(
    f"""WITH {CHOSEN}, l2 AS (SELECT l.raw_record_id, l.canonical_entity_id FROM raw_to_canonical l, s WHERE l.raw_record_id <> s.candidate_raw_record_id UNION ALL SELECT candidate_raw_record_id, canonical_entity_id FROM s),
prev AS (SELECT DISTINCT l.canonical_entity_id AS e FROM raw_to_canonical l, s WHERE l.raw_record_id = s.candidate_raw_record_id AND l.canonical_entity_id <> s.canonical_entity_id)
SELECT e.id, coalesce(nullif(e.primary_email, ''), CASE WHEN e.id = s.canonical_entity_id THEN nullif(r.email, '') END) AS primary_email, coalesce(nullif(e.primary_phone, ''), CASE WHEN e.id = s.canonical_entity_id THEN nullif(r.phone, '') END) AS primary_phone, (SELECT count(*) FROM l2 WHERE l2.canonical_entity_id = e.id) AS n_links
FROM canonical_entities e, s JOIN raw_records r ON r.id = s.candidate_raw_record_id WHERE NOT (e.id IN (SELECT e FROM prev) AND NOT EXISTS (SELECT 1 FROM l2 WHERE l2.canonical_entity_id = e.id))"""
)
def approve_entities(spark: SparkSession, d: str) -> DataFrame:
    s = _chosen(spark, d)
    after = state.approve(_state(spark, d), s["id"], s["organization_id"], "me", "2026-01-01")
    n = after.raw_to_canonical.groupBy(F.col("canonical_entity_id").alias("_e")).agg(F.count(F.lit(1)).alias("n"))
    e = after.canonical_entities.join(n, F.col("id") == F.col("_e"), "left")
    return e.select("id", "primary_email", "primary_phone", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(f"WITH {CHOSEN} SELECT m.id, CASE WHEN m.id = s.id THEN 'rejected' ELSE m.status END AS status, CASE WHEN m.id = s.id THEN 'me' ELSE m.decided_by END AS decided_by FROM merge_suggestions m, s")
def reject_suggestion(spark: SparkSession, d: str) -> DataFrame:
    s = _chosen(spark, d)
    return state.reject(_state(spark, d), s["id"], s["organization_id"], "me", "2026-01-01").merge_suggestions.select("id", "status", "decided_by")


SHARED = "one AS (SELECT DISTINCT l.canonical_entity_id AS e, r.source_id AS s FROM raw_to_canonical l JOIN raw_records r ON r.id = l.raw_record_id), shared AS (SELECT DISTINCT a.s AS source_id, b.s AS other FROM one a JOIN one b ON a.e = b.e AND a.s <> b.s)"


@query(f"WITH {SHARED} SELECT source_id, other FROM shared")
def shared_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return tenants.all_shared_pairs(t["raw_to_canonical"], t["raw_records"])


@query(
    f"""WITH RECURSIVE {SHARED}, nodes AS (SELECT id FROM sources), reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, x.other FROM reach r JOIN shared x ON x.source_id = r.b) SELECT a AS source_id, min(b) AS component FROM reach GROUP BY 1"""
)
def source_components(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return tenants.components(t["sources"].select(F.col("id").alias("source_id")), tenants.shared_entities(t["raw_to_canonical"], t["raw_records"]))


@query(r"SELECT organization_id, coalesce(string_agg(DISTINCT nullif(trim(imported_by), ''), ', ' ORDER BY nullif(trim(imported_by), '')), '') AS importers, count(*) AS sources FROM sources WHERE organization_id NOT LIKE 'org\_user\_%' ESCAPE '\' GROUP BY 1")
def tenant_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tenants.tenant_list(table(spark, d, "sources"))


_INTEGRITY = {
    "record_source": "raw_records x JOIN sources y ON y.id = x.source_id",
    "link_record": "raw_to_canonical x JOIN raw_records y ON y.id = x.raw_record_id",
    "link_entity": "raw_to_canonical x JOIN canonical_entities y ON y.id = x.canonical_entity_id",
    "suggestion_record": "merge_suggestions x JOIN raw_records y ON y.id = x.candidate_raw_record_id",
    "suggestion_entity": "merge_suggestions x JOIN canonical_entities y ON y.id = x.canonical_entity_id",
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS n FROM {f} WHERE x.organization_id <> y.organization_id" for c, f in _INTEGRITY.items()))
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    return tenants.integrity(_state(spark, d))


_INVARIANTS = {
    "record_with_two_entities": "SELECT raw_record_id FROM raw_to_canonical GROUP BY 1 HAVING count(DISTINCT canonical_entity_id) > 1",
    "repeated_suggestion": "SELECT 1 FROM merge_suggestions GROUP BY canonical_entity_id, candidate_raw_record_id HAVING count(*) > 1",
    "unknown_state": "SELECT 1 FROM merge_suggestions WHERE status NOT IN ('pending', 'approved', 'rejected')",
    "link_without_record": "SELECT 1 FROM raw_to_canonical WHERE raw_record_id NOT IN (SELECT id FROM raw_records)",
    "link_without_entity": "SELECT 1 FROM raw_to_canonical WHERE canonical_entity_id NOT IN (SELECT id FROM canonical_entities)",
    "suggestion_without_entity": "SELECT 1 FROM merge_suggestions WHERE canonical_entity_id NOT IN (SELECT id FROM canonical_entities)",
    "suggestion_without_record": "SELECT 1 FROM merge_suggestions WHERE candidate_raw_record_id NOT IN (SELECT id FROM raw_records)",
    "record_without_source": "SELECT 1 FROM raw_records WHERE source_id NOT IN (SELECT id FROM sources)",
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS n FROM ({q})" for c, q in _INVARIANTS.items()))
def invariant_checks(spark: SparkSession, d: str) -> DataFrame:
    return schemas.invariants(tables(spark, d))


PICKED = "('org-sen-vang', 'org-phu-sa', 'org-tre-viet')"


def _owners(spark: SparkSession, d: str) -> DataFrame:
    mail = F.nullif(F.lower(F.trim(text.null_to_blank("imported_by"))), F.lit(""))
    return table(spark, d, "sources").select(mail.alias("email")).filter("email is not null").distinct().withColumn("organization_id", text.tenant_key(F.lit(""), F.lit(""), "email"))


@query(
    f"""WITH RECURSIVE {SHARED}, chosen AS (SELECT id, imported_by, imported_at FROM sources WHERE organization_id IN {PICKED}), near AS (SELECT x.source_id, x.other FROM shared x WHERE x.source_id IN (SELECT id FROM chosen) AND x.other IN (SELECT id FROM chosen)),
reach(a, b) AS (SELECT id, id FROM chosen UNION SELECT r.a, x.other FROM reach r JOIN near x ON x.source_id = r.b), comp AS (SELECT a AS source_id, min(b) AS component FROM reach GROUP BY 1),
blocked AS (SELECT c.component, string_agg(DISTINCT s.organization_id, ', ' ORDER BY s.organization_id) AS blocked_by FROM comp c JOIN shared x ON x.source_id = c.source_id JOIN sources s ON s.id = x.other WHERE x.other NOT IN (SELECT id FROM chosen) GROUP BY 1),
who AS (SELECT c.component, h.id, nullif(trim(h.imported_by), '') AS w, h.imported_at FROM comp c JOIN chosen h ON h.id = c.source_id),
firsts AS (SELECT component, w FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY imported_at, id) AS k FROM who WHERE w IS NOT NULL) WHERE k = 1)
SELECT n.component, n.sources, coalesce(n.importers, '') AS importers, b.blocked_by, CASE WHEN f.w IS NOT NULL THEN 'org_user_' || substr(sha256(lower(f.w)), 1, 24) END AS target
FROM (SELECT component, count(*) AS sources, string_agg(DISTINCT w, ', ' ORDER BY w) AS importers FROM who GROUP BY 1) n LEFT JOIN blocked b ON b.component = n.component LEFT JOIN firsts f ON f.component = n.component"""
)
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return tenants.plan(_state(spark, d), ["org-sen-vang", "org-phu-sa", "org-tre-viet"], _owners(spark, d))


@query()
def migration(spark: SparkSession, d: str) -> DataFrame:
    """Integrity after moving three tenants' ready components."""
    return tenants.migrate(_state(spark, d), ["org-sen-vang", "org-phu-sa", "org-tre-viet"], _owners(spark, d))[3]


@query("SELECT id, trim(regexp_replace(coalesce(full_name, ''), '\\s+', ' ', 'g')) AS name_cell, trim(regexp_replace(coalesce(notes, ''), '\\s+', ' ', 'g')) AS note_cell FROM raw_records")
def norm_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.cell("full_name").alias("name_cell"), text.cell("notes").alias("note_cell"))


@query("WITH x AS (SELECT id, lower(trim(regexp_replace(coalesce(email, ''), '\\s+', ' ', 'g'))) AS v FROM raw_records) SELECT id, CASE WHEN regexp_matches(v, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN v ELSE '' END AS email FROM x")
def norm_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.email("email").alias("email"))


@query("WITH x AS (SELECT id, regexp_replace(regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g'), '^\\+', '') AS v FROM raw_records) SELECT id, CASE WHEN v LIKE '84%' AND length(v) > 9 THEN '0' || substr(v, 3) ELSE v END AS phone FROM x")
def norm_phone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.phone("phone").alias("phone"))


_PART = "nullif(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')), '')"


@query(f"SELECT id, coalesce(nullif(concat_ws(' | ', {_PART.format('full_name')}, {_PART.format('organization')}, {_PART.format('role_title')}), ''), '(không rõ)') AS identity FROM raw_records")
def norm_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.identity("full_name", "organization", "role_title").alias("identity"))


_TITLE = "(?i)^(gs|pgs|ts|ths|th\\.s|bs|ks|cn|ncs|prof|dr|mr|mrs|ms|ong|ba)\\b[.\\s]*"


def _titles(v: str) -> str:
    out = v
    for _ in range(4):
        out = f"regexp_replace({out}, '{_TITLE}', '')"
    return out


@query(f"WITH x AS (SELECT c_custkey, 'PGS.TS. ' || c_name AS v FROM customer) SELECT c_custkey, trim({_titles('v')}) AS name, trim(regexp_replace(lower({_titles('v')}), '[^a-z0-9]+', ' ', 'g')) AS blocking_key FROM x")
def norm_titles(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("PGS.TS. "), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.strip_titles(v).alias("name"), text.blocking_key(v).alias("blocking_key"))


@query()
def blocking_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.blocking_key("full_name").alias("blocking_key"))


def _built(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1900 AND 2200 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d')::DATE END"


def _part(v: str, pattern: str, group: int) -> str:
    return f"try_cast(regexp_extract({v}, '{pattern}', {group}) AS INT)"


_ISO, _DMY, _VN = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})", "^(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{2,4})", "(\\d{1,2})\\s*thang\\s*(\\d{1,2})\\s*(?:nam\\s*)?(\\d{4})"


@query(
    f"""WITH x AS (SELECT id, trim(regexp_replace(coalesce(event_date_raw, ''), '\\s+', ' ', 'g')) AS v FROM raw_records), f AS (SELECT *, lower(replace(replace(strip_accents(v), 'đ', 'd'), 'Đ', 'D')) AS w FROM x),
p AS (SELECT *, {_part('v', _DMY, 1)} AS d, {_part('v', _DMY, 2)} AS m, {_part('v', _DMY, 3)} AS y0 FROM f), q AS (SELECT *, CASE WHEN y0 < 70 THEN y0 + 2000 WHEN y0 < 100 THEN y0 + 1900 ELSE y0 END AS y FROM p)
SELECT id, CASE WHEN regexp_matches(v, '^\\d{{5}}(\\.\\d+)?$') THEN CASE WHEN {_part('v', '^(\\d+)', 1)} BETWEEN 1 AND 100000 THEN DATE '1899-12-30' + {_part('v', '^(\\d+)', 1)} END
  WHEN regexp_matches(v, '{_ISO}') THEN {_built(*(_part('v', _ISO, g) for g in (1, 2, 3)))}
  WHEN regexp_matches(v, '{_DMY}') THEN CASE WHEN m > 12 AND d <= 12 THEN {_built('y', 'd', 'm')} ELSE {_built('y', 'm', 'd')} END
  WHEN regexp_matches(w, '{_VN}') THEN {_built(*(_part('w', _VN, g) for g in (3, 2, 1)))}
  ELSE coalesce(try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%b %d, %Y'))::DATE END AS event_date FROM q"""
)
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    """The day each text means by the rules of the importer (not those of problem 6)."""
    return table(spark, d, "raw_records").select("id", dates.event_date("event_date_raw").alias("event_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 1 AND 100000 THEN DATE '1899-12-30' + (o_orderkey % 100000 + 1)::INT END AS day FROM orders")
def excel_serials(spark: SparkSession, d: str) -> DataFrame:
    serial = (F.col("o_orderkey") % 100000 + 1).cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey").between(1, 100000), dates.excel_serial(serial)).alias("day"))


@query("SELECT o_orderkey, strptime(printf('%02d/%02d/%04d', day(o_orderdate), month(o_orderdate), year(o_orderdate)), '%d/%m/%Y')::DATE AS day FROM orders")
def day_first_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.event_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"))


@query("SELECT id, CASE WHEN regexp_matches(organization_id, '^[a-zA-Z0-9._-]{1,128}$') THEN organization_id ELSE 'org_user_' || substr(sha256(id), 1, 24) END AS tenant, 'org_user_' || substr(sha256(id), 1, 24) AS own FROM sources")
def tenant_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.tenant_key("organization_id", F.lit(None).cast("string"), "id").alias("tenant"), text.tenant_key(F.lit("org a"), F.lit(""), "id").alias("own"))


@query("SELECT id, regexp_replace(name, '\\.[^./\\\\]{0,6}$', '') AS title, CASE WHEN length(name) > 20 THEN substr(name, 1, 19) || '…' ELSE name END AS short FROM sources")
def source_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", text.trim_extension("name").alias("title"), text.truncate("name", 20).alias("short"))


_PRICE = "l_extendedprice::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS quantity, CASE WHEN {_PRICE} = floor({_PRICE}) THEN ({_PRICE})::BIGINT::VARCHAR ELSE ({_PRICE})::VARCHAR END AS price FROM lineitem")
def sheet_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.number_text("l_quantity").alias("quantity"), text.number_text("l_extendedprice").alias("price"))


@query(f"WITH {ENTITIES} SELECT * FROM entities WHERE organization_id = '{TENANT}'")
def tenant_entities(spark: SparkSession, d: str) -> DataFrame:
    """The directory of one tenant: the condition is in the filters of every scan."""
    return reads.search_entities(reads.of_tenant(tables(spark, d), TENANT))


@query(f"{DETAILS} WHERE r.organization_id = '{TENANT}'")
def tenant_records(spark: SparkSession, d: str) -> DataFrame:
    return reads.record_details(reads.of_tenant(tables(spark, d), TENANT))


@query(f"WITH {ENTITIES} SELECT * FROM entities WHERE organization_id = '{TENANT}' AND id = (SELECT min(id) FROM canonical_entities WHERE organization_id = '{TENANT}')")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return reads.entity_by_id(t, TENANT, _first_id(t["canonical_entities"]))


@query(f"{DETAILS} WHERE r.organization_id = '{TENANT}' AND r.id = (SELECT min(id) FROM raw_records WHERE organization_id = '{TENANT}')")
def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return reads.record_by_id(t, TENANT, _first_id(t["raw_records"]))


def _first_id(df: DataFrame) -> str:
    return df.filter(F.col("organization_id") == TENANT).agg(F.min("id")).first()[0]


@query(f"WITH {LINKS}, {{0}}, h AS (SELECT x.*, row_number() OVER (ORDER BY event_date DESC NULLS LAST, created_at DESC, id) AS k FROM links l JOIN details x ON x.id = l.raw_record_id WHERE l.canonical_entity_id = (SELECT canonical_entity_id FROM raw_to_canonical GROUP BY 1 ORDER BY count(DISTINCT raw_record_id) DESC, 1 LIMIT 1)) SELECT id, event_date, created_at, k::INT AS position FROM h".format(f"details AS ({DETAILS})"))
def history_order(spark: SparkSession, d: str) -> DataFrame:
    """The history of the entity with the most records, with each record's place in it."""
    t = tables(spark, d)
    top = reads.links(t).groupBy("canonical_entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "canonical_entity_id").first()[0]
    order = Window.orderBy(F.monotonically_increasing_id())  # one entity's records, in the order given
    return reads.entity_history(t, top).coalesce(1).withColumn("position", F.row_number().over(order)).select("id", "event_date", "created_at", "position")


@query(f"WITH {ENTITIES} SELECT count(*) AS total, greatest(1, ceil(count(*) / 25.0))::BIGINT AS pages FROM entities WHERE event_count > 1")
def entity_total(spark: SparkSession, d: str) -> DataFrame:
    return reads.entity_total(tables(spark, d), search.build([_f("event_count", "gt", "1")], "AND"))


@query("SELECT s.id, s.organization_id, s.name, s.source_type, s.imported_at, count(r.id) AS record_count FROM sources s LEFT JOIN raw_records r ON r.source_id = s.id GROUP BY ALL ORDER BY s.imported_at DESC, s.id LIMIT 20")
def latest_sources(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_sources(tables(spark, d)).limit(20)


@query("SELECT s.organization_id, s.source_type, count(DISTINCT s.id) AS files FROM sources s GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 7")
def first_types(spark: SparkSession, d: str) -> DataFrame:
    return reads.statistics_by_type(tables(spark, d)).limit(7).select("organization_id", "source_type", "files")


@query(r"SELECT organization_id, count(*) AS sources FROM sources WHERE organization_id NOT LIKE 'org\_user\_%' ESCAPE '\' GROUP BY 1 ORDER BY 1 LIMIT 3")
def first_tenants(spark: SparkSession, d: str) -> DataFrame:
    return tenants.tenant_list(table(spark, d, "sources")).limit(3).select("organization_id", "sources")


@query("WITH s AS (SELECT id, CASE WHEN coalesce(full_name, '') <> '' THEN full_name WHEN coalesce(email, '') = '' THEN organization ELSE email END AS name FROM raw_records WHERE coalesce(full_name, '') <> '' OR coalesce(email, '') <> '' OR coalesce(organization, '') <> '') SELECT id AS raw_record_id, name AS display_name FROM s")
def seed_names(spark: SparkSession, d: str) -> DataFrame:
    """The display name each record's own entity would start with."""
    entities, links = state.seeds(table(spark, d, "raw_records"), IMPORT_AS_OF)
    return links.join(entities, links["canonical_entity_id"] == entities["id"]).select("raw_record_id", "display_name")


@query("SELECT id, list_filter(list_transform(string_split(coalesce(notes, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM raw_records")
def split_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("id", text.split_list("notes").alias("parts"))


@query(
    f"WITH {LINKS}, x AS (SELECT l.canonical_entity_id AS entity_id, unnest(r.embedding) AS v, generate_subscripts(r.embedding, 1) AS pos FROM links l JOIN raw_records r ON r.id = l.raw_record_id WHERE r.embedding IS NOT NULL), m AS (SELECT entity_id, pos, avg(v::DOUBLE) AS v FROM x GROUP BY 1, 2), n AS (SELECT entity_id, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1) SELECT m.entity_id, list(round(CASE WHEN norm > 0 THEN v / norm ELSE v END, 5) ORDER BY pos) AS centroid FROM m JOIN n ON n.entity_id = m.entity_id GROUP BY 1"
)
def unit_centroids(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return state.centroids(t["raw_to_canonical"], t["raw_records"], unit=True).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 5)))


@query("SELECT id AS source_id, map_from_entries(list_sort(map_entries(field_mapping)))::JSON::VARCHAR AS mapping FROM sources")
def mapping_json(spark: SparkSession, d: str) -> DataFrame:
    """Each file's mapping as the JSON object that is stored with it, its headers in order."""
    return table(spark, d, "sources").select(F.col("id").alias("source_id"), grid.map_json("field_mapping").alias("mapping"))


@query("WITH m AS (SELECT unnest(map_entries(field_mapping)) AS e FROM sources) SELECT e.key AS header, e.value AS field, CASE e.value " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reads.FIELD_OPTIONS.items()) + " ELSE e.value END AS label, count(*) AS files FROM m GROUP BY ALL")
def mapped_headers(spark: SparkSession, d: str) -> DataFrame:
    """How many files map a header to a field, with the field's label."""
    m = table(spark, d, "sources").select(F.explode("field_mapping").alias("header", "field"))
    return m.groupBy("header", "field").agg(F.count(F.lit(1)).alias("files")).withColumn("label", reads.label("field", reads.FIELD_OPTIONS))


HEADERS = ["Khách", "", "Ghi chú", "Ghi chú"]


@query(
    "SELECT (c_custkey + 1)::INT AS row_number, trim(c_name) AS full_name, c_mktsegment || ' / ' || c_nationkey AS notes, 'Danh_sach' AS event_name, trim(c_name) AS normalized_text FROM customer"
)
def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of all customers, parsed with two note columns."""
    c = table(spark, d, "customer")
    lines = c.select((F.col("c_custkey") + 1).cast("int").alias("row_number"), F.array(F.col("c_name"), F.lit(""), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("cells"))
    headers = grid.header_names(HEADERS, 4)
    parsed = grid.parse_rows(headers, grid.rectangular(lines, 4), {"Khách": "full_name", "Ghi chú": "notes", "Ghi chú (2)": "notes"}, "Danh_sach.xlsx")
    return parsed.select("row_number", "full_name", "notes", "event_name", "normalized_text")


IMPORT_AS_OF = "2026-06-01"


@query()
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of importing all incoming rows into the current state, a file per tenant; summed over the tenants."""
    i = table(spark, d, "incoming_records")
    now = F.lit(IMPORT_AS_OF).cast("timestamp")
    names = {f.name: f.dataType for f in schemas.RECORDS}
    records = i.select("id", "organization_id", "full_name", "organization", "role_title", "email", "phone", "normalized_text")
    records = records.withColumns({"source_id": F.concat(F.lit("incoming-"), "organization_id"), "row_number": F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int"), "raw_data": F.create_map(F.lit("name"), text.null_to_blank("full_name")), "created_at": now})
    records = records.withColumns({n: F.lit(None).cast(k) for n, k in names.items() if n not in records.columns})
    source = i.select("organization_id").distinct().select(F.concat(F.lit("incoming-"), "organization_id").alias("id"), "organization_id", F.lit("incoming.xlsx").alias("name"), F.lit("local_upload").alias("source_type"), F.lit(None).cast("string").alias("external_file_id"), F.lit(None).cast("string").alias("imported_by"), now.alias("imported_at"), F.create_map(F.lit("name"), F.lit("full_name")).alias("field_mapping"))
    return state.import_batch(_state(spark, d), source, records, IMPORT_AS_OF)[1]


