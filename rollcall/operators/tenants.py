"""Moving sources to the tenants of their importers, along the graph of shared entities."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import null_to_blank
from rollcall.operators.state import State
from rollcall.session import cut

ROUNDS = 40


def tenant_list(sources: DataFrame) -> DataFrame:
    """(organization_id, importers, sources) of shared tenants, that is all but those of single users, by name."""
    shared = sources.filter(~F.col("organization_id").like("org\\_user\\_%"))
    who = F.nullif(F.trim(null_to_blank("imported_by")), F.lit(""))
    return shared.groupBy("organization_id").agg(F.array_join(F.array_sort(F.collect_set(who)), ", ").alias("importers"), F.count(F.lit(1)).alias("sources")).orderBy("organization_id")


def shared_entities(links: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, other): pairs of sources that share an entity, both ways.

    Sources of an entity are united before they meet, so an entity with many records gives its sources once; an entity of
    very many sources links each to the smallest only, which connects the same components.
    """
    one = links.select("raw_record_id", "canonical_entity_id").join(records.select(F.col("id").alias("raw_record_id"), "source_id"), "raw_record_id").select("canonical_entity_id", "source_id").distinct()
    hub = one.groupBy("canonical_entity_id").agg(F.min("source_id").alias("hub"))
    star = one.join(hub, "canonical_entity_id").filter("source_id <> hub").select("source_id", F.col("hub").alias("other")).distinct()
    return star.unionByName(star.select(F.col("other").alias("source_id"), F.col("source_id").alias("other"))).distinct()


def all_shared_pairs(links: DataFrame, records: DataFrame) -> DataFrame:
    """(source_id, other) of every ordered pair of sources with an entity in common."""
    one = links.select("raw_record_id", "canonical_entity_id").join(records.select(F.col("id").alias("raw_record_id"), "source_id"), "raw_record_id").select("canonical_entity_id", "source_id").distinct()
    return one.join(one.select("canonical_entity_id", F.col("source_id").alias("other")), "canonical_entity_id").filter("source_id <> other").select("source_id", "other").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, component): the smallest id of each component, by min-label propagation with pointer jumping."""
    edges = cut(edges)
    labels = cut(nodes.select("source_id", F.col("source_id").alias("component")))
    for _ in range(ROUNDS):
        near = edges.join(labels.withColumnsRenamed({"source_id": "other", "component": "_c"}), "other").groupBy("source_id").agg(F.min("_c").alias("near"))
        jump = labels.select(F.col("source_id").alias("component"), F.col("component").alias("far"))
        fresh = cut(labels.join(near, "source_id", "left").join(jump, "component", "left").select("source_id", "component", F.least("component", "near", "far").alias("fresh")))
        moved = fresh.filter("fresh < component").limit(1).count()
        labels = fresh.select("source_id", F.col("fresh").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"components not stable after {ROUNDS} rounds")


def plan(state: State, tenants: list[str], owners: DataFrame) -> DataFrame:
    """(component, sources, importers, blocked_by, target): what would move where.

    blocked_by names the tenants of sources outside the selection that share an entity; the target is the tenant of the
    first importer by time and id, matched on the lower-case address in owners (email, organization_id).
    """
    chosen = state.sources.filter(F.col("organization_id").isin(tenants)).select(F.col("id").alias("source_id"), "imported_by", "imported_at")
    full = cut(all_edges_from(chosen, state))
    near = full.join(chosen.select(F.col("source_id").alias("other")), "other", "left_semi").select("source_id", "other")
    comp = components(chosen, near)
    outside = full.join(chosen.select(F.col("source_id").alias("other")), "other", "left_anti").join(state.sources.select(F.col("id").alias("other"), "organization_id"), "other")
    blocked = outside.join(comp, "source_id").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("organization_id")), ", ").alias("blocked_by"))
    who = F.nullif(F.trim(null_to_blank("imported_by")), F.lit(""))
    seen = comp.join(chosen, "source_id").groupBy("component").agg(F.count(F.lit(1)).alias("sources"), F.array_join(F.array_sort(F.collect_set(who)), ", ").alias("importers"), F.min_by(who, F.when(who.isNotNull(), F.struct("imported_at", "source_id"))).alias("first"))
    own = owners.groupBy(F.lower("email").alias("_email")).agg(F.min("organization_id").alias("target"))
    return seen.join(own, F.lower("first") == F.col("_email"), "left").join(blocked, "component", "left").select("component", "sources", "importers", "blocked_by", "target")


def all_edges_from(chosen: DataFrame, state: State) -> DataFrame:
    """(source_id, other): for chosen sources, every source with an entity in common."""
    one = state.raw_to_canonical.select("raw_record_id", "canonical_entity_id").join(state.raw_records.select(F.col("id").alias("raw_record_id"), "source_id"), "raw_record_id").select("canonical_entity_id", "source_id").distinct()
    mine = one.join(chosen.select("source_id"), "source_id", "left_semi")
    return mine.join(one.select("canonical_entity_id", F.col("source_id").alias("other")), "canonical_entity_id").filter("source_id <> other").select("source_id", "other").distinct()


def integrity(state: State) -> DataFrame:
    """(check, n): rows whose tenant differs from the one they depend on; all must be 0."""
    source = state.sources.select(F.col("id").alias("source_id"), F.col("organization_id").alias("_t"))
    record = state.raw_records.select(F.col("id").alias("_r"), F.col("organization_id").alias("_rt"))
    entity = state.canonical_entities.select(F.col("id").alias("_e"), F.col("organization_id").alias("_et"))
    r, l, s = state.raw_records, state.raw_to_canonical, state.merge_suggestions
    checks = {
        "record_source": r.join(source, "source_id").filter("organization_id <> _t"),
        "link_record": l.join(record, l["raw_record_id"] == F.col("_r")).filter("organization_id <> _rt"),
        "link_entity": l.join(entity, l["canonical_entity_id"] == F.col("_e")).filter("organization_id <> _et"),
        "suggestion_record": s.join(record, s["candidate_raw_record_id"] == F.col("_r")).filter("organization_id <> _rt"),
        "suggestion_entity": s.join(entity, s["canonical_entity_id"] == F.col("_e")).filter("organization_id <> _et"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("check"), "n") for c, df in checks.items()])


def migrate(state: State, tenants: list[str], owners: DataFrame) -> tuple[State, DataFrame, DataFrame, DataFrame]:
    """(new state, plan, dropped suggestions by status, integrity): ready components move; a dry run is not using the new state."""
    planned = cut(plan(state, tenants, owners))
    chosen = state.sources.filter(F.col("organization_id").isin(tenants)).select(F.col("id").alias("source_id"), "imported_by", "imported_at")
    full = cut(all_edges_from(chosen, state))
    near = full.join(chosen.select(F.col("source_id").alias("other")), "other", "left_semi").select("source_id", "other")
    comp = components(chosen, near)
    to = cut(comp.join(planned.filter("blocked_by is null and target is not null"), "component").select("source_id", "target"))
    record_to = cut(state.raw_records.select(F.col("id").alias("raw_record_id"), "source_id").join(to, "source_id").select("raw_record_id", "target"))
    entity_to = cut(state.raw_to_canonical.select("raw_record_id", "canonical_entity_id").join(record_to, "raw_record_id").groupBy("canonical_entity_id").agg(F.min("target").alias("target")))

    def moved(df: DataFrame, key: str, by: DataFrame, by_key: str) -> DataFrame:
        m = by.select(F.col(by_key).alias("_k"), F.col("target").alias("_to"))
        return df.join(m, F.col(key) == F.col("_k"), "left").withColumn("organization_id", F.coalesce("_to", "organization_id")).select(*df.columns)

    suggestions = moved(state.merge_suggestions, "canonical_entity_id", entity_to, "canonical_entity_id")
    records = moved(state.raw_records, "source_id", to, "source_id")
    tenant_of = records.select(F.col("id").alias("_r"), F.col("organization_id").alias("_t"))
    scope = entity_to.select(F.col("canonical_entity_id").alias("_e"))
    checked = suggestions.join(tenant_of, suggestions["candidate_raw_record_id"] == F.col("_r"), "left").join(scope, suggestions["canonical_entity_id"] == F.col("_e"), "left").join(record_to.select(F.col("raw_record_id").alias("_m")), suggestions["candidate_raw_record_id"] == F.col("_m"), "left")
    cross = (F.col("_e").isNotNull() | F.col("_m").isNotNull()) & (F.col("_t") != F.col("organization_id"))
    checked = cut(checked.withColumn("_cross", F.coalesce(cross, F.lit(False))))
    after = replace(
        state, sources=moved(state.sources, "id", to, "source_id"), raw_records=records, canonical_entities=moved(state.canonical_entities, "id", entity_to, "canonical_entity_id"),
        raw_to_canonical=moved(state.raw_to_canonical, "raw_record_id", record_to, "raw_record_id"), merge_suggestions=checked.filter("not _cross").select(*state.merge_suggestions.columns),
    )
    dropped = checked.filter("_cross").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return after, planned, dropped, integrity(after)


def ready(planned: DataFrame) -> DataFrame:
    """Components that can move."""
    return planned.filter("blocked_by is null and target is not null")
