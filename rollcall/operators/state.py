"""State transitions as pure functions from five DataFrames to five DataFrames, and snapshots that publish them.

A snapshot is a folder v=N with the tables that changed and a list that names the folder of every table; a pointer file
names the current version and is replaced by rename, so readers never see a half written one. A table that is the very one
that was loaded isn't written again. There is one writer.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions.scores import l2_normalize
from rollcall.functions.text import blank_to_null, stable_id
from rollcall.operators import retrieval
from rollcall.session import cut

BATCH = 16
#: Decisions that are folded before their tables are cut.
SETTLE = 8


class NotFound(LookupError):
    """No such suggestion in the tenant."""


class Conflict(ValueError):
    """The suggestion has been decided."""


@dataclass(frozen=True)
class State:
    sources: DataFrame
    raw_records: DataFrame
    canonical_entities: DataFrame
    raw_to_canonical: DataFrame
    merge_suggestions: DataFrame
    version: int = 0

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in schemas.TABLES}

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(**{n: schemas.empty(spark, n) for n in schemas.TABLES})

    def map(self, f: Callable[[str, DataFrame], DataFrame]) -> State:
        return replace(self, **{n: f(n, df) for n, df in self.tables.items()})

    def settled(self) -> State:
        """All tables cut from their lineage."""
        return self.map(lambda _, df: cut(df))


class Snapshots:
    """Numbered versions of a state in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._loaded: dict[str, DataFrame] = {}
        self._version: int | None = None

    def current(self) -> int | None:
        found = [s.getPath().getName() for s in self._fs.globStatus(self._path("CURRENT-*")) or []]
        return max((int(n.split("-")[1]) for n in found), default=None)

    def folders(self, version: int) -> dict[str, str]:
        """The folder of every table of a version."""
        rows = self.spark.read.schema("name string, folder string").json(f"{self.folder}/v={version}/tables").collect()
        return {r["name"]: r["folder"] for r in rows}

    def save(self, state: State) -> State:
        """Writes the tables that changed as the next version, then publishes it."""
        old = self.current()
        version = (old or 0) + 1
        known = self.folders(old) if old is not None else {}
        at = {}
        for name, df in state.tables.items():
            if old is not None and self._loaded.get(name) is df and self._version == old:
                at[name] = known[name]
                continue
            at[name] = f"{self.folder}/v={version}/{name}"
            df.write.mode("overwrite").parquet(at[name])
        self.spark.createDataFrame(list(at.items()), "name string, folder string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/v={version}/tables")
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        self._fs.create(draft).close()
        if not self._fs.rename(draft, self._path(f"CURRENT-{version}")):
            raise OSError(f"version {version} couldn't be published")
        if old is not None:
            self._fs.delete(self._path(f"CURRENT-{old}"), False)
        return self.load()

    def drop(self) -> None:
        """Deletes all versions."""
        self._fs.delete(self._path(""), True)

    def load(self, version: int | None = None) -> State:
        version = version or self.current()
        if version is None:
            return State.empty(self.spark)
        at = self.folders(version)
        self._loaded = {n: self.spark.read.schema(s).parquet(at[n]) for n, s in schemas.TABLES.items()}
        self._version = version
        return State(**self._loaded, version=version)


def add_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links of records that have none yet are added; the rest of `new` does nothing. Of several new ones for a record the earliest stays."""
    order = Window.partitionBy("raw_record_id").orderBy("linked_at", "canonical_entity_id")
    first = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select("raw_record_id"), "raw_record_id", "left_anti").select(*old.columns))


def new_suggestions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The suggestions that are really new: a pair is suggested once, ever."""
    pair = ["canonical_entity_id", "candidate_raw_record_id"]
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy("created_at", "id"))).filter("_n = 1").drop("_n")
    return first.join(old.select(*pair), pair, "left_anti").select(*old.columns)


def add_suggestions(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new_suggestions(old, new))


def enriched(entities: DataFrame, values: DataFrame) -> DataFrame:
    """Blank primary fields filled from values (id, email, phone, organization, role_title); nothing is overwritten."""
    fields = {"primary_email": "email", "primary_phone": "phone", "primary_organization": "organization", "primary_role": "role_title"}
    v = values.select("id", *(F.col(c).alias("_" + c) for c in fields.values()))
    joined = entities.join(v, "id", "left")
    return joined.withColumns({p: F.coalesce(blank_to_null(p), blank_to_null("_" + c)) for p, c in fields.items()}).select(*entities.columns)


def centroids(links: DataFrame, records: DataFrame, unit: bool = False) -> DataFrame:
    """(entity_id, centroid): the mean of the linked records' vectors, at length one if asked for; entities without any vector are left out.

    Summed per position with map-side combination, so an entity with very many records is no hot group.
    """
    v = links.select("raw_record_id", F.col("canonical_entity_id").alias("entity_id")).distinct().join(records.select(F.col("id").alias("raw_record_id"), "embedding"), "raw_record_id").filter("embedding is not null")
    mean = v.select("entity_id", F.posexplode("embedding").alias("at", "x")).groupBy("entity_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = mean.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))
    return out.withColumn("centroid", l2_normalize("centroid")) if unit else out


def _one(state: State, suggestion_id: str, tenant: str):
    rows = state.merge_suggestions.filter((F.col("id") == suggestion_id) & (F.col("organization_id") == tenant)).limit(1).collect()
    if not rows:
        raise NotFound(suggestion_id)
    if rows[0]["status"] != "pending":
        raise Conflict(suggestion_id)
    return rows[0]


def _decided(df: DataFrame, where, status: str, by: str, as_of: str) -> DataFrame:
    """Rows that satisfy `where` get a status, the rest stays."""
    put = {"status": F.lit(status), "decided_by": F.lit(by), "decided_at": F.lit(as_of).cast("timestamp")}
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in put.items()})


def reject(state: State, suggestion_id: str, tenant: str, by: str, as_of: str) -> State:
    """A pending suggestion is rejected; the row stays as a lasting no."""
    _one(state, suggestion_id, tenant)
    return replace(state, merge_suggestions=_decided(state.merge_suggestions, F.col("id") == suggestion_id, "rejected", by, as_of))


def approve(state: State, suggestion_id: str, tenant: str, by: str, as_of: str) -> State:
    """A pending suggestion is approved: the record moves to the entity; an entity it leaves empty goes with all its suggestions; blanks are filled, the centroid renewed, the record's other pending suggestions rejected as superseded."""
    s = _one(state, suggestion_id, tenant)
    entity, record = s["canonical_entity_id"], s["candidate_raw_record_id"]
    now = F.lit(as_of).cast("timestamp")
    suggestions = _decided(state.merge_suggestions, F.col("id") == suggestion_id, "approved", by, as_of)
    mine = F.col("raw_record_id") == record
    before = {r["canonical_entity_id"] for r in state.raw_to_canonical.filter(mine).select("canonical_entity_id").distinct().collect()} - {entity}
    moved = state.merge_suggestions.filter(F.col("id") == suggestion_id).select(F.lit(record).alias("raw_record_id"), F.lit(entity).alias("canonical_entity_id"), "organization_id", F.lit("approved_merge").alias("link_method"), now.alias("linked_at"))
    links = state.raw_to_canonical.filter(~mine).unionByName(moved)
    kept = {r[0] for r in links.filter(F.col("canonical_entity_id").isin(list(before))).select("canonical_entity_id").distinct().collect()} if before else set()
    gone = list(before - kept)
    entities = state.canonical_entities.filter(~F.col("id").isin(gone))
    suggestions = suggestions.filter(~F.col("canonical_entity_id").isin(gone))
    values = state.raw_records.filter(F.col("id") == record).select(F.lit(entity).alias("id"), "email", "phone", "organization", "role_title")
    entities = enriched(entities, values)
    mean = centroids(links.filter(F.col("canonical_entity_id") == entity), state.raw_records).select(F.col("entity_id").alias("id"), "centroid")
    entities = entities.join(mean, "id", "left").withColumns({"embedding": F.coalesce(F.col("centroid").cast("array<float>"), "embedding"), "updated_at": F.when(F.col("id") == entity, now).otherwise(F.col("updated_at"))}).select(*state.canonical_entities.columns)
    others = (F.col("candidate_raw_record_id") == record) & (F.col("status") == "pending")
    suggestions = _decided(suggestions, others, "rejected", "superseded", as_of)
    return replace(state, canonical_entities=entities, raw_to_canonical=links, merge_suggestions=suggestions)


def decide_all(state: State, decisions: list[tuple[str, str]], tenant: str, by: str, as_of: str) -> State:
    """Decisions (suggestion id, 'approve' or 'reject') folded in order; they don't commute. Tables a decision leaves as they are aren't written; the others are cut from their lineage every SETTLE decisions."""
    steps = {"approve": approve, "reject": reject}
    start = now = state
    for n, (suggestion, what) in enumerate(decisions, 1):
        now = steps[what](now, suggestion, tenant, by, as_of)
        if n % SETTLE == 0 or n == len(decisions):
            now = now.map(lambda name, df: df if df is getattr(start, name) else cut(df))  # noqa: B023
            start = now
    return now


def embedded(records: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> DataFrame:
    """records with vectors of their normalized_text, at unit length; a vector of another length fails the job before anything is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lo in range(0, len(pdf), batch):
                got = embed(list(pdf["normalized_text"].iloc[lo : lo + batch]))
                for v in got:
                    if len(v) != dim:
                        raise ValueError(f"vector of length {len(v)}, not {dim}")
                    n = sum(x * x for x in v) ** 0.5
                    out.append([x / n for x in v] if n else list(v))
            yield pd.DataFrame({"id": pdf["id"], "_v": out})

    vectors = records.select("id", "normalized_text").mapInPandas(run, "id string, _v array<float>")
    return records.drop("embedding").join(vectors, "id", "left").withColumnRenamed("_v", "embedding")


def seeds(records: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(entities, links) that new records start with: one entity per record that can be resolved."""
    now = F.lit(as_of).cast("timestamp")
    r = retrieval.entity_kind(records).filter("entity_type is not null").withColumn("_e", stable_id(F.lit("entity"), "id"))
    name = F.coalesce(blank_to_null("full_name"), F.when(F.col("entity_type") == "organization", blank_to_null("organization")), blank_to_null("email"), F.lit(""))
    entities = r.select(F.col("_e").alias("id"), "organization_id", "entity_type", name.alias("display_name"), blank_to_null("email").alias("primary_email"), blank_to_null("phone").alias("primary_phone"), blank_to_null("organization").alias("primary_organization"), blank_to_null("role_title").alias("primary_role"), "embedding", now.alias("created_at"), now.alias("updated_at"))
    return entities, r.select(F.col("id").alias("raw_record_id"), F.col("_e").alias("canonical_entity_id"), "organization_id", F.lit("seed").alias("link_method"), now.alias("linked_at"))


def import_batch(state: State, source: DataFrame, records: DataFrame, as_of: str, judge: retrieval.Adjudicator | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 0, **floors: float) -> tuple[State, DataFrame]:
    """(new state, counters): a source and its parsed records are appended with their seeds, then all records are resolved as one batch.

    With `embed`, records get vectors of that dimension first; if it fails, nothing is imported. Resolution is best effort:
    if it fails as a whole, the import stands without suggestions and is counted; a record whose judgement fails is
    counted, too.
    """
    records = cut((embedded(records, embed, dim) if embed else records).select(*schemas.RECORDS.names))
    ents, links = (cut(x) for x in seeds(records, as_of))
    grown = replace(
        state, sources=state.sources.unionByName(source.select(*schemas.SOURCES.names)), raw_records=state.raw_records.unionByName(records), canonical_entities=state.canonical_entities.unionByName(ents), raw_to_canonical=add_links(state.raw_to_canonical, links)
    )
    count = lambda df, name, where="true": df.filter(where).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
    counters = [count(records, "imported"), count(retrieval.entity_kind(records), "unidentified", "entity_type is null"), count(ents, "new_entities")]
    try:
        fresh, resolved = _resolved(grown, records, as_of, judge or retrieval.RuleAdjudicator(), floors, count)
    except Exception as e:  # noqa: BLE001 - what is imported stays imported
        logging.getLogger(__name__).warning("resolution failed: %s", e)
        failed = records.limit(1).select(F.lit("resolution_failed").alias("counter"), F.lit(1).cast("bigint").alias("n"))
        return grown, reduce(DataFrame.unionByName, [*counters, failed])
    return replace(grown, merge_suggestions=state.merge_suggestions.unionByName(fresh)), reduce(DataFrame.unionByName, [*counters, *resolved])


def _resolved(grown: State, records: DataFrame, as_of: str, judge: retrieval.Adjudicator, floors: dict[str, float], count: Callable) -> tuple[DataFrame, list[DataFrame]]:
    """(new suggestions, counters) of an import's records."""
    by_vector = retrieval.candidates_by_vector(grown.tables, records, floor=floors.get("similarity", retrieval.SIMILARITY_FLOOR))
    resolvable = retrieval.entity_kind(records).filter("entity_type is not null").drop("entity_type")
    short = cut(retrieval.shortlist(by_vector, retrieval.candidates_by_identifier(grown.tables, resolvable)))
    verdicts = cut(retrieval.adjudicate(short, records, grown.canonical_entities, judge))
    outcome = cut(retrieval.scored(short, verdicts, floors.get("auto_reject", retrieval.AUTO_REJECT), floors.get("combined", retrieval.COMBINED_FLOOR)))
    fresh = cut(new_suggestions(grown.merge_suggestions, retrieval.as_suggestions(outcome, records, as_of)))
    asked = short.select("record_id").distinct()
    return fresh, [count(fresh, "suggestions", "status = 'pending'"), count(fresh, "auto_rejected", "status = 'rejected'"), count(asked, "judged_records"), count(verdicts, "judge_errors", "entity_id is null")]
