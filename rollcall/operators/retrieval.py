"""Stage one of resolution: candidate entities of each record, by vectors and by identifiers; stage two: verdicts and scores.

A whole import is resolved as one batch: a record's candidates depend only on entities seeded before it and on
suggestions for that record, so the row-order condition replaces the loop. Conditions come before the top-k, the
similarity floor after it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.scores import AUTO_REJECT, COMBINED_FLOOR, SIMILARITY_FLOOR, clamp01, combine_confidence
from rollcall.functions.text import blank_to_null, digits_only, null_to_blank, stable_id
from rollcall.session import cut, shuffle_width

TOP, IDENTIFIERS = 5, 5
#: Oldest entities of a shared address or number a record meets before the rest.
FIRST = 64
#: Vectors of either side a task holds at once.
BLOCK = 4096
#: Entities of a cell of the index, rows its centroids are fitted on, most centroids, cells a record is looked for in.
CELL, SAMPLE, CELLS, PROBES = 4096, 16384, 4096, 3
VERDICTS = "record_id string, entity_id string, verdict boolean, confidence double, reasoning string"


def entity_kind(records: DataFrame) -> DataFrame:
    """records with entity_type: a name or an address makes a person, else an organisation an organisation, else null."""
    said = lambda c: null_to_blank(c) != ""
    return records.withColumn("entity_type", F.when(said("full_name") | said("email"), "person").when(said("organization"), "organization"))


def excluded_pairs(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_id, entity_id): a record's own entity, and every pair that was ever suggested, in whatever state."""
    own = tables["raw_to_canonical"].select(F.col("raw_record_id").alias("record_id"), F.col("canonical_entity_id").alias("entity_id"))
    said = tables["merge_suggestions"].select(F.col("candidate_raw_record_id").alias("record_id"), F.col("canonical_entity_id").alias("entity_id"))
    return own.unionByName(said).distinct()


def later_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, source_id, last_row): the last row of each source an entity has."""
    rows = tables["raw_records"].select(F.col("id").alias("raw_record_id"), "source_id", "row_number")
    linked = tables["raw_to_canonical"].select("raw_record_id", F.col("canonical_entity_id").alias("entity_id")).distinct()
    return linked.join(rows, "raw_record_id").groupBy("entity_id", "source_id").agg(F.max("row_number").alias("last_row"))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    columns = ["record_id", "entity_id", "similarity"]

    def run(records: pd.DataFrame, entities: pd.DataFrame) -> pd.DataFrame:
        if records.empty or entities.empty:
            return pd.DataFrame({c: [] for c in columns}).astype({"record_id": str, "entity_id": str, "similarity": float})
        entities = entities.sort_values("entity_id", kind="stable").reset_index(drop=True)
        e, names = _unit(entities["v"]), entities["entity_id"].to_numpy()
        at = {n: i for i, n in enumerate(names)}
        rows_of: dict[str, list[tuple[int, int]]] = {}
        for i, spans in enumerate(entities["spans"]):
            for s in spans if spans is not None else ():
                rows_of.setdefault(s["source_id"], []).append((i, s["last_row"]))
        spans_of = {s: (np.array([i for i, _ in x]), np.array([r for _, r in x])) for s, x in rows_of.items()}
        out = []
        for lo in range(0, len(records), 512):
            part = records.iloc[lo : lo + 512]
            sims = np.round(_unit(part["v"]) @ e.T, 12)
            for n, (source, row, gone) in enumerate(zip(part["source_id"], part["row_number"], part["gone"])):
                if source in spans_of:
                    i, last = spans_of[source]
                    sims[n, i[last >= row]] = -9
                sims[n, [at[g] for g in (gone if gone is not None else ()) if g in at]] = -9
            # All that reach the k-th best, so that ties go to the smaller id.
            least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -9.0)
            for n, rid in enumerate(part["record_id"]):
                near = np.flatnonzero((sims[n] >= least[n]) & (sims[n] > -9))
                out += [(rid, names[j], sims[n, j]) for j in near[np.argsort(-sims[n, near], kind="stable")][:k]]
        return pd.DataFrame(out, columns=columns)

    return run


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    c = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-30), c)
    return c


def _nearest_cells(middle: dict[int, np.ndarray], probes: int) -> Callable:
    """A pandas UDF of vectors: the cells whose centroids are most similar, by the vectors' length; cell 0 where none was fitted."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = pd.Series([[0]] * len(vectors), index=vectors.index)
        sizes = vectors.map(len)
        for dim, c in middle.items():
            mine = vectors[sizes == dim]
            for lo in range(0, len(mine), 1024):
                part = mine.iloc[lo : lo + 1024]
                sims = _unit(part) @ c.T
                top = np.argpartition(-sims, min(probes, len(c)) - 1, axis=1)[:, : min(probes, len(c))]
                out.loc[part.index] = pd.Series(top.tolist(), index=part.index)
        return out

    return cells


def index_cells(entities: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids by length of vectors (entity_id, v, dim), as many as cells of `cell` rows are needed, fitted on at most `sample` rows of each length drawn by hash; lengths of one cell have none.

    One count per length reaches the driver; more than 64 lengths are an error.
    """
    counts = {r["dim"]: r["count"] for r in entities.groupBy("dim").count().limit(65).collect()}
    if len(counts) > 64:
        raise ValueError("vectors of more than 64 lengths")
    out = {}
    for dim, n in sorted(counts.items()):
        wanted = min(CELLS, -(-n // cell))
        if wanted > 1:
            share = max(1, n // sample)
            rows = entities.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("entity_id", F.lit("cells")), F.lit(share)) == 0)).select("v").limit(sample).toPandas()
            if len(rows):
                out[dim] = _centroids(_unit(rows["v"]), wanted)
    return out


def candidates_by_vector(tables: dict[str, DataFrame], records: DataFrame, k: int = TOP, floor: float = SIMILARITY_FLOOR, block: int = BLOCK, exact: bool = False, probes: int = PROBES, cell: int = CELL) -> DataFrame:
    """(record_id, entity_id, similarity): the k most similar entities of the same tenant and type that a record may still be matched with.

    By an index: every entity is in the cell of its nearest centroid, and a record is compared, exactly, with the entities
    of its `probes` nearest cells; their number grows with the table, so the work grows in proportion to the rows. exact:
    with all entities. A cell's two sides are cut into blocks per tenant and type by hash (block sizes follow the counted
    sizes, one row per cell, tenant and type), every pair of blocks is one matrix product, and the k best meet in a ranked union.
    """
    valid = lambda c: F.col(c).isNotNull() & F.exists(c, lambda x: x != 0)
    pairs = excluded_pairs(tables)
    gone = pairs.groupBy("record_id").agg(F.collect_list("entity_id").alias("gone"))
    cur = entity_kind(records).filter(valid("embedding")).select(F.col("id").alias("record_id"), "organization_id", "entity_type", "source_id", "row_number", F.col("embedding").alias("v")).filter("entity_type is not null")
    spans = later_rows(tables).groupBy("entity_id").agg(F.collect_list(F.struct("source_id", "last_row")).alias("spans"))
    ent = tables["canonical_entities"].filter(valid("embedding")).select(F.col("id").alias("entity_id"), "organization_id", "entity_type", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    cur = cur.withColumn("dim", F.size("v"))
    middle = {} if exact else index_cells(ent, cell)
    one = F.array(F.lit(0))
    cur = cur.withColumn("cell", F.explode(_nearest_cells(middle, probes)("v") if middle else one))
    ent = ent.withColumn("cell", (_nearest_cells(middle, 1)("v") if middle else one)[0])
    group = ["organization_id", "entity_type", "dim", "cell"]
    cur, ent = cur.join(gone, "record_id", "left"), ent.join(spans, "entity_id", "left")
    if middle:
        cur, ent = cut(cur), cut(ent)
    sizes = ent.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias("eb")).join(cur.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias("rb")), group)
    left = cur.join(sizes, group).withColumn("r", F.pmod(F.xxhash64("record_id"), F.col("rb"))).withColumn("e", F.explode(F.sequence(F.lit(0), (F.col("eb") - 1).cast("int"))))
    right = ent.join(sizes, group).withColumn("e", F.pmod(F.xxhash64("entity_id"), F.col("eb")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rb") - 1)))
    keys = [*group, "r", "e"]
    found = left.select(*keys, "record_id", "source_id", "row_number", "v", "gone").groupBy(*keys).cogroup(right.select(*keys, "entity_id", "v", "spans").groupBy(*keys)).applyInPandas(_best(k), "record_id string, entity_id string, similarity double")
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("similarity"), "entity_id"))
    return found.withColumn("_rank", rank).filter((F.col("_rank") <= k) & (F.col("similarity") >= floor)).drop("_rank")


def _identifiers(df: DataFrame, email: str, phone: str, *columns) -> DataFrame:
    """One row per row and key: the lower-case address, the digits of the number."""
    mail, number = F.lower(blank_to_null(email)), blank_to_null(digits_only(null_to_blank(phone)))
    keys = F.array_compact(F.array(F.concat(F.lit("e:"), mail), F.concat(F.lit("p:"), number)))
    return df.select(*columns, "organization_id", F.explode(keys).alias("key"))


def candidates_by_identifier(tables: dict[str, DataFrame], records: DataFrame, limit: int = IDENTIFIERS, first: int = FIRST) -> DataFrame:
    """(record_id, entity_id, similarity 1): entities of the tenant with the record's address or number; the oldest `limit` per record.

    Equi-joins on the keys; a join on either column would compare all pairs. The type of the entity doesn't matter. A
    record meets the `first` oldest entities of a key only, so a key a third of all rows share costs no pair of each with
    each; records whose conditions leave fewer than `limit` of those meet the key's other entities too, which is exact.
    """
    cur = _identifiers(records, "email", "phone", F.col("id").alias("record_id"), "source_id", "row_number")
    ent = _identifiers(tables["canonical_entities"], "primary_email", "primary_phone", F.col("id").alias("entity_id"), "created_at")
    late = later_rows(tables).withColumnsRenamed({"entity_id": "_e", "source_id": "_s"})
    barred = excluded_pairs(tables)

    def allowed(asked: DataFrame, entities: DataFrame) -> DataFrame:
        hits = asked.join(entities, ["organization_id", "key"]).join(barred, ["record_id", "entity_id"], "left_anti")
        return hits.join(late, (F.col("entity_id") == F.col("_e")) & (F.col("source_id") == F.col("_s")) & (F.col("last_row") >= F.col("row_number")), "left_anti").select("record_id", "key", "entity_id", "created_at")

    oldest = ent.withColumn("_n", F.row_number().over(Window.partitionBy("organization_id", "key").orderBy("created_at", "entity_id"))).filter(F.col("_n") <= first).drop("_n")
    hot = ent.groupBy("organization_id", "key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > first).select("organization_id", "key")
    hits = allowed(cur, oldest)
    enough = hits.groupBy("record_id", "key").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= limit).select("record_id", "key")
    short = cur.join(hot, ["organization_id", "key"], "left_semi").join(enough, ["record_id", "key"], "left_anti")
    every = hits.unionByName(allowed(short, ent)).select("record_id", "entity_id", "created_at").distinct()
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("created_at", "entity_id"))
    return every.withColumn("_rank", rank).filter(F.col("_rank") <= limit).select("record_id", "entity_id", F.lit(1.0).alias("similarity"))


def shortlist(by_vector: DataFrame, by_identifier: DataFrame) -> DataFrame:
    """(record_id, entity_id, similarity, by_identifier, candidate_index): one row per pair, identifier hits keep similarity 1."""
    both = by_vector.withColumn("by_identifier", F.lit(False)).unionByName(by_identifier.withColumn("by_identifier", F.lit(True)))
    one = both.groupBy("record_id", "entity_id").agg(F.max_by("similarity", "by_identifier").alias("similarity"), F.max("by_identifier").alias("by_identifier"))
    order = Window.partitionBy("record_id").orderBy(F.desc("similarity"), "entity_id")
    return one.withColumn("candidate_index", F.row_number().over(order) - 1)


class Adjudicator(Protocol):
    """Decides which candidates are the record's entity. Called once per record with its shortlist; verdicts may leave candidates out."""

    def __call__(self, record: dict, candidates: list[dict]) -> list[dict]: ...


class RuleAdjudicator:
    """An offline stand-in, our own design: an equal address or number is strong, an equal folded name at the same organisation too; at most one is true."""

    def __call__(self, record: dict, candidates: list[dict]) -> list[dict]:
        same = lambda a, b: bool(a) and bool(b) and a.strip().lower() == b.strip().lower()
        digits = lambda x: "".join(c for c in x or "" if c.isdigit())[-9:]
        out = []
        for i, c in enumerate(candidates):
            score, why = 0.2, "no match"
            if same(record["email"], c["primary_email"]):
                score, why = 0.95, "same e-mail"
            elif len(digits(record["phone"])) == 9 and digits(record["phone"]) == digits(c["primary_phone"]):
                score, why = 0.9, "same phone"
            elif same(record["full_name"], c["display_name"]):
                score, why = (0.85, "same name and organisation") if same(record["organization"], c["primary_organization"]) else (0.55, "same name")
            out.append({"candidate_index": i, "score": score, "reasoning": why})
        best = max(out, key=lambda x: (x["score"], -x["candidate_index"]), default=None)
        return [{"candidate_index": x["candidate_index"], "is_match": x is best and x["score"] >= 0.5, "confidence": x["score"] if x is best and x["score"] >= 0.5 else 1 - min(x["score"], 0.45), "reasoning": x["reasoning"]} for x in out]


def adjudicate(short: DataFrame, records: DataFrame, entities: DataFrame, judge: Adjudicator) -> DataFrame:
    """VERDICTS of every shortlisted pair the judge answers; unknown indices are dropped. A failing call loses that record's pairs only, and leaves a row without an entity that tells why."""
    r = records.select(F.col("id").alias("record_id"), F.struct("full_name", "organization", "role_title", "email", "phone").alias("record"))
    e = entities.select(F.col("id").alias("entity_id"), F.struct("entity_type", "display_name", "primary_organization", "primary_role", "primary_email", "primary_phone").alias("entity"))
    grouped = short.join(e, "entity_id").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("candidate_index", "entity_id", "entity", "similarity"))).alias("candidates")).join(r, "record_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, record, candidates in zip(pdf["record_id"], pdf["record"], pdf["candidates"]):
                known = [dict(c["entity"]) | {"entity_id": c["entity_id"], "similarity": c["similarity"]} for c in candidates]
                try:
                    answers = judge(dict(record), known)
                except Exception as e:  # noqa: BLE001 - a record's failure must not lose the batch
                    rows.append((rid, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                for a in answers:
                    if 0 <= a["candidate_index"] < len(known):
                        c = float(a["confidence"])
                        rows.append((rid, known[a["candidate_index"]]["entity_id"], bool(a["is_match"]), 0.0 if math.isnan(c) else min(max(c, 0.0), 1.0), str(a["reasoning"])))
            yield pd.DataFrame(rows, columns=["record_id", "entity_id", "verdict", "confidence", "reasoning"])

    return grouped.repartition(shuffle_width(grouped.sparkSession), "record_id").mapInPandas(run, VERDICTS)


def scored(short: DataFrame, verdicts: DataFrame, auto_reject: float = AUTO_REJECT, floor: float = COMBINED_FLOOR) -> DataFrame:
    """Pairs with combined score and outcome: a confident no is rejected at once, before the floor drops low scores; the rest is pending."""
    both = short.join(verdicts, ["record_id", "entity_id"]).withColumn("confidence", clamp01("confidence"))
    both = both.withColumn("combined", combine_confidence("similarity", "verdict", "confidence"))
    outcome = F.when(~F.col("verdict") & (F.col("confidence") >= auto_reject), "rejected").when(F.col("combined") >= floor, "pending")
    return both.withColumn("status", outcome).filter("status is not null")


def as_suggestions(outcome: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """scored() as rows of merge_suggestions."""
    now = F.lit(as_of).cast("timestamp")
    done = F.col("status") == "rejected"
    tenant = records.select(F.col("id").alias("record_id"), "organization_id")
    return outcome.join(tenant, "record_id").select(
        stable_id("entity_id", "record_id").alias("id"), "organization_id", F.col("entity_id").alias("canonical_entity_id"), F.col("record_id").alias("candidate_raw_record_id"), F.col("similarity").cast("float").alias("vector_similarity"), F.col("confidence").cast("float").alias("llm_confidence"),
        F.col("combined").cast("float").alias("combined_confidence"), F.col("verdict").alias("llm_verdict"), "reasoning", "status", F.when(done, now).alias("decided_at"), F.when(done, F.lit("gemini_stage2")).alias("decided_by"), now.alias("created_at"))
