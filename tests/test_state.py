import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import retrieval, search, state, tenants
from rollcall.streaming import imports
from tests.test_sources import workbook

T0 = dt.datetime(2025, 1, 1)


def rows(spark, name, *items):
    fields = schemas.TABLES[name]
    base = {"organization_id": "t", "source_type": "local_upload", "imported_at": T0, "field_mapping": {}, "raw_data": {}, "normalized_text": "x", "created_at": T0, "updated_at": T0, "entity_type": "person", "display_name": "", "link_method": "seed", "linked_at": T0,
        "vector_similarity": 0.9, "llm_confidence": 0.9, "combined_confidence": 0.9, "llm_verdict": True, "reasoning": "", "status": "pending", "row_number": 2, "name": "n"}
    return spark.createDataFrame([tuple((base | i).get(f.name) for f in fields) for i in items], fields)


@pytest.fixture
def st(spark):
    return state.State(
        sources=rows(spark, "sources", {"id": "s1", "imported_by": " Me@x "}, {"id": "s2", "imported_by": ""}, {"id": "s3", "organization_id": "u"}),
        raw_records=rows(spark, "raw_records", {"id": "r1", "source_id": "s1", "embedding": [1.0, 0.0], "email": "a@x.vn", "full_name": "A"}, {"id": "r2", "source_id": "s2", "embedding": [0.0, 1.0], "full_name": "A", "phone": "09"}, {"id": "r3", "source_id": "s2", "full_name": "C", "row_number": 3, "embedding": [1.0, 0.1]}),
        canonical_entities=rows(spark, "canonical_entities", {"id": "e1", "display_name": "A", "embedding": [1.0, 0.0]}, {"id": "e2", "display_name": "A", "embedding": [0.0, 1.0]}, {"id": "e3", "display_name": "C", "embedding": [1.0, 0.1]}),
        raw_to_canonical=rows(spark, "raw_to_canonical", *({"raw_record_id": f"r{i}", "canonical_entity_id": f"e{i}"} for i in (1, 2, 3))),
        merge_suggestions=rows(spark, "merge_suggestions", {"id": "m1", "canonical_entity_id": "e1", "candidate_raw_record_id": "r2"}, {"id": "m2", "canonical_entity_id": "e3", "candidate_raw_record_id": "r2"}, {"id": "m3", "canonical_entity_id": "e2", "candidate_raw_record_id": "r1", "status": "rejected"}),
    )


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_approve_moves_absorbs_and_supersedes(st):
    after = state.approve(st, "m1", "t", "me", "2025-02-01")
    assert by_id(after.merge_suggestions, "status", "decided_by") == {"m1": ("approved", "me"), "m2": ("rejected", "superseded")}
    e = by_id(after.canonical_entities, "primary_phone", "embedding")
    assert sorted(e) == ["e1", "e3"] and e["e1"] == ("09", [0.5, 0.5])
    assert {(r["raw_record_id"], r["canonical_entity_id"], r["link_method"]) for r in after.raw_to_canonical.collect()} == {("r1", "e1", "seed"), ("r2", "e1", "approved_merge"), ("r3", "e3", "seed")}
    assert all(r["n"] == 0 for r in schemas.invariants(after.tables).collect())
    with pytest.raises(state.Conflict):
        state.approve(after, "m1", "t", "me", "2025-02-01")
    with pytest.raises(state.NotFound):
        state.approve(st, "m1", "other", "me", "2025-02-01")


def test_reject_and_decisions_in_order(st):
    after = state.decide_all(st, [("m2", "reject"), ("m1", "approve")], "t", "me", "2025-02-01")
    assert by_id(after.merge_suggestions, "status") == {"m1": ("approved",), "m2": ("rejected",)}


def test_links_and_suggestions_do_nothing_twice(st, spark):
    new = rows(spark, "raw_to_canonical", {"raw_record_id": "r1", "canonical_entity_id": "e9"}, {"raw_record_id": "r9", "canonical_entity_id": "e9"}, {"raw_record_id": "r9", "canonical_entity_id": "e8"})
    assert {(r[0], r[1]) for r in state.add_links(st.raw_to_canonical, new).collect()} == {("r1", "e1"), ("r2", "e2"), ("r3", "e3"), ("r9", "e8")}
    again = st.merge_suggestions.withColumn("id", F.concat("id", F.lit("x")))
    assert state.add_suggestions(st.merge_suggestions, again).count() == 3


def test_candidates_respect_rows_links_and_suggestions(st):
    got = {(r["record_id"], r["entity_id"]) for r in retrieval.candidates_by_vector(st.tables, st.raw_records, floor=-1.0, block=1).collect()}
    # r2 may not see e3 (later row of its file, and suggested); r3 may see e2 (an earlier row); r1's e2 was suggested.
    assert got == {("r1", "e3"), ("r3", "e1"), ("r3", "e2")}


def test_batch_equals_loop(spark, st):
    got = {(r[0], r[1]): round(r[2], 9) for r in retrieval.candidates_by_vector(st.tables, st.raw_records, k=1, floor=-1.0).collect()}
    assert got[("r3", "e1")] == pytest.approx(1 / (1.01**0.5)) and len(got) == 2


@pytest.mark.parametrize("first", [1, 3, 64])
def test_hot_identifier_is_exact(spark, st, first):
    entities = rows(spark, "canonical_entities", *({"id": f"h{i:02}", "primary_email": "Office@x.vn", "created_at": T0 + dt.timedelta(days=i % 7)} for i in range(20)))
    records = rows(spark, "raw_records", *({"id": f"q{i}", "source_id": "s9", "row_number": i, "email": "office@X.vn"} for i in range(3)))
    said = rows(spark, "merge_suggestions", *({"id": f"m{i}", "canonical_entity_id": f"h{i:02}", "candidate_raw_record_id": "q1", "status": "rejected"} for i in (0, 7, 14, 1)))
    tables = st.tables | {"canonical_entities": entities, "raw_records": records, "merge_suggestions": said}
    got = {}
    for r in retrieval.candidates_by_identifier(tables, records, first=first).collect():
        got.setdefault(r["record_id"], set()).add(r["entity_id"])
    order = sorted(range(20), key=lambda i: (i % 7, i))
    assert got["q0"] == {f"h{i:02}" for i in order[:5]}
    assert got["q1"] == {f"h{i:02}" for i in [i for i in order if i not in (0, 7, 14, 1)][:5]}


def test_scoring_rejects_before_floor(spark):
    short = spark.createDataFrame([("r", "a", 0.9, 0), ("r", "b", 0.9, 1), ("r", "c", 0.1, 2)], "record_id string, entity_id string, similarity double, candidate_index int")
    v = spark.createDataFrame([("r", "a", True, 0.9, ""), ("r", "b", False, 0.8, ""), ("r", "c", False, 0.7, "")], "record_id string, entity_id string, verdict boolean, confidence double, reasoning string")
    assert {r["entity_id"]: r["status"] for r in retrieval.scored(short, v).collect()} == {"a": "pending", "b": "rejected"}


def test_failing_judge_loses_its_record_only(spark, st):
    short = retrieval.shortlist(retrieval.candidates_by_vector(st.tables, st.raw_records, floor=-1.0), retrieval.candidates_by_identifier(st.tables, st.raw_records))

    def judge(record, candidates):
        if record["full_name"] == "C":
            raise ValueError
        return [{"candidate_index": 0, "is_match": True, "confidence": 7, "reasoning": ""}, {"candidate_index": 99, "is_match": True, "confidence": 1, "reasoning": ""}]

    got = retrieval.adjudicate(short, st.raw_records, st.canonical_entities, judge).collect()
    assert [(r["record_id"], r["confidence"]) for r in got if r["entity_id"]] == [("r1", 1.0)] and [r["reasoning"] for r in got if not r["entity_id"]] == ["ValueError: "]


def test_snapshots(spark, st, tmp_path):
    snaps = state.Snapshots(spark, f"file://{tmp_path}/state")
    assert snaps.current() is None and snaps.load().sources.count() == 0
    one = snaps.save(st)
    two = snaps.save(replace(one, sources=one.sources.filter("id = 's1'")))
    assert (one.version, two.version, snaps.current()) == (1, 2, 2) and snaps.load(1).sources.count() == 3
    assert snaps.folders(2)["raw_records"] == snaps.folders(1)["raw_records"] and snaps.folders(2)["sources"] != snaps.folders(1)["sources"]
    assert snaps.load().raw_records.count() == one.raw_records.count() and snaps.load().sources.count() == 1
    snaps.drop()
    assert snaps.current() is None


def test_import_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    workbook(tmp_path / "in" / "a.xlsx", [(1, ["Tên", "Mail"]), (2, ["Lê A", "le@a.vn"]), (3, ["", ""]), (4, ["", "?"])])
    workbook(tmp_path / "in" / "b.xlsx", [(1, ["Tên", "Mail"]), (2, ["Le A", "LE@a.vn"])])
    snaps = state.Snapshots(spark, f"file://{tmp_path}/state")
    take = imports.importer(snaps, "t", lambda h: {"Tên": "full_name", "Mail": "email"}, "2025-01-01")
    imports.watch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", take).awaitTermination()
    now = snaps.load()
    assert now.raw_records.count() == 3 and now.canonical_entities.count() == 2
    assert [(r["status"], r["llm_verdict"]) for r in now.merge_suggestions.collect()] == [("pending", True)]
    (tmp_path / "in" / "c.xlsx").write_bytes(b"nothing")
    imports.watch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", take).awaitTermination()
    refused = spark.read.parquet(f"file://{tmp_path}/state/refused").collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["reason"].split(":")[0]) for r in refused] == [("c.xlsx", "no workbook")] and snaps.load().version == now.version


def test_embedding_checks(spark):
    r = spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, normalized_text string")
    got = {x["id"]: x["embedding"] for x in state.embedded(r, lambda ts: [[3.0 * len(t), 4.0] for t in ts], 2).collect()}
    assert [round(x, 4) for x in got["a"]] == [0.6, 0.8]
    with pytest.raises(Exception, match="length"):
        state.embedded(r, lambda ts: [[1.0] for _ in ts], 2).collect()


def test_centroids(st):
    links = st.raw_to_canonical.withColumn("canonical_entity_id", F.lit("e"))
    assert [round(x, 4) for x in state.centroids(links, st.raw_records).first()["centroid"]] == [0.6667, 0.3667]
    assert sum(x * x for x in state.centroids(links, st.raw_records, unit=True).first()["centroid"]) == pytest.approx(1)


def test_components_are_transitive(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdz"], "source_id string")
    edges = [("a", "b"), ("c", "d"), ("b", "c")]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "source_id string, other string")
    assert {r[0]: r[1] for r in tenants.components(nodes, both).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}


def test_migration(spark, st):
    owners = spark.createDataFrame([("me@X", "org_user_me")], "email string, organization_id string")
    after, planned, dropped, checks = tenants.migrate(st, ["t"], owners)
    p = {r["component"]: (r["importers"], r["blocked_by"], r["target"]) for r in planned.collect()}
    assert p == {"s1": ("Me@x", None, "org_user_me"), "s2": ("", None, None)} and tenants.ready(planned).count() == 1
    assert by_id(after.sources, "organization_id") == {"s1": ("org_user_me",), "s2": ("t",), "s3": ("u",)}
    assert {r["status"]: r["n"] for r in dropped.collect()} == {"pending": 1, "rejected": 1} and all(r["n"] == 0 for r in checks.collect())


def test_search_rejections():
    bad = [("secret", "equals", "1"), ("display_name", "like", "1"), ("event_count", "contains", "1"), ("display_name", "equals", "  "), ("event_count", "gt", "many"), ("event_count", "gt", "nan")]
    p = search.build([dict(zip(("column", "operator", "value"), b)) for b in bad])
    assert not p.applied and [r for _, r in p.rejected] == ["unknown column", "unknown operator", "operator doesn't fit the column", "blank value", "not a number", "not a number"]
    assert search.column_ids() == sorted(search.COLUMNS) and "contains" in search.operator_ids()


def test_index_finds_what_the_exact_search_finds(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("raw_records", "canonical_entities", "raw_to_canonical", "merge_suggestions")}
    pairs = lambda df: {(r["record_id"], r["entity_id"]) for r in df.collect()}
    exact = pairs(retrieval.candidates_by_vector(t, t["raw_records"], exact=True))
    found = pairs(retrieval.candidates_by_vector(t, t["raw_records"], cell=256))
    assert len(exact) > 10 and len(found & exact) >= 0.9 * len(exact) and len(found - exact) <= 0.02 * len(exact)
    assert pairs(retrieval.candidates_by_vector(t, t["raw_records"])) == exact
