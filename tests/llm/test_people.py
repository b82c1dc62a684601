import random

import pytest
from pyspark.sql import functions as F

from rollcall.llm import history, names, people
from rollcall.llm.skeleton import look_alike_table


@pytest.fixture(autouse=True, scope="module")
def table(spark):
    look_alike_table(spark)


COLUMNS = "id string, organization_id string, full_name string, organization string, email string, phone string"


def compare(a, b):
    return names.compare_names(names.name_tokens(a), names.name_tokens(b))[0]


STRONG = [("Hung, Tran Khanh", "Trần Khánh Hưng"), ("PGS.TS. Đinh Xuân Phong", "Dnih Xuan Phong"), ("Ddawngj Trongj Coong Cuwowngf", "Đặng Trọng Công Cường"), ("Peggy Brckmann", "Margaret Brückmann"), ("mai.hai.tan", "Mai Hải Tân (Bi)"), ("Ηồ Ρhương Τài", "HỒ PHƯƠNG TÀI"), ("Zo Fontenoy", "Fontenoy, Zoë"), ("Басманов, Тимур", "ТИМУР БАСМАНОВ")]
WEAK = [("P.T.X. Binh", "Phan Thị Xuân Bình"), ("Lương Triết", "Lương Hữu Triết"), ("Nga Ngo", "Nga Gia Hải Ngô"), ("T. Ferrantis", "Theodore F. Ferrantis"), ("Anh Bùi Gia My", "Bùi Gia My")]
NOT = [("Trần Ngọc Nga", "Trần Ngọc Nguyệt"), ("Hoàng Hiếu", "Hoàng Hiền"), ("Nguyễn Gia Việt", "Nguyễn Văn Việt"), ("", "An"), ("An", "Bình")]


@pytest.mark.parametrize("pairs, wanted", [(STRONG, names.STRONG), (WEAK, names.WEAK), (NOT, names.NONE)])
def test_names(pairs, wanted):
    assert {p: compare(*p) for p in pairs} == {p: wanted for p in pairs}
    assert all(compare(b, a) == compare(a, b) for a, b in pairs)


def test_organisations():
    assert {names.organisation(o) for o in ("Cty Cổ phần Lamutusоdе, chi nhánh 2", "Lamutusode J.S.C.", "Công ty CP LAMUT-USODE")} == {("lamutusode", "jsc")}
    assert names.organisation("Trung tâm Tovabutobi") != names.organisation("Hiệp hội Tovabutobi") and names.organisation(None) == ("", "") == names.organisation("  ")


ROWS = [
    ("a1", "t", "Trần Khánh Hưng", "Trung tâm Fisubudedo", "hung.tran@fisubudedo.example", None), ("a2", "t", "Hung, Tran Khanh", "Fisubudedo Ctr", None, "(068) 567-2530"), ("a3", "t", "T. K. Hưng", "TT Fisubuddeo", None, "0685672530"), ("a4", "t", "Trần Khánh Hưng", None, "HUNG.TRAN@FISUBUDEDO.EXAMPLE;", None),
    ("b1", "t", "Trần Khánh Hưng", "Đại học Kokobarabi", None, None), ("c1", "u", "Trần Khánh Hưng", "Trung tâm Fisubudedo", None, None),
    ("d1", "t", "Lê Gia Việt", "Trung tâm Fisubudedo", None, None), ("d2", "t", "Lê Văn Việt", "Trung tâm Fisubudedo", None, None), ("d3", "t", "Lê Việt", "Trung tâm Fisubudedo", None, None),
    ("o1", "t", None, "Trung tâm Fisubudedo", None, None), ("o2", "t", "", "Fisubudedo Center", None, None), ("o3", "t", None, "Hội Fisubudedo", None, None), ("n1", "t", None, None, None, None), ("n2", "t", "  ", "", "", ""),
]


def test_variant_pairs(spark):
    got = {tuple(r) for r in people.variant_pairs(spark.createDataFrame(ROWS, COLUMNS)).collect()}
    assert got == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("o1", "o2")}
    assert people.variant_pairs(spark.createDataFrame([], COLUMNS)).count() == 0


def test_offices_link_nobody(spark):
    rows = [(f"r{i}", "t", f"{n} Hoa", f"Công ty TNHH Abc{n}", "info@x.example", "0655555123") for i, n in enumerate(("Lê", "Vũ", "Trần", "Đỗ", "Bùi", "Ngô", "Hồ", "Lý", "Tạ", "Cao", "Võ", "Mai"))] + [("s", "t", "L. Hoa", "Công ty TNHH Xyzk", "info@x.example", None)]
    assert people.variant_pairs(spark.createDataFrame(rows, COLUMNS)).count() == 0


def test_hot_group_of_copies(spark):
    rows = [(f"c{i}", "t", "Đỗ Thị Hoa", "Trung tâm Abcdefg", None, None) for i in range(300)] + [("x", "t", "Do Thi Hoa", "Abcdefg Center", None, None)]
    got = people.variant_pairs(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == 300 and all("x" in tuple(r) for r in got)


def test_one_person_with_thirty_spellings_is_one_class(spark):
    full = "Trần Khánh Hưng"
    spelt = [full, "T. K. Hưng", "Hưng Trần", "Tran Khanh Hung"] + [f"Trần Khánh H{x}ưng" for x in "bcdghklmnpqstvx"] + [f"Trần Khá{x}nh Hưng" for x in "bcdghklpqvx"]
    rows = [(f"r{i}", "t", n, f"Công ty TNHH Zyx{chr(97 + i)}wvu{chr(97 + i % 7)}qq" if i % 2 else None, "hung.tran@mail.example", None) for i, n in enumerate(spelt)]
    got = people.class_members(people.as_rows(spark.createDataFrame(rows, COLUMNS))).collect()
    assert len(got) == 30 and len({r["class_id"] for r in got}) == 1 and {r["n_links"] for r in got} == {29}


def test_crowded_office_links_nobody_and_crowded_address_loses_nobody(spark):
    given = ["An", "Bình", "Chi", "Dung", "Giang", "Hà", "Khoa", "Linh", "Minh", "Nga", "Oanh", "Phúc", "Quân", "Sơn", "Tâm", "Uyên", "Vinh", "Xuân", "Yến", "Đức"]
    office = [(f"o{i}", "t", f"{s} {m} {g}", f"Viện Q{chr(97 + i % 26)}w{chr(97 + i // 26)}erty", None, "0655555123") for i, (s, m, g) in enumerate((s, m, g) for s in ("Lê", "Vũ") for m in ("Thị", "Gia") for g in given)]
    office += [("x", "t", "L. T. An", "Viện Zzzzzz", None, "0655555123")]
    assert people.variant_pairs(spark.createDataFrame(office, COLUMNS)).count() == 0


@pytest.mark.parametrize("hot", [2, 5])
def test_refined_keys_find_the_same(spark, monkeypatch, hot):
    rows = people.as_rows(spark.read.parquet("/root/testdata/sf0.001/raw_records.parquet"))
    want = classes_of(people.classes(rows))
    monkeypatch.setattr(people, "HOT", hot)
    assert classes_of(people.classes(rows)) == want


def classes_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["kind"], r["class_id"]), set()).add(r["row_id"])
    return sorted(map(sorted, out.values()))


def test_candidates_at_a_hot_employer_grow_in_proportion(spark):
    def pairs(n):
        parts = [a + b + c for a in "bcdghklmnprstvx" for b in ("a", "e", "i", "o", "u", "ay", "oi") for c in ("lo", "mi", "na", "pe", "qu", "ri", "su", "ta", "vo", "xi", "ke", "du", "fa", "gi", "ho", "jy", "za", "we", "by", "co")]
        names_ = [(f"r{i}", "t", f"Nguyen H{parts[i]}zk", "Viện Abcdefgh", None, None) for i in range(n)]
        nodes = people.vertices(people.placed_rows(people.as_rows(spark.createDataFrame(names_, COLUMNS))).filter("vertex is not null"))
        return people.employer_candidates(nodes, people.name_keys(nodes)).count()

    assert pairs(1600) < 40 * 1600


def test_groups_decided_in_one_pass_or_in_rounds(spark):
    rows = [(1, 2, True, False, 2, 0.9, 1), (2, 3, True, False, 2, 0.9, 2), (4, 5, True, False, 1, 0.6, 4), (4, 6, True, False, 1, 0.6, 4), (7, 8, True, False, 1, 0.6, 7), (9, 10, False, True, 1, 0.4, 9), (10, 11, True, False, 1, 0.5, 11)]
    found = spark.createDataFrame(rows, "a long, b long, same_employer boolean, contact boolean, class int, score double, short long")
    namesakes = spark.createDataFrame([(12, 1), (13, 4)], "a long, b long")
    groups = people.components(found.select("a", "b").unionByName(namesakes))
    sets = lambda df: sorted(sorted(r["vertex"] for r in rows) for rows in group_by(df.collect()))
    want = sets(people.decided(found, namesakes))
    assert [1, 2, 3, 12] in want and [7, 8] in want and [9, 10, 11] in want and not any({4, 5} <= set(x) for x in want)
    several = lambda x: [s for s in x if len(s) > 1]
    assert all(several(sets(people.decided_by_group(found, namesakes, groups, most))) == several(want) for most in (0, 2, 100))


def group_by(rows):
    out = {}
    for r in rows:
        out.setdefault(r["label"], []).append(r)
    return out.values()


def test_cores(spark):
    counts = spark.createDataFrame([("t", "abcdefgh", 9), ("t", "abcdefg", 5), ("t", "abcdef", 3), ("t", "abcdxf", 3), ("t", "fpt", 9), ("t", "fpts", 2), ("t", "wxyz", 1), ("t", "wxyy", 1), ("u", "abcdef", 1)], "tenant string, core string, n long")
    near = people.near_cores(counts, people.core_pieces(counts))
    got = {(r["tenant"], r["core"]): r["to_core"] for r in people.spelling_roots(counts, near).collect()}
    assert got == {("t", "abcdefgh"): "abcdefgh", ("t", "abcdefg"): "abcdefgh", ("t", "abcdef"): "abcdefgh", ("t", "abcdxf"): "abcdefgh", ("t", "fpt"): "fpt", ("t", "fpts"): "fpts", ("t", "wxyz"): "wxyy", ("t", "wxyy"): "wxyy", ("u", "abcdef"): "abcdef"}


def step_by_step(spark, old, batches):
    """The pairings each batch establishes."""
    h, out = history.start(history.as_rows(spark.createDataFrame(old, COLUMNS))), []
    for part in batches:
        found, new = history.match(h, history.as_rows(spark.createDataFrame(part, COLUMNS)))
        out.append({tuple(r) for r in found.collect()})
        history.append(h, new)
    h.drop()
    return out


def hold(spark, old, batches):
    """After each batch: what it established is in the joint run over all rows so far, and all of that has come out."""
    seen = set()
    for k, found in enumerate(step_by_step(spark, old, batches)):
        joint = joint_pairs(spark, old, [r for b in batches[: k + 1] for r in b])
        seen |= found
        assert found <= joint <= seen
    return seen


def test_batches_one_by_one(spark):
    new = [("m1", "t", "Trần Khánh Hưng", "Fisubudedo Centre", None, None), ("m2", "t", "TRẦN KHÁNH HƯNG", None, None, "0685 672 530"), ("m3", "u", "Tran Khanh Hung", None, None, None), ("m4", "t", None, "Trung tâm Fisubudedo", None, None), ("n5", "t", "Trần Khánh Hưng", "TT Fisubudedo", None, None)]
    seen = hold(spark, ROWS[:4], [new[:1], new[1:]])
    assert seen == {tuple(sorted(p)) for p in [(m, a) for m in ("m1", "m2", "n5") for a in ("a1", "a2", "a3", "a4")] + [("m1", "m2"), ("m1", "n5"), ("m2", "n5")]}


def test_any_cuts_give_the_joint_run(spark):
    rows = [tuple(r) for n in ("raw_records", "incoming_records") for r in spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").select(*(c.split()[0] for c in COLUMNS.split(", "))).collect()]
    rng = random.Random(5)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(100, len(rows)), 2))
    hold(spark, rows[: cuts[0]], [rows[cuts[0] : cuts[1]], rows[cuts[1] :]])


def test_rare_tokens_are_weighed_by_history(spark):
    family = [a + b for a in ("Bu", "Ca", "Da", "Do", "Ho", "La", "Le", "Ly", "Ma", "Ta", "To", "Vo") for b in ("c", "m", "n", "ng", "p", "t", "i", "o", "ch", "nh", "u", "y", "")]
    old = [(f"h{i:03}", "t", f"{f} Khánh Hưng", "Viện Mosatuline", None, None) for i, f in enumerate(family[:145])] + [("h", "t", "Đỗ Khánh Hưng", "Viện Mosatuline", None, None)]
    hold(spark, old, [[("n", "t", "Đỗ Khánh Hun", "Viện Mosatuline", None, None)]])


def test_a_batch_that_changes_the_usual_spelling_of_an_employer(spark):
    old = [("a", "t", "Lê Gia Việt", "Viện Mosatuline", None, None), ("b", "t", "Lê Gia Việt", "Viện Mosatulines", None, None), ("c", "t", "Lê Gia Việt", "Viện Mosatulinesxx", None, None), ("d", "t", "Lê Gia Việt", None, "x.y@rapanalo.example", None), ("e", "t", "Lê Gia Việt", "Mosatuline", None, None)]
    first = [(f"n{i}", "t", "Bùi Gia My", "Hội Mosatulinesx", None, None) for i in range(5)] + [("k", "t", "Lê Gia Việt", "Tập đoàn Rapanalo", None, None)]
    hold(spark, old, [first, [("z", "t", "L. G. Việt", "Mosatuline", None, None)]])


def joint_pairs(spark, old, new):
    """Pairings of new rows by one run of the classes over all rows."""
    rows = people.classes(history.as_rows(spark.createDataFrame(old + new, COLUMNS))).filter("kind = 'person'").collect()
    fresh = {r[0] for r in new}
    return {(x.row_id, y.row_id) for x in rows for y in rows if x.class_id == y.class_id and x.row_id < y.row_id and {x.row_id, y.row_id} & fresh}


def chain():
    old = [("a", "t", "Trần Khánh Hưng", "Trung tâm Fisubudedo", "hung.tran@mail.example", None), ("b", "t", "Trần Khánh Hưng", "Đại học Kokobarabi", "hung.tran@mail.example", None)]
    old += [("s", "t", "Lê Việt", "Viện Mosatuline", None, None), ("l1", "t", "Lê Gia Việt", "Viện Mosatuline", None, None), ("l2", "t", "Lê Văn Việt", "Viện Mosatuline", None, None)]
    return old, [("n1", "t", "Trần Khánh Hưng", "Trung tâm Fisubudedo", None, None), ("n2", "t", "Lê Gia Việt", "Viện Mosatuline", None, None)]


def test_history_links_of_old_rows_hold(spark):
    old, new = chain()
    tables = spark.catalog.listTables()
    found = {tuple(r) for r in history.batch_pairs(spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS)).collect()}
    assert found == joint_pairs(spark, old, new) == {("a", "n1"), ("b", "n1"), ("l1", "n2")}
    assert spark.catalog.listTables() == tables


def test_history_links_of_appended_rows_hold(spark):
    old, new = chain()
    assert hold(spark, old[:1] + old[2:], [old[1:2], new]) == {("a", "b"), ("a", "n1"), ("b", "n1"), ("l1", "n2")}


def test_a_late_row_joins_earlier_ones(spark):
    old = [("a", "t", "Trần Khánh Hưng", "Trung tâm Fisubudedo", "hung.tran@mail.example", None)]
    batches = [[("b", "t", "Trần Khánh Hưng", "Đại học Kokobarabi", None, "0685672530")], [("c", "t", "Tran Khanh Hung", None, "hung.tran@mail.example", "0685672530")]]
    assert step_by_step(spark, old, batches) == [set(), {("a", "b"), ("a", "c"), ("b", "c")}]


def test_steps():
    assert history.steps([(2, 10), (1, 10), (3, 10), (5, 100), (6, 1)], 240, 12) == [[1, 2], [3], [5], [6]]
    assert history.steps([], 5) == [] and history.steps([(1, 5), (2, 5)], 0) == [[1], [2]]


def test_copies(spark):
    columns = "id string, organization_id string, normalized_text string, batch_no int"
    old = spark.createDataFrame([("a", "t", "An | Abc | Sếp", 0), ("b", "u", "Bình | Abc", 0), ("n", "t", None, 0)], columns)
    new = spark.createDataFrame([("x", "t", " an | abc | sếp ", 1), ("y", "t", "An | Xyz", 1), ("z", "t", "An | Xyz", 2), ("w", "t", "", 2), ("v", "t", "Bình | Abc", None)], columns)
    assert {tuple(r) for r in history.copies(old, new).collect()} == {("x", 1, True, 1.0), ("y", 1, False, 0.5), ("z", 2, True, 1.0), ("w", 2, True, 0.0), ("v", None, False, 0.5)}


def test_empty_history_and_batch(spark):
    some, none = spark.createDataFrame(ROWS, COLUMNS), spark.createDataFrame([], COLUMNS)
    assert history.batch_pairs(some, none).count() == 0
    assert history.batch_pairs(none, some.filter("id like 'o%'")).count() == 0


def test_the_driver_is_tidied_all_along(spark, monkeypatch):
    # What jobs leave in the driver is given back after a dozen tables or so, not after a step; Java's command for native memory can be called.
    history._trim(spark)
    written, most = [], []
    for m in (people, history):
        monkeypatch.setattr(m, "cut", lambda one, real=m.cut: written.append(1) or real(one))
    monkeypatch.setattr(history, "_tidy", lambda s: most.append(len(written)) or written.clear())
    old, new = chain()
    history.batch_pairs(spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS))
    assert len(most) >= 10 and max(most) <= 14 and sum(most) > 40


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    # A chain, a ring, a loop and a missing end; two tables are written instead of some for every round.
    edges = [(i + 1, i) for i in range(40)] + [(-5, 90), (90, 91), (91, -5), (70, 70), (None, 71)]
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(people, "cut", lambda one, real=people.cut: written.append(1) or real(one))
    want = {i: 0 for i in range(41)} | {-5: -5, 90: -5, 91: -5, 70: 70}
    assert {r["vertex"]: r["label"] for r in people.components(df).collect()} == want and len(written) == 2
    assert {r["vertex"]: r["label"] for r in people.components(df, limit=-1).collect()} == want
    assert people.components(df.filter("false")).count() == 0


def test_history_is_neither_sorted_nor_wide(spark):
    # A batch's hashes are held per bucket, whose rows are read as they lie; parts share their columns, which come back as they were.
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    h = history.start(history.as_rows(spark.createDataFrame(ROWS, COLUMNS)))
    plan = planned(h.touched("keys", spark.range(3).select(F.col("id").alias("key"))))
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and len(spark.table(h.name).columns) <= 13
    assert {(r["row_id"], r["core"], r["kind"], r["phone_key"], r["incoming"]) for r in h.read("rows").collect()} >= {("a2", "fisubudedo", "centre", "685672530", False), ("n1", "", "", None, False)}
    assert h.read("keys").schema.simpleString() == "struct<key:bigint,vertex:bigint,size:int>" and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    h.drop()


def test_probes_of_spellings_are_not_broadcast(spark, monkeypatch):
    counts = history.cut(spark.createDataFrame([("t", "abcdefgh", 9), ("t", "abcdefg", 5)], "tenant string, core string, n long"))
    near = lambda: people.near_cores(counts, history._met(people.core_pieces(counts)))
    plan, found = near()._jdf.queryExecution().executedPlan().toString(), near().collect()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(history, "broadcast_if_small", lambda df: df)
    plan = near()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and sorted(near().collect()) == sorted(found) and len(found) == 2


def test_spellings_before_and_now_are_those_of_either_run(spark):
    # Chains, ties, a new core more frequent than the old ones, a core that is known only now and one without neighbours.
    kinds = [("t", "abcdefgh", "jsc", 3, 3), ("t", "abcdefg", "", 3, 3), ("t", "abcdefg", "ltd", 1, 9), ("t", "abcdef", "ltd", 2, 2), ("t", "abcdxf", "", 2, 2), ("t", "abcdxfyz", "", 0, 20), ("t", "lonesome", "", 1, 4), ("u", "abcdef", "co", 0, 1)]
    kinds = spark.createDataFrame(kinds, "tenant string, core string, kind string, was long, n long")
    counts = history._counts(kinds)
    was = kinds.filter("was > 0").select("tenant", "core").distinct()
    near = people.near_cores(counts, people.core_pieces(counts))
    near = near.join(was.withColumn("_x", F.lit(True)), ["tenant", "core"], "left").join(was.select("tenant", F.col("core").alias("other"), F.lit(True).alias("_y")), ["tenant", "other"], "left").select("tenant", "core", "other", F.coalesce(F.col("_x") & F.col("_y"), F.lit(False)).alias("was"))
    got = history._both_places(kinds, near)
    old = history._places(kinds.filter("was > 0").select("tenant", "core", "kind", F.col("was").alias("n")), near.filter("was").drop("was"))
    new = history._places(kinds.drop("was"), near.drop("was"))
    rows = lambda places: [sorted(tuple(r[c] for c in names) for r in df.collect()) for df, names in zip(places, (("tenant", "core", "to_core"), ("tenant", "to_core", "usual")))]
    assert rows(got[0]) == rows(old) and rows(got[1]) == rows(new) and rows(old) != rows(new)
    assert ("t", "abcdef", "abcdefg") in rows(got[0])[0]


def test_names_with_too_little_in_common_are_no_candidates(spark):
    # The first two share 4 of 6 q-grams, the third one with either, of which alike names have two; q-grams one name has count as the rarest.
    rows = [("a", "t", "Nguyễn Văn Thành", "Viện Mosatuline", None, None), ("b", "t", "Nguyễn Văn Thnah", "Viện Mosatuline", None, None), ("c", "t", "Nguyễn Gia Tùng", "Viện Mosatuline", None, None)]
    placed = people.placed_rows(people.as_rows(spark.createDataFrame(rows, COLUMNS)))
    nodes, at = people.vertices(placed), {r["vertex"]: r["row_id"] for r in placed.collect()}
    keys = history.cut(people.name_keys(nodes))
    frequency = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    met = lambda mine: people.meetings(keys.join(placed.filter(F.col("row_id").isin(*mine)).select("vertex"), "vertex", "left_semi"), keys, frequency, nodes)
    pairs = lambda df: {tuple(sorted((at[r["a"]], at[r["b"]]))) for r in df.collect()}
    assert pairs(people.employer_candidates(nodes, keys)) == {("a", "b")} == pairs(met("a")) == pairs(met("ab")) and pairs(met("c")) == set()


def test_wide_rows_are_kept_apart(spark):
    h = history.start(history.as_rows(spark.createDataFrame(ROWS, COLUMNS)))
    assert len(spark.table(h.name).columns) <= 8 and h.read("rows").count() == len(ROWS) and h.read("members").count() > 0
    h.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(h.name)]
