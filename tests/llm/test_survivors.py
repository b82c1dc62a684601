import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.llm import survivors as s

ENTITIES = "id string, display_name string, primary_email string, primary_phone string, primary_role string, updated_at timestamp"

EMAILS = {"a.b@x.example": 1, "A-B+c@X.Example": 1, "": 0, None: 0, " ": 0, "khongco": 0, "n/a": 0, "a@": 0, "@x.example": 0, "a@@x.example": 0, "a@.example": 0, "a@x": 0, "a x.example": 0, "noemail@none.example": 0, "test@test.example": 0, "x@x.example": 0, "guest07@x.example": 1}
PHONES = {"0655647968": 1, "+84 655 647 968": 1, "0084655647968": 1, "(+84) 65-564-7968": 1, "0655.647.968": 1, "84655647968": 1, "065565": 0, "06556479680000": 0, "0655xxxxxx": 0, "0655647???": 0, "+84": 0, "0": 0, "0000000000": 0, "0999999999": 0, "1234567890": 0, "1111111111": 0, "chưa có": 0, None: 0}
NAMES = {"Trần Gia Hân": 1, "P.Q. Vinh": 1, "luong_van_triet": 1, "Глеб Верхотурин": 1, "森本 拓人": 1, "(không rõ)": 0, "Guest 12": 0, "Đại biểu 7": 0, "Họ tên": 0, "no name": 0, "N/A": 0, "-": 0, "a@b.example": 0, "  ": 0, None: 0, "Khách mời": 0}
ROLES = {"Dean": 1, "Trưởng khoa": 1, "TRO LY": 1, "0": 0, ".": 0, "???": 0, "none": 0, "chưa rõ": 0, "không": 0, "Chức vụ": 0, "": 0, None: 0}


@pytest.mark.parametrize("f, cases", [(s.usable_email, EMAILS), (s.usable_phone, PHONES), (s.usable_name, NAMES), (s.usable_text, ROLES)])
def test_usable(spark, f, cases):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string").orderBy("i")
    got = {v: r[0] for v, r in zip(cases, df.select(f("v").alias("x")).collect())}
    assert got == {v: bool(x) for v, x in cases.items()}


def day(n):
    return dt.datetime(2025, 1, n)


def test_latest_usable_with_ties_repeats_and_nulls(spark):
    e = spark.createDataFrame([("a", "Lê A", "a@x.example", None, None, day(1)), ("b", "(không rõ)", "b@x.example", "0655647968", "", day(3)), ("c", "Lê B", "bad", "065", None, day(3)), ("d", "Lê D", None, None, None, None), ("e", None, "", "0", "none", day(9))], ENTITIES)
    g = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (1, "d"), (2, "e"), (2, "gone"), (None, "a"), (3, "b"), (3, "c")], "group_id long, canonical_entity_id string")
    got = {(r["group_id"], r["field_name"]): r["canonical_entity_id"] for r in s.best_values(g, e).collect()}
    assert got == {(1, "primary_email"): "b", (1, "primary_phone"): "b", (1, "display_name"): "c", (3, "primary_email"): "b", (3, "primary_phone"): "b", (3, "display_name"): "c"}
    gold = {r["group_id"]: r for r in s.golden_entities(g, e).collect()}
    assert gold[1]["primary_email"] == "b@x.example" and gold[1]["display_name_from"] == "c" and gold[2]["primary_email"] is None and gold[1]["n_members"] == 4
    assert s.best_values(g.filter("false"), e).count() == 0


def test_trust_before_recency_and_brute_force(spark):
    rows = [(f"e{i:03}", f"Lê {i}" if i % 3 else None, f"m{i}@x.example" if i % 4 else "-", None, "Dean", day(1 + i * 7 % 27)) for i in range(120)]
    e = spark.createDataFrame(rows, ENTITIES).withColumn("trust", F.length("id"))
    g = spark.createDataFrame([(0 if i % 3 == 0 else i % 9, r[0]) for i, r in enumerate(rows)], "group_id long, canonical_entity_id string")
    got = {(r["group_id"], r["field_name"]): r["canonical_entity_id"] for r in s.best_values(g, e).collect()}
    want = {}
    for i, r in enumerate(rows):
        for f, ok in (("display_name", i % 3), ("primary_email", i % 4), ("primary_role", 1)):
            if ok:
                k = (0 if i % 3 == 0 else i % 9, f)
                want[k] = min(want.get(k, ((dt.datetime.max - r[5]), r[0])), ((dt.datetime.max - r[5]), r[0]))
    assert got == {k: v[1] for k, v in want.items()}
    trusted = s.best_values(g, e, trust=F.when(F.col("id") == "e001", 1).otherwise(0)).filter("group_id = 1 and field_name = 'primary_role'").first()
    assert trusted["canonical_entity_id"] == "e001"
