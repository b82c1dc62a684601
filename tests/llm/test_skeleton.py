import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import skeleton as s

SAME = ["", "Тарас", "Νίκος", "Олена А.", "“Abc”", "森本 一郎", "סוס", "Nguyễn Văn A", "  two  blanks ", "Глеб Верхотурин", "ОЛЕНА ТИХОЛІЗ", "Μυρτώ Σταθάκου", "森本 拓人", "Zoë Ørsgaard", "chi nhánh 2", "Тихоліз, Олена", "Dr Глеб Верхотурин"]
ODD = {
    "Nguyօn": "Nguyon", "Bսi": "Bui", "Ꭺnh": "Anh", "ꓐui": "Bui", "ᴛuan": "tuan", "Ⲟanh": "Oanh", "Hסa": "Hoa", "Ӏan": "Ian", "ѵu": "vu", "Abкm": "Abkm",
    "Nguyễn": "Nguyễn", "Ｈồ Ngọc": "Hồ Ngọc", "Lamut⁠usode​": "Lamutusode", "Bùi My": "Bùi My", "Cοrр": "Corp", "Нο Ρhương": "Ho Phương", "Ν. Ν. T. Khuê": "N. N. T. Khuê", "Ðỗ": "Đỗ", "Ɖinh": "Đinh", "soft­hyphen": "softhyphen",
    "à": "à", "﻿Tran": "Tran", "Bаsmаnov": "Basmanov", "Сoкoленкo": "Соколенко", "（a）": "(a)", "x" * 20000 + "‍": "x" * 20000,
}


@pytest.fixture(autouse=True, scope="module")
def table(spark):
    s.look_alike_table(spark)


@pytest.mark.parametrize("text", SAME)
def test_usual_values_stay(text):
    assert s.consistent_form(text) == text


@pytest.mark.parametrize("text, wanted", ODD.items())
def test_odd_values(text, wanted):
    assert s.consistent_form(text) == wanted


def test_null():
    assert s.consistent_form(None) is None and s.skeleton(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_stable_and_composed(text):
    once = s.consistent_form(text)
    assert s.consistent_form(once) == once and unicodedata.is_normalized("NFC", once)
    assert s.skeleton(once) == s.skeleton(text)


def test_tables(spark):
    rows = spark.createDataFrame([("1", "Hồ A", None, 1), ("2", "Ｈồ A", "Сorp", 2), ("2", "Ｈồ A", "", 3), ("3", None, "Corp", 4)], "id string, full_name string, organization string, record_id int")
    assert sorted(tuple(r)[:2] for r in s.unusual_values(rows).collect()) == [("2", "full_name"), ("2", "full_name"), ("2", "organization")]
    assert [r["full_name"] for r in s.consistent_columns(rows).orderBy("record_id").collect()] == ["Hồ A", "Hồ A", "Hồ A", None]
    assert {r["consistent"] for r in s.unusual_values(rows).collect()} == {"Hồ A", "Corp"}
    alike = {r["field_name"]: (r["n_rows"], r["n_spellings"]) for r in s.look_alikes(rows).collect()}
    assert alike == {"full_name": (3, 2), "organization": (2, 2)}
    assert s.unusual_values(rows.filter("false")).count() == 0


def test_usual_form_is_the_groups_most_frequent_usual_member(spark):
    rows = spark.createDataFrame([("1", "Роса"), ("2", "Роса"), ("3", "Poca"), ("4", "Рoca")], "id string, full_name string")
    got = s.unusual_values(rows, fields=("full_name",)).collect()
    assert [(r["record_id"], r["consistent"]) for r in got] == [("4", "Роса")]


def test_plan_groups_by_skeleton(spark):
    rows = spark.createDataFrame([("1", "Роса")], "id string, full_name string")
    plan = s.unusual_values(rows, fields=("full_name",)).select("record_id", "field_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "skeleton" in plan and "Window" in plan
