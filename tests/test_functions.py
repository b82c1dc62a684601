import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates, scores, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f("v").alias("x")).collect()]


CASES = [
    (text.cell, [" a \t b\n", None, ""], ["a b", "", ""]),
    (text.strip_diacritics, ["Đỗ Thị Ngọc", "éa", "plain"], ["Do Thi Ngoc", "ea", "plain"]),
    (text.strip_titles, ["PGS.TS. Nguyễn Văn Hoàng", "TS", "Ông Đỗ Bá", "TSé x"], ["Nguyễn Văn Hoàng", "TS", "Ông Đỗ Bá", "é x"]),
    (text.blocking_key, ["PGS.TS. Nguyễn Văn Hoàng", "ThS. Lê Thị Thu Hà", "Trần Văn A", "Ông Đỗ Bá", "TS", None], ["nguyen van hoang", "le thi thu ha", "tran van a", "ong do ba", "ts", ""]),
    (text.phone, ["0988 112 233", "+84912345678", "84123", "(+84) 903-998-877", "abc", None], ["0988112233", "0912345678", "84123", "0903998877", "", ""]),
    (text.email, [" Hoang.Nguyen@VINAI.io ", "a@b", "x y@z.vn", None], ["hoang.nguyen@vinai.io", "", "", ""]),
    (text.trim_extension, ["TechFest_2025_Attendees.xlsx", "a.longextension", "no_ext"], ["TechFest_2025_Attendees", "a.longextension", "no_ext"]),
    (text.trim_lower, [" Ab ", None], ["ab", ""]),
    (lambda c: F.array_join(text.split_list(c), "|"), ["a, b,,c ", None, " , "], ["a|b|c", "", ""]),
]


@pytest.mark.parametrize("f, given, wanted", CASES)
def test_text(spark, f, given, wanted):
    assert column(spark, given, f) == wanted


def test_numbers_as_text(spark):
    assert column(spark, [45823.0, 45823.5, -2.0, 1e12], text.number_text, "double") == ["45823", "45823.5", "-2", "1000000000000"]


def test_identity_and_tenant(spark):
    df = spark.createDataFrame([("A", None, "x"), ("", " ", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(text.identity("a", "b", "c")).collect()] == ["A | x", "(không rõ)"]
    keys = spark.createDataFrame([("innovation-center", "", "u"), (None, None, "u"), ("org a", None, "v")], "a string, b string, u string").select(text.tenant_key("a", "b", "u").alias("k")).collect()
    assert keys[0][0] == "innovation-center" and keys[1][0].startswith("org_user_") and keys[2][0] not in ("orga", keys[1][0])


DATES = {
    "15/06/2025": "2025-06-15", "03/06/2025": "2025-06-03", "06/15/2025": "2025-06-15", "45823": "2025-06-15", "45823.5": "2025-06-15", "1.2.69": "2069-02-01", "1-2-70": "1970-02-01", "15 tháng 6 năm 2025": "2025-06-15", "15 thang 6 2025": "2025-06-15",
    "2025-06-15T10:00:00Z": "2025-06-15", "2025/06/15": "2025-06-15", "Jun 5, 2025": "2025-06-05", "31/02/2025": None, "13/13/2025": None, "2025-13-01": None, "TBD": None, "": None, None: None,
}


def test_event_dates(spark):
    assert column(spark, list(DATES), dates.event_date) == [dt.date.fromisoformat(d) if d else None for d in DATES.values()]


def test_scores(spark):
    df = spark.createDataFrame([(0.94, True, 0.9), (0.94, False, 0.9), (float("nan"), True, 2.0)], "s double, v boolean, c double")
    assert [round(r[0], 3) for r in df.select(scores.combine_confidence("s", "v", "c")).collect()] == [0.914, 0.394, 0.65]
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(scores.cosine("a", "b").alias("c"), scores.l2_normalize("a").alias("u")).collect()
    assert round(v[0]["c"], 6) == 0.96 and v[1]["c"] is None and v[2]["c"] is None and v[1]["u"] == [0.0, 0.0]


@pytest.mark.parametrize("version, ok", [("0.8.6", True), ("0.8.0", True), ("0.10.0", True), ("1.0.0", True), ("0.7.4", False), ("0.5.1", False), ("", False), ("garbage", False), ("0", False)])
def test_versions(version, ok):
    assert text.version_at_least(version) is ok


def test_number_text(spark):
    from rollcall.functions.text import number_text

    values = {12.0: "12", -3.0: "-3", 0.5: "0.5", 1e-12: "0.000000000001", -2.5e-7: "-0.00000025", 1234567.25: "1234567.25", 1e21: "1000000000000000000000", 12345678.9: "12345678.9", 0.1234567890123: "0.1234567890123"}
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_text("v").alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == values


def test_retries():
    from rollcall.operators.models import call_json

    def tries(*answers):
        seen = []

        def ask():
            seen.append(1)
            a = answers[len(seen) - 1]
            if isinstance(a, Exception):
                raise a
            return a

        try:
            return call_json(ask, sleep=lambda _: None), len(seen)
        except Exception as e:  # noqa: BLE001
            return type(e).__name__, len(seen)

    assert tries(RuntimeError("DEADLINE_EXCEEDED"), '{"a": 1}') == ({"a": 1}, 2)
    assert tries(RuntimeError("limit of 1500 rows"), "{}") == ("RuntimeError", 1)
    assert tries("", " ", "{}") == ({}, 3) and tries("", None, "")[0] == "EmptyAnswer"
    assert tries(RuntimeError("HTTP 503"), RuntimeError("status: 429 Too Many"), "[]") == ([], 3)
    assert tries("no json", "{}") == ("JSONDecodeError", 1)
