import zipfile

import pytest

from rollcall.operators import models
from rollcall.sources import grid, readers, staging, xlsx


def workbook(path, rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")


def test_header_names():
    assert grid.header_names(["", " A ", "A"], 4) == ["Cột 1", "A", "A (2)", "Cột 4"]


def test_rows_of_three_kinds(spark):
    headers, rows = grid.from_python(spark, ["Tên", "Đơn vị", "Ghi chú"], [["  Nguyễn   Văn A ", "", ""], ["", "Công ty B", ""], ["", "", "chỉ ghi chú"]])
    got = {r["row_number"]: r for r in grid.parse_rows(headers, rows, {"Tên": "full_name", "Đơn vị": "organization", "Ghi chú": "notes"}, "DS.xlsx").collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2]["full_name"] == "Nguyễn Văn A" and got[2]["entity_type"] == "person" and got[2]["raw_data"]["Tên"] == "  Nguyễn   Văn A "
    assert got[3]["entity_type"] == "organization" and not got[4]["resolvable"] and got[4]["event_name"] == "DS"


def test_blank_line_keeps_numbers(spark):
    _, rows = grid.from_python(spark, ["Tên"], [["A"], [" "], ["B"]])
    assert [r["row_number"] for r in rows.orderBy("row_number").collect()] == [2, 4]
    assert {r["header"]: r["sample"] for r in grid.samples(["Tên"], rows).collect()} == {"Tên": "A"}
    assert grid.within_limits(rows, 2) and not grid.within_limits(rows, 1) and grid.preview(rows, 1).count() == 1


def test_mapping_checks():
    assert grid.checked_mapping(["a", "b"], {"a": "email", "b": "salary"}) == {"a": "email", "b": "ignore"}
    for bad in ({"a": "ignore"}, {"a": "notes"}):
        with pytest.raises(ValueError):
            grid.checked_mapping(["a"], bad)


def test_workbook_source(spark, tmp_path):
    workbook(tmp_path / "one.xlsx", [(1, ["Tên", "Ngày"]), (2, ["A", 45823.0]), (4, [None, "x"])])
    xlsx.register(spark)
    rows = spark.read.format("xlsx").load(str(tmp_path / "*.xlsx")).orderBy("row_number").collect()
    assert [(r["row_number"], r["cells"]) for r in rows] == [(1, ["Tên", "Ngày"]), (2, ["A", "45823"]), (4, ["", "x"])]
    assert readers.read_workbooks(spark, str(tmp_path)).count() == 3
    assert [r["name"] for r in readers.list_workbooks(spark, str(tmp_path), "ONE").collect()] == ["one.xlsx"] and readers.list_workbooks(spark, str(tmp_path), "%").count() == 0


def test_csv_and_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a\nb",2\n', encoding="utf-8")
    assert [r["cells"] for r in readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()] == [["x", "y"], ["a\nb", "2"]]
    (tmp_path / "v.json").write_text('{"values": [["h", "n"], ["a", 3.0, true]]}')
    assert [r["cells"] for r in readers.read_values(spark, str(tmp_path / "v.json")).orderBy("row_number").collect()] == [["h", "n"], ["a", "3", "true"]]


def test_models():
    assert models.infer_mapping(["Tên ", "X"], [], lambda h, r: {"tên": {"field": "full_name", "confidence": 2}, "X": {"field": "zzz"}}) == {"Tên ": {"field": "full_name", "confidence": 1.0, "reasoning": ""}, "X": {"field": "notes", "confidence": 0.0, "reasoning": ""}}
    assert models.infer_mapping(["a"], [], None)["a"]["field"] == "ignore"
    waits, tries = [], []

    def ask():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("503 UNAVAILABLE")
        return '```json\n{"a": 1}\n```'

    assert models.call_json(ask, sleep=waits.append) == {"a": 1} and waits == [0.4, 0.8]
    assert len(models.translate("x", None).applied) == 4


def test_staging(spark):
    now = [0.0]
    store = staging.Staging(lambda: now[0])
    headers, rows = grid.from_python(spark, ["Tên"], [["A"]])
    token = store.put("t", "DS", headers, rows, {})
    assert store.get(token, "t").headers == ["Tên"] and store.get(token, "u") is None and store.get("x", "t") is None
    now[0] = staging.TTL + 1
    assert store.get(token, "t") is None and store.reap() == 1
    with pytest.raises(ValueError):
        store.put("t", "DS", headers, spark.range(5001).selectExpr("cast(id as int) row_number", "array('a') cells"), {})
