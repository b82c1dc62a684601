import os

import pyarrow.parquet as pq
import pytest

from rollcall.llm import subjects as s

SF = "/root/testdata/sf0.1"


def test_sentences_fold_markup_and_odd_characters():
    assert s.sentences("<p>Một câu.<br>HAI câu!</p>Paper no. 9 looks") == ["mot cau", "hai cau", "paper no. 0 looks"]
    assert s.sentences("chia g会場iúp một\r\n\r\n\tphần") == ["chia giup motphan"] and s.sentences(None) == [] == s.sentences(" \n ")


@pytest.fixture(scope="module")
def held_out():
    if not os.path.exists(SF):
        pytest.skip("no test data")
    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    labels = {}
    for d, x in zip(*pq.read_table(f"{SF}/doc_labels.parquet").to_pydict().values()):
        labels.setdefault(d, set()).add(x)
    known = [(r["subject"], f"{r['title_vi']}, {r['description']}") for r in pq.read_table(f"{SF}/subjects.parquet").to_pylist()]
    ids = sorted(d for d in labels if texts.get(d))
    return texts, labels, known, ids


def test_held_out_accuracy(held_out):
    texts, labels, known, ids = held_out
    right = wrong = missed = 0
    for fold in range(1):
        c = s.fit([(texts[d], labels[d]) for d in ids if d % 3 != fold], known)
        for d in (d for d in ids if d % 3 == fold):
            got = {x for x, n in c.counts(texts[d]).items() if n >= s.SENTENCES}
            right, wrong, missed = right + len(got & labels[d]), wrong + len(got - labels[d]), missed + len(labels[d] - got)
    # Some labels are wrong on purpose.
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "từ", 1), (4, "goal. " * 5, 1), (4, "goal. " * 5, 1)], "doc_id long, text string, subject int")
    labels = spark.createDataFrame([(4, "sport"), (4, "sport"), (9, "law"), (4, "nothing"), (None, "law")], "doc_id long, subject string")
    known = spark.createDataFrame([("sport", "Thể thao", "Goal, match"), ("law", "Luật", None)], "subject string, title_vi string, description string")
    got = s.assign_subjects(docs, labels, known).collect()
    assert {(r["doc_id"], r["subject"]) for r in got} == {(4, "sport")} and len(got) == 2
    assert s.assign_subjects(docs.filter("false"), labels.filter("false"), known).count() == 0
    mixed = s.subject_mixtures(docs, labels, known).collect()
    assert len(mixed) == 5 * 3 and all(abs(sum(r["share"] for r in mixed if r["doc_id"] == d) - 1) < 1e-5 for d in (1, 2, 3))
    assert {r["share"] for r in mixed if r["doc_id"] == 1} == {0.0, 1.0}
    whole = {r["subject"]: r["documents"] for r in s.composition(s.subject_mixtures(docs, labels, known)).collect()}
    assert abs(sum(whole.values()) - 5) < 0.01 and whole["sport"] > whole["law"]
