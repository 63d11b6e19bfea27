"""Whole jobs: what an operator finds isn't cut by fragments, endings, ids or short tables."""

import pytest
from tessera.llm import nearjoin, pii


@pytest.mark.parametrize(("text", "kind"), [
    ("jоhn.smith@example.com", 0), ("john@example.cоm", 0), ("john dot smith@example.com", 0), ("anna@mail.example dot com", 0),
    ("+1 555 1234 five six seven eight", 3),
])
def test_whole_of_partly_disguised(text, kind):
    base, every = pii.spans(text)
    assert len(base) == 1 and base[0] in every and (kind, 0, len(text)) in every


def test_plain_identifiers_are_given_once():
    text = "jоe and john.smith@example.com or +1 555 123 4567"
    assert pii.spans(text)[0] == pii.spans(text)[1] and len(pii.spans(text)[0]) == 2


def test_whole_of_partly_disguised_is_redacted(spark):
    docs = spark.createDataFrame([(1, "an jоhn.smith@example.com, john dot smith@example.com")], "doc_id long, text string")
    assert pii.detect(docs, redact=True).first().text == "an [EMAIL], [EMAIL]"
    assert pii.detect(docs).first().n_email == 4


@pytest.mark.parametrize("text", ["hans at beispiel.de", "marie at exemple.fr", "ana at ejemplo.es", "joe at example.co.uk", "a.b at firma.museum", "li at mail.xn--p1ai", "joe at example.com", "JOE AT EXAMPLE.DE", "o_k at 163.cn"])
def test_any_ending_of_an_address(text):
    assert (0, 0, len(text)) in pii.spans(text)[1]
    assert (0, 6, 6 + len(text)) in pii.spans(f"write {text}. Then go.")[1] and (0, 6, 6 + len(text)) in pii.spans(f"(mail {text}, now)")[1]


@pytest.mark.parametrize("text", ["We met at noon.Then we left", "look at it.It is", "open at 9.am", "look at notes.txt", "stand at x.y", "we stay at home.", "be at home. de", "see you at 10.30 or at 5.x2", "at chez.moié", "Sei um 8 at haus. es"])
def test_prose_without_an_address(text):
    assert pii.spans(text) == ([], [])


A, B, C = ("one fine day in spring the birds sang over a field of barley", "rain fell on slate roofs while seven clerks counted copper coins", "no ship has left this harbour since the old lighthouse lost its lamp")


def test_texts_of_null_and_shared_ids_survive(spark):
    rows = [(None, A), (None, A), (5, B), (5, C), (5, C), (9, C), (None, B.upper()), (1, None), (None, ""), (None, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, (r.text or "").lower()) for r in nearjoin.stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, A), (5, B), (5, C), (1, ""), (None, ""), (None, ""), (2, "")], key=str)
    got = sorted(((r.doc_id, r.rep_id, r.class_id, r.n_links, r.n_class) for r in nearjoin.join(docs).where("n_words > 0").collect()), key=str)
    assert got == sorted([(None, None, None, 1, 2)] * 2 + [(5, 5, 5, 1, 2), (None, 5, 5, 1, 2)] + [(5, 5, 5, 2, 3)] * 2 + [(9, 5, 5, 2, 3)], key=str)


def test_null_ids_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(None, text + " end"), (None, text + " stop"), (4, A), (4, text)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.class_id, r.n_links, r.n_class) for r in nearjoin.join(docs).collect()}
    assert got == {(None, 201): (4, 2, 3), (4, 200): (4, 2, 3), (4, 13): (4, 0, 1)}
    assert sorted((r.doc_id, r.text) for r in nearjoin.stage(spark, docs, "").collect()) == sorted([(4, A), (4, text)])
