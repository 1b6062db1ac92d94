"""The bootstrap of contextual spans: whole seeds, words of any script, words that introduce other things."""

from clickweave.llm import pii


def test_phones_are_seeds_of_their_own(docs_of):
    rows = [(i, f"Some words. hotline: +1 (017) 555-77{i:02d} and more") for i in range(20)]
    found = {r.doc_id: [s.hit for s in r.id] for r in pii.find(docs_of(rows + [(50, "Here. hotline: QX-12 now")])).collect()}
    assert found[50] == ["QX-12"] and found[3] == []


def test_words_of_any_script_and_line_breaks(docs_of):
    rows = [(i, f"Текст. номер 10.0.0.{i} и так далее") for i in range(20)]
    rows += [(50, "Это номер 12345-AB здесь"), (51, "Это номер:\n777-B здесь")]
    found = {r.doc_id: [s.hit for s in r.id] for r in pii.find(docs_of(rows)).collect()}
    assert found[50] == ["12345-AB"] and found[51] == ["777-B"]


def test_words_that_introduce_other_things_are_refused(docs_of):
    rows = [(i, f"Go to the 10.0.0.{i} with the cat and the dog and the bird") for i in range(20)]
    found = {r.doc_id: [s.hit for s in r.id] for r in pii.find(docs_of(rows + [(50, "It is the 42nd day")])).collect()}
    assert found[50] == []
