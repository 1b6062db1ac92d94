"""The language stage drops texts without a language only."""

from clickweave.llm import language_id


def test_low_scores_are_kept(docs_of):
    class Close:
        """A model whose duels are close; defined here, so that it is sent by value."""

        def predict(self, text):
            return ("de", 0.25) if text.strip() else ("und", 0.0)

    docs = docs_of([(1, "kurz, short"), (2, " "), (3, None)])
    assert [r.doc_id for r in language_id.drop_undetermined(docs, Close()).collect()] == [1]
