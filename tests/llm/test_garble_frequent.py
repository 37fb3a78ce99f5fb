from cuemill.llm import garble as g
from tests.llm.test_garble import TEXTS, misread


def _model(true: str, garbled: str) -> g.Model:
    """A corpus of a million words in which the garbled line stands 100 times, beside the true one 20 000 times."""
    words = {w.casefold(): 100 for w in g._WORD.findall(garbled)} | {w.casefold(): 20_000 for w in g._WORD.findall(true)}
    return g.Model(words, 1_000_000)


def test_frequent_single_byte_line():
    true = "Привет, дорогой друг."
    garbled = misread(true, "cp1251", "cp1252")
    model = _model(true, garbled)
    assert max(model.log[w.casefold()] for w in g._WORD.findall(garbled)) < 10.5
    assert g.restore(garbled, model) == (True, true, True)
    assert g.restore(true, model) == (False, true, True)


def test_frequent_multi_byte_line():
    # Read as Cyrillic letters alone: no sign is left to betray them.
    true = "あい をよ かお"
    garbled = misread(true, "cp932", "cp866")
    assert g.restore(garbled, _model("", garbled)) == (True, true, True)
