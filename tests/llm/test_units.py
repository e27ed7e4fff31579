"""Units of text that stay in use are encoded once however many others come by."""

import collections

from strataflow.llm import tokens


class _Model:
    def __init__(self):
        self.asked = collections.Counter()

    def tokenize(self, piece):
        self.asked[piece] += 1
        return [type("Token", (), {"id": ord(c)})() for c in piece]


class _Tokenizer:
    def __init__(self):
        self.model = _Model()

    def encode(self, text, add_special_tokens):
        return type("Encoding", (), {"ids": [ord(c) for c in text]})()


def _letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_units_in_use_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 20)
    tokenizer = _Tokenizer()
    units = tokens.Units(tokenizer, "", True, None)
    for i in range(500):
        assert units[b"often"] == b"".join(ord(c).to_bytes(4, "little") for c in "often")
        rare = f"{_letters(i)}x"
        assert units[rare.encode()] == b"".join(ord(c).to_bytes(4, "little") for c in rare)
    assert tokenizer.model.asked["often"] == 1
    assert len(units) + len(units.past) <= 41


def test_marks_case_and_other_letters():
    tokenizer = _Tokenizer()
    units = tokens.Units(tokenizer, "", True, None)
    code = lambda s: b"".join(ord(c).to_bytes(4, "little") for c in s)
    assert units[b"Word,"] == code("word") + code(",") and units[b"."] == code(".")
    assert units["Übe.".encode()] == code("übe".encode().decode("latin-1").translate(tokens._LETTERS)) + code(".")
    assert units[b"a1b"] == code("a1b")
    spaced = tokens.Units(tokenizer, " ", False, units)
    assert spaced["Word"] == code("ĠWord") and spaced["a-b"] == code(" a-b")
