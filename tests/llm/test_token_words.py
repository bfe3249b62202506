"""Ids of single words: equal to the library's, and few words take the slow way."""

from kestrel.llm.queries import vocabulary
from kestrel.llm.token_orc import _Words

SIGNED = ["rend%%%", "(825)", "555-2370", "éon.", "ieesuemición%%%", "oust!!", "a.b,c", "_x_", "7é7", "{~}", "straße&&&", "[^`\\]"]
OTHER = ["don't", "'s", "Éaux,###", "áb", "x×y", "µm", "日本", "!'s!", "x\u0085y", "ª1"]


def test_words_equal_the_library():
    words = _Words(vocabulary("word_bpe_49k.json"))
    for w in [*SIGNED, *OTHER, "plain", "größer", "...", "9", "<", "<b>"]:
        want = words.tokenizer.encode(w, add_special_tokens=False).ids
        got = words.encode([w.encode()])[0]
        assert [int.from_bytes(got[i:i + 4], "little") for i in range(0, len(got), 4)] == want, w


def test_signs_and_digits_need_no_whole_tokenizer(monkeypatch):
    words, slow = _Words(vocabulary("word_bpe_49k.json")), []
    whole = _Words.whole
    monkeypatch.setattr(_Words, "whole", lambda self, t: slow.append(t) or whole(self, t))
    words.encode([" ".join(SIGNED).encode()])
    assert slow == []
    words.encode([" ".join(OTHER).encode()])
    assert slow
