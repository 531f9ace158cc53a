"""Repeated and split licence notices."""

from loftline.llm import licences


def test_notices_split_by_words_and_later_copies_are_found():
    index = licences.Index(100, {})
    notice = licences.words_of(licences.TEMPLATES[3][1])
    rare = sorted({p for w in index.places for t, p, _ in index.places[w] if t == 3})
    words = list(notice)
    for at in (rare[6], rare[4], rare[2]):   # from behind; four parts of the rare words
        words.insert(at, "extra")
    phrases = [p for p, at in index.keys[3]]
    assert all(any(words[i:i + len(p)] == p for i in range(len(words))) for p in phrases)
    assert [m[0] for m in index.matches(words)] == ["isc"]
    twice = ["pre"] * 9 + notice + ["mid"] * 40 + notice
    assert [m[:2] for m in index.matches(twice)] == [("isc", 9), ("isc", 49 + len(notice))]
