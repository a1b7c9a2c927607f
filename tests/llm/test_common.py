import random

import numpy as np
import pyarrow as pa

from lodestone.llm import common
from lodestone.llm.common import CHUNK, buffer, chunks, spans, WHITE, word_hashes
from tests.llm.helpers import words


def test_words_and_hashes_follow_the_contract():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc é\n\t\x0b \x1f.") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "x"]
    raw, offs = buffer(pa.array(texts, pa.string()))
    h, first = word_hashes(raw, offs)
    seen: dict = {}
    for i, t in enumerate(texts):
        own = h[first[i] : first[i + 1]]
        assert len(own) == len(words(t))
        for w, x in zip(words(t), own, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_slices_empty_arrays_and_large_strings():
    a = pa.array(["ab c", None, "d e f"])
    for x in (a, a.cast(pa.large_string()), pa.chunked_array([a])):
        assert list(np.diff(word_hashes(*buffer(x))[1])) == [2, 0, 3]
    assert list(np.diff(word_hashes(*buffer(a[1:]))[1])) == [0, 3]
    assert len(word_hashes(*buffer(pa.array([], pa.string())))[0]) == 0
    assert len(buffer(pa.array([None, None]))[1]) == 3


def test_chunks_cover_all_and_long_texts_stand_alone():
    offs = np.array([0, 1, CHUNK * 3, CHUNK * 3 + 5, CHUNK * 3 + 5])
    parts = list(chunks(offs))
    assert parts[0][0] == 0 and parts[-1][1] == 4 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_spans_stop_at_documents():
    raw, offs = buffer(pa.array(["ab", "cd", "", " e"]))
    s, e, first = spans(~WHITE[raw], offs)
    assert list(zip(s, e)) == [(0, 2), (2, 4), (5, 6)] and list(first) == [0, 1, 2, 2, 3]


def test_hashes_tell_patterns_of_repeats_apart():
    """Words that collide under any polynomial modulo 2**64: the Thue-Morse word and its complement."""
    word = b"a"
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    h, _ = word_hashes(*buffer(pa.array([word.decode(), other.decode(), word.decode(), "x " + word.decode()])))
    assert h[0] != h[1] and h[0] == h[2] == h[4]
    letters = [a + b for a in "abcdefghijklmnop" for b in "abcdefghijklmnop0123456789"]
    h, _ = word_hashes(*buffer(pa.array([" ".join(letters)])))
    assert len(set(h.tolist())) == len(letters)


def test_steps_of_many_tables_give_memory_back(spark, monkeypatch):
    """Tables of one step collect the driver's garbage between them, but not after each; a settled step always does."""
    given, real = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda session: given.append(1) or real(session))
    rows = spark.range(3)
    monkeypatch.setattr(common, "_given", [float("-inf")])
    assert [common.written(rows, "t").count() for _ in range(3)] == [3] * 3 and len(given) == 1
    monkeypatch.setattr(common, "GIVE_BACK_S", 0)
    assert common.written(rows, "t").count() == 3 and len(given) == 2
    assert common.settled(rows, "t").count() == 3 and len(given) == 4
