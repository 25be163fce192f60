import re

import numpy as np
import pyarrow as pa

from newsloom.llm.texts import blocks, shingles, span_hashes, word_hashes, words

TEXTS = ["", None, " \t\n\x0b\x0c\r ", "one", "One two THREE four", "a b c d e", "A b c d e f a b c d e", "é à x y", "x" * 5000]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_runs_of_other_than_space():
    for most in (1, 8, 1 << 20):
        found = []
        for _, data, offsets in blocks(pa.array(TEXTS), most):
            starts, ends, bounds = words(data, offsets)
            raw = data.tobytes()
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                found.append([raw[s:e].decode() for s, e in zip(starts[a:z], ends[a:z], strict=True)])
        assert found == [split(t) for t in TEXTS]


def test_shingles_equal_sets_of_word_runs():
    names = {}
    sets = []
    for _, data, offsets in blocks(pa.array(TEXTS)):
        sets += shingles(*word_hashes(data, offsets))
    for text, found in zip(TEXTS, sets, strict=True):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in split(text)]
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
        for value in want:
            names.setdefault(value, set())
        if len(want) == 1:
            names[next(iter(want))].add(int(found[0]))
    assert all(len(v) <= 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values() if v}) == sum(bool(v) for v in names.values())


def test_equal_spans_hash_equally_wherever_they_stand():
    data = np.frombuffer(b"abc abc ab", np.uint8)
    found = span_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 10]))
    assert found[0] == found[1] != found[2]
