import hashlib
import random
from collections import Counter

import pytest

from newsloom.llm import fingerprints as fp


def text_of(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices("abcdefghijklmnopé", k=pick.randint(2, 7))) for _ in range(n))


def edited(docs):
    """Every document with its edited text, in order of id and text, nulls first."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        out.append((key, text, text[: len(text) - k] + after[:k], after))
    return out


def run(spark, docs, parts=3):
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, part string")
    return fp.edited_fingerprints(table.repartition(parts)).collect()


DOCS = [(i * 7 % 101, text_of(i, 1 + i * 3 % 90)) for i in range(101)]
ODD = [(500, None), (501, ""), (502, "a"), (503, "日本語" * 9), (503, "tie"), (None, "no id"), (None, None), (600, "word " * 20_000)]


@pytest.mark.parametrize("docs", [DOCS, DOCS[:20] + ODD, ODD, [(1, "only one text")], [(1, "same"), (1, "same")]])
def test_equals_brute_force(spark, docs):
    want = Counter(
        (key, len(text), hashlib.sha256(other.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(other),
         fp.likeness(fp.fingerprint(text), fp.fingerprint(other)), fp.likeness(fp.fingerprint(text), fp.fingerprint(after)))
        for key, text, other, after in edited(docs)
    )
    assert Counter(map(tuple, run(spark, docs))) == want


def test_edits_move_a_fingerprint_little():
    text = text_of(1, 400)
    pick = random.Random(2)
    changed = list(text)
    for _ in range(10):
        at = pick.randrange(len(changed))
        changed[at : at + 1] = pick.choice([[], ["q"], [changed[at], "z"]])
    near = fp.likeness(fp.fingerprint(text), fp.fingerprint("".join(changed)))
    far = fp.likeness(fp.fingerprint(text), fp.fingerprint(text_of(3, 400)))
    assert near > 0.6 and far < 0.1
    shorter = fp.likeness(fp.fingerprint(text), fp.fingerprint(text[: len(text) * 3 // 4]))
    assert 0.6 < shorter < 0.85


def test_walks_of_part_of_a_text_begin_alike():
    assert fp.fingerprint("") == "0:" and fp.likeness("0:", "0:") == 1.0 and fp.likeness("0:", "0:aa") == 0.0
    assert fp.likeness("1:aabb", "0:aa01bb02") == 1.0


def test_empty_table(spark):
    assert run(spark, []) == []


def test_near_texts_form_groups(spark):
    base = [text_of(k, 60) for k in range(6)]
    docs, pick = [], random.Random(4)
    for i in range(48):
        text = list(base[i % 6])
        for _ in range(pick.randint(0, 3)):
            text[pick.randrange(len(text))] = "q"
        docs.append((i, "".join(text)))
    docs += [(100, base[0]), (101, base[0]), (102, None), (103, ""), (104, "short")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, label string")
    got = {r.doc_id: r.group_id for r in fp.near_texts(table).collect()}
    # Bands may miss a near copy, but join nothing else.
    assert all(got[i] in (i % 6, i) for i in range(48)) and sum(got[i] == i % 6 for i in range(48)) >= 45
    assert [got[i] for i in range(100, 105)] == [0, 0, 102, 102, 104]


def distance(one, two):
    row = list(range(len(two) + 1))
    for i, x in enumerate(one, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(two, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def band_keys(text):
    level, samples = fp.fingerprint(text).split(":")
    level, samples = int(level), bytes.fromhex(samples)
    return {
        (up, k, part[k : k + fp.BAND])
        for up, part in ((level, samples), (level + 1, samples[::2]))
        for k in range(0, len(part) - fp.BAND + 1, fp.BAND)
    }


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[a] if x == label[b] else x for x in label]
    return [label.index(x) for x in label]


@pytest.mark.parametrize("block", [64, 1])
def test_near_texts_beyond_a_bands_least_text_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK_CLASSES", block)
    # One passage begins all texts, so all share its bands; the two texts of a family share few others.
    start, pick, texts = text_of(50, 10), random.Random(2), []
    for family in range(5):
        end = text_of(60 + family, 30)
        for _ in range(2):
            changed = list(end)
            for at in range(pick.randrange(9), len(changed), 9):
                changed[at] = "q"
            texts.append(start + " " + "".join(changed))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a] != texts[b]]
    near = [(a, b) for a, b in pairs if distance(texts[a], texts[b]) <= int(max(len(texts[a]), len(texts[b])) * 0.25)]
    keys = [band_keys(t) for t in texts]
    banded = [(a, b) for a, b in near if keys[a] & keys[b]]
    assert len(banded) >= 0.95 * len(near) > 0
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in fp.near_texts(table).collect()}
    assert [got[i] for i in range(len(texts))] == groups(len(texts), banded)
    assert len(set(got.values())) == 5
