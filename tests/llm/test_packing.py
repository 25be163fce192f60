import zlib

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm.packing import END_ID, Piece, Windows, pack, split, word_encoder
from newsloom.llm.texts import blocks

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FILE = str(public.path("word_bpe_49k.json"))
ODD = [
    "it's THE dog's 'll <|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "", "  ", "naïve café’s “x” … 12345 a1b2",
    "\x01 x \x01y", "日本語 テスト,abc..!!''", "É×Ã÷ À-b", "a b́ c\x1cd \x85", "x" * 5000, "ß,ẞ Σας ΣΑΣ", "é̂e",
]


def reference(texts):
    made = tokenizers.Tokenizer.from_file(FILE)
    return [e.ids for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_by_word_ids_equal_the_tokenizers():
    found = []
    encode = word_encoder(FILE)
    for _, data, offsets in blocks(pa.array(ODD), 40):
        ids, edges = encode(data, offsets)
        found += [ids[a:z].tolist() for a, z in zip(edges[:-1], edges[1:], strict=True)]
    assert found == reference(ODD)


def check(rows, docs):
    """Every id of every document in one piece, sequences gapless and at most a window long."""
    ids = {key: np.array([*x, END_ID], np.uint32) for key, x in zip(docs, reference(docs.values()), strict=True)}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.ids_crc32 == zlib.crc32(own.astype("<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, own in ids.items():
        assert sum(n for _, n in pieces[key]) == len(own) and len(set(pieces[key])) == len(pieces[key])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(map(len, ids.values()))


def test_packing_loses_nothing_and_pads_little(spark):
    random = np.random.default_rng(1)
    docs = {i: " ".join(random.choice(["the", "of", "Zürich", "x1,"], int(n))) for i, n in enumerate(random.geometric(0.004, 300))}
    docs |= {1000: None, 1001: "", 1002: "word " * 30_000, None: "no id"} | {2000 + i: t for i, t in enumerate(ODD)}
    table = spark.createDataFrame(
        [(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, sequence_id string, start int"
    ).repartition(5)
    sequences, tokens = check(pack(table, FILE).collect(), docs)
    assert sequences * 2048 - tokens < 0.03 * tokens + 2048


def test_many_partitions_merge_in_rounds(spark):
    docs = {i: "a b c " * (i % 40) for i in range(200)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(23)
    sequences, tokens = check(pack(table, FILE, fan=3).collect(), docs)
    assert sequences * 2048 - tokens < 0.03 * tokens + 2048


def test_empty_table_and_other_keys(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    row = pack(spark.createDataFrame([("k", None)], "doc_id string, text string"), FILE).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in row] == [("k", 0, 1, 1, 0)]
    same = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert pack(same, FILE).count() == 2
    with pytest.raises(TypeError):
        pack(spark.createDataFrame([(1.5, "a")], "doc_id double, text string"), FILE)


def test_windows_take_the_best_fit_and_give_up_the_fullest():
    def piece(n):
        return [Piece(n, 0, n, bytes(4 * n))]

    held = Windows(10, 2, 3)
    assert list(held.put(piece(7))) == [] and list(held.put(piece(6))) == []
    assert list(held.put(piece(2))) == []  # beside the 7, which leaves less room
    assert [[p.length for p in w] for w in held.rest()] == [[7, 2], [6]]
    # None fits and the gap of 1 is not worth a cut: the fullest goes as it is.
    assert [[p.length for p in w] for w in held.put(piece(5))] == [[7, 2]]
    # A gap of 4 is.
    assert [[p.length for p in w] for w in held.put(piece(8))] == [[6, 4]]
    head, rest = split(piece(4) + piece(3), 5)
    assert [p.length for p in head] == [4, 1] and [(p.start, p.length) for p in rest] == [(1, 2)]
