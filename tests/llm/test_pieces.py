import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece

from apexframe.llm import pieces
from apexframe.llm.queries import op2_piece_encoding, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "▁x ▁▁y", "a  b   c", " \n x\n\n", "<s></s><unk> <0x41>", "ﬁÅé 日本語 🎉\x00\x1c", "x" * 300, "ab" * 200 + " " * 70 + "z", "​foo﻿bar", "\U0010ffff"]


def test_encode_and_decode_equal_the_library(texts):
    model, library = pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    model.memo.limit = 2000
    own = ODD + list(texts.values())
    for k in range(0, len(own), 40):
        part = own[k : k + 40]
        ids, places, agrees = model.encode(pa.array(part))
        assert agrees.all()
        decoded = model.decode(ids, places).to_pylist()
        for n, text in enumerate(part):
            expected = library.encode(text)
            assert ids[places[n] : places[n + 1]].tolist() == expected, text[:40]
            assert decoded[n] == library.decode(expected)


def test_decode_of_any_ids_equals_the_library():
    model, library = pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = np.random.default_rng(0)
    for _ in range(300):
        ids = rng.choice([0, 1, 2, 3, 5, 13, 131, 164, 200, 240, 259, 260, 300, 29871, 29900, 31999], rng.integers(0, 9)).tolist()
        assert model.decode(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist() == [library.decode(ids)], ids


def test_heap_and_side_by_side_agree():
    model = pieces.PieceModel(PATH)
    for text in ("▁international", "▁aaaaaaa", "▁hello", "▁" * 9, "▁zzxxyy"):
        symbols = model.of_char[[ord(c) for c in text]]
        assert model.agenda(symbols.tolist()) == model._side_by_side(symbols, np.array([len(symbols)])).tolist()


def test_query(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = op2_piece_encoding(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edges(edges, nothing):
    rows = pieces.encode_decode(edges, PATH).collect()
    assert len(rows) == edges.count() and all(r.agrees for r in rows)
    assert {tuple(r.ids) for r in rows if r.doc_id in (2, 3)} == {(2,)}
    assert {r.decoded for r in rows if r.doc_id in (2, 3)} == {""}
    assert pieces.encode_decode(nothing, PATH).count() == 0
