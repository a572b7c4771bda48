import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from apexframe.llm import packing
from apexframe.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}


def check(rows, ids, times=1):
    assert len(rows) == sum(-(-len(x) // 2048) for x in ids.values()) * times
    bins = defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 2048 and r.length == len(own) and (r.length == 2048 or r.start + r.length == len(ids[r.doc_id]))
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(map(len, ids.values())) * times


def test_word_ids_equal_whole_texts():
    odd = ["", " ", "<|endoftext|> x<|startoftext|>y", "A\tb\x1cc d", "ΑΣ Σ ς éx İI ﬁ", "it's we're 123 4½ ...!?", "a'S 'LL, b.. c.,", "日本語 🎉🎉", "\r\n\x0b x y", "Ångström,"]
    words = packing.WordIds(PATH)
    words.memo.limit = 3  # also with words forgotten between chunks
    for part in (odd, odd[::-1], odd * 2):
        ids, places = words.ids(pa.array(part))
        expected = reference(dict(enumerate(part)))
        for k in range(len(part)):
            assert ids[places[k] : places[k + 1]].tolist() == expected[k][:-1], part[k]


def test_every_letter_before_marks():
    """All code points that are letters, alone and in a word, before a full stop and a comma."""
    tokenizer = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x80, 0x20000) if chr(c).isalpha() and not 0x4E00 <= c <= 0x9FFF and not 0xAC00 <= c <= 0xD7A3]
    words = [w for x in letters for w in (f"{x}.", f"a{x},")]
    ids, places = packing.WordIds(PATH).ids(pa.array(words))
    want = tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for k, w in enumerate(words) if ids[places[k] : places[k + 1]].tolist() != want[k].ids] == []


def test_pack(documents, texts):
    bins, tokens = check(packing.pack(documents.repartition(6), PATH).collect(), reference(texts))
    assert bins <= 1.03 * tokens / 2048 + 1


def test_tree_with_tiny_tasks(documents, texts):
    rows = packing.pack(documents.repartition(8), PATH, task_items=20, fan_in=2).collect()
    check(rows, reference(texts))


def test_edges(edges, edge_rows, nothing):
    known = edges.filter("doc_id IS NOT NULL AND doc_id <> 9")
    check(packing.pack(known, PATH).collect(), reference({i: t for i, t in edge_rows if i not in (None, 9)}))
    every = packing.pack(edges, PATH).collect()
    assert sum(r.doc_id == 9 and r.piece == 0 for r in every) == 2
    assert packing.pack(nothing, PATH).count() == 0


@pytest.mark.parametrize("lengths, bins", [([], 0), ([5], 1), ([10, 10, 10], 3), ([6, 4, 5, 5], 2), ([9, 1, 8, 2, 7, 3], 3)])
def test_best_fit(lengths, bins):
    found = packing.best_fit(np.array(lengths, np.int64), 10)
    assert len(found) == bins and sorted(i for b in found for i in b) == list(range(len(lengths)))


def test_words_in_capitals_share_an_encoding(monkeypatch):
    words, asked = packing.WordIds(PATH), []
    whole = words._joined
    monkeypatch.setattr(words, "_joined", lambda own: asked.extend(own) or whole(own))
    texts = ["École école. ÉCOLE, Été été", "ΑΣ, ΑΣΑ Σ. ǅ ǆ Ǆ, İ. ß ẞ"]
    ids, places = words.ids(pa.array(texts))
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [ids[places[k] : places[k + 1]].tolist() for k in range(2)] == [x.ids for x in want]
    assert asked.count("école") == asked.count("été") == 1 and "École" not in asked
    assert words.ends.any()  # the words' ends are told by their ids
