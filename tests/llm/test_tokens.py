import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.common import ODD, SCHEMA, empty, odd, some_docs
from tidemark.llm import idfiles, packing
from tidemark.llm.tokens import encoder, text_groups, vocabulary

WORD, BYTE = ("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)


@pytest.mark.parametrize("name,drops", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.,!?'s|<>\n\t\x1c\x00 0é́Σİ字　\xa0", max_size=40), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(name, drops, texts):
    tool = encoder(vocabulary(name), drops)
    assert tool.encode(texts) == tool.whole(texts)


@pytest.mark.parametrize("name,drops", [WORD, BYTE])
def test_prose(duck, name, drops):
    texts = [t for _, t in some_docs(duck, 200)]
    tool = encoder(vocabulary(name), drops)
    assert tool.encode(texts) == tool.whole(texts)


@pytest.mark.parametrize("name,drops,end", [(*WORD, 49407), (*BYTE, 50256)])
def test_added_tokens_as_the_library_gives_them(name, drops, end):
    texts = ["a<|endoftext|>b", "one, two <|endoftext|> three.", "<|ENDOFTEXT|> x", "<|startoftext|>", "\u03a3<|EndOfText|>", "<|endoftext|", "plain words, none", ""]
    plain = Tokenizer.from_file(vocabulary(name))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(vocabulary(name), drops).encode(texts)]
    assert got == want and got[0].count(end) == got[1].count(end) == 1 and end not in got[2]


def test_groups_keep_order():
    texts = ["a" * n for n in (5, 0, 9, 3, 12, 1)] + [None]
    got = [(at + i, t) for at, g in text_groups(texts, 10) for i, t in enumerate(g)]
    assert got == [(i, t or "") for i, t in enumerate(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    ef = idfiles.EliasFano.encode(values)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    bits = 8 * (len(ef.low) + len(ef.high))
    assert bits <= len(values) * (3 + max(0, np.log2(values[-1] / len(values) + 1))) + 32


def _crc(tool, text, end):
    raw = tool.whole([text or ""])[0] + np.array([end], "<u4").tobytes()
    return zlib.crc32(raw), len(raw) // 4


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_id_files(spark, tmp_path, segment):
    idfiles.write_ids(odd(spark), str(tmp_path / f"ids-{segment}"), vocabulary(BYTE[0]), 0, segment_ids=segment)
    rows = idfiles.read_ids(spark, str(tmp_path / f"ids-{segment}"), keep_ids=True).collect()
    tool = encoder(vocabulary(BYTE[0]), False)
    assert sorted((r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in rows) == sorted((i or 0, *_crc(tool, t, 0)) for i, t in ODD)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]).tolist()
    named = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert named == sorted(named)


def test_id_files_of_nothing(spark, tmp_path):
    idfiles.write_ids(empty(spark), str(tmp_path / "none"), vocabulary(BYTE[0]), 0)
    assert idfiles.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size,windows", [(2048, 32), (64, 2)])
def test_packing(spark, duck, size, windows):
    rows = ODD + [(100 + i, t) for i, t in some_docs(duck)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.pack(docs, vocabulary(WORD[0]), 1, size=size, windows=windows, gap=4).collect()
    tool = encoder(vocabulary(WORD[0]), True)
    windows_of = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        windows_of[r["sequence_id"]].append(r)
    for pieces in windows_of.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces[:-1]]]).tolist()
        assert sum(p["length"] for p in pieces) <= size
    total = sum(r["length"] for r in got)
    assert total == sum(len(tool.whole([t or ""])[0]) // 4 + 1 for _, t in rows)
    ends = 4 + 4 * len(windows_of)  # a window misses at most four ids, the last of each merging task more
    assert len(windows_of) * size - total <= ends + size * int(spark.conf.get("spark.sql.shuffle.partitions"))
    per = defaultdict(list)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            per[r["doc_id"]].append(r)
    for i, text in rows:
        if i is None or i == 5:
            continue
        pieces = sorted(per[i], key=lambda r: r["start"])
        whole = tool.whole([text or ""])[0] + np.array([1], "<u4").tobytes()
        assert b"".join(bytes(p["ids"]) for p in pieces) == whole
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces[:-1]]]).tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(whole) // 4}


def test_packing_nothing(spark):
    assert packing.pack(empty(spark), vocabulary(WORD[0]), 1).count() == 0
