import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grovespark.llm import binary_records as B
from grovespark.llm import packing
from grovespark.llm.tokens import PieceEncoder
from tests.conftest import rows
from tests.llm.fixtures import docs, odd_rows

FILES = {"word_bpe_49k.json": "space", "byte_bpe_50k.json": "lead"}
LOADED = {f: (Tokenizer.from_file(public_tokenizers.path(f)), PieceEncoder(public_tokenizers.path(f), s)) for f, s in FILES.items()}
ODD = ["", " ", "a b", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\ta", "don't 's x's,", "a,b. c., d ,e", "Word, WORD word.", "é́ ﬁ İ Σ ΑΣ", "x\x1cy\x85z w", "<|endoftext|>", "hi<|endoftext|> a, <|startoftext|>b", "12345 6 7a_b!?", "\x00", "🙂🙂 a🙂,"]


@pytest.mark.parametrize("file", FILES)
def test_pieces_agree_with_the_library(file):
    library, coder = LOADED[file]
    for kept in (coder.KEPT, 3):  # a memo that is always emptied
        coder.KEPT = kept
        for t in ODD:
            assert np.frombuffer(coder.encode([t])[0], coder.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, t
    del coder.KEPT


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abAB ,.\n\t'é́Σ<|>1🙂 \x1c")), max_size=40), max_size=4))
def test_random_texts_agree_with_the_library(texts):
    for library, coder in LOADED.values():
        got = [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_frames(tmp_path):
    import io

    data = B.frame(b"abc") + B.frame(b"") + B.frame(b"x" * 1000)
    assert list(B.frames(io.BytesIO(data))) == [b"abc", b"", b"x" * 1000]
    for bad in (data[:-1], b"\x04" + data[1:], data[:13] + b"!" + data[14:]):
        with pytest.raises(ValueError):
            list(B.frames(io.BytesIO(bad)))


def test_records(spark, tmp_path):
    library, _ = LOADED["word_bpe_49k.json"]
    got = B.record_digests(docs(spark), public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    want = sorted(odd_rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, t) in zip(got, want, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = f"file://{tmp_path}/r"
    shards = B.write_records(docs(spark), folder, public_tokenizers.path("word_bpe_49k.json"), "space", shards=3)
    assert sum(r["n_docs"] for r in shards.collect()) == len(want)
    for shard in shards.collect():
        for r in B.read_records(shards.where(f"shard = {shard['shard']}")).collect():
            doc_id, ids = B.read_one(folder, r["shard"], r["ordinal"])
            assert doc_id == r["doc_id"] and ids.tobytes() == bytes(r["ids"])
    assert B.record_digests(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_binary_lengths():
    for n in list(range(1, 5000, 7)) + [2048, 4096, 123457]:
        cut = packing.binary_lengths(n)
        assert sum(cut) == n and all(c & (c - 1) == 0 and c <= 2048 for c in cut) and cut == sorted(cut, reverse=True)
        assert len({c for c in cut if c < 2048}) == len([c for c in cut if c < 2048])


def test_packing(spark):
    library, _ = LOADED["byte_bpe_50k.json"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(docs(spark), path)
    got = packing.piece_digests(packed).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and all(r["offset"] == 0 for r in got)
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True), "equal lengths share a bucket"
    pieces = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = []
    for i, t in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for n in packing.binary_lengths(len(ids)):
            want.append((-1 if i is None else i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert pieces == sorted(want)
    assert rows(packing.piece_digests(packing.pack(docs(spark, []), path))) == []
