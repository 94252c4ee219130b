import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siteloom.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "Hello world", " lead  and   trail ", "line\nbreak\ttab", "naïve Σ 漢字 🙂 é́", "▁marker▁ already", "<s> </s> <unk>", "a" * 2000, "x y z " * 300, "   ", "\u0000​", "eatha$$$ thin%%% 'quoted' 12345"]


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return p.Codec(f.read())


def test_whole_texts_equal_sentencepiece(codec):
    peer = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, same = codec.encode_batch(TEXTS)
    for text, got, agreed in zip(TEXTS, ids, same):
        assert agreed and got == peer.encode(text), text
        if "▁" not in text:
            assert codec.decode_batch([got]) == [text]


def test_documents_equal_sentencepiece(codec):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    peer = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, same = codec.encode_batch(texts)
    assert all(same) and ids == peer.encode(texts)
    assert codec.decode_batch(ids) == texts


def test_long_texts_in_stretches(codec, monkeypatch):
    """Stretches between words give the ids of the whole; runs of spaces and texts without any are not cut."""
    monkeypatch.setattr(p, "LONG", 200)
    monkeypatch.setattr(p, "BATCH", 64)
    peer = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*TEXTS, "the quick brown fox  jumps   over " * 30, "x" * 500, " " * 300, "a " * 200 + " " * 90 + "b c " * 60, "mot éà 漢 " * 99, "▁ " * 150]
    ids, same = codec.encode_batch(texts)
    assert ids == [peer.encode(t) for t in texts] and all(same)
    assert max(len(codec._stretches(t)) for t in texts) > 5


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) if number < 16 else bytes([number << 3 & 127 | 2 | 128, number >> 4])
            size = len(value)
            while size > 127:
                out, size = out + bytes([size & 127 | 128]), size >> 7
            out += bytes([size]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += (bytes([number << 3]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4])) + bytes([value])
    return out


def test_unigram_model_with_byte_fallback():
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    listed += [("▁", -2.0, 1), ("▁the", -1.5, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("e", -3.0, 1), ("he", -3.5, 1), ("▁a", -2.5, 1), ("re", -3.2, 1), ("r", -4.5, 1)]
    data = b"".join(message((1, message((1, s.encode()), (2, f), (3, k)))) for s, f, k in listed)
    data += message((2, message((3, 1), (35, 1)))) + message((3, message((3, 1), (4, 0), (5, 1))))
    codec, peer = p.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the there", "a the  re", "xé the", "heret"]
    ids, same = codec.encode_batch(texts)
    assert all(same) and ids == peer.encode(texts)
    assert codec.decode_batch(ids) == texts


def written(extra, prefix=1, kind=2):
    """A small BPE or unigram model with the given pieces (text, score, type)."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((c, -10.0 - i, 1) for i, c in enumerate("▁abcx")), *extra]
    data = b"".join(message((1, message((1, s.encode()), (2, f), (3, k)))) for s, f, k in listed)
    return data + message((2, message((3, kind)))) + message((3, message((3, prefix), (4, 0), (5, 1))))


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("kind", [1, 2])
def test_user_defined_pieces_match_first(prefix, kind):
    data = written([("a▁b", 0.0, 4), ("cc", 0.0, 4), ("ab", -1.0, 1), ("▁a", -2.0, 1)], prefix, kind)
    codec, peer = p.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["a b", "ab a b ab", "ccc ab", "x a b", " a b", "a  b", "", "<s> ab"]
    ids, same = codec.encode_batch(texts)
    assert [i == j for i, j in zip(ids, peer.encode(texts))] == same
    assert all(same[:7]) and not codec.cuttable
    listed = [piece for piece, _, _ in codec.model.pieces]
    assert listed.index("a▁b") in ids[0] and listed.index("cc") in ids[2]


def test_parity_is_of_whole_texts():
    """Where the rebuilt model reads a text otherwise, the text says so."""
    codec = p.Codec(written([("ab", -1.0, 1), ("▁a", -2.0, 1)]))
    other = p.Codec(written([("▁a", -1.0, 1), ("ab", -2.0, 1)]))
    codec.peer = other.peer
    assert codec.encode_batch(["ab", "c", "x ab"])[1] == [False, True, False]


def test_query(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])] + [(None, "x", 2), (None, "x", 2)], "doc_id long, text string, ids int").repartition(3)
    peer = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = p.encode_documents(docs, PATH, with_ids=True).collect()
    texts = {i: t for i, t in enumerate([*TEXTS, ""])} | {None: "x"}
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        want = peer.encode(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.parity and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.round_trip == ("▁" not in texts[r.doc_id])
    assert p.encode_documents(docs.limit(0), PATH).collect() == []
