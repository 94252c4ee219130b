import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siteloom.llm import token_file as t

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello world's  end\n\tit'S", "", " ", None, "a" * 3000, "x y z <|endoftext|>q", "é ́x İ ΣΣ 1234 !!??", "Hello world's  end\n\tit'S", "\r\n a\x1cb\x0bc", "it's IT'LL d'd ''s café's ÀÉ²¼½ª_ß\xad\xa0x\x85y ŒŸ12a3***$$$ naïve\u0301"] + ["word %d" % i for i in range(40)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_round_trip(values):
    assert t.unpack(t.pack(np.array(values, dtype=np.uint64))).tolist() == values


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, t.BLOCK_IDS - 1, t.BLOCK_IDS, 2 * t.BLOCK_IDS + 7])
def test_block_edges(n):
    values = np.random.default_rng(n).integers(0, 49_408, n).astype(np.uint64)
    values[::1000] = 2**60 + 5
    assert (t.unpack(t.pack(values)) == values).all()


def test_chunks_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    got = [t.text_encoder(PATH)(x or "") for x in TEXTS]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_table(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rows = [(i * 3, x, "clash") for i, x in enumerate(TEXTS)] + [(9, "again", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {(r.start, r.doc_id): r for r in t.token_table(docs, PATH).collect()}
    start = 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        r = got.pop((start, doc_id))
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_empty_table(spark):
    assert t.token_table(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer that keeps white space, or whose description differs otherwise, isn't cut at blanks."""
    import json

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        settings = json.load(f)
    assert t.cut_at_blanks(settings)
    texts = ["Hello  the World's 42 times", "x\ny z", ""]
    for i, change in enumerate(({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}})):
        path = str(tmp_path / f"{i}.json")
        with open(path, "w") as f:
            json.dump(settings | change, f)
        assert not t.cut_at_blanks(settings | change)
        whole = Tokenizer.from_file(path)
        for text in texts:
            assert t.text_encoder(path)(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
