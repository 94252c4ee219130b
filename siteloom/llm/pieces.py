"""SentencePiece models on the tokenizers library: parse, rebuild, encode, decode, verify.

The model protobuf is read field by field; its normaliser settings become the library's normaliser and
its pieces the library's model: unigram scores for a unigram model, merges ranked by score for a BPE
model, with byte fallback either way; user-defined pieces win over all others. Whole texts go through the library in multithreaded batches of bounded size, and through
SentencePiece itself; the ids of a text agree or don't. Decoding is the library's.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SPACE = "▁"
#: Characters that go through the library at a time; a longer text goes alone.
BATCH = 1 << 20
#: Characters from which on a text is encoded in stretches between words, where the model has no piece across words.
LONG = 1 << 22
# Fixed values of the public model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, or bytes for all other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"field kind {kind} is not in the model format")
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True


def parse(data: bytes) -> Model:
    """A serialised SentencePiece ModelProto."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            out.charsmap = own.get(2, b"")
            out.dummy_prefix, out.strip_spaces, out.escape_spaces = (bool(own.get(n, 1)) for n in (3, 4, 5))
    if out.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    return out


def rebuild(model: Model):
    """(tokenizer without normaliser, normaliser) of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # a user-defined piece has no score of its own: the public rule gives it one that no other way of reading it reaches
        top = max((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        core = models.Unigram([(p, len(p) * top - 0.1 if kind == USER else s) for p, s, kind in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
        merges = []
        for p, score, kind in model.pieces:
            if kind == NORMAL:
                merges += [(-score, vocab[p], (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        core = models.BPE(vocab, [m for *_, m in sorted(merges, key=lambda m: m[:2])], unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    marker = SPACE if model.escape_spaces else " "
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(marker))
    tokenizer = Tokenizer(core)
    if model.kind == BPE:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(marker, " ")] + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer, normalizers.Sequence(steps)


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, data: bytes, threads: int = 1):
        import sentencepiece

        self.model, self.threads = parse(data), threads
        self.tokenizer, self.normaliser = rebuild(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        # what the normaliser does by plain replacement, it needn't be called for
        self.simple = not self.model.charsmap and not self.model.strip_spaces and self.model.escape_spaces
        inner = any(SPACE in p.lstrip(SPACE) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
        self.cuttable = self.simple and self.model.dummy_prefix and not inner

    def normal(self, text: str) -> str:
        if self.simple:
            return (SPACE if text and self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.normaliser.normalize_str(text)

    def _stretches(self, text: str) -> list[str]:
        """The text, or its parts that each begin with a space, of about BATCH characters: no piece goes from one to the next."""
        if not self.cuttable or len(text) < LONG or SPACE in text:
            return [text]
        out, start, end = [], 0, len(text.rstrip(" "))
        while 0 < (cut := text.find(" ", start + BATCH)) < end:  # spaces at the end stay with what is before them
            while text[cut - 1] == " " and cut > start:  # a run of spaces may be one piece
                cut -= 1
            if cut > start:
                out.append(text[start:cut])
                start = cut
            else:
                break
        return [*out, text[start:]]

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """ids of each text, and whether SentencePiece gives the same."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(list(map(self.normal, texts)), add_special_tokens=False)]
        return got, [a == b for a, b in zip(got, self.peer.encode(texts, num_threads=self.threads))]

    def _long(self, text: str) -> tuple[list[int], bool]:
        """The same for a long text; a stretch after the first begins with the space that the prefix stands for."""
        ids, same = [], True
        for i, part in enumerate(self._stretches(text)):
            (own,), (agrees,) = self._whole([part[1:] if i else part])
            ids, same = ids + own, same and agrees
        return ids, same

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """ids of each text; whether SentencePiece's of the same text are equal."""
        ids: list[list[int]] = []
        same: list[bool] = []
        held: list[str] = []
        size = 0

        def put() -> None:
            nonlocal held, size
            if held:
                own, agree = self._whole(held)
                ids.extend(own), same.extend(agree)
            held, size = [], 0

        for text in texts:
            if len(text) >= LONG:
                put()
                own, agrees = self._long(text)
                ids.append(own), same.append(agrees)
                continue
            if size + len(text) > BATCH:
                put()
            held.append(text)
            size += len(text)
        put()
        return ids, same

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_codecs: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    """The model's codec in this worker, with as many threads as its task has processors."""
    key = zlib.crc32(data)
    if key not in _codecs:
        task = TaskContext.get()
        threads = task.cpus() if task else 1
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # more than that would wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        _codecs[key] = Codec(data, threads)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip and, if asked for, ids.

    Whole texts (null: empty, no ids). parity: SentencePiece gives the same ids for the same text.
    round_trip: the library decodes the ids to the text (null counts as empty). Rows are independent,
    so repeated rows give equal rows and null ids stay null; an empty table gives an empty table; other
    columns are not looked at. The model file is read on the driver and broadcast; its size is fixed.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            times = Counter(batch.column(1).to_pylist())
            known: dict[str, tuple] = {}  # of texts that this batch holds more than once
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                new = [t for t in dict.fromkeys(texts) if t not in known]
                ids, same = codec.encode_batch(new)
                back = [t == u for i in range(0, len(ids), 50) for t, u in zip(codec.decode_batch(ids[i : i + 50]), new[i : i + 50])]
                own = {t: (array("I", x), a, b) for t, x, a, b in zip(new, ids, same, back)}
                known |= {t: x for t, x in own.items() if times[t] > 1}
                rows = [own.get(t) or known[t] for t in texts]
                columns = [part.column(0), pa.array([len(x) for x, *_ in rows], pa.int64()), pa.array([zlib.crc32(x) for x, *_ in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.bool_()) for i in (1, 2))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x, *_ in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids)
