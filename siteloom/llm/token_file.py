"""Token ids of documents in Simple-8b blocks: encode, write, read back.

A 64-bit word holds a 4-bit selector (top bits) and as many ids as the selector's width lets in.
Selector 0 is the escape: the word's payload is the place of a value of over 60 bits in the block's
escape list. A payload holds blocks of BLOCK_IDS ids, each decodable alone through the offset table
in its header:

    magic "S8B1", u32 ids a block, u64 ids, u32 blocks | per block u64 first word, u64 first escape
    | u64 words | u64 escapes                                                     (little-endian)

Files are Parquet tables of such payloads (one row a segment of whole documents, with their ids and
lengths), written by Spark's commit protocol, so that a lost executor leaves no torn file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Scratch, parallelism

# Ids in a word and their width in bits, by selector from 1 to 14.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 65_536
SEGMENT_IDS = 1 << 20
HEADER = struct.Struct("<4sIQI")
COUNTS = np.array([1, *(c for c, _ in PACKS), 0], dtype=np.int64)
#: Distinct chunks and pieces a Python worker remembers at most.
CACHE_CHUNKS, CACHE_PIECES = 250_000, 600_000
FILE_SCHEMA = "shard int, segment int, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def _pack_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 values -> (words, escapes), taking the densest selector that fits at each place."""
    n = len(values)
    padded = np.concatenate((values, np.zeros(60, dtype=np.uint64)))
    small = padded.astype(np.uint32) if n and int(values.max()) < 1 << 32 else padded
    best = np.zeros(n, dtype=np.int8)
    for selector in range(14, 0, -1):
        count, bits = PACKS[selector - 1]
        fits = small < (1 << bits) if bits < 32 or small is padded else np.ones(n + 60, dtype=bool)
        size = 1
        while 2 * size <= count:
            fits = fits[:-size] & fits[size:]
            size *= 2
        if size < count:
            fits = fits[: len(fits) - (count - size)] & fits[count - size :]
        if not fits[:n].any():
            break
        np.copyto(best, selector, where=fits[:n])
    hop = COUNTS[best].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += hop[at]
    starts = np.array(starts, dtype=np.int64)
    chosen = best[starts]
    words = np.zeros(len(starts), dtype=np.uint64)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[rows] = np.arange(len(rows), dtype=np.uint64)
            continue
        count, bits = PACKS[selector - 1]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        packed = np.bitwise_or.reduce(padded[starts[rows][:, None] + np.arange(count)] << shifts, axis=1)
        words[rows] = packed | np.uint64(int(selector) << 60)
    return words, values[starts[chosen == 0]]


def pack(values: np.ndarray) -> bytes:
    """Any unsigned 64-bit values as one payload; no values give a payload without blocks."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    blocks = [_pack_block(values[i : i + BLOCK_IDS]) for i in range(0, len(values), BLOCK_IDS)]
    table, word, escape = [], 0, 0
    for words, escapes in blocks:
        table += [word, escape]
        word, escape = word + len(words), escape + len(escapes)
    return b"".join([HEADER.pack(b"S8B1", BLOCK_IDS, len(values), len(blocks)), np.array(table, dtype="<u8").tobytes(), *(w.astype("<u8").tobytes() for w, _ in blocks), *(e.astype("<u8").tobytes() for _, e in blocks)])


def unpack(payload: bytes) -> np.ndarray:
    """The values of a payload, one scatter for each selector and block."""
    magic, block_ids, n, n_blocks = HEADER.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    table = np.frombuffer(payload, "<u8", 2 * n_blocks, HEADER.size).astype(np.int64).reshape(-1, 2)
    rest = np.frombuffer(payload, "<u8", -1, HEADER.size + 16 * n_blocks)
    parts = []
    n_escapes = 0
    for b in range(n_blocks):
        # words end where the next block's start; the last block's end is found from the count of ids
        size = min(block_ids, n - b * block_ids)
        words = rest[table[b, 0] : table[b + 1, 0]] if b + 1 < n_blocks else rest[table[b, 0] :]
        selectors = (words >> np.uint64(60)).astype(np.int64)
        ends = np.cumsum(COUNTS[selectors])
        if b + 1 == n_blocks:
            used = int(np.searchsorted(ends, size)) + 1
            words, selectors, ends = words[:used], selectors[:used], ends[:used]
            n_escapes = table[b, 0] + used
        parts.append((size, words, selectors, ends - COUNTS[selectors]))
    escapes = rest[n_escapes:]
    out = []
    for b, (size, words, selectors, starts) in enumerate(parts):
        values = np.zeros(size + 60, dtype=np.uint64)
        for selector in np.unique(selectors):
            rows = np.flatnonzero(selectors == selector)
            if selector == 0:
                values[starts[rows]] = escapes[table[b, 1] + (words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
                continue
            count, bits = PACKS[selector - 1]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values[starts[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
        out.append(values[:size])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


#: Texts of printable Latin characters and plain blanks: unchanged by NFC, lower-cased character by character.
_PLAIN = re.compile("[ \\n!-~\u00a1-\u024f]*")
_MARKS = frozenset(".,;:!?")
_encoders: dict[str, Callable[[str], bytes]] = {}


class _Pieces(dict):
    """Pre-token -> its ids by the library's model, remembered."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        # Fixed rule: the byte-level alphabet keeps printable bytes and moves the others, in order, to U+0100 on.
        text = piece if piece.isascii() else "".join([_BYTE_CHARS[c] for c in piece.encode()])
        out = self[piece] = array("I", [t.id for t in self.tokenize(text)]).tobytes()
        return out


class _Chunks(dict):
    """Lower-cased plain chunk between blanks -> its ids, remembered."""

    def __init__(self, tokenizer, pattern: str):
        import regex

        self.pieces = _Pieces(tokenizer.model)
        self.split = regex.compile(pattern).findall

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE_CHUNKS:
            self.clear()
        if chunk.isalpha():
            out = self.pieces[chunk]
        elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            out = self.pieces[chunk[:-1]] + self.pieces[chunk[-1]]
        else:
            out = b"".join([self.pieces[p] for p in self.split(chunk)])
        self[chunk] = out
        return out


def _byte_chars() -> list[str]:
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (chr(256 + i) for i in range(256))
    return [chr(b) if b in kept else next(moved) for b in range(256)]


_BYTE_CHARS = _byte_chars()


# Fixed value: the pre-tokenizer's pattern for which texts can be cut at blanks beforehand.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cut_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer's description says that it lower-cases, drops white space and joins nothing across it."""
    kinds = lambda step, key: [s["type"] for s in (step or {}).get(key, [])]
    normal, words, model = settings.get("normalizer"), settings.get("pre_tokenizer"), settings.get("model") or {}
    if kinds(normal, "normalizers") != ["NFC", "Replace", "Lowercase"] or kinds(words, "pretokenizers") != ["Split", "ByteLevel"]:
        return False
    replace, (split, bytes_) = normal["normalizers"][1], words["pretokenizers"]
    return (
        (replace["pattern"], replace["content"]) == ({"Regex": r"\s+"}, " ")
        and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": _WORDS}, "Removed", True)
        and not bytes_["add_prefix_space"] and not bytes_["use_regex"]
        and model.get("type") == "BPE" and not model.get("dropout") and not settings.get("truncation") and not settings.get("padding") and not settings.get("post_processor")
        and all(t["content"].startswith("<|") and not t["normalized"] for t in settings.get("added_tokens", []))
    )


def text_encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian uint32 bytes, equal to the library's on the whole text.

    Where the tokenizer's own description allows it (cut_at_blanks), plain Latin texts are lower-cased and
    cut here, at blanks and by the pre-tokenizer's own pattern, and each distinct piece goes to the
    library's model once and is remembered. Other texts, and all texts of other tokenizers, go to the
    library whole.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        cut = cut_at_blanks(json.loads(tokenizer.to_str()))
        get = _Chunks(tokenizer, _WORDS).__getitem__ if cut else None

        def encode(text: str) -> bytes:
            if cut and _PLAIN.fullmatch(text) and "<|" not in text:
                return b"".join(map(get, text.lower().replace("\n", " ").split(" ")))
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        _encoders[path] = encode
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shards: int | None = None) -> None:
    """Encodes whole texts (null: empty), adds end_id to each and writes segments in ascending (doc_id, text).

    Null doc_ids come first; repeated doc_ids stay apart, in the order of their texts. An empty table
    writes an empty table. Documents are dealt by ranges of doc_id, one shard a task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, segment, first, held, ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, size
            values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.uint64)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([held.copy()], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())), pa.array([pack(values)], pa.binary())], names=["shard", "segment", "first_id", "n_ids", "doc_ids", "doc_tokens", "payload"])
            segment, first, size = segment + 1, first + len(values), 0
            held.clear(), ids.clear()
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(key)
                ids.append(encode(text or "") + end)
                size += len(ids[-1])
                if size > 4 * SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    n = shards or parallelism(docs.sparkSession)
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, FILE_SCHEMA).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start (ids of all before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                own = [ids[a:b] for a, b in zip(starts, ends)]
                columns = [pa.array([row["shard"]] * len(own), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).selectExpr("shard", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as before")
    rows = files.mapInArrow(read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # one row a shard: as many as the writer had tasks
    return rows.join(F.broadcast(sizes), "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the documents' token files in the shared folder and reads them back."""
    path = Scratch(docs.sparkSession, "tokens").path("files")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(docs.sparkSession, path)
