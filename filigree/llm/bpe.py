"""Byte-level BPE through a sentencepiece model made directly from a vocabulary of ranks.

Nothing is trained. Each vocabulary entry becomes a piece whose bytes are mapped to the characters
U+0100 to U+01FF, with the negative rank as its score, under identity normalisation. Merging the
pair of highest score, leftmost first, is then merging the pair of lowest rank. Texts are cut into
pre-tokens, each is encoded alone (one that is itself an entry takes its id at once), and decoding
maps the pieces of the ids back to bytes.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and
null ids of documents each give a row; other columns of the input are not read. Long texts are
split in parts, so only a part's pre-tokens are held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from filigree.llm.pretokens import IdCache, Splitter, split_patterns
from filigree.llm.text import arrow_map, id_and_text, strings

BYTE_BASE = 0x100
# Fixed values of the model file format: field numbers, wire types, the kind of a model and of a piece.
VARINT, LENGTH, FLOAT = 0, 2, 5
MODEL_BPE, PIECE_UNKNOWN = 2, 2


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def _field(number: int, wire: int, value: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(value)) if wire == LENGTH else b"") + value


def byte_map(data: bytes) -> str:
    """Every byte as one character that no normalisation and no white-space rule touches."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + BYTE_BASE).tobytes().decode("utf-16-le")


def byte_unmap(piece: str) -> bytes:
    return (np.frombuffer(piece.encode("utf-16-le"), "<u2") - BYTE_BASE).astype(np.uint8).tobytes()


def piece_model(tokens: Iterable[bytes], ranks: Iterable[int]) -> bytes:
    """Serialised sentencepiece BPE model of the tokens in their order, with one unknown piece at the end."""
    out, count = [], 0
    for token, rank in zip(tokens, ranks):
        piece = _field(1, LENGTH, byte_map(token).encode()) + _field(2, FLOAT, struct.pack("<f", -float(rank)))
        out.append(_field(1, LENGTH, piece))
        count += 1
    unknown = _field(1, LENGTH, b"<unk>") + _field(2, FLOAT, struct.pack("<f", 0.0))
    out.append(_field(1, LENGTH, unknown + _field(3, VARINT, _varint(PIECE_UNKNOWN))))
    absent = _varint((1 << 64) - 1)
    trainer = _field(3, VARINT, _varint(MODEL_BPE)) + _field(4, VARINT, _varint(count + 1))
    trainer += _field(40, VARINT, _varint(count)) + b"".join(_field(n, VARINT, absent) for n in (41, 42, 43))
    no = _varint(0)
    normalizer = _field(1, LENGTH, b"identity") + b"".join(_field(n, VARINT, no) for n in (3, 4, 5))
    return b"".join(out) + _field(2, LENGTH, trainer) + _field(3, LENGTH, normalizer)


def class_members(name: str) -> set[int]:
    """Code points that the tiktoken library's pattern engine puts in a class."""
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([byte]): byte for byte in range(256)}
    matcher = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
    return set(map(ord, matcher.decode_bytes(matcher.encode_ordinary(everything)).decode()))


def vocabulary(path: str, pattern: str) -> dict:
    """All a worker needs: the model, ranks in piece order and the split patterns. About 2 MB."""
    ranks = sorted(load_ranks(path).items(), key=lambda item: item[1])
    if missing := set(range(256)) - {token[0] for token, _ in ranks if len(token) == 1}:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    model = piece_model((token for token, _ in ranks), (rank for _, rank in ranks))
    narrow, wide = split_patterns(pattern, class_members)
    return {
        "key": hashlib.sha256(model + pattern.encode()).hexdigest(), "model": model,
        "ids": np.array([rank for _, rank in ranks], np.uint32), "narrow": narrow, "wide": wide,
    }


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: dict):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary["model"])
        self.rank_of = vocabulary["ids"]
        tokens = [byte_unmap(self.pieces.id_to_piece(i)) for i in range(len(self.rank_of))]
        self.whole = {token: rank.tobytes() for token, rank in zip(tokens, self.rank_of)}
        self.bytes_of = dict(zip(self.rank_of.tolist(), tokens))
        self.splitter = Splitter(vocabulary["narrow"], vocabulary["wide"])
        self.cache = IdCache(self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        data = [word.encode() for word in words]
        out = [self.whole.get(word) for word in data]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            encoded = self.pieces.encode([byte_map(data[i]) for i in rest], out_type=int, num_threads=1)
            for i, ids in zip(rest, encoded):
                out[i] = self.rank_of[ids].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.cache.ids(part) for part in self.splitter.parts(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(vocabulary: dict) -> Codec:
    if vocabulary["key"] not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary["key"]] = Codec(vocabulary)
    return _CODECS[vocabulary["key"]]


def _shared(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, packed)]) // 4
    values = np.frombuffer(b"".join(packed), "<i4")
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int32()))


def packed_ids(lists: pa.Array) -> list[bytes]:
    return [np.array(ids or [], "<u4").tobytes() for ids in lists.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = _shared(docs, path, pattern)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared.value)
        return [batch.column("id"), id_lists([codec.encode(text) for text in strings(batch.column("text"))])]

    return arrow_map(id_and_text(docs, id_col, text_col), f"id {kind}, ids array<int>", columns, ["id", "ids"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """id and text of rows (id, ids); null ids give the empty text."""
    kind = encoded.schema["id"].dataType.simpleString()
    shared = _shared(encoded, path, pattern)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared.value)
        texts = [codec.decode(ids).decode("utf-8", "replace") for ids in packed_ids(batch.column("ids"))]
        return [batch.column("id"), pa.array(texts, pa.string())]

    return arrow_map(encoded.select("id", "ids"), f"id {kind}, text string", columns, ["id", "text"])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the packed ids and of the bytes decoded from them, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = _shared(docs, path, pattern)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(shared.value)
        rows = []
        for text in strings(batch.column("text")):
            ids = codec.encode(text)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        counts, ids_digests, text_digests = zip(*rows)
        return [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)]

    return arrow_map(
        id_and_text(docs, id_col, text_col),
        f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )
