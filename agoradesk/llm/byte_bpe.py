"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings. The library works on characters, so every byte stands for one printable character; its merges are all
pairs of tokens that make another token, in the order of the ranks. A batch is cut into the matches of the split pattern, the library
encodes each distinct match once, and the ids are gathered for all of them. Decoding turns the characters back into bytes, so a
character whose bytes are split between tokens comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.pretokens import pretoken_starts
from agoradesk.llm.shared import id_and_text
from agoradesk.llm.words import distinct_spans, ramps, slices, text_bytes

#: Matches whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    names = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [names[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[k] for k in range(len(ranks))]


def tokenizer_json(tokens: list[bytes]) -> str:
    """A tokenizers model that encodes as the ranks say: a match that is a token stays whole, else the pair of lowest rank merges."""
    name = byte_characters()
    known = set(tokens)
    spelled = ["".join(name[b] for b in token) for token in tokens]
    merges = [
        [spelled[k][:cut], spelled[k][cut:]]
        for k, token in enumerate(tokens)
        for cut in range(1, len(token))
        if token[:cut] in known and token[cut:] in known
    ]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {s: k for k, s in enumerate(spelled)}, "merges": merges,
    }
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": level, "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model,
    })


class Codec:
    """Encoder and decoder of one rank file, built once per Python worker."""

    def __init__(self, tokens: list[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json(tokens))
        reverse = {c: b for b, c in enumerate(byte_characters())}
        spelled = [bytes(reverse[c] for c in self.library.id_to_token(k)) for k in range(len(tokens))]
        self.length = np.array([len(s) for s in spelled], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.first = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, matches: list[bytes]) -> None:
        """Encode these distinct matches with the library and remember their ids."""
        encoded = self.library.encode_batch_fast([m.decode() for m in matches], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        self.place.update(zip(matches, range(len(self.place), len(self.place) + len(matches)), strict=True))
        self.first = np.concatenate([self.first, np.cumsum(count) - count + len(self.ids)])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter((x for own in ids for x in own), np.uint32, int(count.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text begin, with one more entry)."""
        data, offsets = text_bytes(texts)
        start = pretoken_starts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        code, values = distinct_spans(data, start, np.append(start[1:], len(data)))
        matches = values.to_pylist()
        new = [m for m in matches if m not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            self._forget()
            new = matches
        if new:
            self._learn(new)
        at = np.array([self.place[m] for m in matches], dtype=np.int64)[code]
        count = self.count[at]
        ids = self.ids[np.repeat(self.first[at], count) + ramps(count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offsets)]

    def spans(self, texts: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character range of each id in its text; a part of a character's bytes has that whole character."""
        data, offsets = text_bytes(texts)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        size = self.length[ids]
        last = np.cumsum(size) - 1
        base = np.concatenate([character, [character[-1] + 1 if len(character) else 0]])[offsets[:-1]]
        of = base[np.searchsorted(offsets, last, side="right") - 1]
        return character[last - size + 1] - of, character[last] + 1 - of

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.length):
            raise ValueError("an id is not in the vocabulary")
        size = self.length[ids]
        return self.data[np.repeat(self.start[ids], size) + ramps(size)].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


def _columns(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the columns ids, starts, ends: token ids and the range of characters that each token touches.

    A null or empty text has empty arrays. Columns of these names are replaced.
    """
    path = path or vocabulary()
    rest = docs.drop("ids", "starts", "ends")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                ids, first = own.encode(part["text"])
                starts, ends = own.spans(part["text"], ids)
                offsets = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
                yield pa.record_batch([*(part[n] for n in names), *lists], names=[*names, "ids", "starts", "ends"])

    return rest.mapInArrow(run, _columns(rest) + "ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of ``ids`` as text; bytes that are no UTF-8 (ids cut in a character) become U+FFFD."""
    path = path or vocabulary()
    rest = encoded.drop("decoded")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.record_batch([*(batch[n] for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rest.mapInArrow(run, _columns(rest) + "decoded string")


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document: the ids as little-endian 32-bit integers, the bytes decoded from them."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                ids, first = own.encode(part["text"])
                each = [ids[i:k].astype("<u4") for i, k in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch({
                    "doc_id": part["doc_id"], "n_tokens": pa.array(np.diff(first), pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in each],
                    "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in each],
                })

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
