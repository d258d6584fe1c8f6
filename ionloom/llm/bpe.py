"""Byte-level BPE encoding and decoding with batched merge rounds.

The symbols of many words lie in one flat array. Each round finds, by binary search over the
sorted pair keys, the rank of every new neighbour pair, picks the lowest rank of each word and
merges all its occurrences in all words at once. Words are looked up in a bounded cache first,
so a partition encodes each frequent word once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ionloom.llm.common import text_slices

# Fixed values of the vocabulary's format: how texts are cut into words before merging. The
# second form says the same for texts below U+0100, where the standard engine can be used.
# The forms of a word begin differently, but for those with an apostrophe, so the most frequent
# can be tried first.
_WORDS = regex.compile(
    r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(
    rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_NONE = np.int64(1 << 40)
# Cached words and their total length; the cache starts anew beyond either.
_CACHED, _CACHED_CHARS = 1 << 18, 1 << 23
_PIECES = 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files of this format."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary(NamedTuple):
    """Arrays of a byte-level BPE file; small and of fixed size, so it may be broadcast."""

    start: np.ndarray  # id of each single byte
    pairs: np.ndarray  # sorted keys (left id << 32 | right id)
    ranks: np.ndarray  # rank of each pair
    merged: np.ndarray  # id that a rank makes
    tokens: list[bytes]  # bytes of each id
    special: dict[str, int]  # added tokens, matched before everything else


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, chars = spec["model"], byte_characters()
    if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("not a plain byte-level BPE file")
    if spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("files that add a space before the text are not supported")
    ids, back = model["vocab"], {c: b for b, c in enumerate(chars)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for token, i in special.items():
        tokens[i] = token.encode()
    merged = np.array([ids[a + b] for a, b in merges], np.int64)
    return Vocabulary(np.array([ids[c] for c in chars], np.int64), keys[order], order.astype(np.int64), merged, tokens, special)


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if not len(v.pairs):
        return np.full(len(left), _NONE)
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(v.pairs, keys), len(v.pairs) - 1)
    return np.where(v.pairs[at] == keys, v.ranks[at], _NONE)


def merge_rounds(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word (none of them empty), as little-endian unsigned 32-bit bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.start[np.frombuffer(b"".join(words), np.uint8)]
    names = np.arange(len(words))  # of the words still at work
    ends = np.cumsum(lengths)
    rank = np.full(len(symbols), _NONE)  # of the pair that a symbol begins
    last = np.zeros(len(symbols), bool)  # the symbol ends its word
    last[ends - 1] = True
    inner = np.flatnonzero(~last)
    rank[inner] = _ranks(v, symbols[inner], symbols[inner + 1])
    done_ids, done_lengths, done_names = [], [], []
    while len(symbols):
        lowest = np.minimum.reduceat(rank, ends - lengths)
        over = lowest == _NONE
        if over.any():
            gone = np.repeat(over, lengths)
            done_ids.append(symbols[gone])
            done_lengths.append(lengths[over])
            done_names.append(names[over])
            stay = ~gone
            symbols, rank, last = symbols[stay], rank[stay], last[stay]
            names, lengths, lowest = names[~over], lengths[~over], lowest[~over]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, lengths))
        touching = np.diff(at) == 1
        if touching.any():
            # In a run of overlapping pairs (aaa) every second one merges, from the left.
            fresh = np.r_[True, ~touching]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = v.merged[rank[at]]
        last[at] = last[at + 1]
        ends = np.cumsum(lengths)
        lengths = lengths - np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(lengths))
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, rank, last = symbols[keep], rank[keep], last[keep]
        ends = np.cumsum(lengths)
        changed = at - np.arange(len(at))  # where the merged symbols are now
        rank[changed] = _NONE
        before = changed[changed > 0] - 1
        before = before[~last[before]]
        paired = np.concatenate([changed[~last[changed]], before])
        rank[paired] = _ranks(v, symbols[paired], symbols[paired + 1])
    lengths, names = np.concatenate(done_lengths), np.concatenate(done_names)
    flat, stops = np.concatenate(done_ids).astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
    out = [b""] * len(words)
    start = 0
    for name, stop in zip(names.tolist(), stops, strict=True):
        out[name] = flat[start:stop]
        start = stop
    return out


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit bytes; keeps a bounded word cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache: dict[str, bytes] = {}
        self.chars = 0
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    @staticmethod
    def _pieces(text: str) -> Iterable[str]:
        try:
            text.encode("latin-1")
            pattern = _LATIN_WORDS
        except UnicodeEncodeError:
            pattern = _WORDS
        return pattern.findall(text) if len(text) < _PIECES else (m.group() for m in pattern.finditer(text))

    def _learn(self, pieces: Iterable[str]) -> None:
        pieces = pieces if isinstance(pieces, set) else set(pieces)
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > _CACHED or self.chars > _CACHED_CHARS:
            self.cache, self.chars = {}, 0
            new = list(pieces)
        if new:
            self.cache.update(zip(new, merge_rounds(self.v, [p.encode() for p in new]), strict=True))
            self.chars += sum(map(len, new))

    def _plain(self, text: str) -> bytes:
        """Of any length: a block of words at a time."""
        out, pieces = [], iter(self._pieces(text)) if text else iter(())
        while block := list(itertools.islice(pieces, _PIECES)):
            self._learn(block)
            out.append(b"".join(map(self.cache.__getitem__, block)))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The new words of all short texts are merged together, before the texts are put together."""
        short = {i: self._pieces(t) for i, t in enumerate(texts) if len(t) < _PIECES and not self._marked(t)}
        self._learn(set().union(*short.values()))
        coded = {i: b"".join(map(self.cache.__getitem__, pieces)) for i, pieces in short.items()}
        return [coded[i] if i in coded else self._whole(t) for i, t in enumerate(texts)]

    def _marked(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def _whole(self, text: str) -> bytes:
        if not self._marked(text):
            return self._plain(text)
        parts = enumerate(self.special.split(text))
        return b"".join(self.v.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = np.frombuffer(ids, "<u4")
        parts = [
            b"".join(map(self.v.tokens.__getitem__, numbers[i : i + _PIECES].tolist())) for i in range(0, len(numbers), _PIECES)
        ]
        return b"".join(parts).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


class _Shared:
    """A vocabulary sent to the workers; each keeps one encoder between its tasks."""

    def __init__(self, spark: SparkSession, path: str):
        self.key, self.sent = f"{path} {uuid.uuid4().hex}", spark.sparkContext.broadcast(load(path))

    def encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.key] = Encoder(self.sent.value)
        return _ENCODERS[self.key]


def encode(docs: DataFrame, path: str, keep_text: bool = True, check: bool = False) -> DataFrame:
    """``docs`` plus ``token_ids`` (array of int) and ``n_tokens``, without the text if it is not kept.

    With ``check`` the ids are decoded again: ``decoded_sha256`` digests the decoded text (UTF-8).

    Ids are those of the vocabulary file's own tokenizer without added special tokens; the
    strings of special tokens within a text are matched. Null and empty texts have no ids;
    repeated rows are encoded alike; an empty table gives no rows. Columns of ``docs`` with the
    names of the new ones are replaced.
    """
    kept = docs.select([c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded_sha256")])
    back = [i for i, c in enumerate(kept.columns) if keep_text or c != "text"]
    schema = T.StructType([*[kept.schema.fields[i] for i in back], T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    if check:
        schema = schema.add("decoded_sha256", T.StringType())
    shared = _Shared(docs.sparkSession, path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.encoder()
        for batch in it:
            for start, texts in text_slices(batch, "text"):
                ids = coder.encode(texts)
                sizes = np.array([len(i) // 4 for i in ids], np.int64)
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                part = batch.slice(start, len(texts))
                digests = [pa.array([hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids], pa.string())] if check else []
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in back], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(sizes), *digests],
                    names=schema.names,
                )

    return kept.mapInArrow(batches, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` plus ``decoded``, the text of ``token_ids``; null ids give null."""
    kept = coded.select([c for c in coded.columns if c != "decoded"])
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    shared = _Shared(coded.sparkSession, path)
    at = kept.columns.index("token_ids")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.encoder()
        for batch in it:
            texts = [
                None if ids.as_py() is None else coder.decode(np.asarray(ids.values, "<u4").tobytes()) for ids in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(batches, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded in one pass.

    The ids are digested as little-endian unsigned 32-bit integers, the decoded text as UTF-8.
    """
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shared = _Shared(docs.sparkSession, path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.encoder()
        for batch in it:
            for start, texts in text_slices(batch, "text"):
                ids = coder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(batches, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
