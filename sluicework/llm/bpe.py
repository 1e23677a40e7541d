"""Byte-level BPE: merges from a priority queue over linked symbols, decoding by the vocabulary's strings."""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.tokens import WORD_AND_MARKS, TextMemo, byte_letters, in_runs, load_tokenizer, remembered_ids, special_strings

#: Bits of a queue entry that hold the place; the rank stands above them.
_PLACE = 40
_AT = (1 << _PLACE) - 1
#: Chunks that a worker remembers, in each of two generations.
MEMO_CHUNKS = 400_000
#: Characters of text that a worker looks at together.
RUN_CHARS = 2_000_000


class Merges(NamedTuple):
    """A byte-level vocabulary, ready for merging: ``first[b]`` is the id of byte b, ``at_first`` the rank of every pair of
    bytes or -1, by 256 * left + right; ``rank`` knows mergeable pairs of ids as left * size + right; ``made[rank]`` is the id
    that a merge makes."""

    size: int
    first: list[int]
    at_first: list[int]
    rank: dict[int, int]
    made: list[int]


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """The merges of a tokenizer file. A vocabulary that lacks a byte or a merge's result, or a model that is more than
    merges (dropout, prefixes, whole words first), is an error."""
    model = _file(path)["model"]
    vocab = model["vocab"]
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    first = [0] * 256
    for letter, b in byte_letters().items():
        first[b] = vocab[letter]
    size = max(vocab.values()) + 1
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank: dict[int, int] = {}
    for k, (a, b) in enumerate(pairs):
        rank[vocab[a] * size + vocab[b]] = k
    at_first = [rank.get(a * size + b, -1) for a in first for b in first]
    return Merges(size, first, at_first, rank, [vocab[a + b] for a, b in pairs])


@lru_cache(maxsize=4)
def load_strings(path: str) -> dict[int, bytes]:
    """What each id of a tokenizer file stands for, added tokens included. Decoding needs no more than this."""
    found, letters = _file(path), byte_letters()
    strings = {i: _bytes(t, letters) for t, i in found["model"]["vocab"].items()}
    return strings | {t["id"]: _bytes(t["content"], letters) for t in found.get("added_tokens") or ()}


def _bytes(token: str, letters: dict[str, int]) -> bytes:
    """What a vocabulary string stands for: a byte for each letter, or itself if it has other letters."""
    return bytes(letters[c] for c in token) if letters.keys() >= set(token) else token.encode()


def merge(data: bytes, merges: Merges) -> list[int]:
    """Ids of one pre-token: the pair of least rank, leftmost first, is merged until no pair has a rank.

    Symbols are linked both ways, so that a merge is a change of links. The queue holds rank and place of every pair that
    has come up; an entry is stale, and skipped, unless the pair at its place still has that rank. n bytes take O(n log n) time
    and O(n) memory.
    """
    size, first, at_first, ranks, made = merges
    symbol = [first[b] for b in data]
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [at_first[a << 8 | b] for a, b in zip(data, data[1:], strict=False)]
    pair.append(-1)
    known, push, pop = ranks.get, heapq.heappush, heapq.heappop
    queue = [r << _PLACE | k for k, r in enumerate(pair) if r >= 0]
    heapq.heapify(queue)
    while queue:
        entry = pop(queue)
        at, rank = entry & _AT, entry >> _PLACE
        if pair[at] != rank:
            continue
        right = after[at]
        then = after[right]
        new = symbol[at] = made[rank]
        symbol[right] = pair[right] = pair[at] = -1
        after[at] = then
        if then < n:
            before[then] = at
            r = pair[at] = known(new * size + symbol[then], -1)
            if r >= 0:
                push(queue, r << _PLACE | at)
        left = before[at]
        if left >= 0:
            r = pair[left] = known(symbol[left] * size + new, -1)
            if r >= 0:
                push(queue, r << _PLACE | left)
    return [s for s in symbol if s >= 0]


@lru_cache(maxsize=4)
def _memo(path: str) -> TextMemo:
    """Chunk to the bytes of its ids; each distinct chunk is split into pre-tokens and merged once while remembered."""
    merges, letters = load_merges(path), byte_letters()
    specials = {t.content: i for i, t in load_tokenizer(path).get_added_tokens_decoder().items()}
    split = load_tokenizer(path).pre_tokenizer.pre_tokenize_str

    def ids(chunk: str) -> list[int]:
        if chunk in specials:
            return [specials[chunk]]
        whole = WORD_AND_MARKS.fullmatch(chunk)
        if whole and not whole[2]:  # a word alone is one pre-token
            return merge(chunk.encode(), merges)
        return [i for word, _ in split(chunk) for i in merge(bytes(letters[c] for c in word), merges)]

    return TextMemo(lambda chunks: [array("I", ids(c)).tobytes() for c in chunks], b"".join, False, MEMO_CHUNKS)


assert array("I").itemsize == 4 and sys.byteorder == "little"  # ids are written as they lie in memory


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    return remembered_ids(_memo(path), special_strings(path), texts, 4)


def decode_ids(path: str, ids: bytes) -> str:
    """The text of ids: their strings one after the other, read as UTF-8, with a mark for what is not. Ids that the
    vocabulary does not have stand for nothing."""
    strings = load_strings(path)
    return b"".join([strings.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for run in in_runs(batch.column(1).to_pylist(), RUN_CHARS):
            raw = encode_texts(path, run)
            names, sizes = batch.column(0).slice(at, len(raw)), pa.array([len(x) // 4 for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([names, sizes, pa.array(raw, pa.binary())], names=[batch.schema.names[0], "n_tokens", "ids"])
            at += len(raw)


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [decode_ids(path, raw or b"") for raw in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text of a byte-level BPE tokenizer,
    without added special tokens; special strings in a text are taken out first, as the tokenizer does by default.

    Null or empty text: no ids. Repeated rows each give a row, a null id stays. Only the id and the text are read, so other
    columns cannot clash; an empty table gives none. One narrow pass; memory is bounded by a run of texts, the remembered
    chunks and the longest pre-token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda batches: _encoded(batches, tokenizer_path), f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode_documents`` with the text of their ids. Null ids are no ids: an empty text. One narrow pass."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(f"`{id_col}`"), "n_tokens", "ids")
    return rows.mapInArrow(lambda batches: _decoded(batches, tokenizer_path), f"`{id_col}` {kind}, n_tokens long, ids binary, text string")


def round_trip_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode_documents`` gives of ``encode_documents``, in one pass.

    As two passes, each task holds two Python workers. Spark deals workers to passes as they come, so in time all of them
    would have the chunks of encoding in memory, twice as many as there are tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, tokenizer_path), tokenizer_path)

    return docs.select(id_col, text_col).mapInArrow(both, f"`{id_col}` {kind}, n_tokens long, ids binary, text string")
