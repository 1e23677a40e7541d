"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.tokens import TextMemo, byte_letters, encode_all, in_runs, load_tokenizer, word_chunks


@lru_cache(maxsize=4)
def whole_tokens(path: str, end: str = "</w>") -> frozenset[str]:
    """The texts of vocabulary entries of which it is proved that, as a text of their own, they encode as that one token.

    Every entry that ends a word is written as text and encoded; it is kept if its own single id comes back and the
    pre-tokenizer leaves the text in one piece. Merging never looks beyond a pre-token, so such a pre-token counts as one
    token wherever it stands.
    """
    tok, letters = load_tokenizer(path), byte_letters()
    texts, ids = [], []
    for entry, i in tok.get_vocab(with_added_tokens=False).items():
        word = entry.removesuffix(end)
        if word and entry.endswith(end) and letters.keys() >= set(word):
            try:
                texts.append(bytes(letters[c] for c in word).decode())
                ids.append(i)
            except UnicodeDecodeError:
                pass
    return frozenset(t for i, t, e in zip(ids, texts, encode_all(path, texts), strict=True) if e == [i] and len(tok.pre_tokenizer.pre_tokenize_str(t)) == 1)


@lru_cache(maxsize=4)
def _counts(path: str, proved: frozenset[str]) -> TextMemo:
    """Chunk to number of tokens: proved pre-tokens count at once, the others are merged."""

    def merge(parts: list[str]) -> list[int]:
        rest = [p for p in parts if p not in proved]
        merged = dict(zip(rest, map(len, encode_all(path, rest)), strict=True))
        return [merged.get(p, 1) for p in parts]

    return TextMemo(merge, sum, True)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every whole text, as the tokenizer gives them without added special tokens.

    Pre-tokens that are proved to be one token are counted without merging; the proof is made once, on the driver, and its
    result, at most the vocabulary, is broadcast. The tokenizer merges the rest, each distinct one once while a bounded
    memory holds it. Fits tokenizers that drop white space. Null or empty text: 0 bytes and 0 tokens.
    Repeated rows each give a row; only the id and the text are read, so other columns cannot clash. One narrow pass: no
    shuffle, and memory bounded by a run of texts.
    """
    name = f"`{id_col}`"
    kind = docs.schema[id_col].dataType.simpleString()

    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counts(tokenizer_path, proved.value)
        for batch in batches:
            sizes: list[int] = []
            for run in in_runs(batch.column(1).to_pylist()):
                sizes += [sum(n) for n in memo.values([word_chunks(t) for t in run])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"{name} {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
