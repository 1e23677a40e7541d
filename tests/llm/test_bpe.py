"""Own merges and decoding against the tokenizers library."""

import hashlib
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sluicework.llm import bpe, queries, tokens
from tokenizers import Tokenizer

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.sampled_from(["ab", " ", "  ", "\n", "\t", "don't", "'ll", "<|endoftext|>", "<|endof", "é", "é", "123", " 9", ".", ",,", "\x00", "日本語", "🙂", " ", " ", "\x1c", "%%%", "aaaa"])


@lru_cache(maxsize=1)
def the_library():
    found = Tokenizer.from_file(BYTE)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture
def library():
    return the_library()


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=20).map("".join), st.text("ab e", max_size=200)))
def test_ids_and_text_equal_the_library(text):
    ids, back = want(the_library(), text)
    assert bpe.encode_texts(BYTE, [text]) == [ids]
    assert bpe.decode_ids(BYTE, ids) == back == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_400), max_size=12))
def test_decoding_any_ids_equals_the_library(ids):
    """Broken UTF-8 and ids that are not in the vocabulary included."""
    assert bpe.decode_ids(BYTE, np.array(ids, "<u4").tobytes()) == the_library().decode(ids, skip_special_tokens=False)


def test_merge_is_the_plain_one_and_linear_enough(library):
    merges = bpe.load_merges(BYTE)

    def plain(data):
        symbols = [merges.first[b] for b in data]
        while len(symbols) > 1:
            ranked = [(merges.rank.get(a * merges.size + b, 1 << 40), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
            rank, k = min(ranked)
            if rank == 1 << 40:
                break
            symbols[k : k + 2] = [merges.made[rank]]
        return symbols

    rng = np.random.default_rng(5)
    for n in range(60):
        data = bytes(rng.choice(list(b"theingandation aeiou"), n))
        assert bpe.merge(data, merges) == plain(data)
    long = "ab" * 100_000
    assert bpe.encode_texts(BYTE, [long])[0] == want(library, long)[0]


def test_rejects_other_models(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        found = json.load(f)
    found["model"]["dropout"] = 0.1
    path = tmp_path / "t.json"
    path.write_text(json.dumps(found))
    with pytest.raises(ValueError, match="plain"):
        bpe.load_merges(str(path))


def test_query_and_odd_tables(spark, tiny, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_bpe_round_trip(spark, tiny).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, back = want(library, rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    odd = [(1, None), (2, ""), (None, "a b"), (3, "x" * 50_000), (3, "x" * 50_000), (4, " \n\t <|endoftext|>\x00")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded")})
    back = bpe.decode_documents(bpe.encode_documents(df, BYTE), BYTE).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in odd)
    assert all(r.n_tokens * 4 == len(r.ids) and bytes(r.ids) == want(library, r.text)[0] for r in back)
    assert bpe.encode_documents(df.limit(0), BYTE).count() == 0


def test_round_trip_is_one_pass(spark, tiny):
    """As two passes, a task holds two workers, and both come to hold the remembered chunks."""
    plan = queries.op13_bpe_round_trip(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    odd = [(1, None), (2, ""), (None, "a b"), (3, "x" * 3_000), (3, "x" * 3_000), (4, " \n\t <|endoftext|>\x00"), (5, "日本 " * 300)]
    df = spark.createDataFrame(odd, "`a b` long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens")})
    both = bpe.round_trip_documents(df, BYTE, "a b")
    steps = bpe.decode_documents(bpe.encode_documents(df, BYTE, "a b"), BYTE, "a b")
    assert both.schema == steps.schema and sorted(map(str, both.collect())) == sorted(map(str, steps.collect()))
    assert bpe.round_trip_documents(df.limit(0), BYTE, "a b").count() == 0


def test_remembered_chunks_are_bounded_in_characters(library):
    """Whole texts without a blank are chunks, too."""
    memo = tokens.TextMemo(lambda chunks: [c.encode() for c in chunks], b"".join, False, 2_000)
    for k in range(0, 300, 3):
        texts = [(final, [f"{n}\u4e00" + "\u65e5" * size for size in (0, 90, 990, 5_000)]) for n in range(k, k + 3) for final in (True, False)]
        assert [b"".join(v) for v in memo.values(texts)] == ["".join(c).encode() for _, c in texts]
        for part, limit in ((memo.parts, 2_000), (memo.chunks, 500)):
            for held in (part.young, part.old):
                assert len(held) <= limit and sum(map(len, held)) <= tokens.CHUNK_CHARS * limit
    texts = ["日" * 2_000, "a  b", "日" * 2_000, "a b"]
    assert bpe.encode_texts(BYTE, texts) == [want(library, t)[0] for t in texts]
    shared = bpe._memo(BYTE)
    assert shared.chunks.limit < shared.parts.limit == bpe.MEMO_CHUNKS and "日" * 2_000 not in shared.parts.young
