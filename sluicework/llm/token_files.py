"""Files of token ids: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a folder of Parquet tables, so that Spark's writer commits it and any store can hold it:

``ids``    one row per document: shard, key, within (ids of the shard before it), n_tokens, control, data. ``control`` holds
           two bits per id, lowest first, four ids a byte: the number of its bytes less one. ``data`` holds the bytes of the
           ranks, little-endian, without gaps. Shards, and rows within one, are in ascending order of the key.
``ranks``  one row per id that occurs: its rank (0 is the most frequent; ties by id), id and count.
``shards`` one row per shard: the number of ids in all shards before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluicework.functions.batches import pieces
from sluicework.llm.tokens import byte_ids, id_width, in_runs
from sluicework.scratch import Scratch

#: Of each control byte: the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.uint8) + 1


#: Bytes of ids, or of their data, that a task codes together.
PIECE_BYTES = 1 << 20


def _cut(flat: bytes, ends: np.ndarray) -> list[bytes]:
    at = ends.tolist()
    return [flat[a:b] for a, b in zip([0, *at], at)]


def encode_lists(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each of several lists of unsigned 32-bit or 16-bit ranks, which stand one after the other."""
    n, top = len(ranks), int(ranks.max(initial=0))
    codes = np.zeros(n, np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if top > limit:
            codes += ranks > limit
    ends, fours = np.cumsum(sizes), np.cumsum(-(-sizes // 4))
    padded = np.zeros(4 * int(fours[-1]) if len(fours) else 0, np.uint8)
    for to, a, b in zip([0, *(4 * fours).tolist()], (ends - sizes).tolist(), ends.tolist()):
        padded[to : to + b - a] = codes[a:b]
    four = padded.view("<u4")  # two bits of each of its bytes, moved together
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    width = 2 if top <= 0xFFFF else 4
    raw = ranks.astype(f"<u{width}", copy=False).view(np.uint8).reshape(n, width)
    data = raw[np.arange(width, dtype=np.uint8) <= codes[:, None]]
    more = np.append(0, np.cumsum(codes, dtype=np.int64))
    return _cut(control.tobytes(), fours), _cut(data.tobytes(), ends + more[ends])


def decode_lists(control: list[bytes], data: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ranks of all lists again: a table gives four lengths for each control byte, and with them the bytes' places."""
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].reshape(-1)
    starts = 4 * np.cumsum([0, *map(len, control)])
    lengths = np.concatenate([lengths[:0], *(lengths[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist()))])
    width = 2 if lengths.max(initial=1) <= 2 else 4
    raw = np.zeros((len(lengths), width), np.uint8)
    raw[np.arange(width, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(b"".join(data), np.uint8)
    return raw.reshape(-1).view(f"<u{width}")


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of one list."""
    (control,), (data,) = encode_lists(ranks, np.array([len(ranks)]))
    return control, data


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of one list."""
    return decode_lists([control], [data], np.array([n]))


def _values(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return batch.column(column).to_numpy(zero_copy_only=False).tolist()


def _tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, width: int) -> DataFrame:
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_runs(batch.column(1).to_pylist()):
                raw = [ids + end for ids in byte_ids(tokenizer_path, texts, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(raw)), pa.array([len(x) // width for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=[id_col, "n_tokens", "raw"],
                )
                at += len(raw)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, raw binary")


def _frequencies(tokenised: DataFrame, width: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in pieces(batches, PIECE_BYTES, 0):
            new = np.bincount(np.frombuffer(b"".join(_values(batch, "raw")), f"<u{width}"))
            total = np.pad(total, (0, max(0, len(new) - len(total))))
            total[: len(new)] += new
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return tokenised.select("raw").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write every whole text, with ``end_id`` behind it, as a file set at ``path``.

    Null or empty text: the end id alone. Repeated ids are documents of their own, in order of their tokens' checksum. A null
    id comes first. An empty table gives an empty file set. Only the id and the text are read. Texts are tokenised once, into
    a scratch table; ids cross one shuffle, in ranges of the document id. What reaches the driver is one count per
    vocabulary entry, however many documents there are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    width = max(id_width(tokenizer_path), 2 if end_id <= 0xFFFF else 4)
    tokenised = scratch.table(_tokenised(docs, tokenizer_path, id_col, text_col, end_id, width), "ids", compression="zstd")
    counted = sorted((-r["n"], r["id"]) for r in _frequencies(tokenised, width).collect())  # one row per vocabulary entry at most
    ranks = spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(counted)], "rank long, id long, n long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    ranked = np.zeros(max((i for _, i in counted), default=0) + 1, f"<u{width}")
    ranked[[i for _, i in counted]] = np.arange(len(counted))
    table = spark.sparkContext.broadcast(ranked)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = 0
        for batch in pieces(batches, PIECE_BYTES, at_raw):
            sizes = batch.column("n_tokens").to_numpy()
            starts = within + np.cumsum(sizes) - sizes
            within += int(sizes.sum())
            control, data = encode_lists(table.value[np.frombuffer(b"".join(_values(batch, "raw")), f"<u{width}")], sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column(id_col), pa.array(starts, pa.int64()), batch.column("n_tokens"), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["shard", id_col, "within", "n_tokens", "control", "data"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = tokenised.withColumn("sum", F.crc32("raw")).repartitionByRange(id_col).sortWithinPartitions(id_col, "sum", "n_tokens")
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    at_raw = ordered.columns.index("raw")
    ordered.mapInArrow(encode, f"shard int, `{id_col}` {kind}, within long, n_tokens long, control binary, data binary").write.option("compression", "none").parquet(f"{path}/ids")
    scratch.drop()
    sizes = spark.read.parquet(f"{path}/ids").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a file set: its id, start (ids of all documents before it), n_tokens, and its ids as
    little-endian unsigned 32-bit bytes. One narrow pass."""
    pairs = spark.read.parquet(f"{path}/ranks").select("rank", "id").orderBy("rank").collect()  # the vocabulary's size at most
    table = spark.sparkContext.broadcast(np.array([r["id"] for r in pairs], "<u4"))
    ids = spark.read.parquet(f"{path}/ids")
    at_data = ids.columns.index("data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE_BYTES, at_data):
            sizes = batch.column("n_tokens").to_numpy()
            ids = table.value[decode_lists(_values(batch, "control"), _values(batch, "data"), sizes)]
            raw = _cut(ids.tobytes(), 4 * np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("shard", id_col, "within", "n_tokens")] + [pa.array(raw, pa.binary())], names=["shard", id_col, "within", "n_tokens", "ids"])

    kind = ids.schema[id_col].dataType.simpleString()
    decoded = ids.mapInArrow(decode, f"shard int, `{id_col}` {kind}, within long, n_tokens long, ids binary")
    shards = F.broadcast(spark.read.parquet(f"{path}/shards"))  # one row per written partition
    return decoded.join(shards, "shard").select(id_col, (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")
