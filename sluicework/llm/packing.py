"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sluicework.llm.tokens import in_runs, word_ids

#: Tokens that one packing run of a task places together; it bounds its memory.
RUN_TOKENS = 1_000_000


def attention_cost(length: int, linear: float, quadratic: float) -> float:
    """Cost of attending within a piece of ``length`` tokens."""
    return linear * length + quadratic * length * length


def place(lengths: list[int], size: int, linear: float, quadratic: float, last: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), that hold every token of the documents once.

    Stretches of ``size`` tokens of long documents fill sequences of their own. The rests go, longest first, to the
    sequence of lowest cost that still has room for them; where none has, the rest is cut to fill the cheapest open one.
    The tokens beyond the last full sequence go to sequences of powers of two, which need no padding; unless this is the
    ``last`` run of a task there are none of them: the last of the rests wait for the next run and are left out.
    """
    full: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        whole = n // size * size
        full += [[(d, at, size)] for at in range(0, whole, size)]
        if n > whole:
            rests.append((n - whole, d, whole))
    total = sum(r[0] for r in rests)
    rests.sort(key=lambda r: (-r[0], r[1]))
    rooms = [size] * (total // size)
    tail = total % size if last else 0
    rooms += [1 << b for b in reversed(range(size.bit_length())) if tail >> b & 1]
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    heap = [(0.0, k) for k in range(len(rooms))]
    for n, d, at in rests:
        while n and heap:
            aside = []
            while heap and rooms[heap[0][1]] < n:
                aside.append(heapq.heappop(heap))
            whole = bool(heap)
            cost, k = heapq.heappop(heap) if whole else aside.pop(0)
            for x in aside:
                heapq.heappush(heap, x)
            take = min(n, rooms[k])
            bins[k].append((d, at, take))
            rooms[k] -= take
            if rooms[k]:
                heapq.heappush(heap, (cost + attention_cost(take, linear, quadratic), k))
            n, at = n - take, at + take
    return full + bins


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    size: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
) -> DataFrame:
    """Pack every whole text, with ``end_id`` behind it, into sequences of at most ``size`` tokens.

    One row per piece: the id, start (of its document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset (there, gapless from 0) and cost (of the
    piece, linear plus quadratic in its length). Sequences are balanced by cost within a run of documents of one partition;
    documents are cut only where no sequence has room, so each sequence is full but for at most log2(size) sequences of
    powers of two at the end of a partition: no token is padding.

    Null or empty text: the end id alone. Repeated rows are documents of their own. Only the id and the text are read. An
    empty table gives no piece. No shuffle: a task packs what it reads, in bounded memory, and a retried task gives the same
    sequences, whose ids hold the partition's number.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 33
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
        types: list[pa.DataType] = []
        waiting: list[list] = []  # [id, ids, tokens placed before, all tokens]

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal next_id, waiting
            rows = []
            done = [0] * len(waiting)
            for pieces in place([len(w[1]) // 4 for w in waiting], size, linear, quadratic, last):
                offset = 0
                for d, at, n in pieces:
                    doc, ids, before, total = waiting[d]
                    crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)])
                    rows.append((doc, before + at, n, crc, total, next_id, offset, attention_cost(n, linear, quadratic)))
                    offset += n
                    done[d] += n
                next_id += 1
            # pieces of a document come in any order, yet a rest that waits is always its last stretch
            waiting = [[w[0], w[1][4 * k :], w[2] + k, w[3]] for w, k in zip(waiting, done, strict=True) if 4 * k < len(w[1])]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        held = 0
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.float64()]
            ids_of = iter(batch.column(0).to_pylist())
            for run in in_runs(batch.column(1).to_pylist()):
                for ids in word_ids(tokenizer_path, run):
                    ids += end
                    waiting.append([next(ids_of), ids, 0, len(ids) // 4])
                    held += len(ids) // 4
                    if held >= RUN_TOKENS:
                        yield flush(False)
                        held = sum(len(w[1]) // 4 for w in waiting)
        if waiting:
            yield flush(True)

    return docs.select(id_col, text_col).mapInArrow(pack, columns)
