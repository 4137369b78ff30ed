"""Cost-balanced packing of token ids into sequences of fixed capacity.

The cost of a document piece of n tokens is linear * n + quadratic * n**2, the
latter for attention.  Documents go in descending order of length to the sequence
of the lowest cost that still has room.  A document that exceeds the capacity
first fills whole sequences; one that fits nowhere is cut at the room left.  What
remains of a group after its full sequences goes to sequences whose lengths are
powers of two, which need no padding.

Tokens of at most ``group_tokens`` are packed together, in the task that made
them: no shuffle, bounded memory, and the same result when a task is run again.

Of sequences of equal cost the earlier made is taken, of documents of equal length the
earlier read.  A text of any length is tokenized whole and cut into full sequences.
Null text counts as empty: the document is its end id alone.  An empty table gives
an empty table.  Repeated rows are packed each on its own.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairsmith.llm import _tokens, _vec

#: Token ids that are packed together; 16 million 16-bit ids take 32 MB.
GROUP_TOKENS = 16_000_000


def place(lengths: list[int], capacity: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every token of the documents once."""
    out: list[tuple[int, int, int, int, int]] = []
    made = 0
    rest: list[tuple[int, int, int]] = []  # tokens left, document, start
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, made, 0))
            made += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(n for n, _, _ in rest)
    rooms = [capacity] * (total // capacity)
    tail = total % capacity
    while tail:
        rooms.append(1 << (tail.bit_length() - 1))
        tail -= rooms[-1]
    used = [0] * len(rooms)
    # lengths only fall, so a sequence with room enough keeps it until it is chosen
    roomy: list[tuple[float, int]] = []  # cost, sequence
    narrow = [(-room, 0.0, s) for s, room in enumerate(rooms)]  # by falling room, then cost
    heapq.heapify(narrow)
    todo = [(-n, d, start) for n, d, start in rest]
    heapq.heapify(todo)
    while todo:
        n, d, start = heapq.heappop(todo)
        n = -n
        while narrow and -narrow[0][0] >= n:
            _, cost, s = heapq.heappop(narrow)
            heapq.heappush(roomy, (cost, s))
        if roomy:
            cost, s = heapq.heappop(roomy)
        else:  # cut at the largest room; the rest of the document waits for its turn
            _, cost, s = heapq.heappop(narrow)
        take = min(n, rooms[s] - used[s])
        out.append((d, start, take, made + s, used[s]))
        used[s] += take
        if left := rooms[s] - used[s]:
            heapq.heappush(narrow, (-left, cost + linear * take + quadratic * take * take, s))
        if take < n:
            heapq.heappush(todo, (take - n, d, start + take))
    return out


def pack(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    capacity: int = 4096,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.library(_tokens.vocabulary_path(vocabulary), "<u4")
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            keys = pa.chunked_array(names).combine_chunks()
            pieces = place([len(x) for x in ids], capacity)
            step = 1_000 if with_ids else 20_000
            for i in range(0, len(pieces), step):
                part = pieces[i : i + step]
                d, start, n, s, at = (np.array(x, dtype=np.int64) for x in zip(*part, strict=True))
                cut = [ids[a][b : b + c].astype("<u4") for a, b, c, _, _ in part]
                columns = [keys.take(pa.array(d)), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(ids[a]) for a, *_ in part], pa.int64()), pa.array(s + base), pa.array(at)]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=columns_out)
            base += max((p[3] for p in pieces), default=-1) + 1
            names.clear()
            ids.clear()

        for batch, _, _ in _vec.steps(batches):
            encoded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            names.append(batch.column(0))
            for x in encoded:
                ids.append(np.frombuffer(x + end, dtype="<u4").astype(np.uint16 if small else np.uint32))
                held += len(ids[-1])
            if held >= group_tokens:
                yield from packed()
                held = 0
        if ids:
            yield from packed()

    small = _vocabulary_fits_16_bits(vocabulary) and end_id < 1 << 16
    columns_out = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind = df.schema[id].dataType.simpleString()
    schema = f"{_vec.quoted(id)} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + ", ids array<int>" * with_ids
    return df.select(id, text).mapInArrow(run, schema)


def _vocabulary_fits_16_bits(vocabulary: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokens.vocabulary_path(vocabulary)).get_vocab_size() <= 1 << 16
