"""Packing of documents into fixed windows by minimum bin slack.

Each scan task tokenizes its documents and collects them into batches of at most
``batch_ids`` ids. Of a document, whole windows are cut off as sequences of their
own; what is left is an item of 1 to capacity - 1 ids. Windows are then filled
one after the other: the longest item goes in, and a subset-sum dynamic program
over a bitset of reachable sums picks, from the multiset of remaining lengths,
the one that comes closest to what is left; counts of each length are found by
going back through the stages. A choice is used again for as long as its counts
last. Slack that no subset fills is filled by cutting the next item. The few ids
left at a batch's end are cut into powers of two, which need no padding.

No shuffle and no state between tasks: memory is one batch, and a task that is
run again gives the same sequences, because its input order is its files'.

Edge cases: null and empty texts are the one id ``END``; a very long text is cut into
whole windows and a rest; of choices that fill a window alike the one with longer items is taken; rows that
repeat, also with one id, are packed each; an empty table gives an empty one; only
``doc_id`` and ``text`` are read, so columns of other names do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from verdance.llm.common import release, small_batches, texts
from verdance.llm.tokens import Encoder

CAPACITY = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"


def best_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts by length, out of ``counts``, whose sum is the largest that is at most ``room``.

    Bitset subset-sum: bit s of ``reach`` says that some choice sums to s. Counts
    are taken in binary bundles; one bitset is kept a bundle to go back through.
    """
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((c for c in counts if c <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return dict(chosen)


def fill(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start within the item, length) for items of 1..capacity-1 ids.

    Every id lies in one piece; all sequences but the last few are full.
    """
    queues: dict[int, deque] = {}
    for i, n in enumerate(lengths):
        if n > 0:
            queues.setdefault(n, deque()).append((i, 0))
    counts = Counter({n: len(q) for n, q in queues.items()})
    left = sum(n * c for n, c in counts.items())
    out: list[list[tuple[int, int, int]]] = []

    def pop(n: int) -> tuple[int, int, int]:
        i, start = queues[n].popleft()
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return i, start, n

    def put(n: int, i: int, start: int) -> None:
        queues.setdefault(n, deque()).append((i, start))
        counts[n] += 1

    while left >= capacity:
        first = max(counts)
        rest = Counter(counts)
        rest[first] -= 1
        if not rest[first]:
            del rest[first]
        chosen = Counter(best_subset(rest, capacity - first))
        chosen[first] += 1
        total = sum(n * c for n, c in chosen.items())
        for _ in range(max(1, min(counts[n] // c for n, c in chosen.items())) if total == capacity else 1):
            sequence = [pop(n) for n in sorted(chosen, reverse=True) for _ in range(chosen[n])]
            slack = capacity - total
            if slack:  # nothing left is short enough: the shortest item that is longer is cut
                n = min(c for c in counts if c > slack)
                i, start, _ = pop(n)
                sequence.append((i, start, slack))
                put(n - slack, i, start + slack)
            out.append(sequence)
            left -= capacity
    rest = [pop(n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    while left:
        room = 1 << (left.bit_length() - 1)
        sequence: list[tuple[int, int, int]] = []
        left -= room
        while room:
            i, start, n = rest.pop(0)
            take = min(n, room)
            sequence.append((i, start, take))
            room -= take
            if take < n:
                rest.insert(0, (i, start + take, n - take))
        out.append(sequence)
    return out


def pieces(ids: list[bytes], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for one batch of documents' ids."""
    whole, heads, tails = [], [], []
    for d, raw in enumerate(ids):
        n = len(raw) // 4
        cut = n - n % capacity
        whole += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        heads.append(cut)
        tails.append(n - cut)
    return whole + [[(d, heads[d] + s, n) for d, s, n in seq] for seq in fill(tails, capacity)]


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, batch_ids: int = 1 << 21, batch_docs: int = 8192) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null texts are empty: their one id is ``end``. Rows with one id are packed each.
    Select fewer columns where the ids (a binary of little-endian 32-bit numbers) are not needed.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, Encoder(path)) if path not in _ENCODERS else _ENCODERS[path]
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held_ids, held, size
            rows: list[list] = [[] for _ in range(8)]
            for seq in pieces(held, capacity):
                offset = 0
                for d, start, n in seq:
                    raw = held[d][4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (held_ids[d], start, n, zlib.crc32(raw), len(held[d]) // 4, sequence, offset, raw), strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
                if len(rows[0]) >= 4096:
                    yield batch(rows)
                    rows = [[] for _ in range(8)]
            if rows[0]:
                yield batch(rows)
            held_ids, held, size = [], [], 0

        def batch(rows: list[list]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [doc_kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

        doc_kind: pa.DataType = pa.int64()
        for b in batches:
            doc_kind = b.column("doc_id").type
            all_ids, all_texts = b.column("doc_id").to_pylist(), [t or "" for t in texts(b)]
            for at in range(0, len(all_texts), 256):
                for d, raw in zip(all_ids[at : at + 256], encoder.encode(all_texts[at : at + 256]), strict=True):
                    held_ids.append(d)
                    held.append(raw + last)
                    size += len(raw) // 4 + 1
                    if size >= batch_ids or len(held) >= batch_docs:
                        yield from flush()
        if held:
            yield from flush()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
