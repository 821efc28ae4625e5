"""Packing documents into token sequences by Karmarkar-Karp multiway differencing.

Every document is encoded, closed with the end id and cut: full windows of ``capacity`` tokens
stand alone, the rest of each document is an item; the rest of every fourth document is halved
again and again into smaller items, which let the differencing level the windows to a few tokens. Items are gathered into groups inside each
task (no shuffle), and each group is split into windows by multiway differencing: partial
partitions are merged, the two with the widest spread first, so that the largest part of one
meets the smallest of the other. While a window would exceed the capacity, the number of windows
of the group rises and the group is split anew. The last group of a task may be small; its
windows then take the smallest power of two that holds the group, which needs no padding at that
size.

Nulls and edge cases: a null text counts as empty, so the document is its end id alone; a null
doc_id stays null; repeated rows are packed as often as they come; an empty table gives no rows;
only the two named columns are read, so others may have any name. Ties between items are broken
by their order in the group.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import END_ID, encoder, freed, slices, tokenizer_path

CAPACITY = 2048
#: Tokens of items that one group holds: about 512 windows.
GROUP_TOKENS = 512 * CAPACITY

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split items of the given sizes into ``k`` sets with nearly equal sums; returns item
    indices by set. Largest differencing: a partial partition is its non-empty sets in rising
    order of their sums, less the smallest sum once all k sets are in use."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap, n = [], len(sizes)
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, i, [i])]))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        if len(b) <= free:  # every set of b meets an empty set of a
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:  # b's largest sets go to a's empty ones, then to a's smallest
            b = b[::-1]
            rest = b[free:]
            joined = [(x[0] + y[0], x[1], x[2] + y[2]) for x, y in zip(a, rest, strict=False)]
            a = sorted(joined + a[len(rest) :] + b[:free])
        low = a[0][0] if len(a) == k else 0
        if low:
            a = [(s - low, t, m) for s, t, m in a]
        tick += 1
        heapq.heappush(heap, (-a[-1][0], tick, a))
    sets = [m for _, _, m in heap[0][2]] if heap else []
    return sets + [[] for _ in range(k - len(sets))]


def item_cuts(start: int, stop: int, turn: int, every: int = 4, least: int = 32):
    """(start, length) of the items of one document's rest: one, or for every fourth document
    halves of halves down to ``least`` tokens."""
    while turn % every == 0 and stop - start >= least:
        half = (stop - start) // 2
        yield start, half
        start += half
    if start < stop:
        yield start, stop - start


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item indices by window. The number of windows begins at the least possible and rises
    whenever the fullest window exceeds the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        k += max(1, k // 256)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         group_tokens: int = GROUP_TOKENS, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    With ``keep_ids``, each piece also carries its ids as little-endian uint32 bytes.
    """
    path = tokenizer or tokenizer_path()
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path)
        #: sequence ids of different tasks never meet
        base, count = TaskContext.get().partitionId() << 33, 0
        items: list[tuple] = []
        held, turn = 0, 0
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * keep_ids
        kinds = [pa.int64()] * 8 + [pa.binary()] * keep_ids

        def emit(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)

        def piece(doc, at, ids, of, seq, offset, whole):
            return (doc, at, len(ids) // 4, zlib.crc32(ids), of, seq, offset, whole, ids)

        def place(group, last=False):
            nonlocal count
            total, top = sum(len(x[2]) // 4 for x in group), capacity
            if last:  # a small last group fits a smaller power of two
                while top > 1 and total <= top // 2:
                    top //= 2
            out = []
            for w in windows([len(x[2]) // 4 for x in group], top):
                whole, offset = sum(len(group[i][2]) // 4 for i in w), 0
                for i in sorted(w):
                    doc, at, ids, of = group[i]
                    out.append(piece(doc, at, ids, of, base + count, offset, whole))
                    offset += len(ids) // 4
                count += 1
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in slices(batch, "text", 4 << 20):
                rows = []
                found, bounds = enc.encode(texts)
                for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ids, doc = found[lo:hi].tobytes() + end, doc_ids[first + k]
                    of = hi - lo + 1
                    cut = of - of % capacity
                    for at in range(0, cut, capacity):
                        rows.append(piece(doc, at, ids[4 * at : 4 * (at + capacity)], of, base + count, 0, capacity))
                        count += 1
                    turn += cut < of
                    for at, n in item_cuts(cut, of, turn):
                        items.append((doc, at, ids[4 * at : 4 * (at + n)], of))
                        held += n
                    if held >= group_tokens:
                        rows += place(items)
                        items, held = [], 0
                if rows:
                    yield emit(rows)
        if items:
            yield emit(place(items, last=True))
        enc.forget()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(freed(run), SCHEMA + ", ids binary" * keep_ids)


def op2_pack(spark, sf_dir: str) -> DataFrame:
    from tesserine.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
