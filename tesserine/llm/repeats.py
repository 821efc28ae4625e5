"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A string of ``length`` bytes that starts in a document is removed there if it also starts in a
document with a smaller id. The work goes through these steps, each a shuffle of compact arrays:

1. Documents are gathered into shards of about ``shard_bytes``. Every string of ``length`` bytes
   has an anchor: of its 16-byte words, the one with the least hash (the leftmost on ties). Equal
   strings have equal anchors at equal places. The neighbouring strings that share one anchor form
   a fragment of less than ``2 * length`` bytes.
2. Anchors meet by hash. Those of more than one document are told to their shards; fragments with
   another anchor hold nothing that repeats.
   An anchor found ``hot`` times or more has its fragments cut into single strings, which then meet
   by the hash of the whole string, so that no common phrase gathers its contexts in one task.
3. The fragments left, equal ones of a shard once, meet by the hash of their anchor. There each
   shard has its Burrows-Wheeler transform: the rotations of its fragments in order, as the four
   bytes before each. The transforms are merged by refining the interleave, the vector that says
   which shard each place of the merged order comes from: in each round the bytes before
   each place are read off the shards' transforms in turn, and the places are ordered by these
   bytes, then by the block they were in. After the round for ``length`` bytes, a block is a
   repeated interval: the places whose common prefix has at least that length. No suffix of one
   shard is compared with one of another, and none is sorted again.
4. Each fragment learns which of its strings lie in an interval with a smaller document, as one
   bit a string, and each shard cuts its documents.

All sizes are per shard or bucket and do not grow with the table. A string that very many
documents share costs one fragment in each shard, whatever the number of copies.

Nulls and edge cases: a null text is empty; a null id counts as larger than all others, and two
such documents do not remove each other's strings, nor do rows with equal ids; repeats within one
document stay; texts shorter than ``length`` are kept whole; an empty table gives no rows; only
the two named columns are read. Bytes are compared, so a cut may fall inside a character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import freed, freed_group, row_of, scratch, table, with_row

WORD = 16
NO_ID = np.iinfo(np.int64).max
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
S32 = np.uint64(32)
BLOCK = 1 << 16
PLACE = np.uint64((1 << 20) - 1)
ROWS = "key long, part long, data binary"
OUT = "doc_id long, kept binary, spans array<struct<start:long,length:long>>"


# -- arrays as bytes ---------------------------------------------------------


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return _codec()[0].compress(b"".join([head, *raw]))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = _codec()[1].decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    size = np.frombuffer(raw, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for kind, s in zip(kinds, size, strict=True):
        out.append(np.frombuffer(raw, kind, s // np.dtype(kind).itemsize, at))
        at += s
    return out


def _rows(rows: list[tuple]):
    import pyarrow as pa

    key, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"key": pa.array(key, pa.int64()), "part": pa.array(part, pa.int64()), "data": pa.array(data, pa.binary())})


def _blobs(group):
    """(part, data) of a group's rows, by part."""
    return sorted(zip(group.column("part").to_pylist(), group.column("data").to_pylist(), strict=True))


# -- fragments of a shard ----------------------------------------------------


def _at(text: np.ndarray, start: int = 0, count: int | None = None) -> np.ndarray:
    """Eight bytes from each position on, as little-endian integers; ``text`` has spare bytes."""
    count = len(text) - 7 - start if count is None else count
    return np.ndarray((count,), "<u8", buffer=text, offset=start, strides=(1,))


def cut_fragments(text: np.ndarray, bounds: np.ndarray, length: int):
    """(start, strings, anchor) of the fragments; ``text`` has 2 * length spare bytes at its end."""
    n, reach = int(bounds[-1]), length - WORD + 1
    valid = np.ones(n + 1, bool)
    valid[n] = False
    size = np.diff(bounds)
    tail = np.minimum(size, length - 1)
    at = np.repeat(bounds[1:] - np.cumsum(tail), tail) + np.arange(tail.sum())
    valid[at] = False
    starts, anchors, prior = [], [], -1
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        own = valid[lo : lo + m]
        if not own.any():
            prior = -1
            continue
        u = _at(text, lo, m + reach - 1 + 8).copy()
        h = u[:-8] * M1
        h ^= h >> S32
        h += u[8:]
        h *= M2
        h &= ~PLACE
        h |= np.arange(len(h), dtype=np.uint64)
        have = 1
        while have * 2 <= reach:
            h = np.minimum(h[:-have], h[have:])
            have *= 2
        if have < reach:
            h = np.minimum(h[: -(reach - have)], h[reach - have :])
        a = (h[:m] & PLACE).astype(np.int64) + lo
        fresh = np.empty(m, bool)
        fresh[1:] = a[1:] != a[:-1]
        fresh[1:] |= ~own[:-1]
        fresh[0] = a[0] != prior
        fresh &= own
        found = np.flatnonzero(fresh)
        starts.append(found + lo)
        anchors.append(a[found])
        prior = int(a[-1]) if own[-1] else -1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, anchor = np.concatenate(starts), np.concatenate(anchors)
    begins = ~valid[:-1]
    begins[start] = True
    edges = np.flatnonzero(np.append(begins, True))  # a fragment ends where another or an invalid place begins
    stop = edges[np.searchsorted(edges, start, side="right")]
    return start, stop - start, anchor


class Shard:
    """One shard's documents and fragments."""

    def __init__(self, data: bytes):
        self.ids, bounds, text, gap, n, rel, self.rows = unpack(data, np.int64, np.int64, np.uint8, np.uint32, np.uint8, np.uint8, np.uint8)
        self.bounds, self.text = bounds, text
        self.n = n.astype(np.int64)
        self.start = np.cumsum(gap.astype(np.int64)) + np.cumsum(self.n) - self.n
        at = self.start + rel
        u = _at(text)
        h = u[at] * M2
        h ^= h >> S32
        h = (h + u[at + 8]) * M1
        h ^= h >> S32
        h *= M3
        self.hash = h ^ (h >> np.uint64(29))
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1

    @staticmethod
    def pack(ids: np.ndarray, texts: list[bytes], length: int, rows: bytes = b"") -> bytes:
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
        text = np.frombuffer(b"".join([*texts, bytes(2 * length)]), np.uint8)
        start, n, anchor = cut_fragments(text, bounds, length)
        gap = np.diff(np.concatenate([[0], start + n]))[: len(start)] - n
        return pack(ids, bounds, text, gap.astype(np.uint32), n.astype(np.uint8), (anchor - start).astype(np.uint8), np.frombuffer(rows, np.uint8))

    def keys(self, buckets: int) -> np.ndarray:
        """Bucket of each fragment's anchor, and 31 bits of its hash within; the last bit is 0."""
        return ((self.hash >> S32) * np.uint64(buckets) >> S32) << S32 | (self.hash & np.uint64(0xFFFFFFFE))


def mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * (M1 if k % 2 else M2)
        out ^= out >> S32
    return out


def as_bytes(rows: np.ndarray) -> np.ndarray:
    return rows.view(np.uint8).reshape(len(rows), 8 * rows.shape[1])


def collapse(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place in that order) of equal rows; rows are compared whole."""
    order = np.argsort((key << np.uint64(44)) | (mixed(rows) >> np.uint64(20)), kind="stable")
    own = rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (own[1:] != own[:-1]).any(axis=1)
    fresh[1:] |= key[order][1:] != key[order][:-1]
    return order, np.cumsum(fresh) - 1


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal values; no value is negative."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(x)], strict=False))


def wide(length: int) -> int:
    return -(-(2 * length - WORD) // 8)


def _shown(n: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte of a row of fragments belongs to it, by its number of strings."""
    return np.arange(8 * wide(length)) < (n + length - 1)[:, None]


class Candidates:
    """The fragments of a shard whose anchors other documents hold too, equal ones together."""

    def __init__(self, shard: Shard, repeated: np.ndarray, p_buckets: int, q_buckets: int, length: int):
        keys = shard.keys(p_buckets)
        at = np.searchsorted(repeated, keys)
        met = repeated[np.minimum(at, len(repeated) - 1)] if len(repeated) else keys + np.uint64(2)
        hit = np.flatnonzero((met & ~np.uint64(1)) == keys)
        hot = (met[hit] & np.uint64(1)).astype(bool)
        one, hit = hit[hot], hit[~hot]
        each = shard.n[one]
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.start = np.concatenate([shard.start[hit], np.repeat(shard.start[one], each) + step])
        self.n = np.concatenate([shard.n[hit], np.ones(len(step), np.int64)])
        self.ids = shard.ids[shard.doc[np.concatenate([hit, np.repeat(one, each)])]]
        u = _at(shard.text)
        rows = np.empty((len(self.n), wide(length)), np.uint64)
        for k in range(rows.shape[1]):
            rows[:, k] = u[np.minimum(self.start + 8 * k, len(u) - 1)]
        self.shown = _shown(self.n, length)
        as_bytes(rows)[~self.shown] = 0
        h = np.concatenate([(shard.hash[hit] ^ M3) * M2, mixed(rows[len(hit) :])])
        self.sub = h.astype(np.uint8)
        self.bucket = (h >> S32) * np.uint64(q_buckets) >> S32
        self.order, self.group = collapse(rows, self.bucket)
        self.rows = rows
        self.first = self.order[np.flatnonzero(np.diff(self.group, prepend=-1))]
        self.least = np.minimum.reduceat(self.ids[self.order], np.flatnonzero(np.diff(self.group, prepend=-1))) if len(self.n) else np.zeros(0, np.int64)


# -- Burrows-Wheeler transforms ------------------------------------------------


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    key = high << S32 | low
    order = np.argsort(key)
    own = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]])).astype(np.uint64)
    return out


def rotations(size: np.ndarray, step: int) -> np.ndarray:
    """For each position of cyclic strings of the given sizes, the position ``step`` further on."""
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + step
    over = at >= np.repeat(first + size, size)
    at[over] -= np.repeat(size, size)[over]
    return at


def transform(flat: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, before): the rotations of one shard's strings in the order of their first
    ``length`` bytes, and the four bytes before each. Ranks of ever longer prefixes double."""
    one = rotations(size, 1)
    two = flat.astype(np.uint64) << np.uint64(8) | flat[one]
    ahead = one[one]
    four = two << np.uint64(16) | two[ahead]
    ahead = ahead[ahead]
    rank, have = _ranks(four, four[ahead]), 8
    before = np.empty(len(flat), np.uint32)
    before[ahead] = four
    while have < length:
        step = min(have, length - have)
        rank, have = _ranks(rank, rank[rotations(size, step)]), have + step
    order = np.argsort(rank)
    return order, before[order]


def merge(transforms: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each shard's transform, the block of each of its places: places of all shards are in
    one block if and only if their first ``length`` bytes are equal."""
    size = [len(t) for t in transforms]
    before = np.concatenate(transforms).astype(np.uint64)
    total = len(before)
    if len(size) > 256 or total >= 1 << 24:
        raise ValueError("too much for one merge")
    source = np.repeat(np.arange(len(size), dtype=np.uint8), size)  # the interleave
    block = np.zeros(total, np.uint64)
    of = before << S32
    turn = np.arange(total)
    for step in [length % 4] * bool(length % 4) + [4] * (length // 4):
        read = of if step == 4 else (before & np.uint64((1 << 8 * step) - 1)) << S32
        key = np.empty(total, np.uint64)
        key[turn] = read
        key |= block << np.uint64(8)
        key |= source
        key.sort()
        source = key.astype(np.uint8)
        key >>= np.uint64(8)
        block[0] = 0
        np.cumsum(key[1:] != key[:-1], dtype=np.uint64, out=block[1:])
        turn = np.argsort(source, kind="stable")
    return np.split(block[turn].astype(np.int64), np.cumsum(size)[:-1])


def smaller(frags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """frags: for each shard its fragments as padded rows (uint64), numbers of strings and least
    ids. Returns for each shard and fragment a row of booleans: whether each of its strings lies in
    a repeated interval with a smaller id."""
    rows, n, ids = (np.concatenate(x) for x in zip(*frags, strict=True))
    shard = np.repeat(np.arange(len(frags)), [len(x[1]) for x in frags])
    order, group = collapse(rows, np.zeros(len(rows), np.uint64))
    head = np.flatnonzero(np.diff(group, prepend=-1))
    own = np.empty(len(rows), np.int64)
    own[order] = group
    first = order[head]  # the fragment's first shard holds it in its transform
    least = np.minimum.reduceat(ids[order], head)
    by_shard = np.argsort(shard[first], kind="stable")
    first, least = first[by_shard], least[by_shard]
    place = np.empty(len(by_shard), np.int64)
    place[by_shard] = np.arange(len(by_shard))
    own = place[own]
    n_first = n[first]
    size = n_first + length - 1
    held = np.cumsum(size)
    target = max(1, int(held[-1]) // 32)
    run = np.cumsum(np.diff(shard[first], prepend=-1) > 0) - 1  # shards in turn; small neighbours share a transform
    weight = np.cumsum(np.bincount(run, size))
    run = (np.floor((weight - 1) / target).astype(np.int64))[run] if run[-1] > 32 else run
    run = np.cumsum(np.diff(run, prepend=-1) > 0) - 1
    shown = _shown(n_first, length)
    flat = as_bytes(rows[first])[shown]
    base = held - size
    blocks = np.empty(len(flat), np.int64)
    orders, befores = [], []
    for a, b in stretches(run):
        o, t = transform(flat[base[a] : held[b - 1]], size[a:b], length)
        orders.append(o + base[a])
        befores.append(t)
    for o, x in zip(orders, merge(befores, length), strict=True):
        blocks[o] = x
    reach = length - WORD + 1
    inside = np.arange(reach) < n_first[:, None]
    at = np.where(inside, base[:, None] + np.arange(reach), 0)
    of = blocks[at]
    best = np.full(int(blocks.max()) + 1, NO_ID)
    down = np.argsort(least, kind="stable")[::-1]
    pick = inside[down]
    best[of[down][pick]] = np.repeat(least[down], n_first[down])  # the least id is written last
    found = (best[of][own] < ids[:, None]) & inside[own]
    return np.split(found, np.cumsum([len(x[1]) for x in frags])[:-1])


# -- the Spark job -------------------------------------------------------------


def shards(docs: DataFrame, id_col: str, text_col: str, length: int, shard_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """Packed shards: key is the shard. Each task gathers its documents into shards, with the
    columns that are to be kept."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        ids, texts, rows, held = [], [], [], 0

        def emit():
            sink = pa.BufferOutputStream()
            if keep:
                whole = pa.Table.from_batches(rows)
                with pa.ipc.new_stream(sink, whole.schema) as out:
                    out.write_table(whole)
            row = (base + count, 0, Shard.pack(np.array(ids, np.int64), texts, length, sink.getvalue().to_pybytes()))
            return _rows([row]).to_batches()[0]

        for batch in batches:
            own, since = batch.column("doc_id").fill_null(NO_ID).to_pylist(), 0
            rest = batch.select(["row"] * bool(keep))
            for k, doc in enumerate(own):
                ids.append(doc)
                texts.append(batch.column("text")[k].as_py() or b"")
                held += len(texts[-1])
                if held >= shard_bytes:
                    rows.append(rest.slice(since, k + 1 - since))
                    yield emit()
                    count, since, ids, texts, rows, held = count + 1, k + 1, [], [], [], 0
            if since < len(own):
                rows.append(rest.slice(since))
        if ids:
            yield emit()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *row_of(docs, keep))
    return cols.mapInArrow(freed(run), ROWS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = 8 << 20,
                   hot: int = 1 << 14, merge_bytes: int = 1 << 19, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, kept (the bytes left) and spans (start and length of each removed run, in bytes of
    the text) of every document; with ``keep``, also a struct ``row`` of these columns. With
    ``whole_characters``, what a cut leaves of a character goes as well."""
    if not 24 <= length <= 120:
        raise ValueError("length must be from 24 to 120")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    p_buckets, q_buckets = max(16, total // (4 * shard_bytes)), max(64, total // shard_bytes)
    packed = scratch(shards(docs, id_col, text_col, length, shard_bytes, keep), "shards")

    def anchors(group):
        out = []
        for _, data in _blobs(group):
            shard = Shard(data)
            keys = shard.keys(p_buckets)
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            own, doc = keys[order], shard.doc[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.append(first[1:], len(own)) - 1
            many = doc[first] != doc[last]
            key, times = own[first], np.minimum(last + 1 - first, 65535).astype(np.uint16)
            part = (key >> S32).astype(np.int64)
            low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for a, b in stretches(part):
                out.append((int(part[a]), group.column("key")[0].as_py(), pack(np.diff(low[a:b], prepend=np.uint32(0)), times[a:b], np.packbits(many[a:b]))))
        return _rows(out)

    def repeated(group):
        own = []
        for part, data in _blobs(group):
            step, times, many = unpack(data, np.uint32, np.uint16, np.uint8)
            own.append((part, np.cumsum(step, dtype=np.uint32), times, np.unpackbits(many, count=len(step))))
        low, times, many = (np.concatenate([x[k] for x in own]) for k in (1, 2, 3))
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.diff(low[order], prepend=np.uint32(1)))  # no key is odd
        twice = (np.diff(np.append(first, len(low))) > 1) | np.maximum.reduceat(many[order], first).astype(bool)
        known = low[order][first][twice]
        flag = (np.add.reduceat(times[order], first, dtype=np.int64)[twice] >= hot).astype(np.uint32)
        out, key = [], group.column("key")[0].as_py()
        for part, x, *_ in own:
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                x = (x | flag[at])[known[at] == x]
                out.append((part, key, pack(np.diff(x, prepend=np.uint32(0)))))
        return _rows(out)

    def candidates(package, others) -> tuple[Shard, Candidates]:
        shard = Shard(package.column("data")[0].as_py())
        keys = [np.cumsum(unpack(data, np.uint32)[0], dtype=np.uint32).astype(np.uint64) | np.uint64(part << 32) for part, data in others]
        return shard, Candidates(shard, np.concatenate(keys) if keys else np.zeros(0, np.uint64), p_buckets, q_buckets, length)

    def fragments(package, hits):
        _, own = candidates(package, _blobs(hits))
        bucket = own.bucket[own.first].astype(np.int64)
        out, key = [], package.column("key")[0].as_py()
        for a, b in stretches(bucket):
            at = own.first[a:b]
            out.append((int(bucket[a]), key, pack(own.n[at].astype(np.uint8), own.sub[at], own.least[a:b], as_bytes(own.rows[at])[own.shown[at]])))
        return _rows(out)

    def merged(group):
        own, parts, subs, key = [], [], [], group.column("key")[0].as_py()
        for part, data in _blobs(group):
            n, sub, least, flat = unpack(data, np.uint8, np.uint8, np.int64, np.uint8)
            n = n.astype(np.int64)
            rows = np.zeros((len(n), wide(length)), np.uint64)
            as_bytes(rows)[_shown(n, length)] = flat
            own.append((rows, n, least))
            parts.append(part)
            subs.append(sub)
        held = sum(int(n.sum()) + (length - 1) * len(n) for _, n, _ in own)
        turns = min(256, -(-held // merge_bytes))
        marks = [np.zeros((len(n), length - WORD + 1), bool) for _, n, _ in own]
        for turn in range(turns):  # in parts that a core's cache holds; equal strings are in the same
            at = [np.flatnonzero(sub % turns == turn) for sub in subs] if turns < 256 else [np.flatnonzero(sub == turn) for sub in subs]
            used = [k for k, x in enumerate(at) if len(x)]
            found = smaller([tuple(x[at[k]] for x in own[k]) for k in used], length) if used else []
            for k, x in zip(used, found, strict=True):
                marks[k][at[k]] = x
        return _rows([(part, -1 - key, pack(np.packbits(x, axis=1))) for part, x in zip(parts, marks, strict=True)])

    def cut(package, rest):
        import pyarrow as pa

        rows = _blobs(rest)
        shard, own = candidates(package, [x for x in rows if x[0] >= 0])
        reach = length - WORD + 1
        bits = [unpack(data, np.uint8)[0].reshape(-1, -(-reach // 8)) for _, data in reversed(rows[: sum(x[0] < 0 for x in rows)])]
        n = int(shard.bounds[-1])
        text = shard.text[:n]
        hit = np.zeros(n + 1, np.int8)
        if len(own.start):
            flags = np.unpackbits(np.concatenate(bits), axis=1, count=reach).astype(bool)[own.group]
            start, count = own.start[own.order], own.n[own.order]
            whole = own.ids[own.order] > own.least[own.group]
            flags[whole] = np.arange(reach) < count[whole][:, None]
            row, col = np.nonzero(flags)
            hit[start[row] + col] = 1
        held = np.concatenate([[0], np.cumsum(hit[:n], dtype=np.int64)])
        gone = held[1:] > held[np.maximum(np.arange(n) + 1 - length, 0)]
        kept = np.concatenate([[0], np.cumsum(~gone, dtype=np.int64)])[shard.bounds]
        before = np.concatenate([[False], gone[:-1]]) if n else gone
        edge = shard.bounds[:-1][shard.bounds[:-1] < n]
        before[edge] = False  # a run ends with its document
        after = np.concatenate([gone[1:], [False]]) if n else gone
        after[edge[edge > 0] - 1] = False
        start, stop = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        doc = np.searchsorted(shard.bounds, start, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(start - shard.bounds[doc]), pa.array(stop - start)], ["start", "length"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(shard.ids)))]).astype(np.int32)), spans)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.ids), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(text[~gone].tobytes())])
        if whole_characters:
            uncut = (np.diff(lists.offsets) == 0).tolist()
            data = pa.array([x if same else x.decode("utf-8", "ignore").encode() for x, same in zip(data.to_pylist(), uncut, strict=True)], pa.large_binary())
        out = {"doc_id": pa.array(shard.ids, mask=shard.ids == NO_ID), "kept": data.cast(pa.binary()), "spans": lists}
        if keep:
            out["row"] = pa.ipc.open_stream(pa.py_buffer(shard.rows.tobytes())).read_all().column("row")
        return pa.table(out)

    by_shard = packed.groupBy("key")
    hits = by_shard.applyInArrow(freed_group(anchors), ROWS).groupBy("key").applyInArrow(freed_group(repeated), ROWS)
    found = by_shard.cogroup(hits.groupBy("key")).applyInArrow(freed_group(fragments), ROWS)
    marks = found.groupBy("key").applyInArrow(freed_group(merged), ROWS)
    return by_shard.cogroup(hits.union(marks).groupBy("key")).applyInArrow(freed_group(cut), with_row(OUT, docs, keep))


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
