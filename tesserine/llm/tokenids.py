"""Token ids in binary form, compressed by Re-Pair grammars.

Documents are encoded, closed with the end id and dealt out by ranges of doc_id, so that shard
after shard holds them in ascending order. Each shard is cut into blocks of whole documents, of about
``BLOCK_TOKENS`` tokens, which are what a task holds at once; a block has a grammar of its own. In a
block, frequent pairs of neighbouring ids are replaced by nonterminals again and again; a block
stores its rules, the length that each rule expands to, and the remaining sequence. The lengths
tell where a token lies, so any slice is decoded without the rest of the block (``read_slice``).

File format: a Parquet table, so that it can live in any store that Spark writes to, with one row
a block: ``shard`` (least doc_id and hash of the shard, as text that sorts), ``block`` (number in
the shard), ``start`` (tokens of the shard before the block), ``n_tokens``, ``doc_ids``,
``doc_tokens`` (arrays) and ``payload``. The payload is little-endian:

    4 bytes  b"RPG1"
    uint32   base: ids below are terminals
    uint32   number of rules
    uint32   number of symbols
    uint32   left, right and expansion length of each rule, three arrays
    symbols  uint16 if all are below 65536, else uint32

Nulls and edge cases: a null text counts as empty (its end id alone); null doc_ids come first;
documents with the same doc_id follow one another in the order of their texts' hashes; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import END_ID, encoder, freed, scratch, slices, table, tokenizer_path

MAGIC = b"RPG1"
#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 18

BLOCK_SCHEMA = (
    "shard string, block long, start long, n_tokens long, doc_ids array<long>, "
    "doc_tokens array<long>, payload binary"
)
RESULT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


# -- grammar ----------------------------------------------------------------


#: Places of the table that tells which pairs were frequent.
PLACES = 1 << 18


def _place(keys: np.ndarray) -> np.ndarray:
    """A place of the table for each pair; several pairs may share one."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).view(np.int64)


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (as left << 32 | right, sorted) that occur ``least`` times, and how often they do."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    often = count >= least
    return keys[first[often]], count[often]


def _choose(pairs: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The frequent pairs to replace in one round, sorted: the most frequent ones
    such that no id is a left member of one and a right member of another, which keeps their
    places apart. The id of a pair of equal ids is in no other pair."""
    pairs = pairs[np.argsort(-count, kind="stable")[:most]]
    lefts, rights, chosen = set(), set(), []
    for key, a, b in zip(pairs.tolist(), (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
        if a not in rights and b not in lefts and (a != b or a not in lefts and a not in rights):
            lefts.add(a)
            rights.add(b)
            chosen.append(key)
    return np.sort(np.array(chosen, np.uint64))


def compress(ids: np.ndarray, least: int = 6, rounds: int = 24, most: int = 4096) -> bytes:
    """Payload of one block. ``least``: occurrences that make a rule worth its 12 bytes. A round replaces up to
    ``most`` pairs at once; rounds end where no pair occurs ``least`` times, after ``rounds``, or once a round
    shortens the sequence by less than 0.4 per cent.

    A pair that is too rare in one round never grows frequent, as replacing takes places from it; so a round
    looks only at the places of pairs that were frequent before or hold a new symbol (``live``)."""
    base = int(ids.max()) + 1 if len(ids) else 0
    s = ids.astype(np.uint32)
    left, right, lengths = [], [], [np.ones(base, np.uint32)]
    size = base
    live = np.arange(len(s) - 1)
    for _ in range(rounds):
        if len(s) < 2 * least:
            break
        keys = (s[live].astype(np.uint64) << np.uint64(32)) | s[live + 1]
        places = _place(keys)
        full = np.flatnonzero(np.bincount(places, minlength=PLACES)[places] >= least)  # other pairs occur less often
        live, keys, places = live[full], keys[full], places[full]
        if not len(keys):
            break
        frequent, count = _frequent(keys, least)
        if not len(frequent):
            break
        pairs = _choose(frequent, count, most)
        a, b = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        asked = np.zeros(PLACES, bool)
        asked[_place(pairs)] = True
        hit = np.flatnonzero(asked[places])
        rank = np.minimum(np.searchsorted(pairs, keys[hit]), len(pairs) - 1)
        same = pairs[rank] == keys[hit]
        at, rank = live[hit[same]], rank[same]
        twin = a[rank] == b[rank]
        if twin.any():  # in a run of one id, every other place
            runs = at[twin]
            first = np.diff(runs, prepend=-2) > 1
            twin[twin] = (runs - np.maximum.accumulate(np.where(first, runs, 0))) % 2 == 1
            at, rank = at[~twin], rank[~twin]
        s[at] = (size + rank).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        asked[:] = False
        asked[_place(frequent)] = True
        mark = np.zeros(len(s), bool)
        mark[live] = asked[places]
        mark = mark[keep]
        shrunk = len(at) / len(s)
        s = s[keep]
        new = at - np.arange(len(at))
        mark[new] = True
        mark[np.maximum(new - 1, 0)] = True
        live = np.flatnonzero(mark[:-1])
        known = np.concatenate(lengths)
        left.append(a)
        right.append(b)
        lengths.append(known[a] + known[b])
        size += len(pairs)
        if shrunk < 0.004:
            break
    cat = lambda x: np.concatenate(x).astype("<u4") if x else np.zeros(0, "<u4")
    rules = cat(left)
    body = s.astype("<u2" if size <= 1 << 16 else "<u4")
    head = MAGIC + struct.pack("<III", base, len(rules), len(s))
    return head + rules.tobytes() + cat(right).tobytes() + cat(lengths[1:]).tobytes() + body.tobytes()


def _parts(payload: bytes):
    """(base, left, right, expansion lengths of all symbols, symbols) of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a grammar block")
    base, rules, n = struct.unpack_from("<III", payload, 4)
    left, right, lengths = (np.frombuffer(payload, "<u4", rules, 16 + 4 * rules * k) for k in range(3))
    kind = "<u2" if base + rules <= 1 << 16 else "<u4"
    return base, left, right, np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)]), np.frombuffer(payload, kind, n, 16 + 12 * rules).astype(np.int64)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + size[i] - 1 of all i one after another."""
    ends = np.cumsum(size)
    out = np.repeat(first - (ends - size), size)
    out += np.arange(len(out))
    return out


def _expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids that the symbols stand for. Every pass replaces each nonterminal by its two parts."""
    while True:
        rule = symbols >= base
        if not rule.any():
            return symbols.astype("<u4")
        at = np.flatnonzero(rule)
        out = np.repeat(symbols, rule.astype(np.int64) + 1)
        place = at + np.arange(len(at))
        which = symbols[at] - base
        out[place], out[place + 1] = left[which], right[which]
        symbols = out


def decompress(payload: bytes) -> np.ndarray:
    """All ids of a block. Every rule is expanded once; the sequence then gathers expansions."""
    base, left, right, lengths, symbols = _parts(payload)
    own = lengths[base:]
    if not len(own):
        return symbols.astype("<u4")
    flat = np.concatenate([np.arange(base, dtype="<u4"), _expand(np.arange(base, base + len(own)), base, left, right)])
    first = np.concatenate([np.arange(base), base + np.cumsum(own) - own])
    return flat[_ragged(first[symbols], lengths[symbols])]


def read_slice(payload: bytes, start: int, length: int) -> np.ndarray:
    """The ids start .. start + length - 1 of a block; only the symbols over them are expanded."""
    base, left, right, lengths, symbols = _parts(payload)
    ends = np.cumsum(lengths[symbols])
    lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + length, side="left") + 1
    part = symbols[lo:hi]
    before = start - (int(ends[lo - 1]) if lo else 0)
    return _expand(part, base, left, right)[before : before + length]


# -- tables -----------------------------------------------------------------


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
                 tokenizer: str | None = None) -> DataFrame:
    """Encode all documents into blocks, in ascending doc_id order within and across shards."""
    path = tokenizer or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        shard, number, start = None, 0, 0
        ids, doc_ids, counts, held = [], [], [], 0
        schema = pa.schema([("shard", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])

        def close():
            nonlocal number, start, held
            flat = np.concatenate(ids)
            row = {"shard": shard, "block": number, "start": start, "n_tokens": len(flat), "doc_ids": list(doc_ids), "doc_tokens": list(counts), "payload": compress(flat)}
            number, start, held = number + 1, start + len(flat), 0
            for x in (ids, doc_ids, counts):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        end = np.array([END_ID], np.uint32)
        for batch in batches:
            keys, names = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for first, texts in slices(batch, "text"):
                found, bounds = enc.encode(texts)
                for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    doc = keys[first + k]
                    if shard is None:  # sorts as doc_id, then hash; nulls first
                        shard = f"{0 if doc is None else doc + (1 << 63) + 1:020d}-{names[first + k] + (1 << 63):020d}"
                    ids += [found[lo:hi], end]
                    doc_ids.append(doc)
                    counts.append(hi - lo + 1)
                    held += hi - lo + 1
                    if held >= BLOCK_TOKENS:
                        yield close()
        if doc_ids:
            yield close()

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cols = cols.withColumn("h", F.xxhash64("text"))
    by = ["doc_id", "h"]
    dealt = cols.repartitionByRange(shards, *by) if shards else cols.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).mapInArrow(freed(run), BLOCK_SCHEMA)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Every document of written blocks: its place among all ids, its length and checksum.

    Only one total a shard reaches the driver; shards are as many as partitions."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    offsets, at = {}, 0
    for r in totals:
        offsets[r.shard] = at
        at += r.n

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, payload = (batch.column(c)[row].as_py() for c in ("shard", "start", "payload"))
                counts = np.array(batch.column("doc_tokens")[row].as_py(), np.int64)
                ids, ends = decompress(payload), np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                begin = ends - counts
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(begin + (offsets[shard] + start)), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("shard", "start", "doc_ids", "doc_tokens", "payload").mapInArrow(freed(run), RESULT_SCHEMA)


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    return read_documents(scratch(write_blocks(table(spark, sf_dir, "documents")), "token-ids"))
