"""What the corpus operators share: tables, scratch storage in the shared folder, tokens."""

from __future__ import annotations

import re
from array import array
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.sources.scratch import drop_scratch, scratch, shared_dir  # noqa: F401

#: Java regex of the separators between words: ASCII white space only.
WS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same separators as SQL's trim() takes them.
WS_CHARS = " \t\n\x0b\x0c\r"

#: Id that ends every document in the token operators.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim():
    """glibc's malloc_trim, which hands freed pages back; None elsewhere."""
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def free() -> None:
    """Hand back what this Python worker holds beyond its live objects: workers are used again by the
    stages to come, and an executor's memory is that of all its workers."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def freed(run):
    """A function for mapInArrow that frees memory once the task's batches are through."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            free()

    return go


def freed_group(run):
    """A function for applyInArrow of one or two groups that frees memory after each."""
    if len(signature(run).parameters) == 2:

        def two(a, b):
            try:
                return run(a, b)
            finally:
                free()

        return two

    def one(a):
        try:
            return run(a)
        finally:
            free()

    return one


def row_of(docs: DataFrame, keep: tuple[str, ...]) -> list:
    """The column ``row``, a struct of the columns to keep; none if there are none."""
    return [F.struct(*[docs[c] for c in keep]).alias("row")] if keep else []


def with_row(schema: str, docs: DataFrame, keep: tuple[str, ...]):
    """``schema`` with row_of()'s column."""
    if not keep:
        return schema
    row = T.StructType([docs.schema[c] for c in keep])
    return T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("row", row)])


def words_col(text) -> "F.Column":
    """Array of the words of a text; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def word_count(text) -> "F.Column":
    """Number of words of a text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WS))).cast("long")


def slices(batch, column: str, limit: int = 16 << 20):
    """(first row, texts) of runs of a batch whose column holds about ``limit`` bytes at most
    (or one text), so that a batch of very long texts is never expanded at once. The texts are
    an Arrow array with empty strings for nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    held = pc.cumulative_sum(pc.cast(pc.binary_length(col), pa.int64())).to_numpy(zero_copy_only=False)
    start, base = 0, 0
    while start < len(col):
        stop = max(start + 1, int(held.searchsorted(base + limit, side="right")))
        yield start, col.slice(start, stop - start)
        start, base = stop, int(held[stop - 1])


class Encoder:
    """Ids of texts by the tokenizers library.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    white-space separated chunks one after another. A column's distinct chunks are looked up; a
    new chunk of Latin-1 characters is cut into the tokenizer's own units (runs of letters,
    digits, runs of other signs), of which each new one goes to the library; any other new chunk
    goes there whole. New chunks are cut, looked up and put together many at a time, as one text. Before each slice, the memories of chunks and of units start anew once they hold more than
    ``keep`` and ``keep_units`` bytes.
    """

    #: Chunks whose units the pattern below finds as the tokenizer does.
    PLAIN = re.compile("[!-~\xdf-\xf6\xf8-\xff\xc0-\xd6\xd8-\xde]+")
    LETTERS = "a-z\xdf-\xf6\xf8-\xff"
    UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^{LETTERS}0-9\n]+")
    #: What stands for the line break between two chunks; no id is as large.
    BREAK = b"\xff" * 4

    #: Bytes of an entry besides its text and ids: two objects and a place in a table.
    ENTRY = 190

    def __init__(self, path: str, keep: int = 32 << 20, keep_units: int = 96 << 20):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.keep_units = Tokenizer.from_file(path), keep, keep_units
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {"\n": self.BREAK}
        self.held = self.held_units = 0
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # the ids that end a unit
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn_units(self, fresh: list[str]) -> None:
        """Encode new units, many in one text; an id that ends a unit tells where the next begins."""
        import numpy as np

        for k in range(0, len(fresh), 500):
            part = fresh[k : k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw, at = ids.tobytes(), 0
            if len(stops) != len(part):
                self.units.update(zip(part, self._encode(part), strict=True))
                continue
            for unit, stop in zip(part, stops.tolist(), strict=True):
                self.units[unit] = raw[at:stop]
                at = stop

    def _learn(self, fresh: list[str]) -> None:
        for k in range(0, len(fresh), 5_000):
            part = fresh[k : k + 5_000]
            plain = [c for c in part if self.PLAIN.fullmatch(c) and "<|" not in c]
            if plain:
                found = self.UNITS.findall("\n".join(plain).lower())
                wanted = [u for u in dict.fromkeys(found) if u not in self.units]
                self._learn_units(wanted)
                self.held_units += sum(map(len, wanted)) * 2 + self.ENTRY * len(wanted)
                coded = b"".join(map(self.units.__getitem__, found)).split(self.BREAK)
                self.known.update(zip(plain, coded, strict=True))
            if len(plain) < len(part):
                whole = [c for c in part if c not in self.known]
                self.known.update(zip(whole, self._encode(whole), strict=True))
            self.held += sum(map(len, part)) * 2 + self.ENTRY * len(part)

    def encode(self, texts):
        """(ids as uint32, offsets) of an Arrow array of texts without nulls; no end ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.held > self.keep:
            self.known, self.held = {}, 0
        if self.held_units > self.keep_units:
            self.units, self.held_units = {"\n": self.BREAK}, 0
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        self._learn([w for w in words if w not in self.known])
        parts = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[codes])])
        at = np.repeat(first[codes] - ends[:-1], size[codes])
        at += np.arange(len(at))
        return flat[at], ends[bounds - bounds[0]]


    def forget(self) -> None:
        self.known, self.units, self.held, self.held_units = {}, {"\n": self.BREAK}, 0, 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once in each Python worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
