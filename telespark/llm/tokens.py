"""Token ids by a public byte-level BPE tokenizer, and token tables in ORC."""

from __future__ import annotations

import functools
import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm.common import Recent, blocks, shared_dir, small_batches, take_over

#: White space as Unicode has it, which is also what the pre-tokenizer takes for it.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A byte-level pre-tokenizer always splits before white space and, in a run of it, before the last character if a word
#: follows.
_UNITS = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])").split
_RUN = re.compile(f"[{_SPACE}][{_SPACE}]").search
#: Signs that may follow letters: the pre-tokenizer always splits between these and a letter, but for the apostrophe.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters from here on are left to the tokenizer: its tables and Python's may differ on when a sign became a letter.
_SETTLED = "\u0530"
#: Of how many units a worker keeps the ids at least; it keeps twice as many at most, of about 200 bytes each.
KEPT = 600_000
_ID = operator.attrgetter("id")
_encoders: dict[tuple[str, bool, int], "_Encoder"] = {}


def default_tokenizer() -> str:
    """The public vocabulary file of 50,257 ids that ships with the installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest in turn
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.cache
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def _packed(ids: list[int]) -> bytes:
    return _packer(len(ids))(*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()


class _Encoder:
    """Ids of texts by one vocabulary.  Texts are cut into units where the pre-tokenizer splits in any case, and the ids
    of units met lately are kept.  A unit's key is the unit, without the space that it begins with if it is one space.
    """

    def __init__(self, path: str, added_tokens: bool, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.model, self.letters = self.tokenizer.model, _visible()
        told = json.loads(Path(path).read_text())
        split, added = told.get("pre_tokenizer") or {}, self.tokenizer.get_added_tokens_decoder().values()
        known = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told["model"]["type"] == "BPE"
        #: Whether texts may be cut: so far as its file tells, the vocabulary splits as a byte-level one does.  Where not,
        #: texts are left to the tokenizer whole.
        self.cut = known and not any(told.get(x) for x in ("normalizer", "truncation", "padding")) and all(t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added)
        names = sorted((re.escape(t.content) for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(names)})") if names and added_tokens else None
        self.kept = Recent(self.of_key, kept)
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        self.signs = functools.lru_cache(4096)(self.merged)

    def plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, piece: str) -> bytes:
        """Ids of what is one piece to the pre-tokenizer."""
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return _packed(list(map(_ID, self.model.tokenize(shown))))

    def of_key(self, key: str) -> bytes:
        start = "\n" if key[:1] == "\n" else ""
        signs = key[len(word := key.rstrip(_SIGNS)) :]
        word = word[len(start) :]
        if not word.isalpha() or not (word.isascii() or max(word) < _SETTLED):
            return self.plain(key if key and key[0] in _SPACE else f" {key}")
        if start:
            out = self.signs("\n") + self.merged(word)
        elif signs:
            out = self.kept[word]
        else:  # letters take the space before them along
            out = self.merged(f" {word}")
        return out + self.signs(signs) if signs else out

    def keys(self, text: str) -> list[str]:
        """Keys of a text's units.  The first is that of the text's beginning with a line feed before it; such a key is
        left out where the text begins with white space, after which units stand as they are."""
        if _RUN(text):
            units = _UNITS(text)
            keys = [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in _SPACE else u for u in units]
            return keys if text[0] in _SPACE else [f"\n{units[0]}", *keys[1:]]
        first, *keys = text.replace("\n", " \n").split(" ")
        return [first if first[0] in _SPACE else f"\n{first}", *keys] if first else keys

    def parts(self, text: str | None) -> list[str | bytes]:
        """What a text is put together from: texts to be cut, and ids."""
        if not text:
            return []
        if not self.cut:
            return [self.plain(text)]
        if self.added and self.added.search(text):
            return [self.plain(p) if k % 2 else p for k, p in enumerate(self.added.split(text)) if p]
        return [text]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.kept.__getitem__

        def of_part(part: str | bytes) -> bytes:
            if isinstance(part, bytes):
                return part
            ids = b"".join(map(get, self.keys(part)))
            return ids if part[0] in _SPACE else ids[4:]

        return [b"".join(map(of_part, self.parts(t))) for t in texts]


def _encoder(path: str, added_tokens: bool, kept: int) -> _Encoder:
    take_over("tokens", _encoders.clear)
    key = path, added_tokens, kept
    return _encoders[key] if key in _encoders else _encoders.setdefault(key, _Encoder(*key))


def check_ids(path: str, bits: int, kept: int = KEPT) -> None:
    """Raises an error if an id of the vocabulary doesn't fit in so many bits."""
    most = _encoder(path, True, kept).largest
    if most >> bits:
        raise ValueError(f"id {most} of {path} needs more than {bits} bits")


def encode(texts: list[str | None], path: str, *, added_tokens: bool = False, kept: int = KEPT) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; none for null and empty texts.

    A text is cut where the tokenizer cuts it anyway, and the ids of what was met lately are reused; texts of a vocabulary
    that may cut otherwise are left to the tokenizer whole.  With ``added_tokens`` the vocabulary's added tokens in a text
    become their own ids, as the tokenizer's default has it; without, they are text like any other
    (``encode_special_tokens``).  ``kept``: of how many units ids are kept.
    """
    return _encoder(path, added_tokens, kept).encode(texts)


def crc(ids: memoryview | bytes) -> int:
    return zlib.crc32(ids)


def write_orc(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, partitions: int | None = None, row_index: int = 1000, added_tokens: bool = False) -> None:
    """Writes doc_id and ids (array<int>) of rows with columns doc_id and text, in ascending doc_id order.

    Null ids come first; rows of one id are in the order of their text's hash.  Each document ends with ``end_id``, which
    is all that a null or empty text has.  The files are split by ranges of doc_id and sorted inside, so the order
    of the numbers in their names is the documents' order; the integers are run-length encoded, and each stripe has row indexes and a Bloom
    filter on doc_id, with which readers skip stripes and row groups.
    """
    spark = docs.sparkSession
    n = partitions or max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    end = np.array([end_id], dtype="<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for at, texts in blocks(b.column("text")):
                found = [x + end for x in encode(texts, tokenizer, added_tokens=added_tokens)]
                flat = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(bounds), flat)], ["doc_id", "ids"])

    ordered = (
        small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(made, "doc_id long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index)
        .option("compression", "zstd")
        .orc(path)
    )


def read_orc(spark, path: str) -> DataFrame:
    """doc_id and ids of a token table; filters on doc_id prune its stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of a token table, start by sums over files and then over rows.

    A file's rows are in order and files are in the order of the numbers in their names; a file may be read in several
    splits, so rows are placed by file and by their position in it.
    """
    placed = tokens.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            lists = b.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crcs = [crc(flat[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            rows = np.arange(k, k + len(b), dtype=np.int64)
            k += len(b)
            cols = [b.column("doc_id"), b.column("file"), b.column("block"), pa.array(rows), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "file", "block", "row", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(summed, "doc_id long, file string, block long, row long, n_tokens long, ids_crc32 long")


def with_starts(parts: DataFrame) -> DataFrame:
    """Adds start, the sum of n_tokens of all rows before, to rows with file, block and row.

    Only one row for each split of a file meets in one task; inside a split the sum runs over its own rows.
    """
    split = Window.partitionBy("file", "block")
    totals = parts.groupBy("file", "block").agg(F.sum("n_tokens").alias("_t"))
    # as a number: names have five digits at least, so their text order ends with the 100,000th file
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    upto = Window.partitionBy(F.lit(0)).orderBy(number, "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", "block", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n_tokens").over(split.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_inside", inside).join(base, ["file", "block"]).withColumn("start", F.col("_base") + F.col("_inside"))


def new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
