"""Best-fit packing of tokenised documents into sequences, in bulk steps.

Documents are tokenised where they are read; only pieces (a few numbers each) are shuffled. Pieces and gaps are rows
that are range-sorted by size together; sweeps over the partitions, and over what these leave to each other, match
pieces with their successors, conflicts are resolved by rank, gaps shrink, and the round repeats with what is left.
All pieces of a table are packed against the same gaps. The driver sees counts: of lengths, and two a partition.

Defined cases: a null or empty text is the closing id alone; only texts longer than a sequence are cut; repeated
rows are packed each; a row without id is packed too; other columns are not needed and not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpoint, slices, table, texts

#: Ids a sequence holds, and the id that closes a document.
CAPACITY, CLOSE = 4096, 1
#: Words that a worker remembers before it starts over.
REMEMBERED = 500_000
#: Characters of the longest word that is remembered.
LONG_WORD = 100
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """The ids of texts by a tokenizer that drops white space, word by word: words that were seen before are looked up.

    A new word goes through the library's model if all its characters are in FAMILIAR, where Python and the library
    agree about letters, case and composition; else, and if it may hold a special token, through the whole library.
    """

    #: Fixed value: the pre-tokenizer's pattern in the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Control characters that Python takes for white space and the tokenizer doesn't.
    ODD = re.compile(r"[\x1c-\x1f]")
    #: Printable ASCII, Latin, Cyrillic, kana, Han, Hangul, general punctuation.
    FAMILIAR = re.compile(r"[!-~\u00a1-\u024f\u0400-\u0481\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\u2010-\u2027\u2030-\u2046]+")

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(self.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes as printable characters: those that are not, from 256 on in order.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(odd)}
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a word without white space; its pieces are words too."""
        known = self.known
        familiar = word.isprintable() if word.isascii() else self.FAMILIAR.fullmatch(word)
        if not familiar or ("<" in word and any(t in word for t in self.special)):
            found = self._whole(word)
        elif (lowered := word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()) != word:
            found = known.get(lowered) or self._learn(lowered)
        elif not word.isalpha() and len(pieces := self.find(word)) != 1:
            found = b"".join([known.get(p) or self._learn(p) for p in pieces])
        else:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= LONG_WORD:
            known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.ODD.search(text):
            return self._whole(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, learn = self.known.get, self._learn
        return b"".join([known(w) or learn(w) for w in text.split()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """Loaded once in each Python worker."""
    return WordTokenizer(path)


def token_pieces(df: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows of _PIECES for each document: its ids with the closing one, cut only where longer than a sequence."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        close = CLOSE.to_bytes(4, "little")
        for batch in batches:
            for part in slices(list(zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)), lambda r: len(r[1])):
                rows = []
                for doc, x in part:
                    ids = words.encode(x) + close
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])

    return df.select(F.col(ident).cast("long"), text).mapInArrow(run, _PIECES)


#: A gap (0) comes before a piece (1) of its size; rows are dealt by the numbers given to them, so equal rows are spread.
_GAP, _PIECE = 0, 1
_ROW = f"kind int, row long, {_PIECES}, sequence_id long, offset long"
_SWEPT = f"{_ROW}, part int, nth long, many long"
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the rows of one partition, largest first: a piece takes a place of the last gap before it that has any.

    Gaps come at the end, with the places they have left (many) and how many are left in those before (nth). A piece
    that found no gap here is numbered (nth) and has no sequence.
    """
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    gaps: list[list[int]] = []
    free: list[int] = []  # gaps that have places left, the smallest on top
    alone = 0
    for batch in batches:
        kinds, rows, lengths, places, sequences = (batch.column(c).to_pylist() for c in ("kind", "row", "length", "places", "sequence_id"))
        nth: list[int] = []
        for k, kind in enumerate(kinds):
            if kind == _GAP:
                if places[k]:
                    free.append(len(gaps))
                gaps.append([rows[k], lengths[k], sequences[k], places[k]])
            elif free:
                gap = gaps[free[-1]]
                sequences[k] = gap[2]
                gap[3] -= 1
                if not gap[3]:
                    free.pop()
                nth.append(0)
            else:
                nth.append(alone)
                alone += 1
        found = pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sequences, pa.int64()), batch.column("offset")], names[:9])
        found = found.filter(pa.array([k == _PIECE for k in kinds], pa.bool_()))
        n = len(nth)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(n, part, np.int32)), pa.array(nth, pa.int64()), pa.array(np.zeros(n, np.int64))], names)
    below = 0
    for at in range(0, len(gaps), 10_000):
        some = gaps[at : at + 10_000]
        rows, lengths, sequences, many = (np.array(c, np.int64) for c in zip(*some, strict=True))
        before = below + np.cumsum(many) - many
        below += int(many.sum())
        none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), _GAP, np.int32)), pa.array(rows), *none, pa.array(lengths), pa.nulls(len(some), pa.int64()), pa.array(sequences), pa.nulls(len(some), pa.int64()), pa.array(np.full(len(some), part, np.int32)), pa.array(before), pa.array(many)], names)


def _levels(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of each partition: the places that are free when it begins, and how far later partitions use them up.

    found: partition, pieces without gap, and places left, in the order of the sweep. Free places are numbered like the
    entries of a stack: a piece takes the highest number, and a number that is used again belongs to a later gap.
    """
    rows, level = [], 0
    for part, alone, left in found:
        rows.append((part, level, level - alone))
        level += left - alone
    out, lowest = [], 1 << 60
    for part, level, low in reversed(rows):
        out.append((part, level, lowest))
        lowest = min(lowest, low)
    return out[::-1]


def _across(swept: DataFrame) -> DataFrame:
    """Rows of _ROW of the swept rows, after pieces without a gap have taken places that earlier partitions have left."""
    names = [c.split()[0] for c in _ROW.split(", ")]
    lonely = (F.col("kind") == _PIECE) & F.col("sequence_id").isNull()
    # One row a partition.
    found = swept.groupBy("part").agg(F.count_if(lonely).alias("alone"), F.sum("many").alias("left")).orderBy("part").collect()
    levels = _levels([tuple(r) for r in found])
    if not any(level + r["left"] - r["alone"] > low for r, (_, level, low) in zip(found, levels, strict=True)):
        return swept.select(names)
    rows = [(part, level, level - r["alone"], low) for r, (part, level, low) in zip(found, levels, strict=True)]
    known = F.broadcast(swept.sparkSession.createDataFrame(rows, "part int, level long, rest long, low long"))
    asked = swept.where(lonely).join(known, "part").select(*names, "part", (F.col("level") - F.col("nth")).alias("level"))
    # A number for each place that a later partition uses, so there are as many as pieces that take one.
    first, last = F.greatest(F.col("rest") + F.col("nth"), F.col("low")) + 1, F.col("rest") + F.col("nth") + F.col("many")
    left = swept.where((F.col("kind") == _GAP) & (F.col("many") > 0)).join(known, "part").where(first <= last)
    left = left.select(*names, "part", F.explode(F.sequence(first, last)).alias("level"))
    # At most two rows of each partition have the same level: in the sweep's order a piece, then a place.
    before = F.lag("sequence_id").over(Window.partitionBy("level").orderBy("part", F.col("kind").desc()))
    taken = asked.unionByName(left).withColumn("sequence_id", F.when(F.col("kind") == _PIECE, before).otherwise(F.col("sequence_id")))
    return swept.where(~lonely).select(names).unionByName(taken.where(F.col("kind") == _PIECE).select(names))


def _counts(state: DataFrame) -> dict[int, np.ndarray]:
    """How many gaps (by what is used) and pieces without a sequence (by length) there are: counts by length, whatever the input."""
    found = state.where((F.col("kind") == _GAP) | F.col("sequence_id").isNull()).groupBy("kind", "length").count().collect()
    most = max([r["length"] for r in found], default=0)
    counts = {k: np.zeros(most + 1, np.int64) for k in (_GAP, _PIECE)}
    for r in found:
        counts[r["kind"]][r["length"]] = r["count"]
    return counts


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset, gapless from 0 in each sequence; columns as _PIECES, lengths from 1 to the capacity.

    In rounds, the longer pieces (over an eighth of a sequence) before the others:
    - A gap offers as many places as it could hold of the longest piece that is left, or one if it is smaller.
    - Places and pieces are range-sorted by size, descending. A sweep over each partition, and one over what the
      partitions have left, give each piece its successor: the smallest place before it that no longer piece has taken.
      Of pieces that want the same place, the first in rank gets it, and the others the next larger ones.
    - Pieces get their offsets in their sequence, gaps shrink, and the pieces without a place go on to the next round.
    - Sequences are opened only for what the gaps can't hold: for lengths beyond all gaps together, for pieces over
      half a sequence, and if a round has placed nothing.
    """
    spark = pieces.sparkSession
    fields = [c.split() for c in _ROW.split(", ")]
    names = [n for n, _ in fields]

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select([given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])

    base = rows(pieces, kind=F.lit(_PIECE), row=F.monotonically_increasing_id(), **{c: F.col(c) for c in _COLUMNS})
    base = checkpoint(base)  # from here on a row keeps its number
    is_piece, lonely = F.col("kind") == _PIECE, (F.col("kind") == _PIECE) & F.col("sequence_id").isNull()
    done: list[DataFrame] = []
    gaps, opened = base.limit(0), 0
    for low, high in ((capacity // 8, capacity), (0, capacity // 8)):
        state, before = base.where((F.col("length") > low) & (F.col("length") <= high)).unionByName(gaps), -1
        while left := int((counts := _counts(state))[_PIECE].sum()):
            asked, used = counts[_PIECE], counts[_GAP]
            lengths, at = np.flatnonzero(asked), np.flatnonzero(used)
            shortest, longest, many, rooms = int(lengths[0]), int(lengths[-1]), used[at], capacity - at
            total = int((asked * np.arange(len(asked))).sum())
            room = int((many * rooms)[rooms >= shortest].sum()) if left != before else 0
            wide = int(asked[capacity // 2 + 1 :].sum())
            wide -= int(many[rooms > capacity // 2].sum()) if wide else 0
            need, before = max(-((room - total) // capacity), wide, 0), left
            new = rows(spark.range(opened, opened + need), kind=F.lit(_GAP), row=F.col("id"), length=F.lit(0), sequence_id=F.col("id"))
            opened += need

            free = F.lit(capacity) - F.col("length")
            places = F.when(is_piece | (free < shortest), 0).otherwise(F.greatest(F.lit(1), F.floor(free / longest))).cast("long")
            size = F.when(is_piece, F.col("length")).otherwise(F.floor(free / F.greatest("places", F.lit(1)))).cast("long")
            by = [F.col("size").desc(), F.col("kind"), F.xxhash64("row"), F.col("row")]
            sized = state.unionByName(new).withColumn("places", places).withColumn("size", size)
            swept = checkpoint(sized.repartitionByRange(*by).sortWithinPartitions(*by).select(*names, "places").mapInArrow(_sweep, _SWEPT))

            # A sequence holds at most as many pieces as ids; pieces without one are groups of their own.
            own = Window.partitionBy(F.coalesce("sequence_id", -1 - F.col("row"))).orderBy("kind", F.col("length").desc(), "row")
            ahead = F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            filled = F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            laid = _across(swept).withColumn("ahead", ahead).withColumn("filled", filled)
            laid = checkpoint(rows(laid, **{c: F.col(c) for c in names} | {"length": F.when(is_piece, F.col("length")).otherwise(F.col("filled")), "offset": F.when(is_piece & ~lonely, F.col("ahead"))}))
            done.append(laid.where(is_piece & ~lonely))
            gaps = laid.where(~is_piece & (F.col("length") < capacity))
            state = gaps.unionByName(laid.where(lonely))
    return reduce(DataFrame.unionByName, done or [base]).select(*_COLUMNS, "sequence_id", "offset")


def pack(df: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows of _PIECES with sequence_id and offset: where each piece lies, gapless from 0 in each sequence."""
    return best_fit(token_pieces(df, ident, text, path, capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_best_fit_packing: all documents in sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"))
