"""Where windows of documents may also start in other documents: content-chosen anchors.

A window of W symbols is assigned to the smallest k-gram in it (by hash, the leftmost of equals). The choice depends
on the window's content alone, so equal windows have equal anchors at equal places. Consecutive windows with the
same anchor occurrence make one record of 13 bytes. Anchors only route: no hash decides that something goes.

Records meet by anchor. If two documents share a window, then its anchor, and half of what else a window holds to the
left or to the right of that; so a record has 8 bits of a hash of each side, and those that agree with no other
document's in one of them are dropped. What remains gets a key that depends on the anchor alone, so equal windows get
equal keys:
- Of an anchor with few records, the key is its leader, the smallest document that has it, and the leader's block of
  BLOCK places in which the anchor is. Neighbouring anchors that several documents share mostly have one leader, so
  what a document shares comes as one long stretch. A key has a bounded number of symbols, as a block has a bounded
  number of anchors with FEW records each.
- Of any other anchor the key is the anchor itself. What a slice has in more than HOT documents (an anchor with one
  side) is not sent by that slice but for its least and greatest document; its records are known to be candidates and
  are dealt evenly. So are all of an anchor that a slice has in more than WILD documents, whatever the sides.

The symbols of all candidates are then brought together by key, for the caller to compare. Before that shuffle equal
contents of a task leave those of the smallest document (the others' windows are settled, symbol by symbol), and an
anchor with more symbols than one task should hold is split by the hash of each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, run_bounds, slices, texts, tidy

#: An odd multiplier of rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of contents that a task remembers to settle equal ones before they are shuffled.
KNOWN = 10_000_000
#: Characters of text that one slice of records is made from, unless a single text is longer.
SENT = 700_000
#: Places of a leader that share a key; most records of an anchor that is keyed by its leader.
BLOCK, FEW = 512, 32
#: Records for each bucket, on average, that a task puts together before it deals them out, as rows of slices alone would
#: grow with the square of the input, by slices and by buckets; records that it holds, unless a slice has more; and
#: documents of a row.
DEALT, HELD, DOCS = 1_000, 1_000_000, 30_000
#: Documents of one slice from which an anchor with one side, or with any, is told of rather than sent.
HOT, WILD = 8, 64
#: Split keys that are broadcast; more are joined.
SPLIT = 50_000
#: Bits of a place within a slice; hashes are compared above them.
PLACE_BITS = 31
#: A candidate span, `at` being its first window and number of windows (see AT); or, without doc, the number of windows
#: and of symbols that one task has for an anchor. Keys of leaders are even, those of anchors odd.
SPANS = "doc long, mark long, at long, key long, windows long, size long"
AT = 64
#: Windows of a document that may repeat, also those from the starts in `more` on, and their symbols; without content,
#: in `more` the starts and numbers of the windows that a smaller document of the same task has, symbol by symbol.
CONTENTS = "key long, doc long, mark long, start int, n int, more array<int>, content binary"
#: What goes: n windows of a document from `start` on; and the same as it leaves a task, starts and numbers by turns.
GONE, PACKED = "doc long, mark long, start int, n int", "doc long, mark long, gone array<int>"
#: Rows of GONE that a task puts together by document.
PACK = 100_000
#: A row is what some slices of a task have for one bucket, in the narrowest types: 13 bytes a record. Of the hash the
#: bucket and 32 bits are kept. Rows are dealt by bucket, or evenly where they are known to be candidates.
_RECORDS = "dealt int, known boolean, bucket int, docs array<long>, marks array<long>, doc array<smallint>, low array<smallint>, high array<smallint>, n array<tinyint>, anchor array<int>, left array<tinyint>, right array<tinyint>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and INVERSE, as many as have been needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b))]) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def records(symbols: np.ndarray, sizes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of documents end to end: document, first window, number of windows, anchor hash, and 8 bits of each side."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return (none,) * 6
    up, down = POWERS.upto(n + 1)
    total = np.r_[np.uint64(0), np.cumsum(mixed(symbols + np.uint64(0x632BE59BD9B4E019)) * up[:n])]
    grams = mixed((total[k:] - total[:-k]) * down[: n - k + 1])
    places = np.arange(n - k + 1, dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    at = (sliding_min((grams & ~low) | places, window - k + 1) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    valid = np.flatnonzero(np.arange(len(at)) + window <= ends[doc])
    if not len(valid):
        return (none,) * 6
    at, doc = at[valid], doc[valid]
    fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first = valid[fresh]
    count = np.diff(np.r_[fresh, len(valid)])
    anchor, doc = at[fresh], doc[fresh]
    begin, end = (ends - sizes)[doc], ends[doc]
    side = (window - k + 1) // 2

    def hashed(a: np.ndarray) -> np.ndarray:
        a = np.where((a >= begin) & (a + side <= end), a, begin)  # no such side: anything
        b = np.minimum(a + side, end)
        return (mixed((total[b] - total[a]) * down[a]) >> np.uint64(56)).astype(np.int64)

    return doc, first - begin, count, grams[anchor].view(np.int64), hashed(anchor - side), hashed(anchor + k)


def _send(symbols_of: Callable, window: int, k: int, buckets: int):
    """Rows of records for each bucket. Input: doc, mark, text."""

    def dealt(parts: list, known: bool) -> pa.RecordBatch:
        """Rows of all buckets, from documents, marks and records of slices."""
        docs, marks = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        doc, start, n, anchor, left, right = (np.concatenate(x) for x in zip(*(p[2] for p in parts), strict=True))
        doc = doc + np.repeat(np.cumsum([0, *(len(p[0]) for p in parts[:-1])]), [len(p[2][0]) for p in parts])
        bucket = ((anchor.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        by = np.argsort(bucket, kind="stable")  # by document and place: long runs of equal numbers compress
        bucket, doc, start = bucket[by].astype(np.int32), doc[by], start[by]
        turn = np.r_[True, bucket[1:] != bucket[:-1]]
        fresh = turn | np.r_[True, doc[1:] != doc[:-1]]
        number = np.cumsum(fresh) - 1
        where = number - number[turn][np.cumsum(turn) - 1]
        first = np.flatnonzero(turn | (fresh & (where % DOCS == 0)))
        used = doc[fresh]
        ends, of_docs = np.r_[first, len(doc)], np.r_[number[first], len(used)]
        columns = (docs[used], marks[used], (where % DOCS).astype(np.int16), (start & 0xFFFF).astype(np.uint16).view(np.int16), (start >> 16).astype(np.int16), n[by], anchor[by].astype(np.int32), left[by], right[by])
        bucket = bucket[first]
        head = [pa.array((int(docs[0] & 0xFFFF) + bucket) % buckets if known else bucket, pa.int32()), pa.array(np.full(len(first), known)), pa.array(bucket, pa.int32())]
        return pa.RecordBatch.from_arrays(head + [pa.ListArray.from_arrays(pa.array(of_docs if j < 2 else ends, pa.int32()), pa.array(x)) for j, x in enumerate(columns)], names=[c.split()[0] for c in _RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        for batch in batches:
            rows = [r for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True) if r[0] is not None]
            for part in slices(rows, lambda r: len(r[2]), SENT):
                docs, marks = (np.array([r[j] for r in part], np.int64) for j in (0, 1))
                symbols, sizes = symbols_of([r[2] for r in part])
                found = records(symbols, sizes, window, k)
                doc, start, n, anchor, left, right = found
                if not len(doc):
                    continue
                known, wild, told = np.zeros(len(doc), bool), np.zeros(len(doc), bool), [np.zeros(0, np.int64)]
                for what, most in ((anchor, WILD), (_with(anchor, left), HOT), (_with(anchor, right), HOT)):
                    by = np.argsort(what, kind="stable")
                    starts, ends = run_bounds(what[by])
                    several = np.add.reduceat(np.r_[True, np.diff(doc[by]) != 0].astype(np.int64), starts) > most
                    known[(mine := by[np.repeat(several, ends - starts)])] = True
                    told += [by[a:b][[f(docs[doc[by[a:b]]]) for f in (np.argmin, np.argmax)]] for a, b in zip(starts[several], ends[several], strict=True)]
                    if most == WILD:
                        wild[mine] = True
                # Others are told of known ones by their least and greatest document: no windows, or fewer if any side will do.
                asked = np.unique(np.concatenate([np.flatnonzero(~known), *told]))
                for kind, some, windows in ((True, np.flatnonzero(known), n), (False, asked, np.where(wild, -1, np.where(known, 0, n)))):
                    if len(some):
                        held[kind].append((docs, marks, [x[some].astype(t) for x, t in zip((doc, start, windows, anchor, left, right), (np.int32, np.int32, np.int8, np.int64, np.int8, np.int8), strict=True)]))
                        size[kind] += len(some)
                    if size[kind] >= min(HELD, DEALT * buckets):
                        yield dealt(held[kind], kind)
                        held[kind], size[kind] = [], 0
        for kind, parts in held.items():
            if parts:
                yield dealt(parts, kind)

    return run


def _with(anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Anchor and side as one number."""
    return mixed(anchor.view(np.uint64) + (side.astype(np.uint64) << np.uint64(32))).view(np.int64)


def _agree(what: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Records for which another document has the same."""
    by = np.argsort(what)
    starts, ends = run_bounds(what[by])
    several = np.minimum.reduceat(doc[by], starts) < np.maximum.reduceat(doc[by], starts)
    out = np.zeros(len(what), bool)
    out[by] = np.repeat(several, ends - starts)
    return out


def _keys(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's records: those that are candidates, and their keys."""
    keep = np.flatnonzero(_agree(anchor, doc))
    wild = np.isin(anchor[keep], np.unique(anchor[keep][n[keep] < 0]))
    keep = keep[wild | _agree(_with(anchor[keep], left[keep]), doc[keep]) | _agree(_with(anchor[keep], right[keep]), doc[keep])] if len(keep) else keep
    if not len(keep):
        return keep, keep
    by = keep[np.argsort(anchor[keep])]
    starts, ends = run_bounds(anchor[by])
    sizes = ends - starts
    least = np.minimum.reduceat(doc[by], starts)
    leads = doc[by] == np.repeat(least, sizes)
    place = np.minimum.reduceat(np.where(leads, start[by], np.iinfo(np.int32).max), starts)
    led = (sizes <= FEW) & (np.minimum.reduceat(n[by], starts) > 0)
    leader = mixed(mixed(least.view(np.uint64)) + (place // BLOCK).astype(np.uint64)).view(np.int64) & ~1
    key = np.repeat(np.where(led, leader, anchor[by][starts] | 1), sizes)
    sent = n[by] > 0
    return by[sent], key[sent]


def _spans(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SPANS.split(", ")]
    at = start.astype(np.int64) * AT + n
    for a in range(0, len(doc), 100_000):
        b = slice(a, a + 100_000)
        none = pa.nulls(len(doc[b]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[b]), pa.array(mark[b]), pa.array(at[b]), pa.array(key[b]), none, none], names)
    odd = np.flatnonzero(key & 1)
    if len(odd):
        key, where = np.unique(key[odd], return_inverse=True)
        windows = np.bincount(where, n[odd]).astype(np.int64)
        size = windows + (window - 1) * np.bincount(where)
        none = pa.nulls(len(key), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(key), pa.array(windows), pa.array(size)], names)


def _candidates(window: int):
    """Rows of SPANS whose anchor is in several documents; buckets come one after the other."""

    def unpacked(rows: pa.RecordBatch):
        docs, marks, where, low, high, n, anchor, left, right = (rows.column(j).flatten().to_numpy() for j in range(3, 12))
        of_docs, times = (rows.column(j).value_lengths().to_numpy().astype(np.int64) for j in (3, 5))
        where = where + np.repeat(np.cumsum(of_docs) - of_docs, times)
        number = np.repeat(rows.column(2).to_numpy().astype(np.int64) << 32, times)
        return docs[where], marks[where], low.view(np.uint16) + (high.astype(np.int32) << 16), n, number | anchor.view(np.uint32), left, right

    def bucket(parts: list):
        doc, mark, start, n, anchor, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep, key = _keys(anchor, doc, start, n, left, right)
        yield from _spans(doc[keep], mark[keep], start[keep], n[keep], key, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        of = None
        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False)
            if known.any():
                doc, mark, start, n, anchor, _, _ = unpacked(batch.filter(pa.array(known)))
                yield from _spans(doc, mark, start, n, anchor | 1, window)
            asked = batch.filter(pa.array(~known))
            if not asked.num_rows:
                continue
            numbers = asked.column(2).to_numpy()
            for a, b in zip(*run_bounds(numbers), strict=True):
                if held and numbers[a] != of:
                    yield from bucket(held)
                    held = []
                of = numbers[a]
                held.append(unpacked(asked.slice(a, b - a)))
        if held:
            yield from bucket(held)

    return run


def candidate_spans(df: DataFrame, symbols_of: Callable, window: int, k: int) -> DataFrame:
    """Rows of SPANS: windows that may also start in another document.

    df: doc (long), mark (long, a hash of the text), text. symbols_of gives the symbols of texts end to end, and
    how many each has.
    """
    # A bucket's records are held by one task: about a partition's worth of symbols, 11 bytes for some 18 of them.
    buckets = max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = df.select("doc", "mark", "text").mapInArrow(tidy(_send(symbols_of, window, k, buckets)), _RECORDS)
    return checkpoint(sent.repartition("dealt").sortWithinPartitions("bucket").mapInArrow(tidy(_candidates(window)), SPANS))


def marked(df: DataFrame, ident: str, text: str) -> DataFrame:
    """doc, mark (rows with the same id but other texts are told apart), text, and rest: all columns but the text.

    Columns are renamed within rest, as names may clash there; see unmarked().
    """
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    return df.select(F.col(ident).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*rest, F.col(text).isNull().alias("none")).alias("rest"))


def unmarked(rows: DataFrame, columns: list[str], text: str, new: Column) -> DataFrame:
    """The columns that marked() has hidden, with a new text where there was one.

    new should read the whole of rest: else fields that nobody wants are pruned from one shuffle of the texts and not
    from the other (see contexts()), and there are two.
    """
    return rows.select(*(F.when(~F.col("rest.none"), new).alias(c) if c == text else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)))


def window_hashes(symbols: np.ndarray, window: int) -> np.ndarray:
    up, down = POWERS.upto(len(symbols) + 1)
    total = np.r_[np.uint64(0), np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[: len(symbols)])]
    return mixed((total[window:] - total[:-window]) * down[: len(symbols) - window + 1])


def stretches(at: pa.Array, key: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Row and (key, start, n) of consecutive windows with one key, from lists of spans and their keys."""
    rows = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(rows, at.drop_null().value_lengths().to_numpy())
    at, key = (x.drop_null().flatten().to_numpy() for x in (at, key))
    by = np.lexsort((at, row))
    row, at, key = row[by], at[by], key[by]
    start, n = at // AT, at % AT
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])][: len(row)])
    if not len(first):
        return
    n = np.add.reduceat(n, first).tolist()
    edges = np.flatnonzero(np.r_[True, np.diff(row[first]) != 0, True])
    key, start, row = key[first].tolist(), start[first].tolist(), row[first]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(row[a]), list(zip(key[a:b], start[a:b], n[a:b], strict=True))


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of spans, as few and ascending ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(opened: Callable, window: int, split: dict[int, int] | None):
    """CONTENTS of candidate spans, from rows of doc, mark, text, at, keys. Equal windows have equal keys."""

    def parted(key: int, start: int, n: int, parts: int, hashes: np.ndarray):
        sub = hashes[start : start + n] % np.uint64(parts)
        a, b = run_bounds(sub)
        keys = (mixed(np.uint64(key & (2**64 - 1)) ^ mixed(sub[a] + np.uint64(1))).view(np.int64) | 1).tolist()
        return zip(keys, (start + a).tolist(), (b - a).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, bytes], int] = {}
        held = 0
        for batch in batches:
            docs, marks, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            hot = split if split is not None else dict(kv for m in batch.column(5).drop_null().to_pylist() for kv in m)
            rows: list[tuple] = []
            for i, found in sorted(stretches(batch.column(3), batch.column(4)), key=lambda r: docs[r[0]]):
                doc, mark = docs[i], marks[i]
                content_of, hashes_of = opened(column[i].as_py())
                hashes = window_hashes(hashes_of(), window) if hot and any(k in hot for k, _, _ in found) else None
                pieces, settled, again = [(key, start, n, hot.get(key)) for key, start, n in reversed(found)], [], {}
                while pieces:
                    key, start, n, parts = pieces.pop()
                    own = (key, content_of(start, start + n + window - 1))
                    if least.setdefault(own, doc) < doc:
                        settled.append((start, start + n))
                        continue
                    if own in again:  # once more in the same document
                        again[own].append(start)
                        continue
                    least[own] = doc
                    held += len(own[1])
                    if parts:
                        pieces += [(*piece, None) for piece in parted(key, start, n, parts, hashes)]
                    else:
                        again[own] = []
                        rows.append((key, doc, mark, start, n, again[own], own[1]))
                if settled:  # one row a document, dealt evenly
                    rows.append((doc, doc, mark, None, None, [x for start, end in _joined(settled) for x in (start, end - start)], None))
            if held > KNOWN:
                least, held = {}, 0
            for part in slices(rows, lambda r: len(r[6] or ""), 4_000_000):
                columns = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)], [c.split()[0] for c in CONTENTS.split(", ")])

    return run


def settled_rows(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of GONE from those of CONTENTS that have no content."""
    part = part.filter(part.column("content").is_null()).combine_chunks()
    if part.num_rows:
        pairs = part.column("more").combine_chunks()
        times = pairs.value_lengths().to_numpy() // 2
        pairs = pairs.flatten().to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("doc", "mark")] + [pa.array(pairs[::2]), pa.array(pairs[1::2])], [c.split()[0] for c in GONE.split(", ")])


def packed(settle: Callable) -> Callable:
    """Rows of PACKED instead of those of GONE, a row for each document among so many."""

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        doc, mark, start, n = (whole.column(c).to_numpy() for c in ("doc", "mark", "start", "n"))
        by = np.lexsort((start, mark, doc))
        doc, mark, pairs = doc[by], mark[by], np.column_stack((start[by], n[by])).astype(np.int32).ravel()
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])][: len(doc)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[2 * first, len(pairs)].astype(np.int32)), pa.array(pairs))
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(mark[first]), lists], [c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in settle(batches):
            parts.append(part)
            held += part.num_rows
            if held >= PACK:
                yield merged(parts)
                parts, held = [], 0
        if held:
            yield merged(parts)

    return run


def spans_gone(gone: DataFrame) -> DataFrame:
    """(doc, mark, spans): starts and numbers of all windows that go of a document."""
    rows = gone.groupBy("doc", "mark").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    pairs = F.expr("transform(sequence(0, size(gone) - 2, 2), i -> struct(gone[i] as start, gone[i + 1] as n))")
    return rows.select("doc", "mark", pairs.alias("spans"))


def contexts(docs: DataFrame, spans: DataFrame, opened: Callable, window: int, limit: int) -> DataFrame:
    """Rows of _cut(), in runs of equal keys. opened(text) gives two functions: the content (bytes) between two
    symbols, and the symbols as numbers.

    limit: symbols that one anchor may bring to one task; what has more is split by the windows' hashes. A left join
    of all columns, as with_spans() is, so that both read one shuffle of the texts.
    """
    # Leaders' keys are bounded as they are. Split windows mostly come one by one, each with all its symbols.
    sizes = spans.where("doc is null").groupBy("key").agg(F.sum("windows").alias("windows"), F.sum("size").alias("size")).where(F.col("size") > limit)
    release(spans.sparkSession)  # the records' shuffle
    sizes = sizes.select("key", (F.floor(F.col("windows") * window / limit) + 1).cast("long").alias("parts"))
    few = sizes.limit(SPLIT + 1).collect()
    release(spans.sparkSession)  # again: events that were still being handled may have held on to it
    split = {r["key"]: r["parts"] for r in few} if len(few) <= SPLIT else None
    spans = spans.where("doc is not null")
    # Both lists of a document are in the order in which its rows come.
    asked = spans.groupBy("doc", "mark").agg(F.collect_list("at").alias("at"), F.collect_list("key").alias("keys"))
    if split is None:
        keys = spans.where("key & 1 = 1").select("doc", "mark", "key").join(sizes, "key")
        asked = asked.join(keys.groupBy("doc", "mark").agg(F.map_from_entries(F.collect_set(F.struct("key", "parts"))).alias("split")), ["doc", "mark"], "left")
    rows = docs.join(asked, ["doc", "mark"], "left").select("doc", "mark", "text", "at", "keys", *(["split"] if split is None else []), *docs.columns[3:])
    rows = rows.mapInArrow(tidy(_cut(opened, window, split)), CONTENTS)
    return rows.repartition("key").sortWithinPartitions("key")


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (as marked() gives them, or without rest) with the spans that were found in each."""
    return docs.join(found, ["doc", "mark"], "left")
