"""Suffix-array deduplication of bytes: strings of 50 bytes that also start in a document with a smaller id go.

Anchors (see anchors.py) bring together, under one key, the stretches of documents that may repeat. Equal stretches,
compared byte by byte, are one sequence with several owners; a suffix array of a key's sequences orders their
suffixes; neighbours that agree in 50 bytes form a class whose smallest document keeps its copy. Removals are read
from these classes.

The array is built by linear grouping: suffixes are grouped by Lyndon prefix. Groups are processed in descending
order; each member extends the Lyndon prefix of its previous smaller suffix, which moves to a group of its own above
its old one. Then each group's order is emitted in one pass over the array, by the order of what follows the prefix;
nothing is renamed or sorted again. Keys are independent, so the arrays of many are built side by side, every step
taking one group of each.

Defined cases: null texts are empty; texts under 50 bytes, documents without id and first copies keep everything;
rows with equal id and text are treated alike, rows with equal id and other text are told apart and do not take from
each other; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GONE, PACKED, candidate_spans, contexts, marked, mixed, packed, settled_rows, spans_gone, unmarked, window_hashes, with_spans
from .common import run_bounds, spread, table, texts, tidy, whole_runs

#: Bytes of the strings that may not repeat, and of the anchors in them.
WINDOW, ANCHOR = 50, 16
#: Bytes that are looked through at once, that suffix arrays are built over at once, and that one anchor brings to a task.
CHUNK, BUILT, LIMIT = 400_000, 700_000, 1_000_000
#: Arrays of similar length that are built side by side, at least; fewer are built one by one.
LANES = 16
#: Of a key's sequences, the longest ones that others may be part of.
LONGEST = 12


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; symbols are positive, a shorter suffix precedes its extensions."""
    n = len(symbols)
    # Phase 1: groups by first symbol, in ascending order as a linked list; later by Lyndon prefix.
    group: list[int] = [0] * n
    number = {c: i for i, c in enumerate(sorted(set(symbols)))}
    members: list[list[int]] = [[] for _ in number]
    for i, c in enumerate(symbols):
        g = number[c]
        group[i] = g
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    length = [1] * n
    before = list(range(-1, n - 1))  # previous smaller suffix, or a place on the way to it
    done = bytearray(n)
    order: list[int] = []  # groups, descending
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        order.append(g)
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = before[i]
            while p >= 0 and done[p]:
                p = before[p]
            q = i  # compress the path
            while q != p and before[q] != p:
                before[q], q = p, before[q]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            size = length[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                length[p] += k * size
                key = (group[p], k)
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            # The more repetitions, the higher; all directly above the group they leave.
            for w, k in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new, high, places = len(members), above[w], moved[w, k]
                members.append(places)
                below.append(w)
                above.append(high)
                below[high] = above[w] = new
                for p in places:
                    group[p] = new
        g = below[g]
    # Phase 2: one pass over the array; what ends where the current suffix begins comes next in its group.
    ends: list[list[int] | None] = [None] * (n + 1)
    for p in range(n):
        e = p + length[p]
        if ends[e] is None:
            ends[e] = [p]
        else:
            ends[e].append(p)
    place = [0] * len(members)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    array = [0] * n
    for p in ends[n] or ():
        array[place[group[p]]] = p
        place[group[p]] += 1
    for i in range(n):
        if (found := ends[array[i]]) is not None:
            for p in found:
                array[place[group[p]]] = p
                place[group[p]] += 1
    return array


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _tails(heads: np.ndarray) -> np.ndarray:
    out = np.ones(len(heads), bool)
    out[:-1] = heads[1:]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and members of ranges [first, first + count) end to end."""
    owner = np.repeat(np.arange(len(count)), count)
    shift = first - np.cumsum(count) + count
    return owner, np.arange(len(owner)) + shift[owner]


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of sequences end to end, side by side, as places among all symbols."""
    total, kind = len(symbols), np.int64  # as indices are: narrower ones would be widened by every use
    ends_at = np.cumsum(sizes)
    lane = np.repeat(np.arange(len(sizes)), sizes)
    # Phase 1. A group's members lie in a range of `pool`; that some have left is seen by `group`.
    value = lane * (int(symbols.max()) + 1) + symbols
    pool = np.empty(2 * total, kind)
    pool[:total] = by = np.argsort(value, kind="stable")
    starts, ends = run_bounds(value[by])
    used, groups = total, len(starts)
    first, size, below, above, place, home = (np.empty(2 * total + 1, kind) for _ in range(6))
    first[:groups], size[:groups], home[:groups] = starts, ends - starts, lane[by[starts]]
    group = np.empty(total, kind)
    group[by] = np.repeat(np.arange(groups, dtype=kind), ends - starts)
    lowest = _heads(home[:groups])
    highest = _tails(lowest)
    below[:groups] = np.where(lowest, -1, np.arange(groups) - 1)
    above[:groups] = np.where(highest, -1, np.arange(groups) + 1)
    length = np.ones(total, kind)
    before = np.arange(-1, total - 1, dtype=kind)  # previous smaller suffix, or a place on the way to it
    before[ends_at - sizes] = -1
    done = np.zeros(total + 1, bool)  # the last one is for -1
    left = ends_at.astype(kind)
    now = np.flatnonzero(highest)  # one group of each lane
    while len(now):
        owner, at = _ranges(first[now], size[now])
        own = pool[at]
        here = (group[own] == now[owner]).nonzero()[0]
        own = own[here]
        homes = home[now]
        left[homes] -= np.bincount(owner[here], minlength=len(now)).astype(kind)
        place[now] = left[homes]
        done[own] = True
        at = before[own]
        passed = done[at]
        while passed.any():  # halves the way each time
            at = np.where(passed, before[at], at)
            before[own] = at
            passed = done[at]
        some = (at >= 0).nonzero()[0]
        if len(some):
            up, by_size = at[some], length[own[some]]
            order = up.argsort(kind="stable")
            up = up[order]
            a = _heads(up).nonzero()[0]
            up, by_size, times = up[a], by_size[order[a]], np.append(a[1:], len(up)) - a
            length[up] += (times * by_size).astype(kind)
            # The more repetitions, the higher; all directly above the group they leave.
            rank = group[up] * np.int64(1 << 31) + times
            order = rank.argsort()
            up, rank = up[order], rank[order]
            fresh = _heads(rank).nonzero()[0]
            many = np.append(fresh[1:], len(up)) - fresh
            new = np.arange(groups, groups + len(fresh), dtype=kind)
            old = group[up[fresh]]
            pool[used : used + len(up)] = up
            first[new], size[new], home[new] = used + fresh, many, home[old]
            group[up] = new.repeat(many)
            head = _heads(old)
            tail = _tails(head)
            below[new] = np.where(head, old, new - 1)
            above[new] = np.where(tail, above[old], new + 1)
            last = new[tail]
            below[above[last]] = last
            above[old[head]] = new[head]
            used, groups = used + len(up), groups + len(new)
        now = below[now]
        now = now[now >= 0]
    # Phase 2. What ends where the current suffix begins comes next in its group; ends of lanes are behind all places.
    stops = np.arange(total) + length
    stops = np.where(stops == ends_at[lane], total + lane, stops)
    ending = stops.argsort(kind="stable").astype(kind)
    edges = np.searchsorted(stops[ending], np.arange(total + len(sizes) + 1)).astype(kind)
    array = np.empty(total, kind)

    def emit(at: np.ndarray) -> None:
        low = edges[at]
        some = ending[_ranges(low, edges[at + 1] - low)[1]]
        g = group[some]
        to = place[g]
        array[to] = some
        place[g] = to + 1

    emit(total + np.arange(len(sizes)))
    order = np.argsort(-sizes, kind="stable")
    begins, live = (ends_at - sizes)[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), "left")
    for step in range(int(sizes.max())):
        emit(array[begins[: live[step]] + step])
    return array


def arrays_of(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of sequences end to end: side by side those of similar length, if there are enough."""
    begins = np.cumsum(sizes) - sizes
    array = np.empty(len(symbols), np.int64)
    kind = np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    for k in np.unique(kind):
        some = np.flatnonzero(kind == k)
        owner, nth = spread(sizes[some])
        if len(some) < LANES:
            for i in some:
                array[begins[i] : begins[i] + sizes[i]] = begins[i] + np.array(suffix_array(symbols[begins[i] : begins[i] + sizes[i]].tolist()), np.int64)
        else:
            places = begins[some][owner] + nth
            array[places] = places[suffix_arrays(symbols[places], sizes[some])]
    return array


def least_owners(data: np.ndarray, array: np.ndarray, lane: np.ndarray, starts: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of windows (first places in data, with their lanes and smallest documents) the smallest document with an equal
    one, by the suffix arrays of all lanes."""
    index = np.full(len(data), -1, np.int64)
    index[starts] = np.arange(len(starts))
    found = index[array]
    found = found[found >= 0]  # windows in the order of their suffixes
    at = starts[found]
    # Eight bytes at a time; the last eight overlap those before.
    words = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(7, np.uint8)], 8).copy().view(np.uint64)[:, 0]
    fresh = np.r_[True, np.diff(lane[found]) != 0]
    for step in [*range(0, window - 7, 8), window - 8]:
        part = words[at + step]
        fresh[1:] |= part[1:] != part[:-1]
    least = np.minimum.reduceat(owner[found], np.flatnonzero(fresh))
    out = np.zeros(len(starts), np.int64)
    out[found] = least[np.cumsum(fresh) - 1]
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of GONE from contents, which come sorted by key."""
    pending: list[_Sequences] = []
    for part in whole_runs(batches, "key", 10_000):
        yield from settled_rows(part)
        part = part.filter(part.column("content").is_valid())
        if not part.num_rows:
            continue
        doc, mark, start, key, n = (part.column(c).to_numpy() for c in ("doc", "mark", "start", "key", "n"))
        content, more = part.column("content").to_pylist(), part.column("more").to_pylist()
        for a, b in _chunks(key, n.astype(np.int64) + WINDOW - 1):
            if (found := _Sequences.of_contents(key[a:b], doc[a:b], mark[a:b], start[a:b], more[a:b], content[a:b], n[a:b].astype(np.int64))) is not None:
                pending.append(found)
            if sum(len(x.data) for x in pending) > BUILT:
                yield from _decide(pending)
                pending = []
    if pending:
        yield from _decide(pending)


def _chunks(key: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    starts, ends = run_bounds(key)
    total = np.r_[0, np.cumsum(size)]
    first = 0
    for k in range(len(starts)):
        if total[ends[k]] - total[starts[first]] > CHUNK and k > first:
            yield int(starts[first]), int(starts[k])
            first = k
    if len(starts):
        yield int(starts[first]), int(ends[-1])


def _runs(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each maximal stretch of consecutive windows."""
    firsts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(owner) != 0)][: len(at)])
    return firsts, np.diff(np.r_[firsts, len(at)])


def _repeated(hashes: np.ndarray) -> np.ndarray:
    by = np.argsort(hashes)
    same = hashes[by][1:] == hashes[by][:-1]
    out = np.zeros(len(hashes), bool)
    out[by] = np.r_[False, same] | np.r_[same, False]
    return out


class _Sequences(NamedTuple):
    """What of some keys may repeat: sequences, and stretches of documents that are equal to a part of one."""

    data: bytes  # the sequences, each with a separator behind it
    long: np.ndarray  # of each sequence: its bytes and the number of its key
    lane: np.ndarray
    least: np.ndarray  # of each window of the sequences: the smallest document that has it there
    window: np.ndarray  # of each stretch: its first window among those of all sequences, number of windows,
    runs: np.ndarray
    doc: np.ndarray  # document, mark, and first window in the document
    mark: np.ndarray
    start: np.ndarray

    @classmethod
    def of_contents(cls, key, doc, mark, start, more, content, n) -> _Sequences | None:
        """Windows without an equal (by hash: equal ones have equal hashes) can't repeat. What is left are stretches;
        those of a key that are equal, byte by byte, or part of a longer one share a sequence."""
        raw = np.frombuffer(b"".join(content), np.uint8)
        size = n + WINDOW - 1
        owner, place = spread(n)
        at = (np.cumsum(size) - size)[owner] + place
        keep = np.flatnonzero(_repeated(window_hashes(raw, WINDOW)[at]))
        if not len(keep):
            return None
        at, owner, place = at[keep], owner[keep], place[keep]
        firsts, runs = _runs(at, owner)
        at, owner, place = at[firsts], owner[firsts], place[firsts]
        data = raw.tobytes()
        number: dict[tuple[int, bytes], int] = {}
        of = np.array([number.setdefault((k, data[a : a + m]), len(number)) for k, a, m in zip(key[owner].tolist(), at.tolist(), (runs + WINDOW - 1).tolist(), strict=True)], np.int64)
        sequences, lanes, where = _joined([k for k, _ in number], [x for _, x in number])
        long = np.fromiter(map(len, sequences), np.int64, len(sequences))
        windows = long - WINDOW + 1
        inside = np.array(where, np.int64)[of]
        window = (np.cumsum(windows) - windows)[inside[:, 0]] + inside[:, 1]
        least = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        stretch, nth = spread(runs)
        np.minimum.at(least, window[stretch] + nth, doc[owner][stretch])
        # A content that a document has several times is several stretches of it.
        starts = np.array([x for a, others in zip(start.tolist(), more, strict=True) for x in (a, *(others or ()))], np.int64)
        times = np.array([1 + len(x or ()) for x in more], np.int64)
        each, nth = spread(times[owner])
        owner, place, window, runs = owner[each], place[each], window[each], runs[each]
        return cls(b"".join([x + b"\0" for x in sequences]), long, np.array(lanes), least, window, runs, doc[owner], mark[owner], starts[(np.cumsum(times) - times)[owner] + nth] + place)


def _joined(keys: list[int], contents: list[bytes]) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Sequences, the number of the key of each, and for each content the sequence and place where it is."""
    out: list[bytes] = []
    lanes: list[int] = []
    where = [(0, 0)] * len(keys)
    a = 0
    while a < len(keys):
        b, base = a + 1, len(out)
        while b < len(keys) and keys[b] == keys[a]:
            b += 1
        for i in sorted(range(a, b), key=lambda i: -len(contents[i])):
            x = contents[i]
            for j in range(base, min(len(out), base + LONGEST)):
                if (at := out[j].find(x)) >= 0:
                    where[i] = (j, at)
                    break
            else:
                where[i] = (len(out), 0)
                out.append(x)
                lanes.append(a)
        a = b
    return out, lanes, where


def _decide(parts: list[_Sequences]) -> Iterator[pa.RecordBatch]:
    """Rows of GONE: each key's sequences are one lane of suffix arrays, and each stretch's removals come from the
    classes of its windows. A lane of one sequence whose windows are all different has nothing to sort out."""
    data = np.frombuffer(b"".join(x.data for x in parts), np.uint8)
    long = np.concatenate([x.long for x in parts])
    lane = np.concatenate([x.lane + 1_000_000_000 * i for i, x in enumerate(parts)])
    before = np.cumsum([0, *(len(x.least) for x in parts)])
    window = np.concatenate([x.window + k for x, k in zip(parts, before[:-1], strict=True)])
    least, runs, doc, mark, start = (np.concatenate([getattr(x, c) for x in parts]) for c in ("least", "runs", "doc", "mark", "start"))
    begin = np.cumsum(long + 1) - long - 1
    symbols = data.astype(np.int64) + 2
    symbols[begin + long] = 1
    piece, inside = spread(long - WINDOW + 1)
    first = np.flatnonzero(_heads(lane))
    lane = np.cumsum(_heads(lane)) - 1  # from 0 on
    at, of_lane = begin[piece] + inside, lane[piece]
    single = np.bincount(lane) == 1
    alone = np.flatnonzero(single[of_lane])
    hashes = mixed(window_hashes(data, WINDOW)[at[alone]] + of_lane[alone].astype(np.uint64))
    single[of_lane[alone[_repeated(hashes)]]] = False
    classes = least.copy()
    sizes = np.add.reduceat(long + 1, first)
    if not single.all():
        some = ~single[np.repeat(np.arange(len(sizes)), sizes)]
        index = np.cumsum(some) - 1  # places among the symbols that are sorted
        windows = np.flatnonzero(~single[of_lane])
        array = arrays_of(symbols[some], sizes[~single])
        classes[windows] = least_owners(data[some], array, of_lane[windows], index[at[windows]], least[windows])
    stretch, inside = spread(runs)
    away = np.flatnonzero(classes[window[stretch] + inside] < doc[stretch])
    if len(away):
        stretch, inside = stretch[away], inside[away]
        firsts, n = _runs(inside, stretch)
        stretch, inside = stretch[firsts], inside[firsts]
        yield pa.RecordBatch.from_arrays([pa.array(doc[stretch]), pa.array(mark[stretch]), pa.array((start[stretch] + inside).astype(np.int32)), pa.array(n.astype(np.int32))], [c.split()[0] for c in GONE.split(", ")])


def _bytes_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    return np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.fromiter(map(len, raw), np.int64, len(raw))


def _opened(text: str):
    """Contents between two bytes of a text, and its bytes as numbers."""
    raw = text.encode("utf-8", "surrogatepass")
    return lambda a, b: raw[a:b], lambda: np.frombuffer(raw, np.uint8)


def covered(size: int, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of `size` symbols lie in a window of the spans."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + counts + window - 1, size), -1)
    return np.cumsum(change)[:size] > 0


def removal_spans(docs: DataFrame) -> DataFrame:
    """(doc, mark, spans): for documents with something to remove, first windows and numbers of windows."""
    spans = candidate_spans(docs, _bytes_of, WINDOW, ANCHOR)
    gone = contexts(docs, spans, _opened, WINDOW, LIMIT).mapInArrow(tidy(packed(_settle)), PACKED)
    return spans_gone(gone)


def _cutter(kind: str, rows_of):
    """A column from texts and their spans, by rows_of(text or null, bytes, removed bytes or null)."""

    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, spans, *_ in batches:
            rows = []
            for raw, found in zip(column.to_pylist(), spans.to_pylist(), strict=True):
                data = (raw or "").encode("utf-8", "surrogatepass")
                rows.append(rows_of(raw, data, covered(len(data), np.array([s["start"] for s in found]), np.array([s["n"] for s in found])) if found else None))
            yield pa.array(rows, pa.string() if kind == "string" else _DIGESTS)

    return F.arrow_udf(cut, kind)


_DIGESTS = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _text(raw: str | None, data: bytes, gone: np.ndarray | None) -> str | None:
    return raw if gone is None else np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def _digest(raw: str | None, data: bytes, gone: np.ndarray | None) -> dict:
    kept = data if gone is None else np.frombuffer(data, np.uint8)[~gone].tobytes()
    spans = 0 if gone is None else int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
    return {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": spans, "kept_sha256": sha256(kept).hexdigest()}


def remove_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the text column cut. Where a cut falls within a character, what is left of it is dropped."""
    docs = marked(df, ident, text)
    return unmarked(with_spans(docs, removal_spans(docs)), df.columns, text, _cutter("string", _text)("text", "spans", "rest"))


def digest_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, cut): sizes, number of maximal removed runs and a digest of the bytes that stay."""
    docs = marked(df.select(ident, text), ident, text).drop("rest")
    joined = with_spans(docs, removal_spans(docs))
    return joined.select(F.col("doc").alias(ident), _cutter("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>", _digest)("text", "spans").alias("cut"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_suffix_array_dedup: what is cut from every document, and a digest of what stays."""
    return digest_repeats(table(spark, sf_dir, "documents")).select("doc_id", "cut.*")
