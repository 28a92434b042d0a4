"""Substring deduplication of words: windows of 50 words that also start in a document with a smaller id go.

Anchors (see anchors.py) bring together the stretches of documents that may repeat. These are the reference: cut into
shards of whole anchors (very common ones in parts), each with a suffix automaton whose states carry the smallest
document they occur in. Equal stretches, compared word by word, are one sequence with several owners. Each sequence
is streamed through its shard's automaton for matching statistics; where 50 words or more match, the state of the
last 50 tells the smallest document that has them, and from that each owner's removals.

A shard meets the stretches that can match it by a shuffle on the anchor, not by a broadcast of every shard to every
task: all documents are reference here, so the shards together grow with the data.

Defined cases: null texts have no words; texts under 50 words, documents without id and first copies keep
everything; rows with equal id and text are treated alike, rows with equal id and other text are told apart and do
not take from each other; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GONE, PACKED, POWERS, candidate_spans, contexts, marked, mixed, packed, settled_rows, spans_gone, unmarked, with_spans
from .common import run_bounds, table, tidy, whole_runs
from .suffix_array import covered

#: Words of the windows that may not repeat, and of the anchors in them.
WINDOW, ANCHOR = 50, 8
#: Words of one shard, and most of them (equal stretches counted each) that one anchor brings to a task.
SHARD, LIMIT = 100_000, 400_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts end to end, and how many words each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    up, down = POWERS.upto(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(mixed(np.arange(1, 257, dtype=np.uint64))[data] * up[: len(data)])]
    edges = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return mixed((total[ends] - total[starts]) * down[starts]), np.diff(np.r_[0, np.searchsorted(starts, edges)])


class SuffixAutomaton:
    """Of several sequences; each state has the smallest owner of the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [2**63]

    def add(self, sequence: list[int], owner: int) -> None:
        nexts, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in sequence:
            if c in nexts[last]:
                q = nexts[last][c]
                if length[q] != length[last] + 1:
                    q = self._clone(last, c, q)
                last = q
            else:
                new = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(2**63)
                p = last
                while p >= 0 and c not in nexts[p]:
                    nexts[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            if owner < least[last]:
                least[last] = owner

    def _clone(self, p: int, c: int, q: int) -> int:
        nexts, link = self.next, self.link
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.least.append(2**63)
        link[q] = copy
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Owners go up the suffix links, longest states first."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            u = self.link[v]
            if self.least[v] < self.least[u]:
                self.least[u] = self.least[v]

    def classes(self, sequence: list[int], window: int) -> list[int]:
        """The smallest owner of each window of a sequence that was added."""
        nexts, link, length, least = self.next, self.link, self.length, self.least
        out, v, matched = [], 0, 0
        for i, c in enumerate(sequence):
            while v and c not in nexts[v]:
                v = link[v]
                matched = length[v]
            if c in nexts[v]:
                v = nexts[v][c]
                matched += 1
            if matched >= window:
                while length[link[v]] >= window:
                    v = link[v]
                matched = window  # the state of exactly the last words, all that counts
                out.append(least[v])
        return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of GONE from contents, which come sorted by key."""
    for part in whole_runs(batches, "key", 5_000):
        yield from settled_rows(part)
        part = part.filter(part.column("content").is_valid())
        if not part.num_rows:
            continue
        doc, mark, start, key, n = (part.column(c).to_numpy() for c in ("doc", "mark", "start", "key", "n"))
        content, more = part.column("content").to_pylist(), part.column("more").to_pylist()
        firsts, pasts = run_bounds(key)
        shard: list[int] = []
        held = 0
        for a, b in zip(firsts.tolist(), pasts.tolist(), strict=True):
            shard += range(a, b)
            held += int(n[a:b].sum()) + (WINDOW - 1) * (b - a)
            if held >= SHARD or b == len(key):
                yield from _settle_shard(shard, doc, mark, start, more, content)
                shard, held = [], 0


def _settle_shard(shard, doc, mark, start, more, content) -> Iterator[pa.RecordBatch]:
    owners: dict[bytes, list[int]] = {}
    for i in shard:
        owners.setdefault(content[i], []).append(i)
    automaton = SuffixAutomaton()
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in c.split(b" ")] for c in owners]
    for sequence, rows in zip(sequences, owners.values(), strict=True):
        automaton.add(sequence, int(doc[rows].min()))
    automaton.finish()
    found = []
    for sequence, rows in zip(sequences, owners.values(), strict=True):
        least = np.array(automaton.classes(sequence, WINDOW), np.int64)
        for i in rows:
            gone = np.diff(np.r_[0, (least < doc[i]).astype(np.int8), 0])
            for a, b in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist(), strict=True):
                found += [(int(doc[i]), int(mark[i]), at + a, b - a) for at in (int(start[i]), *(more[i] or ()))]
    if found:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in GONE.split(", ")])


def _opened(text: str):
    """Contents between two words of a text, and hashes of its words."""
    words = WORD.findall(text)
    return lambda a, b: " ".join(words[a:b]).encode("utf-8", "surrogatepass"), lambda: word_hashes([text])[0]


def removal_spans(docs: DataFrame) -> DataFrame:
    """(doc, mark, spans): for documents with something to remove, first windows and numbers of windows, in words."""
    spans = candidate_spans(docs, word_hashes, WINDOW, ANCHOR)
    gone = contexts(docs, spans, _opened, WINDOW, LIMIT).mapInArrow(tidy(packed(_settle)), PACKED)
    return spans_gone(gone)


_DIGESTS = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _cutter(kind: str, rows_of):
    """A column from texts and their spans, by rows_of(text or null, number of words, kept words, whether any went)."""

    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, spans, *_ in batches:
            rows = []
            for raw, found in zip(column.to_pylist(), spans.to_pylist(), strict=True):
                words = WORD.findall(raw or "")
                kept = words
                if found:
                    gone = covered(len(words), np.array([s["start"] for s in found]), np.array([s["n"] for s in found]), WINDOW)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append(rows_of(raw, len(words), kept, bool(found)))
            yield pa.array(rows, pa.string() if kind == "string" else _DIGESTS)

    return F.arrow_udf(cut, kind)


def _text(raw: str | None, n: int, kept: list[str], cut: bool) -> str | None:
    return " ".join(kept) if cut else raw


def _digest(raw: str | None, n: int, kept: list[str], cut: bool) -> dict:
    return {"n_words": n, "n_removed": n - len(kept), "kept_sha256": sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()}


def remove_passages(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the text column cut, its kept words joined by single spaces; texts that lose nothing stay as they are."""
    docs = marked(df, ident, text)
    return unmarked(with_spans(docs, removal_spans(docs)), df.columns, text, _cutter("string", _text)("text", "spans", "rest"))


def digest_passages(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, cut): number of words, of removed words, and a digest of the words that stay."""
    docs = marked(df.select(ident, text), ident, text).drop("rest")
    joined = with_spans(docs, removal_spans(docs))
    return joined.select(F.col("doc").alias(ident), _cutter("struct<n_words:long,n_removed:long,kept_sha256:string>", _digest)("text", "spans").alias("cut"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_suffix_automaton_dedup: what is cut from every document, and a digest of what stays."""
    return digest_passages(table(spark, sf_dir, "documents")).select("doc_id", "cut.*")
