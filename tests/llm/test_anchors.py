"""The steps of substring deduplication run by hand, with small limits, so that every way through them is taken."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_groups import anchors_schema, removed

from fastbreak.llm import anchors, automaton, suffix_array


def lines_and_passages(rng, unit):
    words = [f"{unit}{k}" for k in range(40)]
    shared = [" ".join(rng.choices(words, k=120)) for _ in range(3)]
    line = " ".join(rng.choices(words, k=3)) + " "
    docs = []
    for i in range(70):
        own = [" ".join(rng.choices(words, k=rng.randint(0, 70))) for _ in range(3)]
        a, b = sorted(rng.sample(range(500), 2))
        kind = i % 7
        if kind < 3:  # many documents hold one passage, between other things
            text = " ".join([own[0], shared[0], own[1], shared[1 + i % 2][a:b], own[2]])
        elif kind == 3:  # a line over and over
            text = own[0] + " " + line * rng.randint(2, 40) + own[1]
        elif kind == 4 and i > 20:  # copies, and near ones
            text = docs[rng.randrange(len(docs))][1]
            text = text if i % 2 else text[: len(text) // 2] + " changed " + text[len(text) // 2 :]
        else:
            text = " ".join(own)
        docs.append((i, text))
    docs += [(200, ""), (201, "x" * 400), (202, "x" * 90), (203, docs[0][1])]
    rng.shuffle(docs)
    return docs


def by_hand(docs, module, symbols_of, units, limit, tasks=5, joined=False):
    """Removed units of each document, through the module's own steps."""
    window, k = module.WINDOW, module.ANCHOR
    sent = []
    for t in range(tasks):
        batch = pa.RecordBatch.from_pylist([{"doc": d, "mark": 0, "text": x} for d, x in docs[t::tasks]])
        sent += [r for b in anchors._send(symbols_of, window, k, tasks)(iter([batch])) for r in b.to_pylist()]
    spans = []
    for t in range(tasks):
        mine = sorted((r for r in sent if r["dealt"] == t), key=lambda r: r["bucket"])
        if mine:
            spans += [s for b in anchors._candidates(window)(iter([pa.RecordBatch.from_pylist(mine, anchors_schema(mine[0]))])) for s in b.to_pylist()]
    sizes: dict = {}
    asked: dict = {}
    for s in spans:
        if s["doc"] is None:
            w, n = sizes.get(s["key"], (0, 0))
            sizes[s["key"]] = (w + s["windows"], n + s["size"])
        else:
            asked.setdefault(s["doc"], []).append((s["at"], s["key"]))
    split = {key: w * window // limit + 1 for key, (w, n) in sizes.items() if n > limit}
    contents = []
    for t in range(tasks):
        rows = [{"doc": d, "mark": 0, "text": x, "at": [a for a, _ in asked[d]], "keys": [key for _, key in asked[d]]} for d, x in docs[t::tasks] if d in asked]
        for a in range(0, len(rows), 4):
            contents += [r for b in anchors._cut(module._opened, window, split)(iter([pa.RecordBatch.from_pylist(rows[a : a + 4])])) for r in b.to_pylist()]
    kind = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("more", pa.list_(pa.int32())), ("content", pa.binary())])
    gone = {d: np.zeros(len(units(x)), bool) for d, x in docs}
    for t in range(3):
        mine = sorted((r for r in contents if r["key"] % 3 == t), key=lambda r: r["key"])
        batches = [pa.RecordBatch.from_pylist(mine[a : a + 50], kind) for a in range(0, len(mine), 50)]
        for b in module._settle(iter(batches)):
            for r in b.to_pylist():
                gone[r["doc"]][r["start"] : r["start"] + r["n"] + window - 1] = True
    return gone, {"split": len(split), "leaders": sum(s["key"] % 2 == 0 for s in spans if s["doc"] is not None), "anchors": sum(s["key"] % 2 for s in spans if s["doc"] is not None), "again": sum(bool(r["more"]) for r in contents), "settled": sum(r["content"] is None for r in contents)}


@pytest.mark.parametrize(("hot", "wild", "few", "limit", "chunk"), [(8, 64, 32, 10**9, 10**6), (1, 64, 32, 10**9, 3000), (1, 3, 2, 2000, 3000), (8, 64, 2, 500, 500), (2, 5, 8, 4000, 10**6)])
def test_every_way_gives_the_same(monkeypatch, hot, wild, few, limit, chunk):
    for name, value in (("HOT", hot), ("WILD", wild), ("FEW", few), ("BLOCK", 64)):
        monkeypatch.setattr(anchors, name, value)
    monkeypatch.setattr(suffix_array, "CHUNK", chunk)
    monkeypatch.setattr(suffix_array, "BUILT", chunk)
    monkeypatch.setattr(automaton, "SHARD", chunk)
    taken: dict = {}
    for seed in range(3):
        rng = random.Random(seed)
        docs = lines_and_passages(rng, "w")
        for module, symbols_of, units in ((suffix_array, suffix_array._bytes_of, str.encode), (automaton, automaton.word_hashes, automaton.WORD.findall)):
            want = removed(docs, units)
            got, ways = by_hand(docs, module, symbols_of, units, limit)
            for d, _ in docs:
                assert got[d].tolist() == list(want[d][1]), (seed, module.__name__, d)
            taken = {k: taken.get(k, 0) + v for k, v in ways.items()}
    assert taken["settled"] and taken["anchors"] and taken["leaders"] and (limit > 10**6 or (taken["split"] and taken["again"]))


def test_what_goes_leaves_a_task_by_document():
    """A row for each document, not for each of its stretches; what one task has settled is one row too."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = [{"doc": d, "mark": 0, "text": text, "at": [a * anchors.AT + 10 for a in range(0, 300, 20)], "keys": list(range(0, 30, 2))} for d in (1, 2)]
    contents = [r for b in anchors._cut(suffix_array._opened, 50, {})(iter([pa.RecordBatch.from_pylist(docs)])) for r in b.to_pylist()]
    settled = [r for r in contents if r["content"] is None]
    assert len(settled) == 1 and len(settled[0]["more"]) == 30 and len(contents) == 16

    def settle(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"doc": [2, 1, 2], "mark": [0, 0, 0], "start": pa.array([40, 5, 0], pa.int32()), "n": pa.array([3, 1, 7], pa.int32())})

    assert [r for b in anchors.packed(settle)(iter([None, None])) for r in b.to_pylist()] == [{"doc": 1, "mark": 0, "gone": [5, 1, 5, 1]}, {"doc": 2, "mark": 0, "gone": [0, 7, 0, 7, 40, 3, 40, 3]}]


def test_records_of_many_slices_share_rows(monkeypatch):
    """Rows don't grow with slices times buckets (they did, so with the square of the input), and hold the same records."""
    docs = lines_and_passages(random.Random(3), "w")
    batches = [pa.RecordBatch.from_pylist([{"doc": d, "mark": d % 3, "text": x} for d, x in docs[a : a + 9]]) for a in range(0, len(docs), 9)]
    monkeypatch.setattr(anchors, "SENT", 1000)

    def sent(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(anchors, name, value)
        rows = [r for b in anchors._send(suffix_array._bytes_of, 50, 16, 40)(iter(batches)) for r in b.to_pylist()]
        assert all(len(r["docs"]) <= anchors.DOCS and (r["known"] or r["dealt"] == r["bucket"]) for r in rows)
        return len(rows), sorted((r["known"], r["bucket"], r["docs"][d], r["marks"][d], *rest) for r in rows for d, *rest in zip(*(r[c] for c in ("doc", "low", "high", "n", "anchor", "left", "right")), strict=True))

    n, records = sent()
    assert n <= 2 * 40
    for limits in ({"DEALT": 1}, {"DEALT": 10**9, "HELD": 300}, {"DOCS": 2}):
        more, same = sent(**limits)
        assert more > n and same == records
