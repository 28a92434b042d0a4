"""Operators that compare rows: embeddings, SimHash, substrings, packing, chat, and the pipeline."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fastbreak.llm import anchors, automaton, chat, components, embeddings, packing, simhash, suffix_array, toxicity


def union(pairs):
    parent: dict = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in parent}


def test_components_of_chains_hubs_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(5, k) for k in range(6, 300)] + [(7, 7), (5, 6), (6, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]])
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- embeddings


def test_embeddings_like_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 40))
    near = base[:60] + rng.standard_normal((60, 40)) * np.linspace(0.05, 0.45, 60)[:, None]
    x = np.vstack([base, near, base[:5], base[:5] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 40, [float("nan")] * 40, [None] + [1.0] * 39, [float("inf")] * 40, [1.0] * 3]
    rows += [(1000 + i, v, "b") for i, v in enumerate(odd)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    comp = union(list(zip(*np.nonzero(links), strict=True)))
    for i in range(len(x)):
        assert got[i] == (links[i].sum(), comp.get(i, i), comp.get(i, i) == i)
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(odd)))


def test_vectors_of_every_length_are_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0]), (6, [3.0]), (7, [-1.0]), (None, [1.0, 0.0])]
    rows += [(10 + i, [1.0, float(i), 0.0, 2.0]) for i in range(5)]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "vec_id long, embedding array<float>, rep string, copies int, node int")
    for sample in (embeddings.SAMPLE, 2):  # with few drawn, most lengths have one cell
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(embeddings, "SAMPLE", sample)
            got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_links(df).collect()}
        x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None}
        links = [(i, j) for i in x for j in x if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95]
        comp = union(links)
        assert all(got[i] == (sum(a == i for a, _ in links), comp.get(i, i), comp.get(i, i) == i) for i in x)
        assert got[None] == (0, None, True) and got[1][0] == 1 and got[5][0] == 1


def test_embeddings_in_small_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(24)
    x = (centre + rng.standard_normal((90, 24)) * 0.02).astype(np.float32)
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in embeddings.embedding_links(df).collect()} == {(89, 0)}
    assert embeddings.embedding_links(df.limit(0)).collect() == []


# ---------------------------------------------------------------- SimHash


def print_of(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)) if h else 0


def test_golay_keys_find_up_to_three_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    for n in (0, 1, 2, 3):
        y = np.array([v ^ np.bitwise_or.reduce([np.uint64(1 << int(b)) for b in rng.choice(64, n, replace=False)] or [np.uint64(0)]) for v in x], np.uint64)
        rx, kx, _ = simhash.keys_of(x)
        ry, ky, own = simhash.keys_of(y)
        assert len({p[0] for p in set(zip(rx.tolist(), kx.tolist(), strict=True)) & set(zip(ry[own].tolist(), ky[own].tolist(), strict=True))}) == len(x)


def test_simhash_like_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(40)]
    texts = base + [t.replace(rng.choice(t.split()), "changed", 1) for t in base for _ in range(3)] + [None, "", " \t", "One two", "one TWO", "É é", "x " * 5000, base[0], base[0]]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "lonely row without an id at all", 0), (3, texts[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    prints = [print_of(t) for t in texts]
    comp = union([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for cell in (simhash.CELL, 2):
        monkeypatch.setattr(simhash, "CELL", cell)
        out = simhash.simhash_groups(df).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is not None:
                assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", comp.get(r.doc_id, r.doc_id))
    assert simhash.simhash_groups(df.limit(0)).collect() == []


# ---------------------------------------------------------------- substrings


def test_suffix_array_sorts_suffixes():
    rng = random.Random(3)
    for _ in range(600):
        s = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))]
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_side_by_side():
    rng = random.Random(4)
    for _ in range(60):
        rows = [[rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 70))] for _ in range(rng.randint(1, 40))]
        want, base = [], 0
        for s in rows:
            want += [base + i for i in sorted(range(len(s)), key=lambda i: s[i:])]
            base += len(s)
        flat, sizes = np.array(sum(rows, [])), np.array([len(s) for s in rows])
        assert suffix_array.suffix_arrays(flat, sizes).tolist() == want == suffix_array.arrays_of(flat, sizes).tolist()


def removed(docs, units, window=50):
    """Kept units of each document, by comparing all windows."""
    seen: dict = {}
    for i, t in docs:
        u = units(t or "")
        for j in range(len(u) - window + 1):
            k = tuple(u[j : j + window])
            seen[k] = min(seen.get(k, i), i)
    out = {}
    for i, t in docs:
        u = units(t or "")
        gone = [False] * len(u)
        for j in range(len(u) - window + 1):
            if seen[tuple(u[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (u, gone)
    return out


def passages(rng, unit, sep):
    words = [f"{unit}{k}" for k in range(60)] + ["é", "ß"]
    shared = [sep.join(rng.choices(words, k=90)) for _ in range(4)]
    docs = []
    for i in range(60):
        own = [sep.join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(3)]
        a, b = sorted(rng.sample(range(400), 2))
        docs.append((i, sep.join([own[0], rng.choice(shared)[a:b], own[1], rng.choice(shared), own[2]]) if i % 4 else own[0]))
    return [*docs, (100, docs[5][1]), (101, docs[5][1]), (102, None), (103, ""), (104, "a" * 400), (105, "a" * 300), (106, "ab" * 9000)]


def test_suffix_array_dedup_like_brute_force(spark):
    docs = passages(random.Random(6), "w", " ")
    df = spark.createDataFrame([(i, t, 7) for i, t in docs] + [(None, docs[5][1], 7), (5, docs[5][1], 7)], "doc_id long, text string, start int").repartition(3)
    want = removed(docs, lambda t: t.encode())
    got = [r for r in suffix_array.digest_repeats(df).select("doc_id", "cut.*").collect() if r.doc_id is not None]
    assert len(got) == len(docs) + 1
    for r in got:
        u, gone = want[r.doc_id]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(u), sum(gone), runs)
        assert r.kept_sha256 == sha256(bytes(c for c, g in zip(u, gone, strict=True) if not g)).hexdigest()
    cut = suffix_array.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert cut.where("doc_id is null").first().text == docs[5][1] and cut.where("doc_id = 102").first().text is None
    assert suffix_array.digest_repeats(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    """Texts longer than a slice, whose passages repeat within and across them."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choices(words, k=450_000))
    part = long[1_000_000:1_300_000]
    docs = [(1, long), (2, "start " + part + " end"), (3, long[:2_000_000] + " more"), (4, part)]
    assert len(long) > 2_400_000
    got = {r.doc_id: r.cut for r in suffix_array.digest_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (0, 0) and got[4].n_removed == len(part)
    assert (got[2].n_removed, got[2].n_spans) == (len(part), 1) or got[2].n_removed in range(len(part), len(part) + 3)
    assert got[3].n_removed in range(2_000_000, 2_000_003)


def test_same_id_other_text(spark):
    df = spark.createDataFrame([(1, "x" * 80), (2, "x" * 80), (2, "something else that is long enough to have windows of its own, surely")], "doc_id long, text string")
    assert sorted(len(r.text) for r in suffix_array.remove_repeats(df).collect()) == [0, 69, 80]


def test_automaton_dedup_like_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    docs = passages(rng, "v", " ")
    docs += [(200 + i, "\x0b ".join(rng.choice(docs)[1].split()[k:]) if docs[3][1] else "") for i, k in enumerate((0, 1, 5, 20))]
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    units = automaton.WORD.findall
    want = removed(docs, units)
    for shard in (automaton.SHARD, 100):
        monkeypatch.setattr(automaton, "SHARD", shard)
        monkeypatch.setattr(automaton, "LIMIT", shard)
        for r in automaton.digest_passages(df).select("doc_id", "cut.*").collect():
            u, gone = want[r.doc_id]
            assert (r.n_words, r.n_removed) == (len(u), sum(gone))
            assert r.kept_sha256 == sha256(" ".join(w for w, g in zip(u, gone, strict=True) if not g).encode()).hexdigest()
    assert automaton.remove_passages(df).columns == df.columns
    assert automaton.digest_passages(df.limit(0)).collect() == []


def test_hashes_alone_remove_nothing(monkeypatch):
    """Contents whose hashes all collide: only what is equal byte by byte, or word by word, goes."""
    for name in ("window_hashes", "mixed"):
        for module in (suffix_array, anchors):
            monkeypatch.setattr(module, name, lambda x, *a: np.zeros(max(0, len(x) - (a[0] - 1 if a else 0)), np.uint64), raising=False)
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 256, 66).astype(np.uint8).tobytes() for _ in range(2))
    content = [x, y, x, x[:60]]
    doc = np.array([1, 2, 3, 4])
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 4), pa.array(doc), pa.array([0] * 4), pa.array([0] * 4, pa.int32()), pa.array([len(c) - 49 for c in content], pa.int32()), pa.array([None, [], [200, 300], []], pa.list_(pa.int32())), pa.array(content, pa.binary())], ["key", "doc", "mark", "start", "n", "more", "content"])
    gone = {(r["doc"], r["start"], r["n"]) for b in suffix_array._settle(iter([rows])) for r in b.to_pylist()}
    assert gone == {(3, 0, 17), (3, 200, 17), (3, 300, 17), (4, 0, 11)}
    rows = rows.set_column(6, "content", pa.array([" ".join(map(str, c)).encode() for c in content], pa.binary()))
    assert {(r["doc"], r["start"], r["n"]) for b in automaton._settle(iter([rows])) for r in b.to_pylist()} == gone


def wanted(*spans):
    return {"at": [start * anchors.AT + n for start, n, _ in spans], "keys": [key for _, _, key in spans]}


def unpacked(batch):
    return [{"doc": r["doc"], "start": r["at"] // anchors.AT, "n": r["at"] % anchors.AT, "key": r["key"]} for r in batch.to_pylist() if r["doc"] is not None]


def test_a_hot_anchor_is_split():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 90).astype(np.uint8).tobytes()
    rows = [(i, 0, (rng.integers(97, 123, 30).astype(np.uint8).tobytes() + passage[i % 3 :]).decode(), wanted((0, 60, 7))) for i in range(40)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc", "mark", "text"), r[:3], strict=True)) | r[3] for r in rows])
    cut = anchors._cut(suffix_array._opened, 50, {7: 16})
    pieces = [r for b in cut(iter([batch])) for r in b.to_pylist() if r["content"] is not None]
    by: dict = {}
    for r in pieces:
        by.setdefault(r["key"], []).append(r["n"])
    assert len(by) == 16 and max(map(sum, by.values())) < sum(map(sum, by.values())) / 4
    keys: dict = {}
    for r in pieces:
        for k in range(r["n"]):
            keys.setdefault(r["content"][k : k + 50], set()).add(r["key"])
    assert {len(k) for k in keys.values()} == {1}


def test_a_passage_in_all_documents_is_not_all_records():
    rng = np.random.default_rng(7)
    passage = bytes(rng.integers(97, 123, 200).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_pylist([{"doc": i, "mark": 0, "text": passage} for i in range(50)])
    sent = [r for b in anchors._send(suffix_array._bytes_of, 50, 16, 8)(iter([batch])) for r in b.to_pylist()]
    asked: dict = {}
    for r in sent:
        if not r["known"]:
            for a in r["anchor"]:
                asked[a] = asked.get(a, 0) + 1
    assert set(asked.values()) == {2}
    spans = [s for r in sorted(sent, key=lambda r: r["bucket"]) for b in anchors._candidates(50)(iter([pa.RecordBatch.from_pylist([r], anchors_schema(r))])) for s in unpacked(b)]
    assert sum(s["n"] for s in spans) == 50 * 151
    assert all(s["key"] & 1 for s in spans)
    rows = [{"doc": i, "mark": 0, "text": passage, **wanted((0, 60, 7), (60, 60, 7), (120, 31, 7))} for i in range(50)]
    cut = [r for b in anchors._cut(suffix_array._opened, 50, {})(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert [r["doc"] for r in cut if r["content"] is not None] == [0] and len({r["key"] for r in cut if r["content"] is None}) == 49


def test_many_split_keys_are_joined(spark, monkeypatch):
    """Anchors that are split more than once a task are looked up by a join instead of a broadcast; nothing changes."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh", k=400))
    docs = [(i, "".join(rng.choices("xyz ", k=60)) + passage[i % 7 :]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {i: sum(gone) for i, (_, gone) in removed(docs, lambda t: t.encode()).items()}
    monkeypatch.setattr(suffix_array, "LIMIT", 300)
    for split in (anchors.SPLIT, 0):
        monkeypatch.setattr(anchors, "SPLIT", split)
        assert {r.doc_id: r.cut.n_removed for r in suffix_array.digest_repeats(df).collect()} == want


def test_leaders_keys_hold_few_symbols():
    """Of anchors in few documents neighbours share a key; equal windows have equal keys."""
    rng = np.random.default_rng(11)
    text = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    batches = [pa.RecordBatch.from_pylist([{"doc": i, "mark": 0, "text": text[i * 10 :]}]) for i in range(5)]
    sent = [r for b in anchors._send(suffix_array._bytes_of, 50, 16, 1)(iter(batches)) for r in b.to_pylist()]
    spans = [s for b in anchors._candidates(50)(iter([pa.RecordBatch.from_pylist(sent, anchors_schema(sent[0]))])) for s in unpacked(b)]
    assert len({s["key"] for s in spans}) == 6 and not any(s["key"] & 1 for s in spans)
    of: dict = {}
    for s in spans:
        for k in range(s["start"], s["start"] + s["n"]):
            of.setdefault(text[s["doc"] * 10 :][k : k + 50], set()).add(s["key"])
    assert {len(x) for x in of.values()} == {1}


def anchors_schema(row):
    types = {"dealt": pa.int32(), "known": pa.bool_(), "bucket": pa.int32(), "docs": pa.list_(pa.int64()), "marks": pa.list_(pa.int64()), "doc": pa.list_(pa.int16()), "low": pa.list_(pa.int16()), "high": pa.list_(pa.int16()), "n": pa.list_(pa.int8()), "anchor": pa.list_(pa.int32()), "left": pa.list_(pa.int8()), "right": pa.list_(pa.int8())}
    return pa.schema([(k, types[k]) for k in row])


# ---------------------------------------------------------------- packing


def test_packing(spark):
    texts = [None, "", "don't stop", "Ω ΣΑΣ İstanbul ﬁ é 12ab\x1cx a\x01b", "a<|endoftext|>b <|startoftext|> |endoftext|", "word " * 9000, "a b c", "a b c"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, offset int")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(df).collect()
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        pieces = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert mine == [(k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(pieces)]
    check_places([(r.sequence_id, r.offset, r.length) for r in got])
    assert packing.pack(df.limit(0)).collect() == []


def test_ids_are_the_librarys_for_every_character():
    """Each character between letters, alone, beside controls and signs, and before a combining one."""
    theirs = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    mine = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    points = [c for c in [*range(1, 0x3200), *range(0x3200, 0x110000, 61), *range(0xA640, 0xAB70), *range(0xF900, 0x10000), *range(0x1F000, 0x1FB00)] if not 0xD800 <= c < 0xE000]
    for context in ("a{0}b", "{0}", "x {0}\x01{0}1", "É'{0}s {0}Σ {0}\u0301"):
        for some in np.array_split(np.array(points), 40):
            text = "\n".join(context.format(chr(c)) for c in some)
            if np.frombuffer(mine.encode(text), "<u4").tolist() != theirs.encode(text, add_special_tokens=False).ids:
                assert [hex(c) for c in some.tolist() if np.frombuffer(mine.encode(context.format(chr(c))), "<u4").tolist() != theirs.encode(context.format(chr(c)), add_special_tokens=False).ids] == []
        mine.known = {}


def check_places(rows, capacity=4096):
    by: dict = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def packed(spark, lengths, capacity=4096):
    """How many sequences the operator takes, after a look at all places, and how many a plain loop over single pieces."""
    df = spark.createDataFrame([(k % 5 or None, 0, 0, int(n), 7) for k, n in enumerate(lengths)], packing._PIECES).repartition(5)
    got = packing.best_fit(df, capacity).select("sequence_id", "offset", "length").collect()
    assert sorted(r.length for r in got) == sorted(int(n) for n in lengths)
    gaps: list[int] = []
    for n in sorted(map(int, lengths), reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - n)
    return check_places([tuple(r) for r in got], capacity), len(gaps)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_rounds_take_as_few_sequences_as_best_fit_by_descending_length(spark, coalesced):
    """One sequence more at most; with many partitions most pieces find their gap in an earlier one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    rng = np.random.default_rng(3)
    spark.conf.set(key, coalesced)
    try:
        for capacity, lengths in ((16, rng.integers(1, 17, 300)), (50, rng.integers(1, 30, 300)), (4096, np.r_[np.ones(2000), rng.integers(1, 800, 1000), [4096] * 9, [2049] * 30])):
            mine, plain = packed(spark, lengths, capacity)
            assert mine <= plain + 1
    finally:
        spark.conf.unset(key)


def test_levels_of_partitions():
    """Places are taken from the last partition that has some, as from a stack over all of them."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        found = [(p, int(a), int(b)) for p, (a, b) in enumerate(rng.integers(0, 4, (6, 2)))]
        stack, taken = [], []
        for p, alone, left in found:
            taken += [(p, k, stack.pop()) for k in range(alone) if stack]
            stack += [(p, k) for k in range(left)]
        at = {p: (level, low) for p, level, low in packing._levels(found)}
        events = []
        for p, alone, left in found:
            level, low = at[p]
            events += [(level - k, (p, 0), (p, k)) for k in range(alone)]
            events += [(n, (p, 1), (p, n - (level - alone) - 1)) for n in range(max(level - alone, low) + 1, level - alone + left + 1)]
        events.sort()
        mine = [(p[0], k[1], before[2]) for before, (n, p, k) in zip([None, *events], events) if p[1] == 0 and before and before[0] == n]
        assert sorted(mine) == sorted(taken) and sum(e[1][1] for e in events) == len(taken)


def test_packing_is_one_pass_over_all_pieces(spark):
    """More pieces than the shards of before held: as few sequences as one pass leaves, at most one not filled."""
    df = spark.range(0, 160_000, 1, 5).selectExpr("id as doc_id", "repeat('a ', 3) as text")
    got = packing.pack(df, capacity=4096).select("sequence_id", "offset", "length").collect()
    n = check_places([tuple(r) for r in got])
    assert len(got) == 160_000 and {r.length for r in got} == {4} and n == -(-160_000 // 1024)


# ---------------------------------------------------------------- chat


def test_escapes():
    for t in ("", "<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "a\\n<|\\<||>\n"):
        assert chat.unescape(chat.escape(t)) == t and chat.unescape(chat.escape(t, True), True) == t and "\n" not in chat.escape(t, True)
        assert "<|" not in chat.escape(t)


def test_chat_tree(spark):
    convs = {1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "hi"), ("assistant", "yo"), ("user", "<|im_end|>\n"), ("assistant", "b\\")], 3: [("user", "hi"), ("assistant", "other")], 4: [(None, None)], 5: [("user", "hi"), ("assistant", "yo")], 6: [("ro\nle", "x" * 30_000)]}
    rows = [(c, k, r, t, 0) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(7, None, "user", "n"), (7, 0, "user", "z"), (7, 0, "user", "z")] and [(7, 0, "user", "z", 0), (7, 0, "user", "z", 0), (7, None, "assistant", "n", 0)]
    convs[7] = [("assistant", "n"), ("user", "z"), ("user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    check_chat(spark, df, convs)
    assert chat.emit_tree(chat.named_turns(df.limit(0))).count() == 0


def check_chat(spark, df, convs):
    turns = chat.named_turns(df).cache()
    stream = chat.emit_tree(turns).cache()
    emitted = sorted(stream.collect(), key=lambda r: r.start)
    distinct = {tuple((a or "", b or "") for a, b in rows[:k]) for rows in convs.values() for k in range(1, len(rows) + 1)}
    assert len(emitted) == len(distinct)  # what is shared is emitted once
    at = 0
    for r in emitted:
        assert r.start == at and r.length == len(r.tokens)
        at += r.length
    # Depth first: a node's parent is the last one before it that is a turn less deep, and the intervals say the same.
    parent = {r.node: r.parent for r in turns.collect()}
    attends = {r.node: r for r in chat.with_ancestors(stream).collect()}
    above: list = []
    for r in emitted:
        while above and above[-1].node != parent[r.node]:
            above.pop()
        assert bool(above) == (parent[r.node] is not None)
        above.append(r)
        spans = [(x.start, x.end) for x in attends[r.node].attends]
        want = [i for x in above for i in range(x.start, x.start + x.length)]
        assert [i for a, b in spans for i in range(a, b)] == want and attends[r.node].position == len(want) - r.length
    leaf = turns.groupBy("conv").agg(F.max_by("node", "n").alias("node"))
    read = {r.node: r for r in chat.read_conversations(stream, leaf.select("node").distinct()).collect()}
    for r in leaf.collect():
        rows = [(a or "", b or "") for a, b in convs[r.conv]]
        said = read[r.node]
        loss = [t for a, t in rows if a == "assistant"]
        assert (said.n_turns, said.loss_chars) == (len(rows), sum(map(len, loss)))
        assert said.turns_sha256 == sha256("".join(f"{a}\n{t}\n" for a, t in rows).encode()).hexdigest() and said.loss_sha256 == sha256("".join(loss).encode()).hexdigest()


def test_chat_trees_over_many_partitions(spark):
    """Conversations that go on over several partitions, share beginnings, end within others, and have no id."""
    rng = random.Random(12)
    convs: dict = {}
    for c in [None, *range(40)]:
        old = convs[rng.choice(list(convs))] if convs else []
        convs[c] = old[: rng.randint(0, len(old))] + [(rng.choice(["user", "assistant"]), rng.choice("abc") + f" {k}") for k in range(rng.randint(1, 12))]
    convs[50] = [("user" if k % 2 else "assistant", f"turn {k % 5}") for k in range(900)]
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    check_chat(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), convs)


def test_a_very_long_conversation(spark):
    """A hundred thousand turns that share all but their end with another conversation."""
    n = 100_000
    one = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    two = one.where(F.col("turn") < n - 5).withColumn("conv_id", F.lit(2)).unionByName(spark.createDataFrame([(2, n, "assistant", "end")], "conv_id int, turn long, role string, text string"))
    turns = chat.named_turns(one.unionByName(two))
    stream = chat.emit_tree(turns).cache()
    assert stream.count() == n + 1 and stream.agg(F.max(F.size("way"))).first()[0] == 2
    leaf = turns.groupBy("conv").agg(F.max_by("node", "n").alias("node"))
    assert sorted(r.n_turns for r in chat.read_conversations(stream, leaf).collect()) == [n - 4, n]


def test_one_row_of_each_group_stays(spark):
    """Repeated ids with other texts, rows without id, repeated rows that differ elsewhere, clashing names."""
    text = [" ".join(f"{w}{k}" for k in range(40)) for w in ("a", "b", "c")]
    rows = [(2, text[0], "z", 1), (1, text[0], "y", 2), (1, text[1], "y", 3), (None, text[1], "x", 4), (None, text[2], "w", 5), (None, text[2], "v", 6), (3, None, "u", 7), (4, "", "t", 8), (5, text[2] + " tail", "s", 9), (1, text[0], "a", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string, key int")
    got = simhash.smallest_of_groups(df)
    assert got.columns == df.columns
    linked = bin(print_of(text[2]) ^ print_of(text[2] + " tail")).count("1") <= 3
    want = {(1, text[0], "a", 10), (1, text[1], "y", 3), (3, None, "u", 7), (5, text[2] + " tail", "s", 9)}
    assert {tuple(r) for r in got.collect()} == (want if linked else want | {(None, text[2], "v", 6)})
    assert simhash.smallest_of_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize(("ident", "text"), [("print", "fingerprint"), ("component", "least"), ("key", "said"), ("node", "u")])
def test_simhash_columns_may_have_any_names(spark, ident, text):
    rows = [(3, "the same words are here"), (1, "the same words are here"), (2, "quite other ones stand there"), (4, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], f"{ident} long, {text} string, root long, v long")
    got = {r[0]: r[2] for r in simhash.simhash_groups(df, ident, text).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


# ---------------------------------------------------------------- pipeline


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    """Empty tables, and rows with the same id or none, null texts and columns with clashing names."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = [(1, "one text of some words", "en", "s", 1, 0.5), (1, "quite another text with the same id", "en", "s", 2, 0.5), (None, "no id here", None, None, None, None), (None, None, None, None, None, None), (2, "", "", "", 0, 0.0), (2, "", "", "", 0, 0.0)]
    for name, rows in (("none", []), ("odd", odd)):
        path = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, doc double").write.parquet(str(path / "documents.parquet"))
        labels.write.parquet(str(path / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(path)).collect()
        assert sorted((r.doc_id or 0) for r in packed) == ([0, 1, 1, 2] if rows else [])

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [a + b for a in ("the", "and", "re", "on", "ti") for b in ("sha", "in", "ed", "is", "ou", "ly")]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(words, k=80)) + (" idiot" if i % 6 == 0 else "")
        rows.append((i, text, "en", "s", len(text)))
    passage = " ".join(rng.choices(words, k=30))
    rows[1] = (1, rows[1][1] + " " + passage, "en", "s", 0)
    rows[7] = (7, rows[7][1] + " " + passage, "en", "s", 0)
    rows[8] = (8, rows[2][1], "en", "s", 0)
    rows[9] = (9, rows[9][1] + " password=hunter2222", "en", "s", 0)
    rows += [(300, None, None, None, None), (None, "without an id", "en", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i in range(301) if i % 6 or i == 300} | {None}
    assert set(kept["toxicity"]) == clean
    assert clean - set(kept["simhash_near_dedup"]) == {8}
    cut = kept["suffix_array_dedup"]
    assert passage in cut[1] and passage not in cut[7] and cut[3] == rows[3][1]
    assert kept["secret_scans"][9].endswith("[SECRET]") and kept["secret_scans"][None] == "without an id"
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["secret_scans"])
    check_places([(r.sequence_id, r.offset, r.length) for r in packed])
    assert toxicity.THRESHOLD == 0.7
