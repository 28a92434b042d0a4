"""Merkle manifest, nearest neighbours and whitening, each against a plain version."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastbreak.llm import merkle, polytope, whitening
from fastbreak.llm.common import table

SF = "/root/testdata/sf0.01"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def shown(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The top, and of each leaf the (slot, siblings) of every level."""
    ways: list[list] = [[] for _ in nodes]
    of = list(range(len(nodes)))  # where each leaf's ancestor is
    while len(nodes) > 1:
        runs = [nodes[a : a + 8] for a in range(0, len(nodes), 8)]
        for leaf, at in enumerate(of):
            run = runs[at // 8]
            ways[leaf].append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        of = [at // 8 for at in of]
        nodes = [H(*run) for run in runs]
    return nodes[0], ways


def plain_manifest(rows: list[dict]) -> list[tuple]:
    def leaf(r: dict) -> str:
        return H(*(shown(r[c]) for c in merkle.FIELDS))

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops, ways = {}, {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        tops[lang], ways[lang] = tree([leaf(r) for r in groups[lang]])
    if not langs:
        return []
    root, above = tree([tops[x] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, way in zip(groups[lang], ways[lang], strict=True):
            steps = way + above[k]
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            own = leaf(changed)
            for slot, others in steps:
                own = H(*others[:slot], own, *others[slot:])
            out.append((r["doc_id"], leaf(r), tops[lang], root, H(*(x for _, others in steps for x in others)), own, own == root))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_manifest_of_documents(spark):
    docs = table(spark, SF, "documents")
    got = merkle.query(spark, SF).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got, plain_manifest([r.asDict() for r in docs.collect()]))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("many", [0, 1, 2, 8, 9, 64, 65, 130])
def test_manifest_of_odd_rows(spark, many):
    langs = [None, "-", "ä", "zz", "z", "a" * 70]
    rows = [(None if i % 17 == 3 else i // 2, None if i % 7 == 1 else f"Text {i // 2} É" * (i % 5), langs[0 if i > 40 else i % 6], None if i % 3 else "s:1", None if i % 4 else i, "clash") for i in range(many)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    same(merkle.document_manifest(df).collect(), plain_manifest([r.asDict() for r in df.collect()]))


# ---------------------------------------------------------------- nearest neighbours


def plain_neighbours(ids, vectors, asked) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for q in asked:
        a = vectors[q]
        scored = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), int(ids[j])) for j, b in enumerate(vectors) if ids[j] != ids[q])
        out[int(ids[q])] = [(v, -s) for s, v in scored[: polytope.NEAREST]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall(spark, sf):
    rows = table(spark, f"/root/testdata/{sf}", "embeddings").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = plain_neighbours(ids, vectors, np.flatnonzero(ids % 50 == 0))
    got: dict = {}
    for r in polytope.query(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    place = {int(v): k for k, v in enumerate(ids)}
    for q, x in got.items():
        a = vectors[place[q]]
        for v, s in x.values():
            b = vectors[place[v]]
            assert abs(s - (a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-15 * 8
        assert [x[k] for k in range(1, 6)] == sorted(x.values(), key=lambda p: (-p[1], p[0]))
    found = sum(v in {p[0] for p in got[q].values()} for q, x in want.items() for v, _ in x)
    assert found / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(polytope, "CHUNK", 7)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(30)] + [(200, [x * 2.0**-40 for x in base[0]]), (300, [1e200, 0.0, 0.0, 0.0, 1e200])]
    rows += [(5, base[5]), (400, None), (401, [0.0] * 5), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [float("nan")] * 5), (404, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, base[1]), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (502, [1.0]), (503, [])]
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "vec_id long, embedding array<double>, rank int, size string")
    got: dict = {}
    for r in polytope.nearest_neighbours(df, F.lit(True), probes=1 << 20, tables=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    sound = {i: np.ldexp(np.array(v), -np.frexp(np.abs(v).max())[1]) for i, v in rows if i is not None and i not in (400, 401, 402, 403, 404, 503)}
    for q, a in sound.items():
        same_length = [(v, b) for v, b in sound.items() if v != q and len(b) == len(a)]
        want = plain_neighbours([v for v, _ in same_length] + [q], [b for _, b in same_length] + [a], [len(same_length)])[q]
        assert [(v, pytest.approx(s, abs=1e-14)) for v, s in want] == [(v, s) for _, v, s in sorted(got.get(q, []))], q
    assert set(got) <= set(sound) and 502 not in got and len(got[500]) == 1


def test_few_probes_still_return_all_of_few(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(64).tolist()) for i in range(4)], "vec_id long, embedding array<double>")
    got = polytope.nearest_neighbours(df, F.col("vec_id") == 0, tables=1, probes=1).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3]
    assert polytope.nearest_neighbours(df.limit(0), F.lit(True)).collect() == []


def test_turning_keeps_lengths_and_axes_are_the_nearest():
    x = polytope.unit(np.random.default_rng(0).standard_normal((50, 37)))
    y = polytope.turned(x, 3)
    assert np.allclose(x @ x.T, y @ y.T) and y.shape[1] == 64
    both = np.concatenate([np.eye(64), -np.eye(64)])
    names = np.r_[np.arange(64) * 2, np.arange(64) * 2 + 1]
    assert (polytope.nearest_axes(y, 9) == names[np.argsort(-(y @ both.T), axis=1)[:, :9]]).all()


# ---------------------------------------------------------------- whitening


def check_whitening(got, vectors, wanted=32):
    """Against eigenvectors of the whole matrix."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(c) for c in zip(*x, strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(wanted, d)
    cells = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(cells) == n * k
    white = np.array([[cells[i, j + 1].whitened for j in range(k)] for i, _ in vectors])
    turn = axes[:, :k] / np.sqrt(values[:k])
    want = c @ turn
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-6
    for m, (i, _) in enumerate(vectors):
        assert {cells[i, j + 1].deviation for j in range(k)} == {sum((n * a - b) ** 2 for a, b in zip(x[m], s, strict=True))}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    assert all(abs(cells[vectors[0][0], j + 1].explained / (values[j] / values.sum()) - 1) < 1e-9 for j in range(k))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whitening_like_eigh(spark, sf):
    vectors = [(r[0], r[1]) for r in table(spark, f"/root/testdata/{sf}", "embeddings").select("vec_id", "embedding").collect()]
    check_whitening(whitening.query(spark, f"/root/testdata/{sf}").collect(), vectors)


def test_components_beyond_the_block():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    v = (q * np.linspace(1, 3, 300) ** 2) @ q.T
    values, vectors = whitening.components(lambda x: v @ x, 300, 32)
    assert np.allclose(values, (np.linspace(1, 3, 300) ** 2)[::-1][:32], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12 and np.abs(v @ vectors - vectors * values).max() < 1e-10


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(50, [0.0] * 6), (51, [100.0, -20.0, 3.0, 4.0, 5.0, 6.0])]
    bad = [(60, None), (61, [None] * 6), (62, [float("nan")] + [0.0] * 5), (63, [float("inf")] * 6), (64, [1e300] * 6), (65, [])]
    flat = [(70, [0.25, 1.0]), (71, [0.25, 2.0]), (72, [0.25, 4.0]), (73, [1.0])]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in good + bad + flat], "vec_id long, embedding array<double>, n int, whitened double")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good + flat}
    check_whitening([r for r in got if r.vec_id < 60], good)
    two = {(r.vec_id, r.component): r for r in got if 70 <= r.vec_id <= 72}
    assert len(two) == 6 and all((r.whitened is None) == (k[1] == 2) for k, r in two.items()) and {r.identity_error < 1e-12 for r in two.values()} == {True}
    (one,) = [r for r in got if r.vec_id == 73]
    assert (one.whitened, one.explained, one.deviation, one.n) == (None, 0.0, 0, 1)
    assert whitening.whiten(df.where("vec_id >= 60 and vec_id < 70")).collect() == [] and whitening.whiten(df.limit(0)).collect() == []


def test_whitening_counts_repeated_rows_and_rows_without_id(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2
