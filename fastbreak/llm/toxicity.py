"""Toxicity by noisy-channel deobfuscation.

Tokens written in leetspeak, with separators inside, with repeated letters or letter by letter are restored: each is
a lattice of what its characters may stand for, and Viterbi decoding takes the likeliest word under a character
language model (trigrams counted over all documents) and the channel's costs. Restored words and their prefixes are
the features. A decision list is fitted on a bounded, hashed sample of labelled rows: of the features that are
almost only in toxic rows, those that explain most toxic rows not yet explained. A text's score is the noisy-or of
the precisions of the features in it.

Every token with a letter or a symbol that stands for one is decoded, however long; tokens of digits alone are numbers.

Counting the language model is one aggregation with a bounded number of keys; scoring is row by row.

Defined cases: a null or empty text gets the base score; without usable labels every score is the same small
number; repeated rows score alike; other columns pass through, and an existing column named as the output is
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts, tidy

#: Labelled rows that the decision list is fitted on, about (chosen by the hash of their id).
SAMPLE = 8_000
#: A feature's least precision among the labelled rows of the sample, and least number of rows it must newly explain.
PRECISION, SUPPORT = 0.85, 3
#: A clean row with a feature weighs as much as so many toxic ones.
CAUTION = 3
#: Rows are rejected from this score on.
THRESHOLD = 0.7
#: A feature that explains nothing new is kept too if it is in this part of the toxic rows, and no listed feature in more than that part of its own rows: so words of one group of copies are not.
COMMON, ALIKE = 0.02, 0.7
#: Lengths of the prefixes that count as features.
PREFIXES = (4, 5, 6, 7)
#: Different words with the same prefix are dense in a text if one in so many tokens is one of them.
DENSE = 120
#: Letters of the language model; anything else is one further symbol, and "^" stands before and after a word.
LETTERS = "^abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
#: What characters are written for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set(" .-_*~'`,:;/\\")
#: Channel costs (negative log): a leet character, a dropped separator, a dropped repetition (long run, double letter), a character taken as it is though not a letter.
COST_LEET, COST_SEPARATOR, COST_RUN, COST_DOUBLE, COST_ODD = 0.5, 0.3, 0.2, 8.0, 6.0
#: Restored tokens that a worker remembers before it starts over.
REMEMBERED = 150_000
#: Characters of the longest token that is remembered.
LONG = 200

#: Characters other than digits that stand for letters.
SIGNS = "".join(c for c in LEET if not c.isdigit())
#: Single characters with a separator between each two.
_ONE = rf"(?:[^\W_]|[{re.escape(SIGNS)}])"
SPACED = re.compile(rf"(?<![^\W_]){_ONE}(?:[ ._*-]{_ONE}){{2,}}(?![^\W_])")
EDGES = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>«»“”„…%&*#|~^=_-/\\"
RUN = re.compile(r"(.)\1\1")
#: A letter or a sign for one.
SPEAKS = re.compile(rf"[^\W\d_]|[{re.escape(SIGNS)}]")
_SIZE = len(LETTERS) + 1
_CODE = np.full(0x250, _SIZE - 1, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i
#: Where letters are, by code point, for cutting text into words.
_CODE[[ord(c) for c in " \t\n\r\x0b\x0c.,;:!?\"'()-"]] = 0


# ---------------------------------------------------------------- language model


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for part in slices(texts(batch.column(0)), limit=500_000):
            points = np.frombuffer((" " + " ".join(part).lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            code = _CODE[np.minimum(points, len(_CODE) - 1)]
            total += np.bincount((code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:], minlength=_SIZE**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def language_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log-probabilities [before last, last, next] of letters, from all texts; the size is fixed by LETTERS."""
    counts = np.zeros(_SIZE**3)
    for gram, n in df.select(text).mapInArrow(tidy(_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    three = counts.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 10 * p2[None]) / (three.sum(axis=2, keepdims=True) + 10)
    return -np.log(p3)


class Restorer:
    """Viterbi decoding of obfuscated tokens."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.code = {c: i for i, c in enumerate(LETTERS)}
        self.known: dict[str, str] = {}

    def options(self, raw: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for, with costs; "" is nothing."""
        c = raw[i]
        out = []
        if c in self.code and c != "^":
            out.append((c, 0.0))
            if i and raw[i - 1] == c:
                out.append(("", COST_RUN if raw[max(0, i - 2) : i + 1] == c * 3 or raw[i - 1 : i + 2] == c * 3 else COST_DOUBLE))
            return out
        if c in LEET:
            out += [(x, COST_LEET) for x in LEET[c]]
            if i and raw[i - 1] == c:
                out.append(("", COST_DOUBLE))
        if c in SEPARATORS or c in "!|":
            out.append(("", COST_SEPARATOR))
        return out or [(c, COST_ODD)]

    def decode(self, raw: str) -> str:
        """The likeliest word behind a token."""
        word = self.known.get(raw)
        if word is not None:
            return word
        other = _SIZE - 1
        model, code = self.model, self.code
        letters: list[str] = []
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(raw)):
            options = [(x, code.get(x, other), cost) for x, cost in self.options(raw, i)]
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in best.items():
                for x, c, cost in options:
                    state, way, t = ((a, b), path, total + cost) if not x else ((b, c), (path, x), total + cost + model[a][b][c])
                    if state not in after or t < after[state][0]:
                        after[state] = (t, way)
            best = after
            if len(best) == 1 and i % 64 == 63:  # all ways have one past: it is settled, and long tokens take no memory
                ((state, (_, path)),) = best.items()
                letters += self._unrolled(path)
                best = {state: (0.0, ())}
        _, path = min(((t + model[a][b][0], p) for (a, b), (t, p) in best.items()), key=lambda x: x[0])
        word = "".join(letters + self._unrolled(path))
        if len(raw) <= LONG:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known[raw] = word
        return word

    @staticmethod
    def _unrolled(path: tuple) -> list[str]:
        letters = []
        while path:
            path, x = path
            letters.append(x)
        return letters[::-1]

    def word(self, token: str) -> str:
        """The word behind a lower-case token: itself if it is plain, nothing if it has neither letters nor SIGNS."""
        plain = token.strip(EDGES)
        if plain.isalpha() and not RUN.search(plain):
            return plain
        token = token.rstrip(".,;:?\"')]}%&#").lstrip("\"'([{<")
        return self.decode(token) if SPEAKS.search(token) else ""

    def spaced(self, lowered: str) -> list[str]:
        """Words written letter by letter."""
        return [self.decode(m[0]) for m in SPACED.finditer(lowered) if SPEAKS.search(m[0])]


def features_of(words: dict[str, int], tokens: int) -> set[str]:
    """Of a text's words, with the tokens that each is in: each, its prefixes, and prefixes that 2 or 3 of them share,
    or 2 that are one in DENSE tokens together."""
    words = {w: n for w, n in words.items() if len(w) > 2}
    shared: Counter[str] = Counter()
    often: Counter[str] = Counter()
    for w, times in words.items():
        for n in PREFIXES:
            if len(w) >= n:
                shared[w[:n] + "*"] += 1
                often[w[:n] + "*"] += times
    out = words.keys() | shared.keys()
    for prefix, n in shared.items():
        if n > 1:
            out.add(prefix + "2")
            if n > 2:
                out.add(prefix + "3")
            if often[prefix] * DENSE >= tokens:
                out.add(prefix + "d")
    return out


# ---------------------------------------------------------------- fitting


def held_out(ident: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.col(ident).cast("string")) % 3 == 1


def _count_features(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        clean: Counter[str] = Counter()
        toxic: dict[str, list[int]] = {}
        for batch in batches:
            for ident, text, label in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lowered = text.lower()
                tokens = lowered.split()
                words = Counter(restorer.spaced(lowered))
                for t, n in Counter(tokens).items():
                    words[restorer.word(t)] += n
                seen = features_of(words, len(tokens))
                if label:
                    for f in seen:
                        toxic.setdefault(f, []).append(ident)
                else:
                    clean.update(seen)
        for part in slices(sorted(toxic.keys() | clean.keys()), weight=lambda f: 1 + len(toxic.get(f, ())), limit=50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([clean[f] for f in part], pa.int64()), pa.array([toxic.get(f, []) for f in part], pa.list_(pa.int64()))], ["feature", "clean", "toxic"])

    return run


class ToxicModel:
    """The language model, the features with their precisions, and the score without any feature."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], base: float) -> None:
        self.model, self.weights, self.base = model, weights, base


def fit_toxicity(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Fit on labelled rows that are not held out. Reads all texts once for the language model, the sample's once more."""
    model = language_model(docs, text)
    usable = labels.where(~held_out(ident) & F.col(label).isNotNull()).groupBy(ident).agg(F.max(label).alias("__label"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(ident), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample has about `sample` rows of two numbers, whatever the size of the labels.
    rows = docs.select(ident, text).join(F.broadcast(chosen), ident)
    counted = rows.select(F.col(ident).cast("long"), text, F.col("__label") == 1).mapInArrow(tidy(_count_features(model)), "feature string, clean long, toxic array<long>")
    found = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("toxic")).alias("toxic"))
    found = found.where((F.size("toxic") >= SUPPORT) & (F.size("toxic") >= PRECISION * (F.size("toxic") + F.col("clean"))))
    toxic_rows = chosen.where("__label = 1").count()
    candidates = {r["feature"]: (set(r["toxic"]), r["clean"]) for r in found.collect()}
    weights = decision_list(candidates)
    explained = set().union(*(candidates[f][0] for f in weights)) if weights else set()
    return ToxicModel(model, weights, (toxic_rows - len(explained) + 0.5) / (chosen.count() + 10.0))


def decision_list(candidates: dict[str, tuple[set, int]]) -> dict[str, float]:
    """Features with their precisions: again and again the one with most rows not yet explained, clean rows held against it."""
    left = {f: set(rows) for f, (rows, clean) in candidates.items() if len(rows) - CAUTION * clean >= SUPPORT}
    gain = {f: CAUTION * candidates[f][1] for f in left}
    weights: dict[str, float] = {}
    while left:
        # Of equals, the one in more rows, then whole words before prefixes, then the longer.
        best = max(left, key=lambda f: (len(left[f]) - gain[f], len(candidates[f][0]), "*" not in f, len(f), f))
        new = left.pop(best)
        rows, clean = candidates[best]
        weights[best] = (len(rows) + 0.5) / (len(rows) + clean + 0.7)
        for f in list(left):
            left[f] -= new
            if len(left[f]) - gain[f] < SUPPORT:
                del left[f]
    listed = [candidates[f][0] for f in weights]
    least = max(2 * SUPPORT, COMMON * len(set().union(*listed))) if listed else 0
    for f, (rows, clean) in candidates.items():
        if listed and "*" not in f and len(rows) - CAUTION * clean >= least and max(len(rows & other) for other in listed) <= ALIKE * len(rows):
            weights[f] = (len(rows) + 0.5) / (len(rows) + clean + 0.7)
    return weights


# ---------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, model: ToxicModel) -> None:
        self.restorer, self.weights, self.base = Restorer(model.model), model.weights, model.base
        self.stems = {f.partition("*")[0] + "*" * ("*" in f) for f in model.weights}
        self.words = [f for f in model.weights if "*" not in f and len(f) > 3]
        self.hits: dict[str, str] = {}

    def wanted(self, word: str) -> str:
        """The word if any feature may come from it, else nothing."""
        return word if word in self.stems or any(word[:n] + "*" in self.stems for n in PREFIXES if len(word) >= n) else ""

    def score(self, text: str) -> float:
        lowered = text.lower()
        tokens = lowered.split()
        distinct = Counter(tokens)
        if len(self.hits) > REMEMBERED:
            self.hits = {}
        hits = self.hits
        for t in distinct:
            if t not in hits:
                hits[t] = self.wanted(self.restorer.word(t))
        words: Counter[str] = Counter()
        for t, n in distinct.items():
            if hit := hits[t]:
                words[hit] += n
        for run in self.restorer.spaced(lowered):  # where the word begins is not marked
            for w in {self.wanted(run)} | {w for w in self.words if w in run}:
                words[w] += 1
        found = sorted(features_of(words, len(tokens)) & self.weights.keys())
        return 1.0 - (1.0 - self.base) * math.prod(1.0 - self.weights[f] for f in found)


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the double column `out`, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the trigram table and at most a few thousand features

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.array([scorer.score(t) for t in texts(batch)], pa.float64())

    return df.withColumn(out, run(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_noisy_channel_toxicity: score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
