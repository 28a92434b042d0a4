"""Secret scans: patterns, and strings that zstandard finds novel in a sensitive context.

A candidate is a long run of key-like characters with a sensitive word close before or behind it. Its novelty is what
it adds to the compressed size of the code around it, by a compressor primed with a dictionary of identifiers:
strings that the context or the dictionary explains add few bytes, random ones about their length. Candidates of high
novelty are reported besides the matches of the fixed patterns, whether they overlap or not.

The dictionary holds the words that most identifiers of the corpus are made of, counted over all texts; only sums per
word are shuffled. Every text is searched as a whole, and rows are independent then.

Defined cases: a null or empty text has no spans; repeated rows give equal spans; of words that are equally frequent
the dictionary takes the first ones; of an empty table it is the fixed part; other columns pass through, and
existing columns named as the outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, slices, table, texts, tidy

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, searched in the SIGHT characters on each side of a candidate.
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|auth|bearer|credential|private|signature|sig=|cert|session|cookie", re.IGNORECASE)
SIGHT = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Characters of code on each side that a candidate is measured against.
AROUND = 1500
#: Least added bytes for each character of the candidate.
NOVELTY = 0.7
#: Parts of identifiers that the dictionary counts: too short to be a candidate, so no secret gets into it by its copies.
WORD = re.compile(r"[A-Z]?[a-z]{3,14}|[A-Z]{4,15}")
#: Words of the dictionary; words that a task counts before it hands them on.
DICTIONARY, COUNTED = 2_000, 200_000
#: The fixed part of the dictionary: what code is full of.
IDENTIFIERS = (
    "import from return class def function const let var static public private protected void int string boolean true false null None self this "
    "config configuration settings environment variable default value name type key token secret password authorization bearer credential "
    "client_id client_secret access_key access_token refresh_token private_key public_key session_id user_name username database connection "
    "https://www.example.com/api/v1/users/ localhost 127.0.0.1 application/json content-type user-agent description documentation implementation "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_api_key_here placeholder changeme example test xxxxxxxxxxxxxxxx 0000000000000000"
)


@lru_cache(maxsize=4)
def _primed(dictionary: str) -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def added_bytes(text: str, start: int, end: int, dictionary: str = IDENTIFIERS) -> int:
    """By how much a string lengthens the compressed code around it, placed after that code."""
    compressor = _primed(dictionary)
    around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "surrogatepass")
    return len(compressor.compress(around + text[start:end].encode())) - len(compressor.compress(around))


def spans_of(text: str, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if SENSITIVE.search(text):
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if (SENSITIVE.search(text, max(0, a - SIGHT), a) or SENSITIVE.search(text, b, b + SIGHT)) and added_bytes(text, a, b, dictionary) >= NOVELTY * (b - a):
                found.append((a, b, "novel"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal stretch of findings replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for part in slices(texts(batch.column(0))):
            counts.update(WORD.findall("\n".join(part)))
            if len(counts) > COUNTED:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def identifier_dictionary(df: DataFrame, text: str = "text", size: int = DICTIONARY) -> str:
    """The fixed part, then the `size` most frequent words of all texts, the most frequent last."""
    counted = df.select(text).mapInArrow(tidy(_count_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
    return " ".join([IDENTIFIERS, *(r["word"] for r in reversed(top))])


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets", redacted: str | None = None, dictionary: str | None = None) -> DataFrame:
    """Add `out`, an array of structs (kind, start, end); with redacted, also that column: the text without them.

    dictionary: that of these texts without it.
    """
    dictionary = dictionary or identifier_dictionary(df, text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("spans", pa.list_(span)), ("clean", pa.string())])

    @F.arrow_udf("struct<spans:array<struct<kind:string,start:int,end:int>>,clean:string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for raw in batch.to_pylist():
                spans = spans_of(raw or "", dictionary)
                rows.append({"spans": [{"kind": k, "start": a, "end": b} for a, b, k in spans], "clean": None if raw is None or not redacted else redact(raw, spans)})
            yield pa.array(rows, kind)

    scanned = free_name(df, "scan")
    result = F.col(scanned)
    df = df.withColumn(scanned, scan(F.col(text))).withColumn(out, result["spans"])
    return (df.withColumn(redacted, result["clean"]) if redacted else df).drop(scanned)


def secret_digests(df: DataFrame, text: str = "text", out: str = "found", dictionary: str | None = None) -> DataFrame:
    """Add the struct `out`: number of base findings by kind, their digest, and all spans as text."""
    dictionary = dictionary or identifier_dictionary(df, text)
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    @F.arrow_udf("struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for part in slices(texts(batch)):
                for x in part:
                    spans = spans_of(x, dictionary)
                    base = [s for s in spans if s[2] != "novel"]
                    rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return df.withColumn(out, scan(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_secret_novelty: findings in every document."""
    return secret_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found.*")
