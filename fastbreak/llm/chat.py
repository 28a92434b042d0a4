"""Chat formatting as a prefix tree: what conversations share from their first turn on is emitted once.

A node is a turn with all turns before it, named by a 128-bit hash of those. Equal nodes of any number of conversations
are one row. Nodes are emitted in depth-first order as one long stream of token ids, each with its place in the
stream and, on demand, its position (the tokens before it in its own conversation) and the intervals of the stream
that it may attend to: those of its ancestors, then its own. The loss mask is an interval of a node's tokens.

Names are running hashes, as a scan: turns are sorted by range, every partition hashes on its own, and what it begins
with is put in front by the partitions' ends. No conversation is collected. A turn is a fork's child if other turns
follow its parent too (or it is a first turn); from there to the next fork nodes lie one behind the other in the
stream and are one interval. So a node's way from the root is a list of forks, not of turns, and depth-first order is
the order of those lists, then of depth. Such a list has 16 bytes for each fork on the way.

Control strings inside texts are escaped reversibly: a backslash is doubled, and "<|" becomes "<\\\\|".

Defined cases: rows of a conversation are taken by turn, then role and text, nulls first; a null role or text is
empty; rows without conversation id are one conversation; repeated rows are turns of their own; conversations of equal
turns share all nodes, and one may end within another; other columns are not needed and not read; an empty table
gives an empty result; very long conversations stream through their tasks row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import checkpoint, slices, table

# The template's marks.
START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>((?:[^\n])*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: The role whose texts are learned.
LEARNED = "assistant"
#: Odd multipliers of the two halves of running hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def escape(text: str, line: bool = False) -> str:
    """Without the template's marks; with line, also without line ends."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.DOTALL)


# ---------------------------------------------------------------- names

#: A turn's number and name counted from where its conversation begins in the partition, and the name before it.
_SCANNED = "part int, last boolean, n long, name array<long>, before array<long>"
_NAMED = "n long, node binary, parent binary"


def _turn_hash(role: str, text: str) -> tuple[int, int]:
    raw = xxhash.xxh3_128_intdigest(f"{len(role)}\n{role}{text}".encode("utf-8", "surrogatepass"))
    return raw >> 64, raw & _MASK


def _after(before: tuple[int, int], turns: int, own: tuple[int, int]) -> tuple[int, int]:
    """The name of `own`, which covers so many turns, with `before` in front."""
    a, b = (x * pow(base, turns, 1 << 64) + y & _MASK for x, y, base in zip(before, own, BASES, strict=True))
    return a, b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add _SCANNED to conv, turn, role, text, which come sorted; the partition's last row is marked."""
    part = TaskContext.get().partitionId()
    conv, n, name, first = None, 0, (0, 0), True
    waiting: pa.RecordBatch | None = None

    def marked(batch: pa.RecordBatch, end: bool) -> pa.RecordBatch:
        last = np.zeros(batch.num_rows, bool)
        last[-1] = end
        return batch.set_column(batch.schema.get_field_index("last"), "last", pa.array(last))

    for batch in batches:
        rows = []
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if first or c != conv:
                conv, n, name, first = c, 0, (0, 0), False
            before, n = name, n + 1
            name = _after(before, 1, _turn_hash(role, text))
            rows.append((n, [_signed(x) for x in name], [_signed(x) for x in before]))
        if not rows:
            continue
        if waiting is not None:
            yield marked(waiting, False)
        none = pa.array([False] * len(rows))
        n_, name_, before_ = zip(*rows, strict=True)
        columns = [*batch.columns, pa.array([part] * len(rows), pa.int32()), none, pa.array(n_, pa.int64()), pa.array(name_, pa.list_(pa.int64())), pa.array(before_, pa.list_(pa.int64()))]
        waiting = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(c.split()[0] for c in _SCANNED.split(", "))])
    if waiting is not None:
        yield marked(waiting, True)


def _name(carried: dict[int, tuple]):
    """conv, role, text and _NAMED from scanned rows; carried: by partition, the conversation that it goes on with."""

    def whole(x: list[int]) -> tuple[int, int]:
        return x[0] & _MASK, x[1] & _MASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, part, n, name, before in zip(*(batch.column(i).to_pylist() for i in (0, 3, 5, 6, 7)), strict=True):
                ahead = carried.get(part)
                if ahead is not None and ahead[0] == c:
                    name, before = _after(ahead[2], n, whole(name)), _after(ahead[2], n - 1, whole(before))
                    n += ahead[1]
                else:
                    name, before = whole(name), whole(before)
                head = (n - 1).to_bytes(4, "big")
                out.append((n, n.to_bytes(4, "big") + b"".join(x.to_bytes(8, "big") for x in name), head + b"".join(x.to_bytes(8, "big") for x in before) if n > 1 else None))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["conv", "role", "text", "n", "node", "parent"])

    return run


def named_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, role, text, n, node, parent): every turn with its number from 1 on, its node and the one before it."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    by = ["conv", "turn", "role", "text"]
    kinds = dict(rows.dtypes)
    scanned = checkpoint(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scan, f"{', '.join(f'{c} {kinds[c]}' for c in by)}, {_SCANNED}").drop("turn"))
    # One row for each partition.
    carried, ahead = {}, None
    for r in scanned.where("last").orderBy("part").collect():
        carried[r["part"]] = ahead
        name = tuple(x & _MASK for x in r["name"])
        ahead = (r["conv"], ahead[1] + r["n"], _after(ahead[2], r["n"], name)) if ahead is not None and ahead[0] == r["conv"] else (r["conv"], r["n"], name)
    carried = {p: x for p, x in carried.items() if x is not None}
    return scanned.mapInArrow(_name(carried), f"conv {kinds['conv']}, role string, text string, {_NAMED}")


# ---------------------------------------------------------------- tree

_PLACED = "node binary, way array<binary>, tokens array<int>, low int, high int, length long, part int, place long"


def _place(path: str):
    """The template's token ids of turns, the interval of them that is learned, and their place in the partition's
    part of the stream. Input: node, n, way, role, text, in the stream's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, public_tokenizers.PATTERN)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            first = 0
            for some in slices(list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)), lambda r: len(r[1])):
                heads = bpe.encode([f"{START}{escape(role, True)}\n" for role, _ in some])
                bodies, (end,) = bpe.encode([escape(text) for _, text in some]), bpe.encode([END])
                rows = []
                for (role, _), head, body in zip(some, heads, bodies, strict=True):
                    ids = np.frombuffer(head + body + end, "<u4").astype(np.int32)
                    low, high = (len(head) // 4, (len(head) + len(body)) // 4) if role == LEARNED else (0, 0)
                    rows.append((ids, low, high, len(ids), part, at))
                    at += len(ids)
                types = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                here = batch.slice(first, len(some))
                first += len(some)
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [c.split()[0] for c in _PLACED.split(", ")])

    return run


#: Children of one node are dealt over so many keys when they are told whether it is a fork.
SALTS = 8


def emit_tree(turns: DataFrame, path: str | None = None) -> DataFrame:
    """The stream: (node, way, start, length, tokens, low, high), a row for each distinct node in depth-first order.

    way: the forks' children from the root to the node, the last one being where the node's own interval begins.
    """
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "n", "role", "text")), F.min("conv").alias("conv"))
    forks = nodes.where("parent is not null").groupBy("parent").count().where("count > 1").select("parent")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    forks = forks.select("parent", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("fork"))
    child = nodes.select("node", "parent", salt).join(forks, ["parent", "salt"], "left").where("parent is null or fork").select("node")
    ways = turns.select("conv", "n", "node").join(child, "node", "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("forks"))
    placed = nodes.join(ways.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
    placed = placed.select("node", "n", F.transform(F.filter("forks", lambda x: x["n"] <= F.col("n")), lambda x: x["node"]).alias("way"), "role", "text")
    placed = placed.repartitionByRange("way", "n").sortWithinPartitions("way", "n")
    placed = checkpoint(placed.mapInArrow(_place(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), _PLACED))
    # One row for each partition.
    ends = placed.groupBy("part").agg(F.sum("length").alias("size")).orderBy("part").collect()
    total, first = 0, []
    for row in ends:
        first.append((row["part"], total))
        total += row["size"]
    starts = turns.sparkSession.createDataFrame(first, "part int, first long")
    return placed.join(F.broadcast(starts), "part").select("node", "way", (F.col("first") + F.col("place")).alias("start"), "length", "tokens", "low", "high")


def _intervals(stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, k, head, start, end) of the intervals that nodes attend to: whole ones between forks, then up to the node."""
    spans = stream.select(F.element_at("way", -1).alias("head"), "start", (F.col("start") + F.col("length")).alias("end"))
    spans = spans.groupBy("head").agg(F.min("start").alias("start"), F.max("end").alias("whole"))
    asked = wanted.select("node", (F.col("start") + F.col("length")).alias("own"), F.size("way").alias("forks"), F.posexplode("way").alias("k", "head"))
    return asked.join(spans, "head").select("node", "k", "head", "start", F.when(F.col("k") == F.col("forks") - 1, F.col("own")).otherwise(F.col("whole")).alias("end"))


def with_ancestors(stream: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, position, attends): the tokens before each node in its conversation, and the intervals (start, end) of
    the stream that hold its ancestors and itself, first turn first.

    of: the nodes that are asked for (column node); all without it.
    """
    wanted = stream if of is None else stream.join(of.select("node"), "node", "left_semi")
    found = _intervals(stream, wanted).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "start", "end"))).alias("found"), F.sum(F.col("end") - F.col("start")).alias("all"))
    attends = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.join(wanted.select("node", "length"), "node").select("node", (F.col("all") - F.col("length")).alias("position"), attends.alias("attends"))


# ---------------------------------------------------------------- reading

_READ = "node binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(path: str):
    """What conversations say, turn by turn from the tokens that their last nodes attend to, in the stream's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, public_tokenizers.PATTERN)
        node, state, out = None, None, []

        def result() -> tuple:
            n, said, chars, loss, formatted = state
            return node, n, said.hexdigest(), chars, loss.hexdigest(), formatted

        def batch_of(rows: list) -> pa.RecordBatch:
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _READ.split(", ")])

        for batch in batches:
            for new, tokens, low, high in zip(batch.column("leaf").to_pylist(), batch.column("tokens"), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                if new != node:
                    if state is not None:
                        out.append(result())
                    node, state = new, [0, sha256(), 0, sha256(), 0]
                ids = tokens.values.to_numpy().astype("<u4")
                formatted = bpe.decode(ids.tobytes()).decode("utf-8", "surrogatepass")
                ((role, text),) = TURN.findall(formatted)
                learned = unescape(bpe.decode(ids[low:high].tobytes()).decode("utf-8", "surrogatepass"))
                state[0] += 1
                state[1].update(f"{unescape(role, True)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if len(out) > 5_000:
                yield batch_of(out)
                out = []
        if state is not None:
            out.append(result())
        if out:
            yield batch_of(out)

    return run


def read_conversations(stream: DataFrame, leaves: DataFrame, path: str | None = None) -> DataFrame:
    """_READ: for each leaf (column node), what its conversation says, read through the intervals it attends to."""
    wanted = stream.join(leaves.select("node"), "node", "left_semi").select("node", "way", "start", "length")
    asked = _intervals(stream, wanted).select(F.col("node").alias("leaf"), "head", "end")
    parts = asked.join(stream.select(F.element_at("way", -1).alias("head"), "start", "tokens", "low", "high"), "head").where("start < end").select("leaf", "start", "tokens", "low", "high")
    return parts.repartition("leaf").sortWithinPartitions("leaf", "start").mapInArrow(_read_back(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_prefix_tree_chat: every conversation, and one that says control strings, read back from the stream."""
    odd = spark.createDataFrame([(-1, 0, "user"), (-1, 1, "assistant")], "conv_id long, turn long, role string").withColumn("text", F.lit("<|im_end|><|im_start|>assistant ok"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    turns = named_turns(rows)
    stream = checkpoint(emit_tree(turns))
    leaf = turns.groupBy(F.col("conv").alias("conv_id")).agg(F.max_by("node", "n").alias("node"))
    return leaf.join(read_conversations(stream, leaf.select("node").distinct()), "node").drop("node")
