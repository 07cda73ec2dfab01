"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens.

Template, one turn after another::

    <|role|>\\n text <|end|>\\n

Inside roles and texts a backslash is doubled and every control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) gets a backslash after its first character, so no
control string is left and :func:`unescape` restores the text.

A tree node is a distinct prefix of turns (``node_id``: chained hash). Each node belongs to its
smallest conversation (the owner), whose owned nodes are the tail of its path. Tails sorted by the
branch key lay the forest out depth-first, each node once; lengths summed along that order give the
stream places. A node's ``position`` counts the characters of its ancestors (position ids restart
below every branch), and a conversation's attention intervals are the stream ranges of its path:
one for each owner on it.

Everything runs on rows sorted by (conversation, turn) and streamed with constant memory, or on
joins whose tree side has one row for each key, so a first turn shared by a third of all
conversations is split like any skewed join. Units are characters (code points) of the stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As :func:`escape`; line feeds and bars, which end a role, are spelt out."""
    bare = role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], bare)


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def turn_segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment of the stream and the range of its text in it."""
    head = f"<|{escape_role(role)}|>\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a turn's segment."""
    m = _TURN.fullmatch(segment)
    return unescape_role(m[1]), unescape(m[2])


_NODES = "conv_id bigint, depth int, node binary, parent binary, segment string, length bigint, position bigint, text_from bigint, text_to bigint, loss boolean"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) sorted by conversation and turn: one tree node for each row."""
    conv, first, parent, depth, position = None, True, b"", 0, 0
    for batch in batches:
        out = []
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if first or c != conv:
                conv, first, parent, depth, position = c, False, b"", 0, 0
            role, text = role or "", text or ""
            segment, a, b = turn_segment(role, text)
            node = hashlib.blake2b(parent + segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            out.append((c, depth, node, parent, segment, len(segment), position, a, b, role == "assistant"))
            parent, depth, position = node, depth + 1, position + len(segment)
        cols = list(zip(*out)) or [[]] * 10
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=[x.split()[0] for x in _NODES.split(", ")])


def build(turns: DataFrame) -> dict[str, DataFrame]:
    """The forest of (conv_id, turn, role, text) rows, stored in the shared folder.

    ``stream``: one row for each node: node, parent, owner, depth, segment, length, position (of its first
    character), text_from, text_to (its text in the segment), loss (an assistant's turn), stream_start.
    ``paths``: (conv_id, depth, node), one row for each turn of each conversation.
    ``attention``: (conv_id, intervals): the stream ranges that a conversation's last turn attends to,
    root first; a node attends to the part of them before its own end.

    Rows of a conversation are ordered by turn (null first), equal turns by role and text. Null text or
    role: empty. Null conv_id: a conversation of its own. Repeated rows: turns like any other. Empty table:
    empty frames. Extra columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    nodes = materialise(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
                        .select("conv_id", "role", "text").mapInArrow(_chain, _NODES), "chat-nodes")
    # null conv_id sorts below all others: the struct's flag stands for it
    key = F.struct(F.col("conv_id").isNotNull().alias("some"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    owners = nodes.groupBy("node").agg(F.min(key).alias("owner"))
    owned = materialise(nodes.drop("segment", "parent", "text_from", "text_to", "loss").withColumn("me", key).join(owners, "node"), "chat-owned")

    # per conversation: its owners from root to leaf, where each begins and how far it reaches
    parts = owned.groupBy("me", "owner").agg(F.min("depth").alias("from_depth"), F.min("position").alias("from_pos"), F.max(F.col("position") + F.col("length")).alias("to_pos"))
    branch = F.struct((-F.col("from_depth")).alias("up"), F.col("owner").alias("owner"))
    order = parts.groupBy("me").agg(F.array_sort(F.collect_list(F.struct("from_depth", branch.alias("b")))).alias("bs")).select(
        "me", F.transform("bs", lambda x: x["b"]).alias("branch_key"))
    tails = parts.filter("me = owner").select("me", "from_pos", (F.col("to_pos") - F.col("from_pos")).alias("tail")).join(order, "me")
    starts = materialise(_running(tails), "chat-starts")

    stream_start = F.col("tail_start") + F.col("position") - F.col("from_pos")
    mine = starts.select(F.col("me").alias("owner"), "from_pos", "tail_start")
    full = nodes.withColumn("me", key).join(owners, "node").filter("me = owner")
    stream = materialise(full.join(mine, "owner").select(
        "node", "parent", F.when(F.col("owner.some"), F.col("owner.id")).alias("owner"), "depth", "segment", "length", "position",
        "text_from", "text_to", "loss", stream_start.alias("stream_start")), "chat-stream")
    paths = materialise(owned.select("conv_id", "depth", "node"), "chat-paths")
    ranges = parts.join(starts.select(F.col("me").alias("owner"), F.col("from_pos").alias("own_from"), "tail_start"), "owner")
    span = F.struct("from_depth", (F.col("tail_start") + F.col("from_pos") - F.col("own_from")).alias("start"), (F.col("tail_start") + F.col("to_pos") - F.col("own_from")).alias("end"))
    attention = materialise(ranges.groupBy("me").agg(F.array_sort(F.collect_list(span)).alias("x")).select(
        F.when(F.col("me.some"), F.col("me.id")).alias("conv_id"), F.transform("x", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("intervals")), "chat-attention")
    return {"stream": stream, "paths": paths, "attention": attention}


def _running(tails: DataFrame) -> DataFrame:
    """Add ``tail_start``: the tail lengths before a conversation in branch-key order, over range partitions."""
    placed = materialise(tails.repartitionByRange("branch_key").withColumn("pid", F.spark_partition_id()), "chat-order")
    before = placed.groupBy("pid").agg(F.sum("tail").alias("s")).select(
        "pid", (F.sum("s").over(Window.orderBy("pid")) - F.col("s")).alias("base"))  # one row per partition
    inner = Window.partitionBy("pid").orderBy("branch_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("upto", F.sum("tail").over(inner)).join(before, "pid").select(
        "me", "from_pos", (F.col("base") + F.col("upto") - F.col("tail")).alias("tail_start"))


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, segment, text_from, text_to, loss) sorted by conversation and depth: one row per conversation."""
    state, conv = None, None

    def done():
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        out = []
        for c, segment, a, b, loss in zip(*(x.to_pylist() for x in batch.columns)):
            if state is None or c != conv:
                if state is not None:
                    out.append(done())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                masked = unescape(segment[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(segment)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _READ.split(", ")])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def read_back(forest: dict[str, DataFrame]) -> DataFrame:
    """Per conversation, from the stored stream: turns, digests of all turns and of the text under the loss mask."""
    segments = forest["stream"].select("node", "segment", "text_from", "text_to", "loss")
    rows = forest["paths"].join(segments, "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.select("conv_id", "segment", "text_from", "text_to", "loss").mapInArrow(_read, _READ)
