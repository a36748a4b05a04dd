"""Chat formatting from event logs.

A log has one row per event: ``start`` opens a message of a turn, ``delta`` appends streamed text,
``edit`` replaces the text, ``regenerate`` discards it for what is streamed next.  Logs are
partitioned by conversation and by blocks of its turns, sorted by sequence, and folded into final
messages in one pass, so that a conversation with a third of all rows is spread by its blocks.
Each message is rendered as one chunk; the chunks of a conversation, in order, are its formatted
text, which no task ever holds whole.

Control strings inside texts get a backslash: n backslashes before one become 2n + 1, and back.
A chunk's own control strings follow a space, another control string or the start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]")
_FOUND = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
#: Turns of one block, and code points of one streamed piece.
BLOCK, PIECE = 64, 512


def escape(text: str) -> str:
    return _FOUND.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _FOUND.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's chunk, and the span of it that is trained on: start and length, 0 if none."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]\n", 0, 0
    if role == "assistant":
        return f"[OUT] {body} </s>\n", len("[OUT] "), len(body)
    return f"<s>[ROLE] {escape(role)} [/ROLE] {body} </s>\n", 0, 0


def read_chunk(chunk: str) -> tuple[str, str]:
    """Role and text of a chunk."""
    marks = [(m.start(2), m.end(2), m[2]) for m in _FOUND.finditer(chunk) if len(m[1]) % 2 == 0]
    names = [m[2] for m in marks]
    between = lambda a, b: unescape(chunk[marks[a][1] + 1 : marks[b][0] - 1])
    if names == ["<s>", "[INST]", "[/INST]"]:
        return "user", between(1, 2)
    if names == ["[OUT]", "</s>"]:
        return "assistant", between(0, 1)
    if names == ["<s>", "[ROLE]", "[/ROLE]", "</s>"]:
        return between(1, 2), between(2, 3)
    raise ValueError(f"not a chunk: {names}")


def events_of(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log of (conv_id, turn, role, text) rows, as if each message had been streamed in pieces.

    By a hash of its text a message is streamed plainly, or after a draft that is regenerated, or after a
    draft that is edited into the message's first piece.  Rows of one turn keep apart; they are ordered by role
    and the md5 of their text.  Null texts give no pieces, texts of any length as many as they need; repeated rows stay
    repeated, and an empty table gives no events.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("pieces", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / piece))
    way = F.pmod(F.xxhash64("text"), F.lit(3))  # 0: plain, 1: regenerated, 2: edited
    rows = rows.withColumn("way", way).withColumn("before", F.when(way == 0, 0).otherwise(2)).withColumn("edited", F.least((way == 2).cast("long"), F.col("pieces")))
    seq = F.struct("turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "row", "k")
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("before") + F.col("pieces") - F.col("edited"))).alias("k"))
    draft, changed = (F.col("k") == 1) & (F.col("way") > 0), (F.col("k") == 2) & (F.col("way") > 0)
    kind = F.when(F.col("k") == 0, "start").when(changed & (F.col("way") == 1), "regenerate").when(changed, "edit").otherwise("delta")
    nth = lambda i: F.call_function("substring", F.col("text"), ((i - 1) * piece + 1).cast("int"), F.lit(piece))
    text = F.when(draft, F.lit("draft </s> ")).when(changed & (F.col("way") == 2), nth(F.lit(1))).when((F.col("k") > F.col("before")), nth(F.col("k") - F.col("before") + F.col("edited")))
    return each.select("conv_id", "turn", seq.alias("seq"), kind.alias("kind"), "role", text.alias("text"))


def format_events(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events (conv_id, turn, seq, kind, role, text) to chunks: conv_id, block, place, chunk, loss_start, loss_chars.

    A conversation's formatted text is its chunks by block (null first) and place.  A turn may have
    several messages: each ``start`` opens one, and later events of the turn change the newest.  An
    event before any ``start`` of its turn opens a message with its own role.  Null roles and texts
    count as empty, unknown kinds raise.  Null conversations and turns form groups of their own.  Ids may be of any type
    that can be sorted.  Events of equal ``seq`` are taken in any order.  Messages of any length are folded whole, one block of
    turns at a time.  An empty log gives no chunks; other columns are ignored.
    """
    log = events.select("conv_id", F.floor(F.col("turn") / block).alias("block"), "turn", "seq", "kind", "role", "text")
    log = log.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq").drop("seq")
    kind = dict(log.dtypes)["conv_id"]
    schema = f"conv_id {kind}, block long, place int, chunk string, loss_start int, loss_chars int"

    def types(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([("conv_id", batch.schema.field(0).type), ("block", pa.int64()), ("place", pa.int32()), ("chunk", pa.string()), ("loss_start", pa.int32()), ("loss_chars", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, messages, newest = None, [], {}

        def chunks() -> list[tuple]:
            messages.sort(key=lambda m: (m[0] is not None, m[0] or 0))  # stable: starts of a turn keep their order
            return [(*key, place, *render(role, "".join(parts))) for place, (_, role, parts) in enumerate(messages)]

        for batch in batches:
            out: list[tuple] = []
            for conv, part, turn, what, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, part):
                    if key is not None:
                        out += chunks()
                    key, messages, newest = (conv, part), [], {}
                if what == "start" or turn not in newest:
                    newest[turn] = message = (turn, role or "", [])
                    messages.append(message)
                parts = newest[turn][2]
                if what == "regenerate":
                    parts.clear()
                elif what == "edit":
                    parts[:] = [text or ""]
                elif what in ("delta", "start"):
                    if text:
                        parts.append(text)
                else:
                    raise ValueError(f"unknown event {what!r}")
            if out:
                yield _batch(out, types(batch))
        if key is not None:
            yield _batch(chunks(), types(batch))

    return bounded(log).mapInArrow(run, schema)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(types.names, x, strict=True)) for x in rows], schema=types)


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted text alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  The digests are fed chunk by chunk, so memory holds one chunk; a digest is sequential,
    so the chunks of a conversation pass through one task.  No chunks give no rows.
    """
    kind = dict(chunks.dtypes)["conv_id"]
    rows = chunks.select("conv_id", "block", "place", "chunk", "loss_start", "loss_chars").repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def types(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # conversation, turns, digest, masked code points, digest, code points

        def row() -> tuple:
            conv, n, turns, masked, loss, size = state
            return conv, n, turns.hexdigest(), masked, loss.hexdigest(), size

        for batch in batches:
            out: list[tuple] = []
            for conv, _, _, chunk, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_chunk(chunk)
                masked = unescape(chunk[start : start + length])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(chunk)
            if out:
                yield _batch(out, types(batch))
        if state is not None:
            yield _batch([row()], types(batch))

    return bounded(rows).mapInArrow(run, schema)
