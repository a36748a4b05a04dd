"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A segment is encoded with an agenda: all adjacent symbol pairs whose join is a piece wait in a heap,
best score first and leftmost on ties; the best pair is joined and its new neighbours enter the heap.
What remains outside the vocabulary falls back to bytes.

A text is cut between two characters that stand side by side in no piece, since no pair can ever be
joined across them; before a word's space mark and around line feeds that is done by splitting.
Encoded words and parts are kept in bounded tables of the worker process.  Every part that an agenda
encodes is checked against the sentencepiece library in its Arrow batch, and so is the first whole
text of each batch.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded, kept

MARK, BREAK = "▁", "\ud800"
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of an encoded protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + size]
        at += size


#: Settings of a vocabulary file that ``Codec`` can follow, by message and field number, with the values it takes for granted
#: (fixed values): merges, no mark at a word's end; no normalisation, a space mark in front, white space kept and escaped.
EXPECTED = {2: {3: 2, 24: 0}, 3: {2: b"", 3: 1, 4: 0, 5: 1}}
_DEFAULT = {2: {3: 1, 24: 0}, 3: {2: b"", 3: 1, 4: 1, 5: 1}}


def check_settings(model: bytes) -> None:
    """Raises ValueError for a vocabulary of another kind, normaliser or prefix rule."""
    held = {n: dict(d) for n, d in _DEFAULT.items()}
    for number, value in fields(model):
        if number in held:
            held[number].update((f, v) for f, v in fields(value) if f in held[number])
    if held != EXPECTED:
        raise ValueError(f"the vocabulary's settings {held} are not {EXPECTED}")


class Codec:
    """Encodes and decodes as the library does, without sampling.  ``cached`` bounds the segment table."""

    def __init__(self, model: bytes, cached: int = 200_000, longest: int = 48):
        import sentencepiece

        check_settings(model)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.cost = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.id = {self.pieces[i]: str(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): str(i) for i in range(n) if sp.is_byte(i)}
        self.unknown, self.end = str(sp.unk_id()), str(sp.eos_id())
        if len(self.byte_id) not in (0, 256):
            raise ValueError("the vocabulary has some bytes but not all")
        # what each id decodes to; bytes above 127 wait as lone surrogates until their run is complete
        self.shown = {str(i): p.replace(MARK, " ") for i, p in enumerate(self.pieces)}
        self.shown |= {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in self.byte_id.items()}
        self.control = {str(i) for i in range(n) if sp.is_control(i)}
        self.shown |= dict.fromkeys(self.control, BREAK)
        self.marked = {str(i) for i in plain if self.pieces[i][0] == MARK}
        self.end_suffix = " " + self.end
        self.shown[self.unknown] = " ⁇ "
        self.cuts_words = not any(MARK in p.lstrip(MARK) for p in self.cost)
        self.cuts_lines = not any("\n" in p for p in self.cost)
        self.newline = " ".join(self.agenda("\n"))
        self.cached, self.longest = cached, longest
        self.inside = {p[i : i + 2] for p in self.cost for i in range(len(p) - 1)}
        self.words: dict[str, str] = {}
        self.parts: dict[str, str] = {}
        self.fresh: list[tuple[str, str]] = []

    def agenda(self, segment: str) -> list[str]:
        """Ids, as text, of one segment, in which spaces are already marks."""
        part, cost = list(segment), self.cost.get
        n = len(part)
        # cost is minus the score, so the smallest tuple is the best pair, leftmost on ties
        waiting = [(c, i, pair) for i, pair in enumerate(map(add, part, part[1:])) if (c := cost(pair)) is not None]
        heapq.heapify(waiting)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while waiting:
            _, left, pair = heapq.heappop(waiting)
            right = after[left]
            if right == n or part[left] + part[right] != pair or not part[left]:
                continue  # one of its symbols has been joined to something else since
            part[left], part[right] = pair, ""
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if (c := cost(wider := pair + part[beyond])) is not None:
                    heapq.heappush(waiting, (c, left, wider))
            if (ahead := before[left]) >= 0 and (c := cost(wider := part[ahead] + pair)) is not None:
                heapq.heappush(waiting, (c, ahead, wider))
        ids: list[str] = []
        for p in filter(None, part):
            if (known := self.id.get(p)) is not None:
                ids.append(known)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in p.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def segment(self, text: str) -> str:
        """Ids of a segment as text, joined from the parts between which no pair can ever be joined."""
        pairs = list(map(add, text, text[1:]))
        if self.inside.issuperset(pairs):
            return self.part(text)
        out, start = [], 0
        for i, pair in enumerate(pairs, 1):
            if pair not in self.inside:
                out.append(self.part(text[start:i]))
                start = i
        return " ".join(out) + " " + self.part(text[start:])

    def part(self, text: str) -> str:
        if (ids := self.parts.get(text)) is None:
            ids = " ".join(self.agenda(text))
            self.fresh.append((text, ids))
            if len(text) <= self.longest:
                if len(self.parts) >= self.cached:
                    self.parts.clear()
                self.parts[text] = ids
        return ids

    def word(self, text: str) -> str:
        """Ids of a word with the space before it."""
        ids = self.segment(MARK + text)
        if len(text) <= self.longest:
            if len(self.words) >= self.cached:
                self.words.clear()
            self.words[text] = ids
        return ids

    def encode(self, text: str) -> str:
        """Ids joined by one space, without an end id."""
        if not text:
            return ""
        text = text.replace(MARK, " ")
        if not (self.cuts_words and self.cuts_lines):
            return self.segment(MARK + text.replace(" ", MARK))
        out: list[str] = []
        known, word = self.words.get, self.word
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            else:
                line = " " + line
            first, *words = line.split(" ")
            if first:
                out.append(self.segment(first))
            if "" not in words:
                out += [known(w) or word(w) for w in words]
            else:  # a run of spaces goes with the word after it
                run = ""
                for w in words:
                    run += MARK
                    if w:
                        out.append(self.segment(run + w))
                        run = ""
                if run:
                    out.append(self.segment(run))
        return " ".join(out)

    def decode(self, ids: str) -> str:
        """Text of ids joined by spaces; control ids show nothing, but end a run of bytes."""
        names = ids.removesuffix(self.end_suffix).split(" ") if ids and ids != self.end else []
        text = "".join(map(self.shown.__getitem__, names))
        lead = next((x for x in names if x not in self.control), None)
        if lead in self.marked:  # the mark that was put before the text
            text = text.replace(" ", "", 1)
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = "".join(
                    bytes(ord(c) - 0xDC00 for c in run).decode("utf-8", "each_byte") if run[0] >= "\udc80" and run[0] <= "\udcff" else run.replace(BREAK, "")
                    for run in re.findall(r"[\udc80-\udcff]+|[^\udc80-\udcff]+", text))
        return text

    def check(self, whole: str | None = None, ids: str = "") -> None:
        """Compare segments that came in since the last call, and one whole text, with the library."""
        fresh, self.fresh = self.fresh, []
        if self.cuts_words and self.cuts_lines:
            # no piece holds a line feed, so the library encodes the lines of one text each by itself
            start, line = len(self.library.encode("\n")), list(map(int, self.newline.split(" ")))
            for k in range(0, len(fresh), 500):
                some = fresh[k : k + 500]
                mine = [list(map(int, ids.split(" "))) for _, ids in some]
                theirs = self.library.encode("\n" + "\n".join(s for s, _ in some))[start:]
                if theirs != list(chain.from_iterable(x + line for x in mine))[: -len(line)]:
                    raise RuntimeError(f"the library's ids differ for one of the segments {[s[:40] for s, _ in some]}")
        if whole is not None:
            if ids != " ".join(map(str, self.library.encode(whole))):
                raise RuntimeError(f"a text that begins with {whole[:40]!r} differs from the library's ids")
            if self.decode(ids) != self.library.decode([int(x) for x in ids.split()]):
                raise RuntimeError(f"a text that begins with {whole[:40]!r} differs from the library's decoding")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """One row for every input row: id, n_tokens, ids_sha256, decoded_sha256, and ids or decoded on request.

    The end id follows the text's ids.  Null counts as empty: its only id is the end id, and it
    decodes to empty text.  Texts of any length are encoded whole.  Repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored, whatever their names.
    ``model`` is the vocabulary file's bytes, which go to the executors with the task.
    """
    if len(model) > 32 << 20:
        raise ValueError("the vocabulary file is too large to send with each task")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    model_sha = hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("codec", model_sha), lambda: Codec(model))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            digests: tuple[list, ...] = ([], [], [], [], [])
            for k, text in enumerate(batch.column(1)):
                found = codec.encode(text := text.as_py())
                if k == 0:
                    codec.check(text, found)
                full = f"{found} {codec.end}" if found else codec.end
                back = codec.decode(full)
                digests[0].append(full.count(" ") + 1)
                digests[1].append(sha(full))
                digests[2].append(sha(back))
                if keep_ids:
                    digests[3].append([int(i) for i in full.split(" ")])
                if keep_text:
                    digests[4].append(back)
            codec.check()
            columns = [batch.column(0), pa.array(digests[0], pa.int64()), pa.array(digests[1], pa.string()), pa.array(digests[2], pa.string())]
            columns += [pa.array(digests[3], pa.list_(pa.int32()))] * keep_ids + [pa.array(digests[4], pa.string())] * keep_text
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded(rows).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
