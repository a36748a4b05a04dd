"""Dumps of one huge JSON object, read in splits: no task holds more than a split or a record.

The text source cuts the file at every closing brace, which it can do from any byte on; a brace never follows a
backslash in JSON, so no escape is cut.  A piece's quotes and brackets are counted for both cases, that it begins inside a
string or outside; sums over the pieces of a split, and then over splits, tell which case holds and how deep each piece
begins.  A record ends where a piece closes its depth; pieces are gathered by the end they lead to, and the
records are written as JSON lines by the name of their array, which Spark reads in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from linkwell.operators.joins import small
from linkwell.storage import discard, listing, materialize, scratch_path

#: Bytes of a zip member that are unpacked at once, and of a split of it.
CHUNK, SPLIT = 1 << 20, 64 << 20
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def text_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, i, value): what stands between closing braces, in the order of (split, i)."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")


def zip_pieces(spark: SparkSession, path: str) -> DataFrame:
    """As ``text_pieces``, of the first member of the last zip file (by name) that the path matches.

    Unpacking is sequential by nature: one task holds the packed file and a megabyte of the member.
    """
    files = spark.read.format("binaryFile").load(path)
    last = files.select("path").agg(F.max("path").alias("path"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z, z.open(z.namelist()[0]) as member:
                    rest, i, read = b"", 0, 0
                    while chunk := member.read(CHUNK):
                        *pieces, rest = (rest + chunk).split(b"}")
                        if pieces:
                            yield batch_of(name, read // SPLIT, i, pieces)
                        i, read = i + len(pieces), read + len(chunk)
                    yield batch_of(name, read // SPLIT, i, [rest])

    def batch_of(name: str, split: int, i: int, pieces: list[bytes]) -> pa.RecordBatch:
        n = len(pieces)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([split] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), pa.array([p.decode() for p in pieces])], ["file", "split", "i", "value"])

    packed = files.join(F.broadcast(last), "path", "left_semi").select("path", "content")
    return materialize(packed.mapInArrow(unpack, "file string, split long, i long, value string"), "dump-unpacked")


def _tallies(value: Column) -> tuple[Column, Column, Column]:
    """A piece's quotes, and what it adds to the depth if it begins outside a string or inside, its closing brace counted."""
    plain = F.regexp_replace(value, r"(?s)\\.", "_")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))

    def depth(text: Column, ends_inside: Column) -> Column:
        outside = F.regexp_replace(text, '"[^"]*("|$)', "")
        opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
        closed = F.length(outside) - F.length(F.translate(outside, "]", ""))
        return opened - closed - F.when(ends_inside, 0).otherwise(1)

    return quotes, depth(plain, quotes % 2 == 1), depth(F.concat(F.lit('"'), plain), quotes % 2 == 0)


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``begins`` and ``ends``, the depth before and behind each, and whether it ends ``inside`` a string."""
    quotes, outer, inner = _tallies(F.col("value"))
    counted = pieces.withColumns({"q": quotes, "outer": outer, "inner": inner})
    before = Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("q").over(before), F.lit(0)) % 2
    local = counted.withColumn("odd", odd).withColumns({"d0": F.when(F.col("odd") == 0, F.col("outer")).otherwise(F.col("inner")), "d1": F.when(F.col("odd") == 0, F.col("inner")).otherwise(F.col("outer"))})
    summed = local.withColumns({f"s{k}": F.coalesce(F.sum(f"d{k}").over(before), F.lit(0)) for k in (0, 1)}).drop("outer", "inner")
    held = materialize(summed, "dump-pieces")
    splits = held.groupBy("file", "split").agg(*[F.sum(c).alias(f"t_{c}") for c in ("q", "d0", "d1")])
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flip", F.coalesce(F.sum("t_q").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("flip") == 0, F.col("t_d0")).otherwise(F.col("t_d1"))).over(earlier), F.lit(0)))
    here = held.join(small(materialize(splits.select("file", "split", "flip", "base"), "dump-splits")), ["file", "split"])
    pick = lambda a, b: F.when(F.col("flip") == 0, F.col(a)).otherwise(F.col(b))
    begins = F.col("base") + pick("s0", "s1")
    return here.select("file", "split", "i", "value", begins.alias("begins"), (begins + pick("d0", "d1")).alias("ends"), ((F.col("flip") + F.col("odd") + F.col("q")) % 2 == 1).alias("inside"))


def _cut(depth: int):
    """(file, split, i, begins, text) to records: the text from the brace that reaches ``depth``, and the array's name if the text opens one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, opened, records = [], [], []
            for level, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                name, opens, word, record = None, False, None, None
                for t in _TOKEN.finditer(text):
                    c = t[0]
                    if c[0] == '"':
                        word = c
                    elif c in "{[":
                        level += 1
                        if c == "{" and level == depth:
                            record = text[t.start() :]
                            break
                        if level == depth - 1:
                            opens, name = True, word if c == "[" else None
                    else:
                        level -= 1
                names.append(name[1:-1] if name else None)
                opened.append(opens)
                records.append(re.sub(r"[\r\n]+", " ", record) if record else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(opened, pa.bool_()), pa.array(records, pa.string())], ["file", "split", "i", "name", "opens", "record"])

    return run


def records(pieces: DataFrame) -> DataFrame:
    """(name, record): the members of the arrays of ``Database`` that are objects, as JSON text of one line.

    ``Database`` may be a list, whose first item counts.  Members of ``Database`` that are no arrays are skipped, and so are
    array members that are no objects.  Escapes in the arrays' names stay as written.
    """
    placed = _placed(pieces)
    head = placed.orderBy("file", "split", "i").select("value").first()
    listed = bool(head and re.match(r'\s*\{\s*"Database"\s*:\s*\[', head["value"]))
    depth = 5 if listed else 4
    closes = ~F.col("inside") & (F.col("ends") == depth - 1)
    # backwards: a frame that ends with its partition would be summed anew for every row
    ahead = Window.partitionBy("file", "split").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.withColumn("end", F.min(F.when(closes, F.struct("split", "i"))).over(ahead))
    firsts = marked.groupBy("file", "split").agg(F.min("end").alias("first"), F.min(F.when(~F.col("inside") & (F.col("ends") == 2), F.struct("split", "i"))).alias("item"))
    later = Window.partitionBy("file").orderBy(F.desc("split")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumns({"next": F.last("first", ignorenulls=True).over(later), "item": F.min("item").over(Window.partitionBy("file"))})
    firsts = small(materialize(firsts.select("file", "split", "next", "item"), "dump-ends"))
    led = marked.join(firsts, ["file", "split"]).withColumn("end", F.coalesce("end", "next")).where("end IS NOT NULL")
    if listed:
        led = led.where(F.col("item").isNull() | (F.col("end") < F.col("item")))
    whole = led.groupBy("file", "end").agg(F.array_sort(F.collect_list(F.struct("split", "i", "begins", "value"))).alias("p"))  # the pieces of one record
    texts = whole.select("file", "end.split", "end.i", F.get("p", 0)["begins"].alias("begins"), F.concat(F.array_join("p.value", "}"), F.lit("}")).alias("text"))
    cut = materialize(texts.mapInArrow(_cut(depth), "file string, split long, i long, name string, opens boolean, record string"), "dump-records")
    # an array's name stands before its first record only
    named = F.when(F.col("opens"), F.struct("name"))
    upto = Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where("opens").groupBy("file", "split").agg(F.max_by(F.struct("name"), "i").alias("last"))
    splits = cut.select("file", "split").distinct().join(last, ["file", "split"], "left")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = small(materialize(splits.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("before")), "dump-names"))
    carried = cut.withColumn("own", F.last(named, ignorenulls=True).over(upto)).join(splits, ["file", "split"])
    return carried.select(F.coalesce("own", "before")["name"].alias("name"), "record").where("name IS NOT NULL AND record IS NOT NULL")


def read_dump(spark: SparkSession, path: str, zipped: bool = False, schema: StructType | None = None) -> dict[str, DataFrame]:
    """A frame for each non-empty array of objects in ``Database``, with ``id`` renamed to ``_id``.

    ``schema``: of the whole dump, as for ``feeds.read_feed``; arrays that it lacks are left out.  Else each array's is
    inferred.  The records lie as JSON lines in the scratch folder.
    """
    pieces = zip_pieces(spark, path) if zipped else text_pieces(spark, path)
    where = scratch_path(spark, "dump")
    records(pieces).write.partitionBy("name").text(where)
    discard(pieces)
    out = {}
    kinds = None
    if schema is not None:
        kind = schema["Database"].dataType
        kinds = {f.name: f.dataType.elementType for f in (kind.elementType if isinstance(kind, ArrayType) else kind).fields if isinstance(f.dataType, ArrayType)}
    for folder in listing(spark, where):
        name = folder.removeprefix("name=")
        if folder.startswith("name=") and (kinds is None or name in kinds):
            reader = spark.read if kinds is None else spark.read.schema(kinds[name])
            out[name] = reader.json(f"{where}/{folder}").withColumnRenamed("id", "_id")
    return out
