"""Records of a JSON array that many tasks read, each its range of the file.

No line end can stand inside a JSON string, so lines can be told apart anywhere, and how much deeper or higher a line leads is known from the line alone. The changes of each range are summed first; with the depth
that it begins at, each range then finds the records that begin in it. Of a record that goes on in the next range, or through several, the parts are put together by the range it begins in.

Defined results. The array's items are objects; what else it holds is passed over. An empty array, and a file of white space, have no records; an object that the file breaks off is given as far as it goes. A path that isn't there is an error. A file that is one line is one range, whatever its size: such a file should be written anew, a record a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import cut

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')
#: Ranges whose beginnings are sent to all executors; more are joined by a shuffle.
SENT_RANGES = 200_000
PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("body", pa.string())])


def cut_up(file: str, block: int, depth: int, lines: Iterator[str]) -> Iterator[tuple[str, int, int, str, str]]:
    """Records that begin in a range (``whole``, or ``tail`` where the end is not in it), by their number there; ``head`` is what ends, or goes through, from a range before."""
    held: list[str] | None = [] if depth >= 2 else None
    kind, n = "head", 0
    for line in lines:
        at = 0
        for token in TOKEN.finditer(line):
            c = token[0]
            if c in "{[":
                if depth == 1 and c == "{":
                    held, kind, at = [], "whole", token.start()
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 1 and held is not None:
                    held.append(line[at : token.end()])
                    yield file, block, n if kind == "whole" else -1, kind, "\n".join(held)
                    n += kind == "whole"
                    held = None
        if held is not None:
            held.append(line[at:])
    if held is not None:
        yield file, block, n if kind == "whole" else -1, "tail" if kind == "whole" else kind, "\n".join(held)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``record_index`` (from 0 in its file) and ``body``, the text of each object."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    bare = F.regexp_replace("value", r'"(?:[^"\\]++|\\.)*+"', "")
    change = F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))
    ranges = lines.groupBy("file", "block").agg(F.sum(change).alias("change"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut(ranges.select("file", "block", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")))
    if begins.count() <= SENT_RANGES:
        told = lines.join(F.broadcast(begins), ["file", "block"])  # lines stay in their order
    else:
        told = lines.join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for x in batches:
                yield from zip(*(x.column(c).to_pylist() for c in ("file", "block", "depth", "value")), strict=True)

        stream = rows()
        now = next(stream, None)

        def lines_of(key: tuple) -> Iterator[str]:
            nonlocal now
            while now is not None and now[:2] == key:
                yield now[3]
                now = next(stream, None)

        out, size = [], 0
        while now is not None:
            file, block, depth, _ = now
            for part in cut_up(file, block, depth, lines_of((file, block))):
                out.append(part)
                size += len(part[4])
                if size > 4_000_000 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PART, strict=True)], schema=PART)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PART, strict=True)], schema=PART)

    found = cut(told.select("file", "block", "depth", "value").mapInArrow(look, "file string, block long, n long, kind string, body string"))
    # A file's open parts are two a range at most; a head belongs to the last tail before it.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    open_ = found.where("kind <> 'whole'").withColumn("own", F.last(F.when(F.col("kind") == "tail", F.struct("block", "n")), ignorenulls=True).over(order))
    joined = open_.groupBy("file", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "body"))), lambda x: x.body), "\n").alias("body"))
    whole = found.where("kind = 'whole'").select("file", "block", "n", "body").unionByName(joined.select("file", "own.block", "own.n", "body"))
    counts = found.where("n >= 0").groupBy("file", "block").agg(F.count("*").alias("many"))
    first = counts.select("file", "block", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
    return whole.join(first, ["file", "block"]).select("file", (F.col("first") + F.col("n")).alias("record_index"), "body")
