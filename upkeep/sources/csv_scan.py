"""CSV files split over tasks, multi-line cells included.

A line break inside a quoted cell does not end a record, so where records start
follows from all quotes before a place. Files are read as physical lines, which
Spark splits into byte ranges, and every line is reduced to what it does to the
state "outside a quoted cell" and "inside one" (``line_states``): most lines end
as they began. A range's lines are taken in chunks; a chunk's lines compose to one
such effect, a prefix over the chunks of a file gives the state each chunk starts
in, and from that follows which lines open a record that later lines close.

* Files without blank lines and without such records, which is most of them, are
  parsed line by line where they are read; a line's number is its place in its
  chunk plus the lines of the chunks before. Nothing is shuffled but counts.
* The lines of other files are dealt out by chunk, once and without their paths. In
  a chunk, the lines from one start of a record to the next are put together; blank
  lines between records go. Only a record that goes on in the next chunk is put
  together across chunks. A record's number is its place in its chunk plus the
  records of the chunks before. No task holds more than a bounded share of the bytes.

Each record is parsed by itself into an array of its own length: no width is
known or assumed. A quote opens a cell only at its start; inside it a doubled
quote is a quote; any other quote is text (``18" scrubber``). Empty cells are
null, cells after the last filled one are dropped, lines end with line feed,
carriage return or both (a line feed inside cells).

With ``skip_bad`` files that can't be used are left out and listed with a reason
(``rejects``): ``unreadable`` (errors while reading, or fewer bytes than listed),
``empty``, ``not text`` (NUL or bytes that are no UTF-8), ``open quote`` (a quoted
cell that no line closes). Packed files tell no length to compare, so with any among
them a broken file fails the job. Without ``skip_bad`` an unreadable file fails it too,
and the lines from an open quote on are records of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.session import materialize, small

CSV_GLOB = "*.[cC][sS][vV]"
_PACKED = re.compile(r"\.(gz|bz2|zst|xz|deflate|lz4|snappy)$")
# stands for a separator outside quotes: two noncharacters, which no text holds
_CUT = "\ufdd0\ufdd1"
# a chunk is 2 ** 14 consecutive lines of a byte range at most
CHUNK_BITS = 14
# most chunks whose rows are sent to every task, and bytes of lines that a task puts together
CHUNKS_SENT, TASK_BYTES = 200_000, 1 << 23


def _fold(pieces: Column, start: Column, step, finish=None) -> Column:
    """Left fold over the quotes of a text: ``step(acc, after, last)`` with the text
    up to the next quote and whether this is the last one."""
    n = F.size(pieces) - 1
    rest = F.transform(F.slice(pieces, F.lit(2), n), lambda p, i: F.struct(p.alias("after"), (i + 1 == n).alias("last")))
    return F.aggregate(rest, start, lambda acc, x: step(acc, x["after"], x["last"]), finish)


def _next(state: Column, before: Column, first: Column, after: Column, last: Column) -> Column:
    """State behind a quote: 0 outside, 1 inside a quoted cell, 2 inside, at the second
    half of a doubled quote."""
    opens = before.endswith(",") | (first & (before == ""))
    return (F.when(state == 2, F.lit(1)).when(state == 1, F.when((after == "") & ~last, F.lit(2)).otherwise(F.lit(0)))
            .otherwise(F.when(opens, F.lit(1)).otherwise(F.lit(0))))


def line_states(pieces: Column) -> Column:
    """``struct(a, b)``: the state after a line that starts outside (``a``) or inside
    (``b``) a quoted cell, 1 for inside; ``pieces``: the line cut at its quotes."""
    start = F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.get(pieces, F.lit(0)).alias("before"), F.lit(True).alias("first"))

    def step(acc, after, last):
        return F.struct(_next(acc["a"], acc["before"], acc["first"], after, last).alias("a"),
                        _next(acc["b"], acc["before"], acc["first"], after, last).alias("b"), after.alias("before"), F.lit(False).alias("first"))

    return _fold(pieces, start, step, lambda acc: F.struct(F.least(acc["a"], F.lit(1)).alias("a"), F.least(acc["b"], F.lit(1)).alias("b")))


def _plainly_quoted(pieces: Column) -> Column:
    """Quotes only around whole cells, or doubled inside them."""
    n = F.size(pieces)
    fits = F.transform(pieces, lambda p, i: (i % 2 == 1) | (p == "") | ((i == 0) | p.startswith(",")) & ((i == n - 1) | p.endswith(",")))
    return (n % 2 == 1) & F.forall(fits, lambda x: x)


def record_cells(value: Column, pieces: Column) -> Column:
    """The cells of a record, empty ones null; ``pieces``: the record cut at its quotes."""
    return _nulled(_cell_texts(value, pieces))


def _nulled(cells: Column) -> Column:
    # a lambda over the cells only where one is empty
    return F.when(F.array_contains(cells, ""), F.transform(cells, lambda c: F.nullif(c, F.lit("")))).otherwise(cells)


def _cell_texts(value: Column, pieces: Column) -> Column:
    n = F.size(pieces)
    plain = F.concat_ws("", F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < n - 1), F.lit('"'))
                                        .otherwise(F.replace(p, F.lit(","), F.lit(_CUT)))))
    start = F.struct(F.lit(0).alias("s"), F.get(pieces, F.lit(0)).alias("before"), F.lit(True).alias("first"),
                     F.replace(F.get(pieces, F.lit(0)), F.lit(","), F.lit(_CUT)).alias("out"))

    def step(acc, after, last):
        s = _next(acc["s"], acc["before"], acc["first"], after, last)
        # a quote is text where it opens nothing outside, and where it begins a doubled one
        text = (acc["s"] == 0) & (s == 0) | (s == 2)
        return F.struct(s.alias("s"), after.alias("before"), F.lit(False).alias("first"),
                        F.concat(acc["out"], F.when(text, F.lit('"')).otherwise(""), F.when(s == 0, F.replace(after, F.lit(","), F.lit(_CUT))).otherwise(after)).alias("out"))

    odd = _fold(pieces, start, step, lambda acc: acc["out"])
    return F.when(n == 1, F.split(value, ",")).otherwise(F.split(F.when(_plainly_quoted(pieces), plain).otherwise(odd), _CUT))


def filled(cells: Column) -> Column:
    """Without the empty cells after the last filled one; at least one cell."""
    behind = F.array_position(F.transform(F.reverse(cells), lambda c: c.isNotNull()), True)
    cut = F.slice(cells, 1, F.when(behind == 0, 1).otherwise(F.size(cells) - behind + 1).cast("int"))
    return F.when(F.get(cells, F.size(cells) - 1).isNotNull(), cells).otherwise(cut)


def _parsed(rows: DataFrame) -> DataFrame:
    """``file, row_no, cells`` of ``file, row_no, value``."""
    cut = rows.withColumn("_pieces", F.split("value", '"')).withColumn("_texts", _cell_texts(F.col("value"), F.col("_pieces")))
    cut = cut.withColumn("_cells", _nulled(F.col("_texts")))
    # cells come out of a generator: a condition on them would else be pushed into the parsing and repeat it
    return cut.select("file", F.col("row_no").cast("long").alias("row_no"), F.inline(F.array(F.struct(filled(F.col("_cells")).alias("cells")))))


def _same(path: Column) -> Column:
    """Local paths come with one or three slashes, by where they are asked for."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _name(path: str) -> Column:
    """File name of a path as Spark reports it (percent-encoded)."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


@dataclass
class CsvScan:
    """``grid``: ``file, row_no, cells``; ``rejects``: ``file, reason``."""

    grid: DataFrame
    rejects: DataFrame


def _effects(lines: DataFrame) -> DataFrame:
    """Adds the effects ``a``, ``b`` of the lines; one without a quote leaves the state."""
    cut = lines.withColumn("_pieces", F.split("value", '"'))
    cut = cut.withColumn("_s", F.when(F.size("_pieces") > 1, line_states(F.col("_pieces"))))
    return cut.withColumn("a", F.coalesce("_s.a", F.lit(0))).withColumn("b", F.coalesce("_s.b", F.lit(1))).drop("_pieces", "_s")


def _state_before(effects: DataFrame, by: str, order: str, start) -> DataFrame:
    """Adds ``_now``, the state before a row: that which an earlier row of ``by`` fixes, else
    ``start``, turned as often as the rows since then turn it."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = effects.withColumn("_turned", F.coalesce(F.sum((F.col("a") > F.col("b")).cast("int")).over(earlier), F.lit(0)))
    fixed = F.when(F.col("a") == F.col("b"), F.struct(F.col("a").alias("to"), F.col("_turned").alias("at")))
    out = out.withColumn("_last", F.last(fixed, ignorenulls=True).over(earlier))
    now = F.coalesce(F.col("_last.to") + F.col("_turned") - F.col("_last.at"), start + F.col("_turned")) % 2
    return out.withColumn("_now", now).drop("_last", "_turned")


CHUNK_KEYS = ["_path", "_block", "_chunk"]


def _placed(lines: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """The lines of ``chunks`` with columns of theirs. A chunk's row stands for thousands of lines, so
    chunks are sent to the lines, unless there are very many."""
    names = {k: k + "_" for k in CHUNK_KEYS}
    at = small(chunks.select(*[F.col(k).alias(v) for k, v in names.items()], *columns), CHUNKS_SENT)
    on = [F.col(k) == F.col(v) for k, v in names.items()]
    return lines.join(at, on).drop(*names.values())


def _chunks(lines: DataFrame, blank: Column, *more: Column) -> DataFrame:
    """A row a chunk of lines: ``_g`` its number among all, ``_o`` that in its file, what its lines hold, whether
    its file is ``_uneven`` (has blank lines or records of several lines), ``_shift`` from the ids of its lines to
    their numbers, ``_start`` and ``_end``, the states before and after it."""
    turns = F.sum((F.col("a") > F.col("b")).cast("int"))
    seen = _effects(lines)
    # of the lines that fix the state the last one, and what to
    fixed = F.max(F.when(F.col("a") == F.col("b"), F.col("_id") * 2 + F.col("a")))
    facts = seen.groupBy(*CHUNK_KEYS).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(blank).alias("_blank"), F.sum(F.octet_length("value")).alias("_bytes"),
        F.bool_or(F.col("a") == 1).alias("_opens"), turns.alias("_turns"), fixed.alias("_fixed"), *more)
    file = Window.partitionBy("_path")
    facts = materialize(facts.withColumn("_opened", F.max("_opens").over(file)).withColumn("_uneven", F.max(F.col("_opens") | (F.col("_blank") > 0)).over(file)))
    mixed = facts.where("_opened and _fixed is not null")
    after = F.lit(0)
    if mixed.limit(1).count():
        later = _effects(_placed(lines, mixed, "_fixed").where(F.col("_id") > F.shiftright("_fixed", 1)))
        facts = facts.join(later.groupBy(*CHUNK_KEYS).agg(turns.alias("_after")), CHUNK_KEYS, "left")
        after = F.coalesce("_after", F.lit(0))
    to = F.when(F.col("_fixed").isNotNull(), (F.col("_fixed") % 2 + after) % 2)
    order = file.orderBy("_block", "_chunk")
    out = facts.withColumn("a", F.coalesce(to, F.col("_turns") % 2)).withColumn("b", F.coalesce(to, 1 - F.col("_turns") % 2)).withColumn("_o", F.row_number().over(order))
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _state_before(out.withColumn("_shift", before - F.col("_first")), "_path", "_o", F.lit(0)).withColumnRenamed("_now", "_start")
    out = out.withColumn("_end", F.when(F.col("_start") == 0, F.col("a")).otherwise(F.col("b"))).withColumn("file", _name("_path"))
    return materialize(out.drop("a", "b", "_opens", "_opened", "_turns", "_fixed", "_after", "_first").withColumn("_g", F.monotonically_increasing_id()))


def _told(lines: DataFrame, chunks: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """The lines of ``chunks`` dealt out by chunk, with the state ``_now`` before each."""
    dealt = _placed(lines, chunks, "_g", "_start", *[c for c in columns if c not in lines.columns]).select("_g", "_id", "_start", *columns, "value").repartition(tasks, "_g")
    return _state_before(_effects(dealt), "_g", "_id", F.col("_start"))


def _records(lines: DataFrame, chunks: DataFrame, blank: Column, tasks: int) -> DataFrame:
    """``file, row_no, value`` of the records in ``chunks``, those of uneven files."""
    # a quoted cell that no line closes: the lines from the one that opens it on are records of their own
    files = chunks.groupBy(F.col("_path").alias("_p")).agg(F.max_by("_end", "_o").alias("_e")).where("_e = 1")
    unclosed = materialize(chunks.join(files, F.col("_path") == F.col("_p"), "left_semi"))
    if unclosed.limit(1).count():
        opening = _told(lines, unclosed, tasks, "_path", "_o").where("_now = 0").groupBy(F.col("_path").alias("_p")).agg(F.max(F.struct("_o", "_id")).alias("_at"))
        chunks = materialize(chunks.join(opening, F.col("_path") == F.col("_p"), "left").withColumn(
            "_apart", F.when(F.col("_o") == F.col("_at._o"), F.col("_at._id")).when(F.col("_o") > F.col("_at._o"), F.lit(-1).cast("long"))).drop("_p", "_at"))
    else:
        chunks = chunks.withColumn("_apart", F.lit(None).cast("long"))
    told = _told(lines, chunks, tasks, "_apart")
    outside = (F.col("_now") == 0) | F.coalesce(F.col("_id") >= F.col("_apart"), F.lit(False))
    # lines of a record have the same rank in their chunk; rank 0 goes on from the chunk before
    rank = F.sum((F.col("_out") & ~F.col("_blank")).cast("long")).over(Window.partitionBy("_g").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    ranked = told.withColumn("_out", outside).withColumn("_blank", blank).withColumn("_rank", rank).where("not (_out and _blank)")
    ranked = ranked.groupBy("_g", "_rank").agg(F.sort_array(F.collect_list(F.struct("_id", "value"))).alias("_ls"))
    pieces = materialize(ranked.select("_g", "_rank", _text("_ls").alias("value")))
    counts = pieces.groupBy(F.col("_g").alias("_c")).agg(F.max("_rank").alias("_held"))
    before = Window.partitionBy("_path").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    held = chunks.join(counts, F.col("_g") == F.col("_c"), "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    held = held.select(F.col("_g").alias("_c"), "_path", "file", "_o", "_held", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
                       ((F.col("_end") == 1) & F.col("_apart").isNull()).alias("_on"))
    pieces = pieces.join(small(held, CHUNKS_SENT), F.col("_g") == F.col("_c")).withColumn("row_no", F.col("_before") + F.col("_rank") - 1)
    crosses = (F.col("_rank") == 0) | (F.col("_on") & (F.col("_rank") == F.col("_held")))
    whole = pieces.where(~crosses).select("file", "row_no", "value")
    run = F.sum((F.col("_rank") > 0).cast("long")).over(Window.partitionBy("_path").orderBy("_o", "_rank").rowsBetween(Window.unboundedPreceding, 0))
    runs = pieces.where(crosses).withColumn("_run", run).groupBy("_path", "_run").agg(
        F.first("file").alias("file"), F.max(F.when(F.col("_rank") > 0, F.col("row_no"))).alias("row_no"),
        F.sort_array(F.collect_list(F.struct("_o", "_rank", "value"))).alias("_ls"))
    return whole.unionByName(runs.select("file", "row_no", _text("_ls").alias("value")))


def _text(pieces: str) -> Column:
    return F.concat_ws("\n", F.transform(pieces, lambda x: x["value"]))


def scan_csv(spark: SparkSession, path: str | list[str], glob: str = CSV_GLOB, skip_bad: bool = False) -> CsvScan:
    """The records of every CSV file under ``path``."""

    packed = False

    def source(kind: str):
        reader = spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        if skip_bad and not packed:
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        return reader.load(path)

    names = source("text").inputFiles() if skip_bad else []  # a listing that the driver holds anyway
    packed = any(_PACKED.search(n) for n in names)
    lines = source("text").select(_same(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                                  F.monotonically_increasing_id().alias("_id"), "value").withColumn("_chunk", F.shiftright("_id", CHUNK_BITS))
    blank = F.trim(F.col("value")) == ""
    odd = F.bool_or(F.col("value").contains("\x00") | ~F.is_valid_utf8("value")) if skip_bad else F.lit(False)
    chunks = _chunks(lines, blank, odd.alias("_odd"))
    rejects = spark.createDataFrame([], "file string, reason string")
    if skip_bad:
        rejects = _rejects(spark, chunks, names, source("binaryFile"))
        chunks = materialize(chunks.join(rejects, F.col("_path") == F.col("_r"), "left_anti"))
        rejects = rejects.select(_name("_r").alias("file"), "reason")
    even, size = chunks.agg(F.count_if(~F.col("_uneven")), F.sum(F.when(F.col("_uneven"), F.col("_bytes")))).first()
    parts = []
    if even or size is None:
        parts.append(_placed(lines, chunks.where("not _uneven"), "file", "_shift").select("file", (F.col("_id") + F.col("_shift")).alias("row_no"), "value"))
    if size is not None:
        parts.append(_records(lines, chunks.where("_uneven"), blank, size // TASK_BYTES + 1))
    return CsvScan(_parsed(reduce(DataFrame.unionByName, parts)), rejects)


def _rejects(spark: SparkSession, chunks: DataFrame, names: list[str], listed: DataFrame) -> DataFrame:
    """(``_r``, ``reason``) of the files that can't be used."""
    read = chunks.groupBy(F.col("_path").alias("_p")).agg(F.sum("_bytes").alias("_bytes"), F.sum("_n").alias("_n"), F.sum("_blank").alias("_blank"), F.max("_odd").alias("_odd"),
                                                          F.max_by("_end", "_o").alias("_open"))
    # scans leave out files without a byte, so the names come from the listing
    files = spark.createDataFrame([(f,) for f in names], "_path string").select(_same(F.col("_path")).alias("_path"))
    sizes = listed.select(_same(F.col("_metadata.file_path")).alias("_s"), "length")
    judged = files.join(sizes, F.col("_path") == F.col("_s"), "left").join(read, F.col("_path") == F.col("_p"), "left")
    # line ends are one or two bytes; a mark of the byte order is three
    short = (F.col("length") > 0) & F.col("_p").isNull() | ~F.col("_path").rlike(_PACKED.pattern) & (F.col("_bytes") + 2 * F.col("_n") + 3 < F.col("length"))
    reason = (F.when(F.col("length").isNull(), "empty").when(short, "unreadable").when(F.col("_p").isNull() | (F.col("_n") == F.col("_blank")), "empty").when(F.col("_odd"), "not text")
              .when(F.col("_open") == 1, "open quote"))
    return materialize(judged.select(F.col("_path").alias("_r"), reason.alias("reason")).where("reason is not null"))
