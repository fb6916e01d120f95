"""Delimited and plain text with physical row numbers.

``spark.read.csv`` repairs what an audit has to report: it renames repeated
labels, skips blank lines and drops surplus cells.  So the lines are read as
text and split here, and every line keeps its 1-based physical number.

Numbering without gathering a file: inside one input split the generated ids
are consecutive, so a line's place in its split is a subtraction; the lines
before the split come from the (small) table of split sizes.

Files in UTF-16 and UTF-32 are cut at their own line feeds by the same reader,
so they stay splittable too, and are decoded line by line.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.encoding import (
    WIDE, bom_encoding, decode_cp1252, decode_units, is_cp1252, line_feed, strip_bom, unit_bytes)
from sievework.operators.groups import join_by_key
from sievework.session import written_table

# Candidate delimiters in order of preference.
DELIMITERS = (";", ",", "\t", "|")
GUESS_LINES = 20
MAX_FIELDS_SCORED = 50

_MIN_SPLITS = "spark.sql.files.minPartitionNum"


def pin_splits(spark: SparkSession) -> None:
    """Keep input splits the same from scan to scan.

    Their size depends on the cores at hand unless a number is set, and lines
    meet the split table by where splits start: executors lost or won between
    the two scans must not move them.
    """
    if spark.conf.get(_MIN_SPLITS, None) is None:
        spark.conf.set(_MIN_SPLITS, str(spark.sparkContext.defaultParallelism))


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the input split they came from; ids ascend within a split."""
    pin_splits(spark)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )


def split_table(lines: DataFrame) -> DataFrame:
    """One row per input split: its lines, validity and first line, and the
    lines of the file that come before it."""
    splits = lines.groupBy("file_id", "block_start").agg(
        F.min("line_id").alias("first_id"), F.count(F.lit(1)).alias("n"),
        # A set of at most one mark: with it the whole aggregation is hashed, where
        # the text of ``min_by`` alone would have every line sorted.
        (F.size(F.collect_set(F.when(~F.is_valid_utf8("value"), True))) == 0).alias("utf8"),
        F.min_by("value", "line_id").alias("first_line"))
    before = Window.partitionBy("file_id").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1)
    return splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def place_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Physical row numbers, plus whatever else the split table carries.

    The join strategy is left to Spark: few splits are broadcast after their
    size is known, many are shuffled by split, and a split is never larger
    than maxPartitionBytes, so a huge file is still many small groups.
    """
    row_no = F.col("before") + F.col("line_id") - F.col("first_id") + 1
    return lines.join(splits, ["file_id", "block_start"]).withColumn("row_no", row_no)


def wide_lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines of UTF-16 or UTF-32 files as text, in the columns of ``raw_lines``.

    The reader cuts wherever the bytes of ``line_feed`` stand, whole code units
    or not, and misses no true line feed; only false cuts have to be mended.  A
    cut is true when the bytes up to it make whole units and the zeros that
    belong to it stand before it.  The first follows from running remainders
    inside a split and, over the splits of a file, from the table of splits.
    Files without a false cut are decoded as they are read.  In the others the
    pieces of one line, however many splits they span, are joined again; their
    lines are written once.
    """
    pin_splits(spark)
    unit = unit_bytes(encoding)
    sep, zeros = line_feed(encoding)
    size = F.octet_length("value")
    closed = F.hex(F.substring(F.col("value").cast("binary"), -zeros, zeros)) == "00" * zeros if zeros else F.lit(True)

    def read(files: str | list[str]) -> DataFrame:
        return spark.read.option("lineSep", sep).text(files).select(
            F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block_start"), "value")

    def broken(lines: DataFrame, *keys: str) -> DataFrame:
        body = F.col("value").cast("binary")
        if zeros:  # those of the line feed; a file's last line may have none
            body = F.when(closed & (size % unit == zeros), F.substr(body, F.lit(1), size - zeros)).otherwise(body)
        # A carriage return ends a line too, alone or before the line feed.
        text = F.regexp_replace(decode_units(body, encoding), r"\r\z", "")
        return lines.select(*keys, F.posexplode(F.split(text, "\r")).alias("k", "value"))

    numbered = lambda files: read(files).withColumns({
        "line_id": F.monotonically_increasing_id(), "rest": (size + len(sep)) % unit, "closed": closed})
    true_cut = F.col("closed") & (F.col("rest") == 0)
    cuts = written_table(numbered(path).groupBy("file_id", "block_start").agg(
        F.count_if(~true_cut).alias("false"), F.max(F.struct("line_id", true_cut.alias("true"))).alias("last")), "cuts")
    # What ends a file need not be a line feed.
    mixed = cuts.groupBy("file_id").agg(
        F.sum("false").alias("false"), F.max(F.struct("block_start", "last.true")).alias("last")).filter(
        F.col("false") > F.when(F.col("last.true"), 0).otherwise(1)).select("file_id")
    columns = ["file_id", "block_start", "line_id", "value"]
    clean = broken(read(path), "file_id", "block_start").withColumn(
        "line_id", F.monotonically_increasing_id()).select(*columns)
    to_mend = [_reader_path(r["file_id"]) for r in mixed.collect()]
    if not to_mend:
        return clean
    clean = clean.join(mixed, "file_id", "left_anti")

    raw = numbered(to_mend)
    in_file = Window.partitionBy("file_id").orderBy("block_start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    shifts = raw.groupBy("file_id", "block_start").agg(
        F.sum("rest").alias("n"), F.max(F.struct("line_id", "closed")).alias("last"),
    ).select(
        "file_id", "block_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"),
        F.lag("last.closed", 1, True).over(in_file).alias("entered"))
    split = Window.partitionBy("file_id", "block_start").orderBy("line_id")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    placed = raw.join(shifts, ["file_id", "block_start"])
    aligned = (F.col("shift") + F.coalesce(F.sum("rest").over(before), F.lit(0))) % unit == 0
    whole = aligned & F.coalesce(F.lag("closed").over(split), "entered")
    own = F.when(F.col("whole"), F.struct("block_start", "line_id"))
    pieces = written_table(placed.withColumn("whole", whole).withColumn(
        "head", F.last(own, ignorenulls=True).over(upto)).drop("shift", "entered"), "wide-pieces")
    carried = pieces.groupBy("file_id", "block_start").agg(F.max("head").alias("h")).select(
        "file_id", "block_start", F.max("h").over(earlier).alias("carried"))

    single = F.col("whole") & true_cut
    split_up = pieces.filter(~single).join(carried, ["file_id", "block_start"])
    parts = F.array_sort(F.collect_list(F.struct("block_start", "line_id", "value")))
    mended = split_up.withColumn("head", F.coalesce("head", "carried")).groupBy("file_id", "head").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), sep).alias("value"))
    lines = pieces.filter(single).select(*columns).unionByName(
        mended.select("file_id", "head.block_start", "head.line_id", "value"))
    order = Window.partitionBy("file_id", "block_start").orderBy("line_id", "k")
    whole_lines = broken(lines, "file_id", "block_start", "line_id").withColumn(
        "line_id", F.row_number().over(order).cast("bigint")).select(*columns)
    return clean.unionByName(written_table(whole_lines, "wide-lines"))


def _reader_path(file_id: str) -> str:
    """A file's address as the reader takes it: not escaped, and no pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file_id))


def text_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, splits) of text files; splits also carry ``wide``, the encoding of UTF-16 and UTF-32 files.

    Those are known by their mark, or all files are such when ``encoding`` says
    so.  Only addresses of files are gathered on the driver, for the reader.
    """
    if encoding in WIDE:
        lines = wide_lines(spark, path, encoding)
        return lines, split_table(lines).withColumn("wide", F.lit(encoding))
    lines = raw_lines(spark, path)
    splits = written_table(split_table(lines), "splits")
    mark = F.when(F.col("block_start") == 0, bom_encoding(F.col("first_line")))
    marked = splits.select("file_id", mark.alias("wide")).filter(F.col("wide").isin(*WIDE))
    found: dict[str, list[str]] = {}
    for row in marked.collect():
        found.setdefault(row["wide"], []).append(row["file_id"])
    splits = splits.withColumn("wide", F.lit(None).cast("string"))
    if not found:
        return lines, splits
    lines = lines.join(marked, "file_id", "left_anti")
    splits = splits.join(marked.select("file_id"), "file_id", "left_anti")
    for name, files in sorted(found.items()):
        decoded = wide_lines(spark, [_reader_path(f) for f in sorted(files)], name)
        lines = lines.unionByName(decoded)
        splits = splits.unionByName(split_table(decoded).withColumn("wide", F.lit(name)))
    return lines, splits


def read_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """(file_id, row_no, value) for every physical line, blank ones included."""
    lines, splits = text_lines(spark, path, encoding)
    return place_lines(lines, splits.drop("n", "utf8", "first_line", "wide")).select("file_id", "row_no", "value")


def cell_pattern(sep: Column) -> Column:
    """Regular expression of one cell after its delimiter.

    Loops over groups are possessive: the engine runs those without recursion,
    so a cell may be of any length.
    """
    s = F.concat(F.lit("["), sep, F.lit("]"))
    quoted = F.lit('((?:"(?:[^"]++|"")*+")?[^')
    return F.concat(s, quoted, sep, F.lit("]*)"))


def split_cells(line: Column, sep: Column | str) -> Column:
    """Cells of one line; quotes protect the delimiter, doubled quotes are one."""
    sep = F.lit(sep) if isinstance(sep, str) else sep
    parts = F.regexp_extract_all(F.concat(sep, line), cell_pattern(sep), F.lit(1))

    def unquote(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, r'^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"'))
        rest = F.regexp_extract(cell, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1)
        return F.when(cell.startswith('"') & cell.rlike(r'^"(?:[^"]++|"")*+"'),
                      F.concat(inner, rest)).otherwise(cell)

    return F.when(line.contains('"'), F.transform(parts, unquote)).otherwise(parts)


def guess_delimiters(lines: DataFrame, order: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """Delimiter per file from its first lines.

    The candidate with the most even field count wins, then the one with more
    fields; a single-column file has none.  ``frequent`` is the candidate seen
    most often in those lines, if any.  The rank limit is applied in every task
    before the exchange, so only the heads of the files travel.
    """
    in_file = Window.partitionBy("file_id").orderBy(*order)
    head = lines.withColumn("__k", F.row_number().over(in_file)).filter(
        F.col("__k") <= GUESS_LINES + 1).filter("value <> ''")
    counted = head.select(
        "file_id", "__k",
        F.posexplode(F.array(*[F.struct(
            F.size(split_cells(F.col("value"), d)).alias("fields"),
            (F.length("value") - F.length(F.replace("value", F.lit(d)))).alias("seen")) for d in DELIMITERS])).alias("rank", "c"),
    ).select("file_id", "__k", "rank", "c.fields", "c.seen")
    first = F.first("fields").over(Window.partitionBy("file_id", "rank").orderBy("__k"))
    scored = counted.withColumn("first", first).groupBy("file_id", "rank", "first").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fields") == F.col("first")).alias("even"),
        F.sum("seen").alias("seen"))
    score = F.col("even") / F.col("n") * 100 + F.least(F.col("first"), F.lit(MAX_FIELDS_SCORED))
    even = F.when((F.col("n") >= 2) & (F.col("first") >= 2), F.struct(score, -F.col("rank")))
    often = F.when(F.col("seen") > 0, F.struct("seen", -F.col("rank")))
    best = scored.groupBy("file_id").agg(
        F.max_by("rank", even).alias("rank"), F.max_by("rank", often).alias("often"))
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    return best.select("file_id", F.get(names, F.col("rank")).alias("sep"), F.get(names, F.col("often")).alias("frequent"))


def guess_delimiter(lines: Column) -> Column:
    """Delimiter of a file given as an array of all its lines; the rule of ``guess_delimiters``.

    Where no candidate splits two lines (a header alone, a single column), the
    most frequent one in the first lines, else the comma.
    """
    head = F.filter(F.slice(lines, 1, GUESS_LINES + 1), lambda line: line != "")
    joined = F.array_join(head, "")
    scored, seen = [], []
    for rank, sep in enumerate(DELIMITERS):
        fields = F.transform(head, lambda line, d=sep: F.size(split_cells(line, d)))
        first = F.get(fields, F.lit(0))
        even = F.size(F.filter(fields, lambda n, f=first: n == f)) / F.size(fields) * 100
        scored.append(F.when((F.size(fields) >= 2) & (first >= 2), F.struct(
            (even + F.least(first, F.lit(MAX_FIELDS_SCORED))).alias("score"), F.lit(-rank).alias("rank"), F.lit(sep).alias("sep"))))
        n = F.length(joined) - F.length(F.replace(joined, F.lit(sep)))
        seen.append(F.when(n > 0, F.struct(n.alias("n"), F.lit(-rank).alias("rank"), F.lit(sep).alias("sep"))))
    best = F.array_max(F.array_compact(F.array(*scored)))["sep"]
    return F.coalesce(best, F.array_max(F.array_compact(F.array(*seen)))["sep"], F.lit(","))


def _quote_transition(line: Column, sep: Column) -> tuple[Column, Column]:
    """Is a quoted cell open after the line, if none / one was open before it?"""
    other = F.concat(F.lit("[^"), sep, F.lit("]"))
    field = F.concat(F.lit('(?:"(?:[^"]++|"")*+"'), other, F.lit('*+|[^"'), sep, F.lit("]"), other, F.lit("*+|)"))
    opened = F.concat(F.lit("(?:"), field, F.lit("["), sep, F.lit('])*+"(?:[^"]++|"")*+$'))
    from_outside = F.regexp_like(line, F.concat(F.lit("(?s)^"), opened))
    stays = F.regexp_like(line, F.lit('(?s)^(?:[^"]++|"")*+$'))
    reopens = F.regexp_like(line, F.concat(F.lit('(?s)^(?:[^"]++|"")*+"'), other, F.lit("*+["), sep, F.lit("]"), opened))
    quoted = line.contains('"')
    return (F.when(quoted, from_outside).otherwise(False), F.when(quoted, stays | reopens).otherwise(True))


def join_quoted_lines(placed: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Lines of one record joined by line feeds; ``row_no`` is the first of them.

    Whether a line starts inside a quoted cell follows from the lines before
    it: each either fixes the answer, keeps it or flips it.  Inside an input
    split both answers are worked out in one window pass, for a split that
    starts outside and for one that starts inside a cell; which of the two
    holds is settled on the table of splits.  So no file is read in one task.
    The flagged lines are written once, everything else starts from there.

    A record still open at the end of its file is an unclosed quote: its lines
    stay rows of their own.  So do those of records of ``max_lines`` and more,
    where a limit is given.
    """
    after0, after1 = _quote_transition(F.col("value"), F.col("sep"))
    flagged = placed.withColumns({"a0": after0, "a1": after1}).withColumns({
        "fixes": F.when(F.col("a0") == F.col("a1"), F.col("a0")),
        "flips": F.when(F.col("a0") & ~F.col("a1"), 1).otherwise(0)})
    split = Window.partitionBy("file_id", "block_start").orderBy("line_id")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    counted = flagged.withColumn("f", F.coalesce(F.sum("flips").over(before), F.lit(0)))
    mark = F.when(F.col("fixes").isNotNull(), F.struct(F.col("fixes").alias("v"), F.col("f").alias("f")))
    known = counted.withColumn("last", F.last(mark, ignorenulls=True).over(before))
    fixed, since = F.col("last"), F.col("f") - F.coalesce(F.col("last.f"), F.lit(0))
    both = known.withColumns({
        f"in{i}": F.when(fixed.isNotNull(), fixed["v"]).otherwise(F.lit(bool(i))) != (since % 2 == 1) for i in (0, 1)})
    both = both.withColumns({
        # First row of the record: the last line outside quotes up to here.
        f"first{i}": F.last(F.when(~F.col(f"in{i}"), F.col("row_no")), ignorenulls=True).over(upto) for i in (0, 1)})
    text = ["file_id", "sheet", "row_no", "value", "header", "sep", "encoding"]
    lines = written_table(both.withColumns({
        f"out{i}": F.when(F.col(f"in{i}"), F.col("a1")).otherwise(F.col("a0")) for i in (0, 1)
    }).select(*text, "block_start", "line_id", "in0", "in1", "first0", "first1", "out0", "out1"), "quoted-lines")

    # How a split ends for either start, and the last record it opens.
    ends = lines.groupBy("file_id", "block_start").agg(
        F.max_by(F.struct("out0", "out1"), "line_id").alias("e"), F.max("first0").alias("r0"), F.max("first1").alias("r1"))
    earlier = Window.partitionBy("file_id").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    effect = ends.withColumns({
        "fixes": F.when(F.col("e.out0") == F.col("e.out1"), F.col("e.out0")),
        "flips": F.when(F.col("e.out0") & ~F.col("e.out1"), 1).otherwise(0)})
    effect = effect.withColumn("f", F.coalesce(F.sum("flips").over(earlier), F.lit(0)))
    effect = effect.withColumn("last", F.last(mark, ignorenulls=True).over(earlier))
    opened = F.coalesce(F.col("last.v"), F.lit(False)) != (since % 2 == 1)
    settled = effect.withColumn("open", opened)
    splits = settled.withColumn("r", F.when(F.col("open"), F.col("r1")).otherwise(F.col("r0"))).select(
        "file_id", "block_start", "open", F.max("r").over(earlier).alias("carried"))

    based = lines.join(splits, ["file_id", "block_start"]).withColumns({
        "inside": F.when(F.col("open"), F.col("in1")).otherwise(F.col("in0")),
        "first": F.coalesce(F.when(F.col("open"), F.col("first1")).otherwise(F.col("first0")), "carried", "row_no"),
    }).select(*text, "inside", "first")
    inner = based.filter("inside").groupBy("file_id", "first").agg(F.count(F.lit(1)).alias("n"))
    # Only continued records are gathered; all other lines pass as they are.
    state = F.when(F.col("open"), F.col("e.out1")).otherwise(F.col("e.out0"))
    endings = settled.withColumn("r", F.when(F.col("open"), F.col("r1")).otherwise(F.col("r0"))).groupBy("file_id").agg(
        F.max_by(state, "block_start").alias("unclosed"), F.max("r").alias("first"))
    runaway = endings.filter("unclosed").select("file_id", "first", F.lit(True).alias("runaway"))
    if max_lines is not None:
        long = inner.filter(F.col("n") >= max_lines).select("file_id", "first", F.lit(True).alias("runaway"))
        runaway = runaway.unionByName(long).distinct()
    continued = inner.join(runaway, ["file_id", "first"], "left_anti").select(
        "file_id", F.col("first").alias("row_no"), F.lit(True).alias("continued"))
    heads = based.filter("not inside").join(continued, ["file_id", "row_no"], "left")
    tails = join_by_key(based.filter("inside"), runaway, ["file_id", "first"], "row_no", "left", inner)
    parts = heads.filter("continued").select(*text, F.col("row_no").alias("first")).unionByName(
        tails.filter("runaway is null").select(*text, "first"))
    joined = parts.groupBy("file_id", "sheet", "header", "sep", "encoding", F.col("first").alias("row_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "value"))), lambda p: p["value"]),
                     "\n").alias("value"))
    return (
        heads.filter("continued is null").select(*text)
        .unionByName(tails.filter("runaway").select(*text)).unionByName(joined.select(*text))
    )


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str | None = None, encoding: str | None = None,
    multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of delimited files.

    rows: (file_id, sheet, row_no, tokens, header) for every line after the
    first; headers: (file_id, sheet, header, sep, encoding), one per file.
    With ``multiline`` a quoted cell may run over several lines (the header
    line may not).  The text reader drops a UTF-8 mark by itself; files in
    UTF-16 or UTF-32 are recognised by theirs, or named by ``encoding``, and
    decoded.  A file no delimiter splits evenly has the one seen most often in
    its first lines, else the comma.

    Encoding, delimiter and header ride on the split table, so the lines meet
    them in the same join that numbers them.
    """
    lines, splits = text_lines(spark, path, encoding)
    files = splits.groupBy("file_id").agg(
        F.min_by("first_line", F.col("block_start")).alias("first_line"), F.bool_and("utf8").alias("utf8"),
        F.max("wide").alias("wide"))
    found = F.coalesce("wide", bom_encoding(F.col("first_line")), F.when(F.col("utf8"), "utf-8").otherwise("cp1252"))
    files = files.withColumn("encoding", F.lit(encoding) if encoding else found)
    if sep is None:
        guessed = guess_delimiters(lines.filter("block_start = 0"), ("line_id",))
        files = files.join(guessed, "file_id", "left").withColumn("sep", F.coalesce("sep", "frequent", F.lit(",")))
    else:
        files = files.withColumn("sep", F.lit(sep))

    def text(value: Column) -> Column:
        return F.when(is_cp1252(F.col("encoding")), decode_cp1252(value)).otherwise(value)

    headers = files.select(
        "file_id", F.lit("").alias("sheet"),
        split_cells(strip_bom(text(F.col("first_line"))), F.col("sep")).alias("header"), "sep", "encoding")
    placed = place_lines(lines, splits.drop("n", "utf8", "first_line", "wide").join(headers, "file_id"))
    if multiline:
        placed = join_quoted_lines(placed)
    rows = placed.filter("row_no > 1").select(
        "file_id", "sheet", "row_no", split_cells(text(F.col("value")), F.col("sep")).alias("tokens"), "header")
    return rows, headers


def read_records(spark: SparkSession, path: str | list[str], sep: str = ";") -> DataFrame:
    """(file_id, row_no, tokens) of files without a header; quoted cells may span lines."""
    from sievework.sources.records import joined_in_scan  # the one reader that needs Arrow

    after0, after1 = _quote_transition(F.col("value"), F.lit(sep))
    records = joined_in_scan(raw_lines(spark, path).withColumns({"a0": after0, "a1": after1}))
    return records.select("file_id", "row_no", split_cells(F.col("value"), sep).alias("tokens"))


def scan_text(lines: DataFrame) -> DataFrame:
    """Plain text: is it a table in disguise, and how many lines carry text?

    Tabular when the first three non-blank lines all hold the delimiter.
    """
    filled = lines.filter(F.col("value").rlike(r"(?U)\S"))
    counted = filled.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"))
    # A rank limit is applied in every task before the exchange, so only the
    # first three lines of a file travel, whatever its size.
    in_file = Window.partitionBy("file_id").orderBy("row_no")
    firsts = filled.withColumn("__k", F.row_number().over(in_file)).filter("__k <= 3")
    heads = firsts.groupBy("file_id").agg(F.collect_list("value").alias("__h"))
    out = counted.join(heads, "file_id", "left").join(guess_delimiters(lines).drop("frequent"), "file_id", "left")
    all_files = lines.select("file_id").distinct()
    tabular = F.col("sep").isNotNull() & (F.size("__h") > 0) & F.forall(
        "__h", lambda h: h.contains(F.col("sep")))
    n = F.coalesce("lines", F.lit(0))
    return all_files.join(out, "file_id", "left").select(
        "file_id", n.alias("lines"), F.coalesce(tabular, F.lit(False)).alias("tabular"), "sep",
        F.when(n == 0, 0).otherwise(100).alias("score"),
        F.when(n == 0, "sin-contenido").alias("code"))
