"""CSV files as records with their defects, where a strict reader would stop at the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sluicework.functions.text import strip
from sluicework.operators.rules import all_faults

# A field, quoted or not; what is left of a quoted one; all possessive, so that long fields take no stack.
_INNER = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:"{_INNER}"|[^",][^,]*+|)'
_ENDS = {
    # how a line ends that begins a record, and one that begins inside quotes: True if inside quotes
    "outside": (rf"(?s)^{_FIELD}(?:,{_FIELD})*+$", rf'(?s)^(?:{_FIELD},)*+"{_INNER}$'),
    "inside": (rf'(?s)^{_INNER}"(?:,{_FIELD})*+$', rf'(?s)^{_INNER}(?:"(?:,{_FIELD}(?=,))*+,"{_INNER})?$'),
}


def _end(line: Column, begins: str) -> Column:
    """struct(open, broken): whether a line leaves quotes open, and whether something stands behind a closing quote."""
    whole, open_ = _ENDS[begins]
    return F.struct((~line.rlike(whole) & line.rlike(open_)).alias("open"), (~line.rlike(whole) & ~line.rlike(open_)).alias("broken"))


def _states(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """``rows`` that map a state (open or not) to another, as ``out.open`` and ``in.open``, with what is known of the state before
    each: the one behind the last row that ends alike in both cases (``known``, null if there is none), and whether the rows
    behind that one swap it (``odd``)."""
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    constant, swaps = F.col("out.open") == F.col("in.open"), F.col("out.open") & ~F.col("in.open")
    counted = rows.withColumn("swapped", F.sum(swaps.cast("long")).over(upto))
    last = F.last(F.when(constant, F.struct(F.col("out.open").alias("open"), "swapped")), ignorenulls=True).over(before)
    counted = counted.withColumn("last", last).withColumn("earlier", F.coalesce(F.lag("swapped").over(order), F.lit(0)))
    odd = (F.col("earlier") - F.coalesce("last.swapped", F.lit(0))) % 2 == 1
    return counted.withColumns({"known": F.col("last.open"), "odd": odd}).drop("swapped", "last", "earlier")


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text, fields, broken, valid): the logical records of every CSV file, blank ones included, from 1.

    Nothing fails on a defect: a record keeps its ``text``, its ``fields`` however many, whether text stands behind a closing
    quote or quotes are still open at the end (``broken``), and whether it is UTF-8 (``valid``). A blank record has no fields. Records may
    run over lines: each line maps the state it begins in, outside or inside quotes, to the state it ends in; states
    before a line follow from the last line that ends alike in both cases and the number of those behind it that swap
    them, which are running aggregates over a block of a file. A block, too, maps the state it begins in to the one it
    ends in and to the number of records that begin in it: one row a block, added up along each file and joined back. So no
    task holds more than a block, however long a file is. An empty file has no records.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    line = raw.withColumn("line", F.regexp_replace(F.make_valid_utf8("value"), "\r$", "")).withColumn("valid", F.is_valid_utf8("value"))
    ends = line.withColumns({"out": _end(F.col("line"), "outside"), "in": _end(F.col("line"), "inside")})
    stated = _states(ends, Window.partitionBy("file", "block").orderBy("at"))
    # whether a line is inside quotes, by the state that its block begins in
    inside = {False: F.coalesce("known", F.lit(False)) != F.col("odd"), True: F.coalesce("known", F.lit(True)) != F.col("odd")}
    last = {begins: F.max_by(F.when(inside[begins], F.col("in.open")).otherwise(F.col("out.open")), "at") for begins in inside}
    blocks = stated.groupBy("file", "block").agg(
        F.struct(last[False].alias("open")).alias("out"), F.struct(last[True].alias("open")).alias("in"),
        F.count_if(~inside[False]).alias("starts_out"), F.count_if(~inside[True]).alias("starts_in"),
    )
    along = Window.partitionBy("file").orderBy("block")
    blocks = _states(blocks, along).withColumn("begins", F.coalesce("known", F.lit(False)) != F.col("odd"))
    starts = F.when(F.col("begins"), F.col("starts_in")).otherwise(F.col("starts_out"))
    earlier = F.coalesce(F.sum(starts).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "begins", earlier.alias("earlier"))
    stated = stated.join(F.broadcast(blocks), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))  # one row a block
    stated = stated.withColumn("inside", F.coalesce("known", "begins") != F.col("odd"))
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stated = stated.withColumn("number", F.col("earlier") + F.sum((~F.col("inside")).cast("long")).over(upto))
    end = F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))
    lines = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    records = stated.withColumn("end", end).groupBy("file", "number").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), (F.max_by("end.open", F.struct("block", "at")) | F.bool_or("end.broken")).alias("broken"), F.bool_and("valid").alias("valid")
    )
    found = F.regexp_extract_all(F.concat(F.lit(","), "text"), F.lit(rf'(?s),("{_INNER}"|[^,]*+)'), 1)
    plain = F.transform(found, lambda x: F.when(x.rlike('(?s)^".*"$') & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return records.select("file", "number", "text", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(plain).alias("fields"), "broken", "valid")


def header_faults(scan: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(file, number, code, message) of files whose header is not exactly ``expected``, or that have no rows below it."""
    heads = scan.groupBy("file").agg(F.max(F.when(F.col("number") == 1, F.col("fields"))).alias("head"), F.count("*").alias("n"))
    wanted = F.array(*[F.lit(c) for c in expected])
    rules = [
        ("header", "headers must be exactly: " + ", ".join(expected), ~F.col("head").eqNullSafe(wanted)),
        ("no_rows", "artifact has no data rows", F.col("n") < 2),
    ]
    return heads.select("file", F.lit(1).cast("long").alias("number"), F.inline(all_faults(rules)))


def record_faults(scan: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(file, number, code, message) of every defect of every record below the header: blank, of another number of fields than
    ``expected``, broken quotes, no UTF-8. All of them, not the first."""
    n, number = F.size("fields"), F.col("number").cast("string")
    rules = [
        ("encoding", F.concat(F.lit("row "), number, F.lit(" is not valid UTF-8")), ~F.col("valid")),
        ("quotes", F.concat(F.lit("row "), number, F.lit(" is malformed CSV")), F.col("broken")),
        ("blank", F.concat(F.lit("artifact contains blank row "), number), n == 0),
        ("arity", F.concat(F.lit("row "), number, F.lit(" has "), n.cast("string"), F.lit(f" fields; expected {len(expected)}")), (n > 0) & (n != len(expected))),
    ]
    return scan.filter("number > 1").select("file", "number", F.inline(all_faults(rules)))


def table_rows(scan: DataFrame) -> DataFrame:
    """(file, number, row, extra): records as maps by the names of their file's header, as a reader of dictionaries gives them.

    Blank records do not count and are left out; numbers begin at 2. A record that is too short lacks the last names; ``extra``
    tells of one that is too long. Of repeated names the last counts.
    """
    kept = scan.filter(F.size("fields") > 0).withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("number")).cast("long"))
    heads = kept.filter("number = 1").select("file", F.col("fields").alias("head"))
    rows = kept.filter("number > 1").join(heads, "file")
    last = F.filter(F.arrays_zip("head", "fields"), lambda p, i: ~F.exists(F.slice("head", i + 2, F.size("head")), lambda h: h == p["head"]))
    named = F.map_from_entries(F.filter(last, lambda p: p["head"].isNotNull() & p["fields"].isNotNull()))
    return rows.select("file", "number", named.alias("row"), (F.size("fields") > F.size("head")).alias("extra"))


def layout_faults(scan: DataFrame, name: str, required: Sequence[str], not_empty: Sequence[str], row_id: str, labels: Sequence[str] | None = None, label: str = "label") -> DataFrame:
    """(number, part, message) of everything that is wrong with one CSV file of a data set, in the order of rows and, within
    one, of ``part``: header, extra fields, empty required fields, repeated ids (each but the first), unknown labels, no rows.

    A file that lacks a required column has its header's faults only.
    """
    heads = scan.filter("number = 1").select(F.col("fields").alias("head"))
    repeated = F.array_distinct(F.filter("head", lambda h: F.size(F.filter(F.col("head"), lambda x: x == h)) > 1))
    lacking = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: ~F.array_contains("head", c))
    header = heads.select(
        F.lit(1).cast("long").alias("number"),
        F.inline(F.array_compact(F.array(
            F.when(F.size(repeated) > 0, F.struct(F.lit(0).alias("part"), F.concat(F.lit(f"{name} has duplicate columns: "), F.array_join(repeated, ", ")).alias("message"))),
            F.when(F.size(lacking) > 0, F.struct(F.lit(1).alias("part"), F.concat(F.lit(f"{name} missing required columns: "), F.array_join(lacking, ", ")).alias("message"))),
        ))),
    )
    sound = heads.filter(F.size(lacking) == 0).select(F.lit(True).alias("sound"))
    rows = table_rows(scan).join(F.broadcast(sound), F.lit(True), "left_semi")  # one row
    value = lambda c: strip(F.coalesce(F.col("row")[c], F.lit("")))
    rows = rows.withColumn("id", value(row_id))
    first = rows.filter("id <> ''").groupBy("id").agg(F.min("number").alias("first"))
    rows = rows.join(first, "id", "left")
    start = F.concat(F.lit(f"{name} row "), F.col("number").cast("string"))
    rules = [
        ("2", F.concat(start, F.lit(" has extra unnamed fields")), F.col("extra")),
        *[(str(3 + k), F.concat(start, F.lit(f" has empty required field: {c}")), value(c) == "") for k, c in enumerate(not_empty)],
        (str(3 + len(not_empty)), F.concat(start, F.lit(f" has duplicate {row_id}: "), F.col("id")), F.col("number") > F.col("first")),
    ]
    if labels is not None:
        given = value(label)
        rules.append((str(4 + len(not_empty)), F.concat(start, F.lit(" has invalid label: '"), given, F.lit("'")), (given != "") & ~given.isin(*labels)))
    found = rows.select("number", F.inline(all_faults(rules))).select("number", F.col("code").cast("int").alias("part"), "message")
    none = rows.agg(F.count("*").alias("n")).join(F.broadcast(sound), F.lit(True), "left_semi").filter("n = 0")
    return header.unionByName(found).unionByName(none.select(F.lit(2).cast("long").alias("number"), F.lit(0).alias("part"), F.lit(f"{name} has no data rows").alias("message")))
