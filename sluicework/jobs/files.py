"""Queries on files that Spark writes from the given tables and scans again: CSV with defects, images."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.functions.batches import pieces
from sluicework.jobs.inputs import draw, table, to_duck, to_spark
from sluicework.operators import images
from sluicework.scratch import Scratch
from sluicework.sources import csv_scan
from sluicework.sources.tables import read_files

HEADER = ("doc_id", "text", "lang")
_SHAPE = draw(201, 16)
#: Documents of the files that are written side by side, all sources together.
FILE_DOCUMENTS = 10_000


def csv_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as CSV records, quotes and line ends within their texts, some with a field too few or too many, a
    blank record behind them, or text behind a quote; files for each source, of some thousands of documents each. Each defect names the document it is found at
    or behind."""
    quoted = F.concat(F.lit('"'), F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " "), F.lit('"'), F.lit('""')), F.lit('"'))
    shape = F.expr(to_spark(_SHAPE))
    end = F.when(shape == 0, "").when(shape == 1, ",x,y").when(shape == 2, ",x\n").when(shape == 3, "x,y").otherwise(F.concat(F.lit(","), F.coalesce("lang", F.lit(""))))
    given = table(spark, sf_dir, "documents")
    n_parts = -(-given.count() // FILE_DOCUMENTS) or 1
    docs = given.select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).alias("part"), F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted, end).alias("value"))
    heads = docs.select("source", "part").distinct().select(F.lit(-1).cast("long").alias("doc_id"), "source", "part", F.lit(",".join(HEADER)).alias("value"))
    scratch = Scratch(spark, "csv")
    rows = docs.unionByName(heads).repartition(n_parts, "source", "part").sortWithinPartitions("source", "part", "doc_id")
    rows.select("source", "part", "value").write.partitionBy("source", "part").text(scratch.path("files"))
    scan = csv_scan.scan_csv(spark, scratch.path("files"))
    faults = csv_scan.record_faults(scan, HEADER).unionByName(csv_scan.header_faults(scan, HEADER))
    ids = scan.select("file", "number", F.get("fields", F.lit(0)).alias("id"))
    near = faults.join(ids, ["file", "number"], "left")
    before = ids.select("file", (F.col("number") + 1).alias("number"), F.col("id").alias("id_before"))
    named = near.join(before, ["file", "number"], "left")
    told = F.regexp_replace("message", r"row [0-9]+", "row")
    return named.select(F.coalesce("id", "id_before").try_cast("long").alias("doc_id"), "code", told.alias("message"))


#: What an item's file begins with, and the path that its listing names.
_FORM = draw(211, 6).replace("doc_id", "item_id")
HEAD = f"case {_FORM} when 0 then 'GIF89a' when 1 then 'GIF87a' when 2 then 'RIFF0000WEBP' when 3 then 'RIFF0000WAVE' when 4 then 'GIF88a' else '' end"


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each item of the benchmark, with its text behind the first bytes of some format, or of none; the listing
    names items that have no file, folders and files twice as well."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.expr(HEAD), F.coalesce("text", F.lit(""))).alias("value"))
    scratch = Scratch(spark, "images")
    items.filter(f"{_FORM.replace(' DIV ', ' div ')} < 5 or item_id % 2 = 0").withColumnRenamed("item_id", "item").repartition("item").write.partitionBy("item").text(scratch.path("files"))
    files = read_files(spark, scratch.path("files")).withColumn("path", F.regexp_replace("path", "/part-[^/]*$", "/image")).filter(F.startswith("path", F.lit("item=")))
    names = items.select("item_id", F.explode(F.array(F.concat(F.lit("item="), F.col("item_id").cast("string"), F.lit("/image")), F.concat(F.lit("item="), F.col("item_id").cast("string")))).alias("path"))
    return images.load_images(names, files).select("item_id", "path", "status", "format", "error", "sha256")


#: Damage done to a document's image: none, or one of these.
DAMAGE = ("none", "cut", "flip", "no_end", "size_0", "two_heads", "not_packed", "half_packed", "behind", "end_data", "text", "gif", "gif_cut", "webp", "webp_cut", "jpeg", "jpeg_cut")
_DAMAGE = draw(212, 2 * len(DAMAGE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def _image(text: str, damage: str) -> bytes:
    """An image whose pixels are a text, damaged in some way. Pixels that are not packed begin with two bytes that are no header
    of zlib's, so that none of a text's can make one of them."""
    data = text.encode()
    if damage.startswith(("gif", "webp", "jpeg", "text")):
        whole = {"gif": b"GIF89a" + data + b"........;", "webp": b"RIFF" + (len(data) + 16).to_bytes(4, "little") + b"WEBP" + data + b"." * 12, "jpeg": b"\xff\xd8\xff" + data + b"...\xff\xd9", "text": b"text" + data}[damage.removesuffix("_cut")]
        return whole[:-1] if damage.endswith("_cut") else whole
    head = _chunk(b"IHDR", (0 if damage == "size_0" else 7).to_bytes(4, "big") + b"\0\0\0\1\x08\0\0\0\0")
    packed = zlib.compress(data, 1)
    packed = {"not_packed": b"??" + data, "half_packed": packed[:-4]}.get(damage, packed)
    middle = _chunk(b"IDAT", packed[: len(packed) // 2]) + _chunk(b"tEXt", b"x") + _chunk(b"IDAT", packed[len(packed) // 2 :])
    end = {"no_end": b"", "end_data": _chunk(b"IEND", b"x")}.get(damage, _chunk(b"IEND", b""))
    found = b"\x89PNG\r\n\x1a\n" + head * (2 if damage == "two_heads" else 1) + middle + end + (b"x" if damage == "behind" else b"")
    if damage == "flip":
        found = found[:-20] + bytes([found[-20] ^ 1]) + found[-19:]
    return found[:-13] if damage == "cut" else found


def image_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pixels of images, every other one damaged."""

    def draw_images(batches):
        for batch in pieces(batches):
            made = [_image(t or "", DAMAGE[k] if k < len(DAMAGE) else "none") for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(to_spark(_DAMAGE)).cast("int").alias("damage"))
    return images.structure_faults(docs.mapInArrow(draw_images, "doc_id long, content binary"), "doc_id", "content")


_FAULTS = {
    "cut": "truncated PNG chunk", "flip": "invalid PNG checksum", "no_end": "incomplete PNG", "size_0": "invalid PNG dimensions", "two_heads": "invalid PNG header",
    "not_packed": "invalid PNG pixel data: Error -3 while decompressing data: incorrect header check", "half_packed": "invalid PNG pixel data: Error -5 while decompressing data: incomplete or truncated stream",
    "behind": "incomplete PNG", "end_data": "invalid PNG end marker", "text": "unsupported image container", "gif_cut": "incomplete GIF", "webp_cut": "incomplete WEBP", "jpeg_cut": "incomplete JPEG",
}
QUERIES = (csv_defects, image_scan, image_structure)
ORACLE = {
    "image_structure": to_duck(f"""select doc_id, 'image decode failed: ' || case {_DAMAGE} {" ".join(f"when {DAMAGE.index(k)} then '{v}'" for k, v in _FAULTS.items())} end as fault from documents"""),
    "image_scan": to_duck(f"""with b as (select item_id, {HEAD} as head, text, {_FORM} < 5 or item_id % 2 = 0 as there from benchmark),
l as (select *, 'item=' || item_id || '/image' as path, false as folder from b union all select *, 'item=' || item_id, true from b),
s as (select *, case when not there then 'missing' when folder then 'unreadable' when head in ('GIF89a', 'GIF87a', 'RIFF0000WEBP') then 'loaded' else 'corrupt' end as status from l)
select item_id, path, status, case when status = 'loaded' then case when starts_with(head, 'GIF') then 'gif' else 'webp' end end as format,
 case status when 'missing' then 'image path does not exist: ' when 'unreadable' then 'image path is not a regular file: ' when 'corrupt' then 'unsupported or corrupt image bytes: ' end || path as error,
 case when status = 'loaded' then sha256(head || coalesce(text, '') || chr(10)) end as sha256 from s"""),
    "csv_defects": to_duck(f"""with d as (select doc_id, {_SHAPE} as shape from documents)
select doc_id, case shape when 0 then 'arity' when 1 then 'arity' when 2 then 'blank' else 'quotes' end as code,
 case shape when 0 then 'row has 2 fields; expected 3' when 1 then 'row has 4 fields; expected 3' when 2 then 'artifact contains blank row' else 'row is malformed CSV' end as message from d where shape < 4"""),
}
