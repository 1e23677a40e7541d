"""Image files: what a listing names and what is there, formats by their first bytes, soundness of their structure."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.functions.batches import pieces

#: The bytes that image files begin with, as hex patterns of the first twelve.
MAGIC = {"jpeg": "^FFD8FF", "png": "^89504E470D0A1A0A", "gif": "^47494638(37|39)61", "webp": "^52494646.{8}57454250"}
_PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of pixel data that are unpacked at a time.
_STEP = 1 << 20


def image_format(content: Column) -> Column:
    """jpeg, png, gif or webp by the first bytes, or null. Only twelve bytes are looked at."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC.items()):
        found = F.when(head.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def load_images(listing: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """``listing`` with status, format, error and sha256 of the file at each path.

    ``files`` holds path and content (null if it could not be read), one row for each file. Status is loaded; missing (no such
    path); unreadable (a folder, or a file without content); or corrupt (empty, or of no known format). Only what is loaded has a
    format and a hash. Every row of the listing gives one row: several may name one path, null names none. Contents are
    hashed and looked at where they are read and do not move.
    """
    kept = [f"`{c}`" for c in listing.columns]
    content = F.col("content")
    looked = files.select(F.col("path").alias("_file"), F.octet_length(content).alias("_size"), image_format(content).alias("_format"), F.sha2(content, 256).alias("_sha256"))
    parts = F.split(F.col("path"), "/")
    folders = files.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("_folder")).distinct()
    found = listing.join(looked, F.col(path) == F.col("_file"), "left").join(folders, F.col(path) == F.col("_folder"), "left")
    sound = F.coalesce(F.col("_size") > 0, F.lit(False)) & F.col("_format").isNotNull()
    status = F.when(F.col("_file").isNull(), F.when(F.col("_folder").isNull(), "missing").otherwise("unreadable")).when(F.col("_size").isNull(), "unreadable").when(sound, "loaded").otherwise("corrupt")
    said = (
        F.when(status == "missing", "image path does not exist")
        .when(status == "unreadable", F.when(F.col("_folder").isNull(), "image file cannot be read").otherwise("image path is not a regular file"))
        .when(status == "corrupt", F.when(F.col("_size") == 0, "image file is empty").otherwise("unsupported or corrupt image bytes"))
    )
    error = F.concat(said, F.lit(": "), F.coalesce(F.col(path).cast("string"), F.lit("")))
    loaded = status == "loaded"
    return found.select(*kept, status.alias("status"), F.when(loaded, F.col("_format")).alias("format"), error.alias("error"), F.when(loaded, F.col("_sha256")).alias("sha256"))


def _unpacks(parts: list[memoryview]) -> str | None:
    """What is wrong with packed pixels, unpacked piece by piece and thrown away."""
    unpack = zlib.decompressobj()
    try:
        for part in parts:
            rest = part
            while len(rest) and not unpack.eof:
                unpack.decompress(rest, _STEP)
                rest = unpack.unconsumed_tail
        while not unpack.eof and unpack.decompress(unpack.unconsumed_tail, _STEP):
            pass
    except zlib.error as e:
        return f"invalid PNG pixel data: {e}"
    return None if unpack.eof else "invalid PNG pixel data: Error -5 while decompressing data: incomplete or truncated stream"


def _png_fault(data: memoryview) -> str | None:
    """The first fault of a PNG's chunks: each is met once, its bytes are checked by their sum, none is copied."""
    at, header, end, pixels = len(_PNG), False, False, []
    while not end and at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        body, then = data[at + 8 : at + 8 + size], at + 12 + size
        if then > len(data):
            return "truncated PNG chunk"
        if zlib.crc32(data[at + 4 : then - 4]) != int.from_bytes(data[then - 4 : then], "big"):
            return "invalid PNG checksum"
        match bytes(data[at + 4 : at + 8]):
            case b"IHDR":
                if header or size != 13:
                    return "invalid PNG header"
                if not any(body[:4]) or not any(body[4:8]):
                    return "invalid PNG dimensions"
                header = True
            case b"IDAT":
                pixels.append(body)
            case b"IEND":
                if size:
                    return "invalid PNG end marker"
                end = True
        at = then
    if not (header and pixels and end) or at != len(data):
        return "incomplete PNG"
    return _unpacks(pixels)


def structure_fault(data: bytes) -> str | None:
    """Why image bytes are no whole image, or None."""
    if data.startswith(_PNG):
        fault = _png_fault(memoryview(data))
    elif data.startswith(b"\xff\xd8\xff"):
        fault = None if len(data) >= 8 and data.endswith(b"\xff\xd9") else "incomplete JPEG"
    elif data.startswith((b"GIF87a", b"GIF89a")):
        fault = None if len(data) >= 14 and data.endswith(b";") else "incomplete GIF"
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        fault = None if len(data) >= 20 and int.from_bytes(data[4:8], "little") + 8 == len(data) else "incomplete WEBP"
    else:
        fault = "unsupported image container"
    return fault and f"image decode failed: {fault}"


def structure_faults(images: DataFrame, row_id: str, content: str) -> DataFrame:
    """(id, fault) of every image: null where its container is whole. Null bytes have a null fault; empty ones are of no known
    container. Python in Arrow batches, as nothing built in walks chunks of their own length; time is linear in the bytes, and
    memory is that of a batch: pixels are never held unpacked."""
    kind = images.schema[row_id].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            faults = [None if x is None else structure_fault(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(faults, pa.string())], names=[row_id, "fault"])

    return images.select(row_id, content).mapInArrow(look, f"`{row_id}` {kind}, fault string")
