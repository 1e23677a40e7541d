"""Image files on disk, and containers with every kind of damage."""

import hashlib
import zlib

from pyspark.sql import functions as F
from sluicework.jobs.files import DAMAGE, _chunk, _image
from sluicework.operators import images
from sluicework.sources.tables import read_files

KINDS = {"a.jpg": b"\xff\xd8\xff..", "b.png": b"\x89PNG\r\n\x1a\n", "d/c.gif": b"GIF87a", "d/e.webp": b"RIFF\0\xff\n\0WEBPx", "none.png": b"", "odd.png": b"RIFF0000WAVE", "short": b"\xff\xd8"}


def test_files_of_a_listing(spark, tmp_path):
    for name, data in KINDS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = read_files(spark, str(tmp_path))
    assert {r.path: bytes(r.content) for r in files.collect()} == KINDS
    names = [*KINDS, "a.jpg", "d", "gone.png", None, ""]
    listing = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, path string").withColumns({c: F.lit(1) for c in ("content", "size", "n")})
    got = {r.id: r for r in images.load_images(listing, files).collect()}
    assert len(got) == len(names)
    told = {n: (got[k].status, got[k].format, (got[k].error or "").split(":")[0]) for k, n in enumerate(names)}
    assert told == {
        "a.jpg": ("loaded", "jpeg", ""), "b.png": ("loaded", "png", ""), "d/c.gif": ("loaded", "gif", ""), "d/e.webp": ("loaded", "webp", ""),
        "none.png": ("corrupt", None, "image file is empty"), "odd.png": ("corrupt", None, "unsupported or corrupt image bytes"), "short": ("corrupt", None, "unsupported or corrupt image bytes"),
        "d": ("unreadable", None, "image path is not a regular file"), "gone.png": ("missing", None, "image path does not exist"), None: ("missing", None, "image path does not exist"), "": ("missing", None, "image path does not exist"),
    }
    assert got[0].sha256 == hashlib.sha256(KINDS["a.jpg"]).hexdigest() and got[4].sha256 is None
    unread = files.withColumn("content", F.lit(None).cast("binary"))
    assert {r.status for r in images.load_images(listing.filter("id = 0"), unread).collect()} == {"unreadable"}
    assert images.load_images(listing, files.limit(0)).filter("status <> 'missing'").count() == 0


def test_every_damage_is_told(spark):
    sound = {d for d in DAMAGE if images.structure_fault(_image("a text of pixels " * 50, d)) is None}
    assert sound == {"none", "gif", "webp", "jpeg"}
    big = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", b"\0\0\0\1\0\0\0\1....."[:13]) + _chunk(b"IDAT", zlib.compress(bytes(30_000_000))) + _chunk(b"IEND", b"")
    assert images.structure_fault(big) is None
    for cut in range(8, 90):  # no prefix of a whole image passes, none fails to be judged
        assert images.structure_fault(_image("x" * 40, "none")[:cut])
    df = spark.createDataFrame([(1, None), (2, b""), (2, b""), (None, b"GIF89a........;")], "id int, content binary")
    assert sorted((str(r.id), r.fault) for r in images.structure_faults(df, "id", "content").collect() if r.fault) == [("2", "image decode failed: unsupported image container")] * 2


def test_pixels_that_are_not_packed_have_one_fault_whatever_their_text():
    """One byte before a text is a header of zlib's with one text in 31."""
    found = {images.structure_fault(_image(chr(c) + "a text of pixels", "not_packed")) for c in range(1, 1000)} | {images.structure_fault(_image("", "not_packed"))}
    assert found == {"image decode failed: invalid PNG pixel data: Error -3 while decompressing data: incorrect header check"}
