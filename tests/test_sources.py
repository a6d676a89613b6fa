"""Container files built here, read back by the sources; ranges; sinks; the stream."""

import gzip
import random
import struct
import zipfile

from pyspark.sql import functions as F
from shelfmark.operators import chunks as K
from shelfmark.sources import archives, containers, sinks, volumes
from shelfmark.streaming import ingest


def prodos_volume():
    image = bytearray(280 * 512)
    entry = bytes([0x16]) + b"README".ljust(15, b"\0") + bytes([4]) + struct.pack("<HH", 7, 1) + (300).to_bytes(3, "little") + struct.pack("<HH", (99 << 9) + (2 << 5) + 3, (5 << 8) + 6) + bytes(2) + bytes([0xC3]) + struct.pack("<H", 0x2000) + bytes(6)
    image[2 * 512 + 4] = 0xF4
    image[2 * 512 + 4 + 39 : 2 * 512 + 4 + 39 + len(entry)] = entry
    return bytes(image)


def build(folder):
    image = prodos_volume()
    header = b"2IMGtest" + struct.pack("<HHIIIII", 64, 1, 1, 0x1FE, 280, 64, len(image)) + bytes(32)
    (folder / "disk.po").write_bytes(image)
    (folder / "disk.2mg").write_bytes(header + image)
    (folder / "a.txt.gz").write_bytes(gzip.compress(b"hello"))
    with zipfile.ZipFile(folder / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/x", b"x" * 1000)
        z.writestr("y", b"")
    (folder / "bad.zip").write_bytes(b"PK\x03\x04broken")
    (folder / "notes.txt").write_bytes(b"plain")


def test_scan(spark, tmp_path):
    build(tmp_path)
    files = containers.identified(containers.scan(spark, str(tmp_path)))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.collect()}
    assert kinds == {"disk.po": "sectors", "disk.2mg": "2img", "a.txt.gz": "gzip", "b.zip": "zip", "bad.zip": "zip", "notes.txt": None}
    head = containers.image_headers(files).first()
    assert (head.creator, head.format, head.data_start, head.volume, head.fits) == ("test", 1, 64, 0xFE, True)
    blocks = containers.chunks(files.where("kind in ('sectors', '2img')"))
    assert blocks.groupBy("path").count().select("count").distinct().collect()[0][0] == 1
    assert containers.chunks(files.where("kind = 'sectors'"), keep_zero=True).count() == 280
    for r in volumes.prodos_directory(blocks).collect():
        assert (r.name, r.storage, r.file_type, r.key, r.data_len, r.aux_type, r.access) == ("README", 1, 4, 7, 300, 0x2000, 0xC3)
        assert str(r.created) == "1999-02-03 05:06:00"
    got = {(r.path.rsplit("/", 1)[1], r.name): (r.data_len, r.good) for r in containers.members(files).collect()}
    assert got == {("a.txt.gz", "a.txt"): (5, True), ("b.zip", "dir/x"): (1000, True), ("b.zip", "y"): (0, True), ("bad.zip", None): (None, False)}


def test_ranges_across_blocks(spark):
    rnd = random.Random(1)
    values = sorted({*range(65530, 65545), *range(131072, 200000), 5, *(rnd.randrange(300000, 900000) for _ in range(3000))})
    want, low = [], values[0]
    for a, b in zip(values, [*values[1:], None], strict=True):
        if b != a + 1:
            want.append((low, a, a - low + 1))
            low = b
    df = spark.createDataFrame([(v,) for v in [*values, *values[:9], None]], "v long")
    assert sorted(tuple(r) for r in K.ranges(df, "v").collect()) == want


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"b'), (2, " c"), (3, None)], "i int, t string").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert text == b'1,"a""b"\r\n2," c"\r\n3,\r\n'
    for n in (3, 2):
        sinks.replace_table(rows.limit(n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["csv", "table"]


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    build(inbox)
    for more in (0, 1):
        if more:
            (inbox / "late.gz").write_bytes(gzip.compress(b"late"))
        ingest.append(ingest.new_files(spark, str(inbox), files_at_once=2), table, str(tmp_path / "checkpoint")).awaitTermination()
        rows = spark.read.parquet(table)
        assert rows.count() == rows.select("path").distinct().count() == 6 + more
    assert rows.where(F.col("path").endswith("late.gz")).first().kind == "gzip"


def test_volumes(spark, tmp_path):
    dos = bytearray(35 * 16 * 256)
    for slot, (track, kind, name) in enumerate([(18, 0x82, "HELLO"), (255, 0, "GONE"), (0, 0, ""), (20, 0x04, "BIN FILE")]):
        at = (17 * 16 + 15) * 256 + 11 + 35 * slot
        dos[at : at + 35] = bytes([track, 15, kind]) + bytes(ord(c) | 0x80 for c in name.ljust(30)) + struct.pack("<H", 9 + slot)
    files = spark.createDataFrame([("d", bytes(dos)), ("short", b"x")], "path string, content binary")
    got = sorted((r.name, r.kind, r.locked, r.sectors, r.list_track, r.sector) for r in volumes.dos_catalog(files).collect())
    assert got == [("BIN FILE", 4, False, 12, 20, 15), ("HELLO", 2, True, 9, 18, 15)]

    entries = [struct.pack("<HHH", 0, 6, 0) + b"\x03VOL".ljust(8, b"\0") + struct.pack("<HHHH", 280, 25, 0, 0)]
    entries[0] = entries[0].ljust(26, b"\0")
    for i in range(25):
        name = f"FILE{i}.TEXT".encode()
        entries.append(struct.pack("<HHH", 6 + i, 8 + i, 3) + bytes([len(name)]) + name.ljust(15, b"\0") + struct.pack("<HH", 100, (85 << 9) + (4 << 4) + 2))
    image = bytes(1024) + b"".join(entries).ljust(2048, b"\0")
    blocks = spark.createDataFrame([("p", i, image[512 * i : 512 * i + 512]) for i in range(6)], "path string, chunk int, data binary")
    rows = {r.slot: r for r in volumes.pascal_directory(blocks).collect()}
    assert len(rows) == 25 and rows[20].name == "FILE19.TEXT" and rows[20].data_len == 612 and str(rows[20].modified) == "1985-02-04 00:00:00"

    slot = lambda user, name, ext, n: bytes([user]) + name.ljust(8).encode() + ext.ljust(3).encode() + bytes([0, 0, 0, n]) + bytes(16)
    data = (slot(0, "A", "COM", 128) + slot(0, "A", "COM", 5) + slot(3, "B", "", 1) + bytes([0xE5] * 32)).ljust(512, b"\xe5")
    cpm = spark.createDataFrame([("c", 24, data)], "path string, chunk int, data binary")
    assert sorted((r.user, r.name, r.extents, r.records) for r in volumes.cpm_directory(cpm, 24, 1).collect()) == [(0, "A.COM", 2, 133), (3, "B", 1, 1)]

    part = lambda n, start, count, name: (b"PM\0\0" + struct.pack(">III", n, start, count) + name.encode().ljust(32, b"\0") + b"Apple_HFS".ljust(32, b"\0")).ljust(512, b"\0")
    disk = [b"ER".ljust(512, b"\0"), part(2, 1, 2, "map"), part(2, 3, 4, "data"), *[bytes([i]) * 512 for i in range(3, 9)]]
    blocks = spark.createDataFrame([("m", i, b) for i, b in enumerate(disk)], "path string, chunk int, data binary")
    parts = volumes.apple_partitions(blocks)
    assert sorted((r.part, r.start, r["count"], r.name, r.kind) for r in parts.collect()) == [(1, 1, 2, "map", "Apple_HFS"), (2, 3, 4, "data", "Apple_HFS")]
    inside = volumes.partition_blocks(blocks, parts.where("part = 2"), 4).collect()
    assert sorted((r.chunk, r.data[0]) for r in inside) == [(0, 3), (1, 4), (2, 5), (3, 6)]


def test_archive_headers(spark):
    single = bytes.fromhex("00051600 00020000") + bytes(16) + struct.pack(">HIIIIII", 2, 3, 50, 4, 1, 54, 9)
    mac = bytearray(128 + 128 + 5)
    mac[1:6] = bytes([4]) + b"Name"
    mac[65:73], mac[83:91], mac[91:95] = b"TEXTttxt", struct.pack(">II", 100, 5), struct.pack(">I", 3000000000)
    head = lambda name, n, left: (b"\x0aGL\xc3\x04\x00\x20\x01" + bytes(10) + b"\x02\x00" + n.to_bytes(3, "little") + bytes([len(name)]) + name).ljust(127, b"\0") + bytes([left]) + bytes(-(-n // 128) * 128)
    two = head(b"A", 0, 2) + head(b"DIR/B", 129, 1) + head(b"C", 5, 0)
    nufx = bytes.fromhex("4EF546E96CE5") + struct.pack("<HI", 0, 7) + bytes([1, 2, 3, 99, 4, 5, 0, 1]) + bytes(8) + struct.pack("<H", 2) + bytes(8) + struct.pack("<I", 4000) + bytes(6)
    files = spark.createDataFrame([("s", bytearray(single)), ("m", mac), ("b", bytearray(two)), ("cut", bytearray(two[:200])), ("n", bytearray(nufx)), ("e", bytearray())], "path string, content binary")
    assert [tuple(r) for r in archives.apple_single(files).orderBy("entry").collect()] == [("s", False, 0, 3, 50, 4), ("s", False, 1, 1, 54, 9)]
    r = archives.mac_binary(files).where("path = 'm'").first()
    assert (r.name, r.type, r.creator, r.data_len, r.rsrc_len, r.rsrc_start, str(r.created), r.whole) == ("Name", "TEXT", "ttxt", 100, 5, 256, "1999-01-24 05:20:00", False)
    got = [(r.path, r.record, r.name, r.length, r.start) for r in archives.binary_two(files).orderBy("path", "record").collect()]
    assert got == [("b", 0, "A", 0, 128), ("b", 1, "DIR/B", 129, 256), ("b", 2, "C", 5, 640), ("cut", 0, "A", 0, 128)]
    r = archives.nufx_archive(files).first()
    assert (r.path, r.records, str(r.created), r.modified, r.version, r.length) == ("n", 7, "1999-06-05 03:02:01", None, 2, 4000)


def test_prodos_links_and_folders(spark):
    """A chain of directory blocks that goes in a circle, and a directory in a directory."""
    entry = lambda kind, name, key: (bytes([kind << 4 | len(name)]) + name.ljust(15, b"\0") + b"\x04" + struct.pack("<HH", key, 1)).ljust(39, b"\0")
    block = lambda after, *entries: (struct.pack("<HH", 0, after) + b"\xe4".ljust(39, b"\0") + b"".join(entries)).ljust(512, b"\0")
    chunks = [("d", 2, block(3, entry(1, b"A", 50))), ("d", 3, block(2, entry(13, b"SUB", 9))), ("d", 9, block(0, entry(13, b"LOW", 11), entry(2, b"B", 60))), ("d", 11, block(0, entry(1, b"C", 70))), ("d", 12, block(0, entry(1, b"NOT", 70))), ("x", 7, bytes(512))]
    df = spark.createDataFrame([(p, c, bytearray(d)) for p, c, d in chunks], "path string, chunk int, data binary")
    got = sorted((r.folder, r.name, r.storage) for r in volumes.prodos_directory(df).collect())
    assert got == [("", "A", 1), ("", "SUB", 13), ("SUB", "B", 2), ("SUB", "LOW", 13), ("SUB/LOW", "C", 1)]
    assert volumes.prodos_directory(df.limit(0)).collect() == []


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_binary_two_rows_have_their_header_only(spark):
    from shelfmark.sources import archives

    files = spark.createDataFrame([("a", b"x")], "path string, content binary")
    generate = next(x for x in _plan(archives.binary_two(files)).splitlines() if "Generate" in x)
    assert "head" in generate and ", [1]" in generate


def test_checksums_take_no_step_for_each_byte(spark):
    from binascii import crc_hqx

    from shelfmark.functions import bits
    from pyspark.sql import functions as F

    data = bytes(range(256)) * 5
    df = spark.createDataFrame([(data,), (b"",), (None,)], "b binary").select(bits.crc16_xmodem(F.col("b")).alias("x"), bits.crc16_kermit(F.col("b")).alias("k"))
    assert "aggregate" not in _plan(df)
    rows = df.collect()
    assert [r.x for r in rows] == [crc_hqx(data, 0), 0, None]
    assert [r.k for r in rows][1:] == [0, None]
