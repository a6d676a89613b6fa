"""Fixed vectors, edges and round trips of the scalar functions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from shelfmark.functions import bits, charsets, dates, formats, labels, names, paths
from shelfmark.operators.catalog import best_format


def value(spark, column, **inputs):
    cols = [F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select(column).first()[0]


@pytest.mark.parametrize(("pattern", "path", "prefix", "hit"), [
    ("a*c", "abbc", False, True), ("a*c", "a/c", False, False), ("?", "/", False, False), ("A?", "ab", False, True), ("dir", "dir/sub/x", True, True), ("dir/", "dir", False, True),
    ("dir", "dir/", False, True), ("a\\b", "a\\b", False, True), ("a\\b", "ab", False, False), ("d.r", "dxr", False, False), ("a\\*c", "a*c", False, True), ("a\\*c", "abc", False, False), ("*", "x\ny", False, True), ("dir", "dirt", True, False),
])
def test_globs(spark, pattern, path, prefix, hit):
    assert value(spark, paths.matches(F.col("p"), pattern, prefix=prefix), p=path) is hit


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x2FF), min_size=1, max_size=12))
def test_escape_round_trip(name):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    escaped = paths.escaped_name(F.col("n"))
    assert value(spark, paths.unescaped_name(escaped), n=name) == name
    assert not set(value(spark, escaped, n=name)) & set('<>:"/\\|?*')


def test_paths(spark):
    p = F.col("p")
    assert value(spark, paths.file_name(p), p="a/b/c") == "c"
    assert value(spark, paths.directory_name(p), p="c") == ""
    assert value(spark, paths.ancestors(p), p="a/b/c") == ["a", "a/b"]
    assert value(spark, paths.ancestors(p), p="c") == []
    assert value(spark, paths.sidecar_path(p), p="c") == "__MACOSX/._c"
    assert value(spark, paths.printable(p), p="a\x00\x7fb") == "a␀␡b"
    assert value(spark, paths.unprintable(paths.printable(p)), p="\x01\n") == "\x01\n"
    assert value(spark, paths.without_gz(p), p="x.po.GZ") == "x.po"


def test_checksums(spark):
    data = F.col("d")
    assert value(spark, bits.crc32(data), d=b"123456789") == 0xCBF43926
    assert value(spark, bits.crc16_xmodem(data), d=b"123456789") == 0x31C3
    assert value(spark, bits.crc16_xmodem(data, 0xFFFF), d=b"123456789") == 0x29B1
    assert value(spark, bits.crc16_kermit(data), d=b"123456789") == 0x2189


def test_bits(spark):
    d = F.col("d")
    assert value(spark, bits.uint(d, 1, 3), d=b"\x00\xff\x01\x02") == 0x0201FF
    assert value(spark, bits.uint(d, 1, 3, big=True), d=b"\x00\xff\x01\x02") == 0xFF0102
    assert value(spark, bits.uint(d, 3, 2), d=b"\x00\xff\x01\x02") is None
    assert value(spark, bits.sign_extended(F.col("x"), 1), x=0xFE) == -2
    assert [value(spark, bits.power_of_two_from(F.col("x")), x=x) for x in (0, 1, 2, 3, 64, 65)] == [1, 1, 2, 4, 64, 128]
    assert value(spark, bits.trailing_zeros(F.col("x")), x=0) == 32
    for x in (0, 0x5A, 0xFF):
        y = value(spark, bits.four_and_four(F.col("x")), x=x)
        assert value(spark, bits.from_four_and_four(F.col("a"), F.col("b")), a=y >> 8, b=y & 255) == x
    assert value(spark, bits.free_chunks(d), d=b"\x0f\xff\x00") == 12
    assert value(spark, bits.all_zero(d), d=b"\x00\x00") is True


def test_dates(spark):
    x = F.col("x")
    assert value(spark, dates.from_prodos(x), x=0) is None
    assert value(spark, dates.from_prodos(x), x=(39 << 9) + (1 << 5) + 2) == dt.datetime(2039, 1, 2)
    assert value(spark, dates.from_prodos(x), x=(100 << 9) + (1 << 5) + 2) == dt.datetime(2000, 1, 2)
    assert value(spark, dates.from_prodos(x), x=(80 << 9) + (13 << 5) + 2) is None
    for packed, word in ((0, "none"), ((80 << 9) + (13 << 5) + 2, "invalid"), ((80 << 9) + (2 << 5) + 29, "valid")):
        assert value(spark, dates.status(x, dates.from_prodos(x)), x=packed) == word
    pascal = lambda y, m, d: (y << 9) + (d << 4) + m
    made = [value(spark, dates.from_pascal(x), x=p) for p in (pascal(99, 12, 31), pascal(39, 1, 2), pascal(101, 1, 2), pascal(80, 0, 2), pascal(80, 13, 2))]
    assert made == [dt.datetime(1999, 12, 31), dt.datetime(2039, 1, 2), None, None, None]
    assert [value(spark, dates.status(x, dates.from_pascal(x), dates.pascal_none(x)), x=p) for p in (pascal(101, 1, 2), pascal(80, 0, 2), pascal(80, 13, 2))] == ["none", "none", "invalid"]
    gs = lambda y: (y << 24) + (9 << 16) + (1 << 32)
    assert [value(spark, dates.from_gs(x), x=gs(y)).year for y in (22, 40, 122)] == [2022, 1940, 2022]
    assert value(spark, dates.from_unix(x), x=0) == dt.datetime(1970, 1, 1) and value(spark, dates.from_unix(x), x=-(1 << 31)) is None
    assert value(spark, dates.from_unix(x), x=-1) == dt.datetime(1969, 12, 31, 23, 59, 59)
    assert [value(spark, dates.to_unix(x.cast("timestamp_ntz")), x=t) for t in ("1969-12-31 23:59:59", "1970-01-02 00:00:01", "2040-01-01 00:00:00", None)] == [-1, 86401, -(1 << 31), -(1 << 31)]
    for zone in ("America/New_York", "Asia/Tokyo"):  # no zone has a part in it
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert value(spark, dates.from_hfs(x).cast("string"), x=3000000000) == "1999-01-24 05:20:00"
        assert value(spark, dates.to_hfs(x.cast("timestamp_ntz")), x="1999-01-24 05:20:00") == 3000000000
        assert value(spark, dates.to_unix(dates.from_unix(x)), x=1000000000) == 1000000000
        spark.conf.set("spark.sql.session.timeZone", before)
    assert value(spark, dates.from_hfs(x), x=2082844800 + 86400) == dt.datetime(1970, 1, 2)
    assert value(spark, dates.from_msdos(F.col("d"), F.col("t")), d=(40 << 9) + (2 << 5) + 29, t=(23 << 11) + (59 << 5) + 29) == dt.datetime(2020, 2, 29, 23, 59, 58)


def test_formats(spark):
    x, s = F.col("x"), F.col("s")
    percent = formats.comp_percent(F.col("a"), F.col("b"))
    assert [value(spark, percent, a=a, b=b) for a, b in ((-1, 5), (5, 0), (0, 5), (1, 1000), (25, 1000), (35, 1000), (99999, 9))] == ["??%", "0%", "0%", "<1%", "2%", "4%", "999%"]
    assert [value(spark, formats.csv_field(s), s=t) for t in ("a", "a,b", 'a"b', " a", "a ", "a\rb", "")] == ["a", '"a,b"', '"a""b"', '" a"', '"a "', '"a\rb"', ""]
    assert value(spark, formats.newlines(s), s="a\r\nb\rc\nd\r\r\n") == "a\nb\nc\nd\n\n"
    assert [value(spark, formats.parsed_int(s), s=t) for t in ("-12", "$ff", "0x10", "%101", "x", "")] == [-12, 255, 16, 5, None, None]
    assert [value(spark, formats.size_bytes(s), s=t) for t in ("800KB", "280blk", "35trk", "5", "x", "1parsec")] == [819200, 143360, 143360, 5, None, None]
    assert [value(spark, formats.size_bytes(s), s=t) for t in ("2T", "3 tb", "5 b", "1block", "2track", " 5", "5 ", "3000000000", "7blocks")] == [2 << 40, 3 << 40, None, None, None, None, 5, None, 3584]
    assert value(spark, formats.size_bytes(s, 0), s="1trk") is None and value(spark, formats.size_bytes(s, blocks=True), s="3") == 1536
    assert [value(spark, formats.size_text(x, u), x=n) for n, u in ((1000, 512), (512, 512), (143360, 256), (143360, 512), (819200, 1024), (10 << 20, 512), (33554432, 1024), (3 << 30, 512), (0, 512))] == ["1 block", "1 block", "560 sectors", "280 blocks", "800KB", "10.0MB", "32.0MB", "3.0GB", "0 blocks"]
    assert [value(spark, formats.access_letters(x), x=a) for a in (0xFF, 0xC3, 0x21, 0)] == ["dnb??iwr", "dnwr", "br", ""]
    best = best_format(F.col("d"), F.col("r"))
    assert [value(spark, best, d=d, r=r) for d, r in (("unknown", "plain"), ("plain", "lzw1"), ("lzw2", "lzw1"), ("plain", "unknown"), ("unknown", "unknown"))] == ["plain", "lzw1", "lzw2", "plain", "unknown"]
    assert value(spark, formats.date_text(F.lit(None).cast("timestamp_ntz"))) == "[No Date]"
    assert value(spark, formats.option_text(formats.option_map(s)), s="b=2,a=1") == "a=1,b=2"
    assert value(spark, formats.text_int_list(s), s="") == []
    assert value(spark, formats.hex_value(x, 4), x=10) == "$000a"


def test_escapes(spark):
    n = F.col("n")
    assert [value(spark, paths.escaped_name(n), n=t) for t in ("a%b", "a/b", "", "x\x01", "x␁")] == ["a%%b", "a%2fb", "A", "x%01", "x%01"]
    assert [value(spark, paths.unescaped_name(n), n=t) for t in ("a%%b", "a%2Fb", "a%00b", "100%", "%zz", "%%41")] == ["a%b", "a/b", "ab", "100%", "%zz", "%41"]
    assert value(spark, paths.unescaped_name(n, "/"), n="a%2fb") == "a%b"
    assert value(spark, paths.escaped_path(n, "/", ":"), n="a%/b?") == "a%%:b%3f" and value(spark, paths.unescaped_path(n, ":", "/"), n="a%%:b%2f") == "a%/b%"
    assert value(spark, paths.host_path(n), n="a:b/c?") == "a_b/c_"


def test_labels(spark):
    x, c = F.col("x"), F.col("c")
    assert [value(spark, labels.dos_type(x), x=t) for t in (4, 0xF3, 0xFA, 9)] == ["T", "AA", "I", "?"]
    assert [value(spark, labels.pascal_type(x), x=t) for t in (0, 0xF5, 8, 9)] == ["Untyped", "S.dir", "Foto", "?"]
    assert [value(spark, labels.fork_format(c), c=t) for t in ("plain", "lzw1", "new")] == ["Stored", "LZW/1", "?new"]
    assert value(spark, labels.media_kind(c), c="gcr525") == 'GCR 5.25"'
    types = spark.createDataFrame([(4, "TXT"), (0xF9, "OS "), (5, "TXT")], "type int, abbrev string")
    asked = spark.createDataFrame([("txt",), ("os",), ("t",), ("none",)], "a string")
    assert {r.a: r.type for r in labels.types_by_abbreviation(asked, types, "a").collect()} == {"txt": 4, "os": 0xF9, "t": -1, "none": -1}
    codes = spark.createDataFrame([(4,), (300,)], "t int")
    assert {r.t: r.abbrev for r in labels.type_abbreviations(codes, types, "t").collect()} == {4: "TXT", 300: ""}


def test_office_names(spark):
    shown = names.office_cased(F.col("n"), F.col("t"), F.col("a"))
    assert [value(spark, shown, n="MY.FILE", t=t, a=a) for t, a in ((0x1A, 0x0070), (0x19, 0), (4, 0x0070))] == ["M" + "y f" + "ILE", "MY.FILE", "MY.FILE"]


def test_charsets(spark):
    data = bytes(range(256))
    for codec in ("mac_roman", "cp437"):
        assert value(spark, charsets.decoded(F.col("d"), codec), d=data) == data.decode(codec)
        assert value(spark, charsets.encoded(charsets.decoded(F.col("d"), codec), codec), d=data) == data
    assert value(spark, charsets.encoded(F.col("s")), s="漢é") == b"?\x8e"
    assert value(spark, charsets.high_ascii(F.col("d")), d=b"\xc8\xe9") == "Hi"
    assert value(spark, charsets.length_prefixed(F.col("d")), d=b"\x02abc") == "ab"
    assert value(spark, charsets.four_characters(F.col("x")), x=0x54455854) == "TEXT"


@pytest.mark.parametrize("rule", list(names.RULES))
@pytest.mark.parametrize("name", ["A", "", "1abc", "a b:c,d", "x" * 40, "\x01", "é", "ok.name"])
def test_adjusted_names_are_valid(spark, rule, name):
    made = value(spark, names.adjusted(F.col("n"), rule), n=name)
    assert value(spark, names.valid(F.col("n"), rule), n=made), (rule, name, made)
    if value(spark, names.valid(F.col("n"), rule), n=name):
        assert made == name


def test_case_bits(spark):
    shown = "Hello wOrld 12"
    bits_ = value(spark, names.case_bits(F.col("n")), n=shown)
    assert value(spark, names.cased(F.col("n"), F.col("b")), n=shown.upper().replace(" ", "."), b=bits_) == shown
    assert value(spark, names.cased(F.col("n"), F.col("b")), n="A.B", b=0) == "A.B"


def test_python_batches_are_bounded_by_bytes(spark):
    import pandas as pd
    from pyspark.sql import functions as F
    from shelfmark.functions import charsets

    @F.pandas_udf("int")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))
    df = spark.range(300, numPartitions=1).select(F.repeat(F.lit("ä"), 50000).alias("t"))
    whole = df.select(rows("t").alias("n")).agg(F.max("n")).first()[0]
    df = df.select("t", charsets.encodable(F.col("t")).alias("e"))
    assert df.select(rows("t").alias("n")).agg(F.max("n")).first()[0] < whole == 300
    assert df.where("e").count() == 300
