"""Types, nesting, sets to add, numbering and blocks."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import bits, mac, paths
from shelfmark.operators import catalog as C
from shelfmark.operators import chunks as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind, aux, letters, creator",
    [(0, 0, "BINA", "pdos"), (4, 0, "TEXT", "pdos"), (4, 1, "p\x04\x00\x01", "pdos"), (0xFF, 0x2000, "PSYS", "pdos"), (0xB3, 0, "PS16", "pdos"), (0xB3, 0xDB01, "p\xb3\xdb\x01", "pdos"), (0xE0, 5, "dImg", "dCpy"), (0xD8, 1, "AIFC", "pdos")],
)
def test_mac_type(spark, kind, aux, letters, creator):
    assert tuple(one(spark, mac.mac_type(F.lit(kind), F.lit(aux)))) == (letters, creator)


@pytest.mark.parametrize(
    "letters, creator, want",
    [("TEXT", "ttxt", (4, 0, False)), ("TEXT", "pdos", (4, 0, True)), ("B3  ", "pdos", (0xB3, 0, True)), ("G3  ", "pdos", (0, 0, True)), ("pABC", "pdos", (0x41, 0x4243, True)), ("pABC", "ttxt", (0, 0, False)), ("dImg", "dCpy", (0xE0, 5, False)), ("PSYS", "pdos", (0xFF, 0, True)), (None, None, (0, 0, False))],
)
def test_numeric_type(spark, letters, creator, want):
    assert tuple(one(spark, mac.numeric_type(F.lit(letters).cast("string"), F.lit(creator).cast("string")))) == want


def test_ascii_reduced(spark):
    assert one(spark, paths.ascii_reduced(F.lit("Élan ƒ ß\t␉ 漢 😀"))) == "Elan f s\t␉ ? ??"
    assert one(spark, paths.ascii_reduced(F.lit("漢"), "$")) == "$"


def test_packed(spark):
    assert bytes(one(spark, bits.packed(F.lit(0x123456), 4))) == b"\x56\x34\x12\x00"
    assert bytes(one(spark, bits.packed(F.lit(-1).cast("long"), 2, big=True))) == b"\xff\xff"
    assert [one(spark, bits.power_of_two_above(F.lit(n))) for n in (0, 1, 7, 8)] == [1, 2, 8, 16]


def test_numbered(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), F.when(F.col("id") == 7, None).otherwise(F.col("id") * 37 % 5003).alias("v"), F.lit("kept").alias("place_"))
    got = C.numbered(rows, ["g"], [F.col("v")]).collect()
    for g in (True, False):
        mine = sorted((r for r in got if r["g"] is g), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["v"] for r in mine] == sorted((r["v"] for r in mine), key=lambda v: (v is not None, v or 0))
    assert C.numbered(rows.limit(0), ["g"], [F.col("v")]).count() == 0


def test_numbered_null_group(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert sorted((str(r["g"]), r["v"], r["place"]) for r in C.numbered(rows, ["g"], [F.col("v")]).collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 5, 1)]


def test_add_set(spark):
    files = spark.createDataFrame([(p,) for p in ("d/a", "d/._a", "d/%a", "d/b", "d/B.rsrc", "c.RSRC", "._", "e")], "path string")
    got = {tuple(r) for r in C.add_set(files).collect()}
    assert got == {("d/a", "d/a", "d/._a"), ("d/b", "d/b", None), ("d/B", None, "d/B.rsrc"), ("c", None, "c.RSRC"), ("._", "._", None), ("e", "e", None)}


def test_blocks(spark):
    target = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "chunk long, data string")
    source = spark.createDataFrame([(0, "s0"), (1, "s1")], "chunk long, data string")
    got = dict(map(tuple, K.replaced_partition(target, source, 2, 3).collect()))
    assert got == {0: "t0", 1: "t1", 2: "s0", 3: "s1", 4: "t4", 5: "t5"}
    with pytest.raises(ValueError):
        K.replaced_partition(target, source, 2, 1)
    far = spark.createDataFrame([(9, "x"), (1, "y")], "chunk long, data string")
    assert dict(map(tuple, K.written_blocks(target, far, 6).collect()))[1] == "y"
    assert K.written_blocks(target, far, 6).count() == 6
