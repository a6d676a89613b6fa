"""Four-letter types and creators, and their translation to and from numeric file types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (numeric type, auxiliary type, four letters) that stand for each other
# whatever the creator.
PLAIN = ((0x00, 0x0000, "BINA"), (0x04, 0x0000, "TEXT"), (0xD7, 0x0000, "MIDI"), (0xD8, 0x0000, "AIFF"), (0xD8, 0x0001, "AIFC"))
# Numeric types that have four letters under the creator `pdos` alone.
SYSTEM = ((0xFF, "PSYS"), (0xB3, "PS16"))
NUMERIC, IMAGER = "pdos", ("dCpy", "dImg", 0xE0, 0x0005)


def _letters(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "ISO-8859-1")


def _number(letters: Column) -> Column:
    return F.conv(F.hex(F.encode(letters, "ISO-8859-1")), 16, 10).cast("long")


def mac_type(file_type: Column, aux_type: Column) -> Column:
    """struct(type, creator) for a numeric type; those without a name of their own are `p`
    and the three bytes, under the creator `pdos`.  Null for a null."""
    creator, image, kind, aux = IMAGER
    out = F.when((file_type == kind) & (aux_type == aux), image)
    for t, a, name in PLAIN:
        out = out.when((file_type == t) & (aux_type == a), name)
    # A system program whose auxiliary type starts with DB hex keeps it.
    for t, name in SYSTEM:
        out = out.when((file_type == t) & ((F.lit(name) != "PS16") | (F.shiftright(aux_type.cast("int"), 8) != 0xDB)), name)
    packed = _letters(F.lit(ord("p") << 24) + file_type.cast("long") * 65536 + aux_type.cast("long"))
    by = F.when((file_type == kind) & (aux_type == aux), creator).when(file_type.isNotNull() & aux_type.isNotNull(), NUMERIC)
    return F.struct(out.otherwise(packed).alias("type"), by.alias("creator"))


def numeric_type(type_: Column, creator: Column) -> Column:
    """struct(file_type, aux_type, preferred) for four letters; zeros where they say
    nothing.  preferred: the creator is `pdos`, whose numbers count before the letters."""
    made, image, kind, aux = IMAGER
    pdos = creator == NUMERIC
    number = _number(type_)
    named = F.when(F.lit(False), F.lit(0))
    for t, a, name in PLAIN:
        named = named.when(type_ == name, t * 65536 + a)
    named = named.when((creator == made) & (type_ == image), kind * 65536 + aux)
    packed = number.bitwiseAND(F.lit(0xFFFFFF))
    digits = F.conv(F.substring(type_, 1, 2), 16, 10).cast("long") * 65536
    own = F.when(F.substring(type_, 1, 1) == "p", packed).when(F.substring(type_, 3, 2) == "  ", F.when(type_.rlike("^[0-9A-Fa-f]{2}"), digits).otherwise(0))
    for t, name in SYSTEM:
        own = own.when(type_ == name, t * 65536)
    both = F.coalesce(named.cast("long"), F.when(pdos, own), F.lit(0).cast("long"))
    return F.struct(F.shiftright(both, 16).cast("int").alias("file_type"), both.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("aux_type"), F.coalesce(pdos, F.lit(False)).alias("preferred"))
