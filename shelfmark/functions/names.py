"""Names that formats allow, and names that carry case in spare bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern of valid names, of their first character, of characters that are
# replaced, longest name).
RULES = {
    "prodos": (r"^[A-Za-z][A-Za-z0-9.]{0,14}$", r"^[A-Za-z]", r"[^A-Za-z0-9.]", 15),
    "pascal": (r"^[^ $=?,\[#:\x00-\x1f\x7f]{1,15}$", r"^.", r"[ $=?,\[#:\x00-\x1f\x7f]", 15),
    "hfs": (r"^[^:\x00]{1,31}$", r"^.", r"[:\x00]", 31),
    "dos": (r"^[A-Za-z\x40-\x5f][^,\x00-\x1f\x7f]{0,29}$", r"^[A-Za-z\x40-\x5f]", r"[,\x00-\x1f\x7f]", 30),
}


def valid(name: Column, rule: str) -> Column:
    return name.rlike(RULES[rule][0])


def adjusted(name: Column, rule: str, replacement: str = ".") -> Column:
    """A valid name near the given one: bad characters replaced, an `X` before a start that
    is not allowed, the middle left out of what is too long."""
    _, first, bad, most = RULES[rule]
    clean = F.regexp_replace(name, bad, replacement)
    start = F.when(clean.rlike(first), clean).otherwise(F.concat(F.lit("X"), clean))
    half = most // 2
    short = F.concat(F.substring(start, 1, half), F.lit(".."), F.right(start, F.lit(most - half - 2)))
    return F.when(F.length(start) > most, short).otherwise(start)


def cased(name: Column, bits: Column, width: int = 16) -> Column:
    """An upper-case name in mixed case: bit width-1 less the place of a character makes it
    lower case; a full stop under such a bit is shown as a space."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    shown = F.transform(chars, lambda c, i: F.when(F.call_function("shiftleft", bits.cast("int"), i).bitwiseAND(F.lit(1 << (width - 1))) != 0, F.when(c == ".", " ").otherwise(F.lower(c))).otherwise(c))
    return F.array_join(shown, "")


def case_bits(name: Column, width: int = 16) -> Column:
    """The bits that cased() takes to show a name as it is."""
    chars = F.slice(F.filter(F.split(name, ""), lambda c: c != ""), 1, width)
    return F.aggregate(F.transform(chars, lambda c, i: F.when(c.rlike("[a-z ]"), F.call_function("shiftright", F.lit(1 << (width - 1)), i)).otherwise(0)), F.lit(0), lambda s, x: s.bitwiseOR(x))


def swapped(bits: Column) -> Column:
    """A 16-bit number with its bytes swapped."""
    x = bits.cast("int")
    return F.shiftleft(x.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(x, 8).bitwiseAND(F.lit(0xFF)))


def office_cased(name: Column, file_type: Column, aux_type: Column) -> Column:
    """The name of a word processor, data base or spreadsheet file (types 19 to 1B hex) in
    the case that its auxiliary type tells, bytes swapped: a set bit makes a character lower
    case and a full stop a space, a clear one upper case and a space a full stop.  Other
    names stay."""
    raw = F.replace(F.upper(name), F.lit(" "), F.lit("."))
    return F.when(file_type.between(0x19, 0x1B), cased(raw, swapped(aux_type))).otherwise(name)
