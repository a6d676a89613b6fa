"""Path names: wildcards, components, display and escaping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, sep: str = "/", *, ignore_case: bool = True, prefix: bool = False) -> str:
    """A regular expression for a wildcard path: `*` is any run and `?` any character
    within a component; a backslash makes the next of these plain, and stands for itself
    elsewhere.  A trailing separator is dropped, from the pattern and from paths.  prefix:
    also match what lies below a matched path."""
    out, i = [], 0
    pattern = pattern[:-1] if len(pattern) > 1 and pattern.endswith(sep) else pattern
    inside = f"[^{re.escape(sep)}]"
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2] in ("*", "?"):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": inside + "*", "?": inside}.get(c) or re.escape(c))
        i += 1
    tail = f"({re.escape(sep)}.*)?" if prefix else f"{re.escape(sep)}?"
    return f"^(?s{'i' if ignore_case else ''}){''.join(out)}{tail}$"


def matches(path: Column, pattern: str, sep: str = "/", *, ignore_case: bool = True, prefix: bool = False) -> Column:
    return path.rlike(glob_regex(pattern, sep, ignore_case=ignore_case, prefix=prefix))


def matches_any(path: Column, patterns: list[str], sep: str = "/", *, ignore_case: bool = True, prefix: bool = False) -> Column:
    """Whether any pattern matches; with prefix, a match pulls in all below it."""
    return reduce(lambda a, b: a | b, (matches(path, p, sep, ignore_case=ignore_case, prefix=prefix) for p in patterns), F.lit(False))


def components(path: Column, sep: str = "/") -> Column:
    return F.split(path, re.escape(sep))


def file_name(path: Column, sep: str = "/") -> Column:
    return F.element_at(components(path, sep), -1)


def directory_name(path: Column, sep: str = "/") -> Column:
    """All but the last component; empty where there is one alone."""
    parts = components(path, sep)
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)


def ancestors(path: Column, sep: str = "/") -> Column:
    """Paths of all directories above, the outermost first."""
    parts = components(path, sep)
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), sep))).otherwise(F.array().cast("array<string>"))


_CONTROL = "".join(map(chr, [*range(32), 127]))
_PICTURE = "".join(chr(0x2400 + i) for i in range(32)) + "␡"


def printable(text: Column) -> Column:
    """Control characters shown as their pictures."""
    return F.translate(text, _CONTROL, _PICTURE)


def unprintable(text: Column) -> Column:
    return F.translate(text, _PICTURE, _CONTROL)


# Letters and the sign without their marks.
UNMARKED = (
    ("A", "ÀÁÂÃÄÅ"), ("a", "àáâãäå"), ("C", "Ç"), ("c", "ç"), ("E", "ÈÉÊË"), ("e", "èéêë"), ("f", "ƒ"), ("I", "ÌÍÎÏ"), ("i", "ìíîïı"), ("N", "Ñ"), ("n", "ñ"),
    ("O", "ÒÓÔÕÖØ"), ("o", "òóôõöø"), ("s", "ß"), ("U", "ÙÚÛÜ"), ("u", "ùúûü"), ("Y", "Ÿ"), ("y", "ÿ"), ("~", "˜"),
)


def ascii_reduced(text: Column, replacement: str = "?") -> Column:
    """Letters without their marks; what is not ASCII then is replaced, but for pictures of
    control characters, which stay.  A character past U+FFFF counts as two."""
    plain = F.translate(text, "".join(m for _, m in UNMARKED), "".join(c * len(m) for c, m in UNMARKED))
    other = F.regexp_replace(plain, r"[\x{10000}-\x{10FFFF}]", re.sub(r"([\\$])", r"\\\1", replacement * 2))
    return F.regexp_replace(other, r"[^\x00-\x7f\u2400-\u241f\u2421]", re.sub(r"([\\$])", r"\\\1", replacement))


def host_name(name: Column, replacement: str = "_") -> Column:
    """A name that any host takes: signs with a meaning and control characters replaced."""
    return F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', replacement)


def escaped_name(name: Column) -> Column:
    """A reversible host-legal name: `%` twice, characters with a meaning and control
    characters (or their pictures) as `%` and two hex digits; `A` for no name."""
    parts = F.filter(F.split(unprintable(name), ""), lambda c: c != "")
    bad = lambda c: c.rlike(r'^[\x00-\x1f\x7f<>:"/\\|?*]$')
    out = F.array_join(F.transform(parts, lambda c: F.when(c == "%", "%%").when(bad(c), F.concat(F.lit("%"), F.lower(F.lpad(F.hex(F.encode(c, "utf-8")), 2, "0")))).otherwise(c)), "")
    return F.when(name == "", "A").otherwise(out)


def unescaped_name(name: Column, new_sep: str | None = None) -> Column:
    """Inverse of escaped_name: `%%`, and `%` with two hex digits; `%00` is left out, an
    escaped new_sep becomes `%`, and any other `%` stays."""
    parts = F.regexp_extract_all(name, F.lit(r"(%%|%[0-9A-Fa-f]{2}|(?s:.))"), F.lit(1))
    code = lambda c: F.conv(F.substring(c, 2, 2), 16, 10).cast("int")
    char = lambda c: F.decode(F.unhex(F.concat(F.substring(c, 2, 2))), "ISO-8859-1")
    return F.array_join(F.transform(parts, lambda c: F.when(c == "%%", "%").when(F.length(c) != 3, c).when(code(c) == 0, "").when(char(c) == F.lit(new_sep), "%").otherwise(char(c))), "")


def escaped_path(path: Column, sep: str = "/", new_sep: str = "/") -> Column:
    """escaped_name of each component."""
    return F.array_join(F.transform(components(path, sep), escaped_name), new_sep)


def unescaped_path(path: Column, sep: str = "/", new_sep: str = "/") -> Column:
    """unescaped_name of each component; none of them holds new_sep then."""
    return F.array_join(F.transform(components(path, sep), lambda c: unescaped_name(c, new_sep)), new_sep)


def host_path(path: Column, sep: str = "/", replacement: str = "_", new_sep: str = "/") -> Column:
    """host_name of each component."""
    return F.array_join(F.transform(components(path, sep), lambda c: host_name(c, replacement)), new_sep)


def sidecar_path(path: Column) -> Column:
    """Where the header file of an archive entry is kept."""
    folder = directory_name(path)
    return F.concat(F.lit("__MACOSX/"), F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("._"), file_name(path))


def without_gz(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.gz$", "")


def attribute_suffix(file_type: Column, aux_type: Column) -> Column:
    """`#`, the type in two hex digits and the auxiliary type in four."""
    return F.format_string("#%02x%04x", file_type, aux_type)


def sort_key(path: Column, sep: str = "/") -> Column:
    """Compares path names component by component, whatever the case."""
    return F.transform(components(path, sep), F.lower)
