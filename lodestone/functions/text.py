"""Text, path and number functions as Column expressions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what JavaScript's trim() and \s take as white space, for Java's regular expressions.
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Fixed value: the characters of JS_SPACE but the space.
JS_SPACES = "\t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Languages whose comment lines begin with # and with --.
HASH_LANGUAGES = ("python", "ruby")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def collapse(x: Column | str) -> Column:
    """Trimmed, each run of white space as one space.

    Most texts have single spaces only. A search for each other character tells them many times faster than the regular
    expression. ``x`` is read again for each search: give a column, not a costly expression.
    """
    x = _col(x)
    odd = reduce(operator.or_, (F.contains(x, F.lit(c)) for c in ["  ", *JS_SPACES]))
    return F.trim(F.when(odd, F.regexp_replace(x, f"{JS_SPACE}+", " ")).otherwise(x))


def lines(x: Column | str) -> Column:
    return F.split(_col(x), "\n", -1)


def line_count(x: Column | str) -> Column:
    """Number of lines; a newline at the end begins another, and an empty text has none."""
    x = F.coalesce(_col(x), F.lit(""))
    return F.when(x == "", 0).otherwise(newlines(x) + 1)


def code_line_count(x: Column | str, language: Column | str) -> Column:
    """Lines that are neither blank nor a comment by their first characters, counted over the whole text."""
    x, language = F.coalesce(_col(x), F.lit("")), _col(language)
    space = JS_SPACE.replace("[", "", 1)[:-1]

    def counted(comment: str) -> Column:
        # the first character of a line that is no space, if no comment begins there
        return F.regexp_count(x, F.lit(rf"(?<![^\n])[{space}&&[^\n]]*+(?!{comment})[^{space}]"))

    return F.when(language.isin(*HASH_LANGUAGES), counted("#")).when(language == "sql", counted("--")).otherwise(counted(r"//|\*|/\*"))


def round1(x: Column) -> Column:
    """To one decimal, half towards plus infinity."""
    return F.floor(x * 10 + 0.5) / 10


def round0(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def dirname(path: Column | str) -> Column:
    path = _col(path)
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """With its full stop and in lower case; empty without one, or if the name begins with its only one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def top_folder(path: Column | str) -> Column:
    path = _col(path)
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")


def normalize_path(path: Column | str) -> Column:
    """Without empty and '.' segments, and with '..' taking the segment before it away where there is one."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: (p != "") & (p != "."))

    def fold(done: Column, part: Column) -> Column:
        drop = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(drop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def safe_relative_path(path: Column | str, skipped: tuple[str, ...]) -> Column:
    """A path without back-slashes, dots and empty segments; null if nothing is left or a segment is to be skipped."""
    parts = F.filter(F.split(F.translate(_col(path), "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    bad = F.arrays_overlap(parts, F.array(*map(F.lit, skipped)))
    return F.when((F.size(parts) > 0) & ~bad, F.array_join(parts, "/"))


def package_root(source: Column | str) -> Column:
    source = _col(source)
    return F.when(source.startswith("@"), F.substring_index(source, "/", 2)).otherwise(F.substring_index(source, "/", 1))


def masked(text: Column | str, pattern: str) -> Column:
    """A text in which all that the pattern matches is blank, with newlines kept in place.

    ``pattern`` is a regular expression without groups that begins with a character no empty match can have.
    """
    tokens = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"(?s)(?:{pattern})|.[^\"'`/#\\-]*+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit(f"(?s)\\A(?:{pattern})\\z")), F.regexp_replace(t, "[^\n]", " ")).otherwise(t)), "")


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n")))


def shortened(x: Column, most: int) -> Column:
    """A label of over ``most`` characters ends in an ellipsis two characters earlier."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 2)), F.lit("…"))).otherwise(x)


def severity(value: Column, bad: float, warn: float) -> Column:
    return F.when(value > bad, "bad").when(value > warn, "warn").otherwise("good")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clean_identifier(x: Column) -> Column:
    """The first of several names, without quotes and brackets."""
    return F.regexp_replace(js_trim(F.substring_index(x, ",", 1)), r"[`\"\[\]]", "")
