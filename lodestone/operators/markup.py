"""Issues of HTML pages and style sheets.

A page or sheet is cut into pieces that follow each other without a gap, so the line of a piece is one more than the
newlines of the pieces before it, and facts about it need windows over the pieces of one file, which is at most 1 MiB.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, js_trim, masked, newlines
from lodestone.sources.tables import spread

# Fixed values.
DEPRECATED = ("font", "center", "marquee", "blink", "big", "strike", "tt", "frame", "frameset", "acronym", "applet", "basefont", "dir", "isindex")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
MAX_DUPLICATE_IDS, MAX_DEPRECATED, MAX_STYLE_ISSUES, MAX_LINES = 20, 30, 120, 20
_TAG = r"(?i)<(/)?([a-z][a-z0-9-]*)((?:\s[^<>]*)?)/?>"
_RAW = r"<(script|style)((?:\s[^<>]*)?)(?<!/)>(.*?)(?:</\1\s*>|\z)"
_ALT, _HANDLER, _STYLE, _LANG, _SRC = r"(?i)\balt\s*=", r"(?i)\son\w+\s*=", r"(?i)\bstyle\s*=", r"(?i)\blang\s*=", r"(?i)\bsrc\s*="
_VIEWPORT, _ID = r"(?i)name\s*=\s*[\"']viewport[\"']", r"(?i)\bid\s*=\s*[\"']([^\"']+)[\"']"


def _pieces() -> Column:
    return F.regexp_extract_all("content", F.lit(rf"(?is)<!--.*?-->|{_RAW}|</?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?>|.[^<]*+"), F.lit(0))


def pieces(pages: DataFrame) -> DataFrame:
    """(file, pos, line, t, raw) of (file, content): comments, scripts and styles as a whole (raw), tags, and text between.

    A script or style without an end tag takes the rest of the page, one that closes itself is a tag. A file without
    content has one row without a piece.
    """
    return _lined(spread(pages).select("file", F.posexplode_outer(_pieces()).alias("pos", "t")))


def _lined(found: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.sum(newlines(F.col("t"))).over(before), F.lit(0)) + 1
    return found.withColumns({"line": line, "raw": F.regexp_like("t", F.lit(rf"(?is)\A{_RAW}\z"))})


def tags(pages: DataFrame) -> DataFrame:
    """(file, pos, line, closing, tag, attrs, closed) of every tag outside comments, scripts and styles; closed: by itself.

    A file without tags has one row without a tag.
    """
    return _tags(pieces(pages))


def _tags(found: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("t", _TAG, k)
    own = F.regexp_like("t", F.lit(_TAG.replace("(?i)", r"(?i)\A") + r"\z")) & ~F.col("raw")
    x = found.where(own | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
    of = lambda c: F.when(own, c)
    return x.select("file", "pos", "line", of(part(1) == "/").alias("closing"), of(F.lower(part(2))).alias("tag"), of(part(3)).alias("attrs"), of(F.col("t").endswith("/>")).alias("closed"))


def _listed_tags(pages: DataFrame) -> DataFrame:
    """(file, pieces, tags): a row for each page with the array of its tags, which are structs of pos, tag, attrs, closing and
    closed as in ``tags``; ``_line`` gives the line of one."""
    name = lambda t: F.when(t.startswith("<"), F.regexp_extract(t, _TAG.replace("(?i)", r"(?i)\A") + r"\z", 2)).otherwise("")
    raw = lambda x: F.lower(x["name"]).isin("script", "style") & F.regexp_like(x["t"], F.lit(rf"(?is)\A{_RAW}\z"))
    cut = spread(pages).select("file", F.coalesce(_pieces(), F.array().cast("array<string>")).alias("pieces"))
    named = F.filter(F.transform("pieces", lambda t, k: F.struct(k.alias("pos"), t.alias("t"), name(t).alias("name"))), lambda x: (x["name"] != "") & ~raw(x))
    # what stands between the name and the last character, with the slash
    attrs = lambda x: F.substring(x["t"], F.length(x["name"]) + F.when(x["t"].startswith("</"), 3).otherwise(2), F.length(x["t"]) - F.length(x["name"]) - F.when(x["t"].startswith("</"), 3).otherwise(2))
    tag = lambda x: F.struct(x["pos"].alias("pos"), F.lower(x["name"]).alias("tag"), attrs(x).alias("attrs"), x["t"].startswith("</").alias("closing"), x["t"].endswith("/>").alias("closed"))
    return cut.select("file", "pieces", F.transform(named, tag).alias("tags"))


def _has(x: Column, pattern: str) -> Column:
    return (F.length(x["attrs"]) > 1) & x["attrs"].rlike(pattern)


def _line(tag: Column) -> Column:
    """One more than the newlines of the pieces before; for the few tags of a page whose line is wanted."""
    return (1 + newlines(F.array_join(F.slice("pieces", F.lit(1), tag["pos"]), ""))).cast("int")


def _is_no_alt(x: Column) -> Column:
    return ~x["closing"] & (x["tag"] == "img") & ~_has(x, _ALT)


def _is_handler(x: Column) -> Column:
    return ~x["closing"] & _has(x, _HANDLER)


def _is_deprecated(x: Column) -> Column:
    return ~x["closing"] & x["tag"].isin(*DEPRECATED)


def page_checks(pages: DataFrame) -> DataFrame:
    """A row for each page with what it misses or holds too much of; document checks only where there is an <html> tag.

    max_depth is that of open elements (see ``deepest``), the lists hold the lines of the first tags of their kind. A page's
    tags are an array of its own row, so nothing is sorted or grouped.
    """
    lines = lambda found: F.transform(F.slice(found, 1, MAX_LINES), _line)
    step = lambda x: F.when(x["closing"], F.concat(F.lit("/"), x["tag"])).when(~x["tag"].isin(*VOID) & ~x["closed"], x["tag"])
    is_html = lambda x: ~x["closing"] & (x["tag"] == "html")
    x = _listed_tags(pages).withColumn("given", F.filter("tags", lambda x: F.length(x["attrs"]) > 1))
    x = x.withColumns({"no_alt": F.filter("tags", _is_no_alt), "handlers": F.filter("given", _is_handler), "has_html": F.exists("tags", is_html)})
    has = {"lang": lambda x: is_html(x) & _has(x, _LANG), "viewport": lambda x: (x["tag"] == "meta") & _has(x, _VIEWPORT), "title": lambda x: ~x["closing"] & (x["tag"] == "title")}
    return x.select(
        "file",
        F.size("tags").cast("long").alias("tag_count"),
        F.size("no_alt").cast("long").alias("missing_alt"),
        F.size("handlers").cast("long").alias("inline_handlers"),
        F.size(F.filter("given", lambda x: ~x["closing"] & _has(x, _STYLE))).cast("long").alias("inline_styles"),
        F.least(F.size(F.filter("tags", _is_deprecated)).cast("long"), F.lit(MAX_DEPRECATED)).alias("deprecated_tags"),
        lines("no_alt").alias("missing_alt_lines"),
        lines("handlers").alias("inline_handler_lines"),
        *((F.col("has_html") & ~F.exists("tags" if k == "title" else "given", found)).alias(f"missing_{k}") for k, found in has.items()),
        deepest(F.array_compact(F.transform("tags", step))).alias("max_depth"),
    )


def deepest(steps: Column | str) -> Column:
    """How many elements are open at most, by a page's tags in order, those that close with a slash in front.

    A closing tag takes away the last open element of its name and all that are inside it; one without such an element
    nothing.
    """

    @F.pandas_udf("int")
    def walk(pages: pd.Series) -> pd.Series:
        out = []
        for names in pages.str.split():
            opened: list[str] = []
            places: dict[str, list[int]] = {}
            most = 0
            for name in names:
                if name[0] != "/":
                    places.setdefault(name, []).append(len(opened))
                    opened.append(name)
                    most = max(most, len(opened))
                elif places.get(name[1:]):
                    at = places[name[1:]][-1]
                    for inner in opened[at:]:
                        places[inner].pop()
                    del opened[at:]
            out.append(most)
        return pd.Series(out, dtype="int32")

    # one string, which costs Arrow and pandas less than an array; names hold no spaces
    return walk(F.array_join(steps, " "))


def depth(pages: DataFrame) -> DataFrame:
    """(file, max_depth)."""
    return page_checks(pages).select("file", "max_depth")


def _repeated_ids(pages: DataFrame) -> DataFrame:
    """Only pages in which tags name an id twice become rows of their pieces."""
    opened = F.filter("tags", lambda x: ~x["closing"])
    named = F.filter(F.transform(opened, lambda x: F.regexp_extract(x["attrs"], _ID, 1)), lambda x: x != "")
    some = _listed_tags(pages).withColumn("ids", named)
    # no filter, which would run before the pages are dealt
    some = some.select("file", F.posexplode(F.when(F.size("ids") > F.size(F.array_distinct("ids")), F.col("pieces"))).alias("pos", "t"))
    ids = _tags(_lined(some)).where(~F.col("closing")).select("file", "pos", "line", F.nullif(F.regexp_extract("attrs", _ID, 1), F.lit("")).alias("id")).where("id is not null")
    same = Window.partitionBy("file", "id").orderBy("pos")
    again = ids.withColumns({"nth": F.row_number().over(same), "lines": F.array(F.first("line").over(same), "line").cast("array<int>")}).where("nth > 1")
    return again.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("place") <= MAX_DUPLICATE_IDS)


def duplicate_ids(pages: DataFrame) -> DataFrame:
    """(file, id, nth, lines) of each repetition of an id, at most 20 a file; lines are those of the first one and of this."""
    return _repeated_ids(pages).select("file", "id", "nth", "lines")


def deprecated_tags(pages: DataFrame, most: int = MAX_DEPRECATED) -> DataFrame:
    """(file, nth, tag, line) of deprecated tags in the order of the page, at most 30 a file."""
    first = F.slice(F.filter("tags", _is_deprecated), 1, most)
    found = _listed_tags(pages).select("file", F.posexplode(F.transform(first, lambda x: F.struct(x["tag"].alias("tag"), _line(x).alias("line")))).alias("nth", "x"))
    return found.select("file", (F.col("nth") + 1).alias("nth"), "x.tag", "x.line")


def page_issues(pages: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(file, ord, type, line, what, lines): missing alts, duplicate ids, deprecated tags, handlers and what the document
    misses, in this order and as many of each as the page's own lists hold."""
    none, no_lines = F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    row = lambda kind, nth, name, line, what=none, lines=no_lines: F.struct(F.struct(F.lit(kind).alias("kind"), nth.cast("int").alias("nth")).alias("ord"), name.alias("type"), line.cast("int").alias("line"), what.alias("what"), lines.cast("array<int>").alias("lines"))
    listed = lambda column, kind, name: F.transform(column, lambda line, nth: row(kind, nth, F.lit(name), line))
    missing = F.array_compact(F.array(*(F.when(F.col(f"missing_{k}"), f"missing-{k}") for k in ("lang", "viewport", "title"))))
    document = F.transform(missing, lambda name, nth: row(4, nth, name, F.lit(1)))
    c = page_checks(pages) if checks is None else checks
    of_checks = c.select("file", F.explode(F.concat(listed("missing_alt_lines", 0, "missing-alt"), listed("inline_handler_lines", 3, "inline-handler"), document)).alias("i")).select("file", "i.*")
    of_ids = _repeated_ids(pages).select("file", row(1, F.col("place"), F.lit("duplicate-id"), F.lit(None), F.col("id"), F.col("lines")).alias("i")).select("file", "i.*")
    of_tags = deprecated_tags(pages).select("file", row(2, F.col("nth"), F.lit("deprecated-tag"), F.col("line"), F.col("tag")).alias("i")).select("file", "i.*")
    return of_checks.unionByName(of_ids).unionByName(of_tags)


def inline_code(pages: DataFrame) -> DataFrame:
    """(file, ord, line, language, content) of scripts without a source, and of styles; line is where the tag begins."""
    part = lambda k: F.regexp_extract("t", rf"(?is)\A{_RAW}\z", k)
    found = pieces(pages).where("raw")
    x = found.select("file", F.col("pos").alias("ord"), "line", F.when(F.lower(part(1)) == "style", "css").otherwise("javascript").alias("language"), part(2).alias("attrs"), part(3).alias("content"))
    return x.where((F.col("language") == "css") | ~F.col("attrs").rlike(_SRC)).drop("attrs")


# --- style sheets ------------------------------------------------------------------------------------------------------

# Fixed values.
_IDS, _CLASSES, _TYPES = r"#[A-Za-z_-][\w-]*", r"\.[A-Za-z_-][\w-]*|\[[^\]]+\]|:[a-zA-Z-]+(?:\([^)]*\))?", r"(?:^|[\s>+~])[a-zA-Z][a-zA-Z0-9]*"
_UNIVERSAL, _CHAIN, _IMPORTANT, _VENDOR = r"(\s|>)\*|^\*\s", r"\s*[>+~]\s*|\s+", r"(?i)!\s*important", r"^-(webkit|moz|ms|o)-"
SPECIFIC, LONG_CHAIN, HIGH_Z = 100, 4, 1000


def blocks(sheets: DataFrame) -> DataFrame:
    """(file, pos, line, end, text, level, block) of the pieces of (file, content), each up to its {, } or ; (its end).

    ``level`` is how many blocks are open around the piece, with the one that it opens. ``block`` is the innermost of them:
    pos, line, selector and whether it is a rule, as at-rules are none. A closing brace too many closes nothing.
    ``line`` is that of the character behind the piece before.
    """
    clean = masked("content", r"/\*.*?\*/")
    x = spread(sheets).select("file", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?s)[^{};]*[{};]"), F.lit(0))).alias("pos", "t"))
    w = Window.partitionBy("file").orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    end = F.right("t", F.lit(1))
    x = x.withColumns({"end": end, "text": js_trim(F.expr("left(t, char_length(t) - 1)")), "line": F.coalesce(F.sum(newlines(F.col("t"))).over(past), F.lit(0)).cast("int") + 1, "sum": F.sum(F.when(end == "{", 1).when(end == "}", -1).otherwise(0)).over(w)})
    # what is open: the sum, less what braces too many have taken from it
    open_after = F.col("sum") - F.least(F.lit(0), F.min("sum").over(w))
    x = x.withColumn("after", open_after)
    x = x.withColumn("level", F.when(F.col("end") == "{", F.col("after")).otherwise(F.coalesce(F.lag("after").over(w), F.lit(0))))
    own = F.when(F.col("end") == "{", F.struct("pos", "line", F.col("text").alias("selector"), ((F.col("text") != "") & ~F.col("text").startswith("@")).alias("rule")))
    block = F.last(own, ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("pos"))
    return x.withColumn("block", F.when(F.col("level") > 0, block)).select("file", "pos", "line", "end", "text", "level", "block")


def specificity(selector: Column) -> Column:
    return 100 * F.regexp_count(selector, F.lit(_IDS)) + 10 * F.regexp_count(selector, F.lit(_CLASSES)) + F.regexp_count(selector, F.lit(_TYPES))


def _declarations(parts: DataFrame) -> DataFrame:
    """Pieces that may be a declaration, with property, value and whether they count as one of a rule."""
    colon = F.instr("text", ":")
    x = parts.where("end != '{'").withColumn("counts", (colon > 1) & F.coalesce(F.col("block.rule"), F.lit(False)))
    return x.withColumns({"property": F.when(F.col("counts"), F.lower(js_trim(F.substring_index("text", ":", 1)))), "value": F.when(F.col("counts"), js_trim(F.expr("substring(text, instr(text, ':') + 1)")))})


def style_issues(sheets: DataFrame) -> DataFrame:
    """(file, ord, type, what, line, first_line, number) in the order of the sheet.

    Types: duplicate-selector (first_line is where it stood first), high-specificity (number), universal-selector,
    long-selector (number of parts), important, duplicate-property, z-index (number) and empty-rule.
    """
    parts = blocks(sheets)
    none = F.lit(None).cast("int")

    def issue(rank: int, when: Column, kind: str, what: Column, line: Column, first: Column = none, number: Column = none) -> Column:
        fields = {"rank": F.lit(rank), "type": F.lit(kind), "what": what, "line": line.cast("int"), "first_line": first.cast("int"), "number": number.cast("int")}
        return F.when(when, F.struct(*(c.alias(k) for k, c in fields.items())))

    names = F.filter(F.transform(F.split("block.selector", ","), collapse), lambda p: p != "")
    s = parts.where("end = '{' and block.rule").select("file", "pos", "line", F.posexplode(names).alias("k", "what"))
    same = Window.partitionBy("file", "what").orderBy("pos", "k")
    s = s.withColumns({"first": F.first("line").over(same), "nth": F.row_number().over(same), "weight": specificity(F.col("what")), "chain": F.size(F.filter(F.split("what", _CHAIN), lambda p: p != ""))})
    w, line = F.col("what"), F.col("line")
    of_selectors = s.select("file", "pos", "k", F.explode(F.array_compact(F.array(
        issue(0, F.col("nth") > 1, "duplicate-selector", w, line, F.col("first")), issue(1, F.col("weight") >= SPECIFIC, "high-specificity", w, line, number=F.col("weight")),
        issue(2, w.rlike(_UNIVERSAL), "universal-selector", w, line), issue(3, F.col("chain") > LONG_CHAIN, "long-selector", w, line, number=F.col("chain")),
    ))).alias("i"))
    d = _declarations(parts)
    in_block = Window.partitionBy("file", "block.pos")
    d = d.withColumns({"twice": F.row_number().over(Window.partitionBy("file", "block.pos", "property").orderBy("pos")) > 1, "declared": F.count_if("counts").over(in_block)})
    z = F.regexp_extract("value", r"^([+-]?\d+)", 1).try_cast("long")
    empty = (F.col("end") == "}") & F.coalesce(F.col("block.rule"), F.lit(False)) & (F.col("declared") == 0)
    of_declarations = d.select("file", "pos", F.lit(0).alias("k"), F.explode(F.array_compact(F.array(
        issue(0, F.col("text").rlike(_IMPORTANT), "important", F.col("text"), line), issue(1, F.col("counts") & (F.col("property") != "") & F.col("twice"), "duplicate-property", F.col("property"), line),
        issue(2, F.col("counts") & (F.col("property") == "z-index") & (F.abs(z) >= HIGH_Z), "z-index", F.col("value"), line, number=z), issue(3, empty, "empty-rule", F.col("block.selector"), F.col("block.line")),
    ))).alias("i"))
    return of_selectors.unionByName(of_declarations).select("file", F.struct("pos", "k", "i.rank").alias("ord"), "i.type", "i.what", "i.line", "i.first_line", "i.number")


def style_facts(sheets: DataFrame) -> DataFrame:
    """(file, rule_count, max_nesting, vendor_prefixes); files without a piece are left out."""
    parts = blocks(sheets)
    vendor = F.when(F.col("end") != "{", (F.instr("text", ":") > 1) & F.coalesce(F.col("block.rule"), F.lit(False)) & F.lower("text").rlike(_VENDOR))
    return parts.groupBy("file").agg(F.count_if((F.col("end") == "{") & F.col("block.rule")).alias("rule_count"), F.coalesce(F.max(F.when(F.col("end") == "{", F.col("level"))), F.lit(0)).cast("int").alias("max_nesting"), F.count_if(vendor).alias("vendor_prefixes"))


def vendor_prefixes(sheets: DataFrame) -> DataFrame:
    """(file, vendor_prefixes): declarations of properties that belong to one browser; files without any are left out."""
    return style_facts(sheets).select("file", "vendor_prefixes").where("vendor_prefixes > 0")


def issue_counts(issues: DataFrame, *keys: str) -> DataFrame:
    return issues.groupBy(*keys, "type").agg(F.count("*").alias("issues"))


def listed(issues: DataFrame, most: int = MAX_STYLE_ISSUES) -> DataFrame:
    """The issues with ``capped``: whether one is among the first of its file, in its order."""
    return issues.withColumn("capped", F.row_number().over(Window.partitionBy("file").orderBy("ord")) <= most)
