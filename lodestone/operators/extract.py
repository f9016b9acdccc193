"""Functions, imports and embedded templates of source files, as relational work over their tokens and lines.

Brace languages and Ruby: strings and comments are blanked, one regular expression cuts the rest into the tokens that
matter, and windows over a file's tokens give depths and partners of braces. Functions are nested or apart, so the one
around a token is the last that was opened at the token's own depth of functions: another window, and no join. Python: a
stack of indents, kept by one small function over the array of a file's indents, tells where each head's body ends and
which head is around each line. A file is at most 1 MiB, so its tokens and lines are bounded; files are spread by hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import js_trim, lines, masked, newlines
from lodestone.operators import javascript
from lodestone.sources.tables import spread

# Words that look like calls but are control flow, those of them that count, and the languages' patterns.
CONTROL = ("if", "else", "for", "while", "switch", "case", "catch", "return", "do", "new", "sizeof", "typeof", "delete", "throw", "using", "lock", "foreach", "fixed", "when", "guard", "select", "defer", "assert", "synchronized")
COUNTED = ("if", "for", "while", "case", "catch", "foreach", "when", "guard")
_ARGS = r"\s*\(([^;{}()]*)\)\s*"
_LIST = r"\s*\(((?:[^()]|\([^()]*\))*)\)"
_LINE = r"(^|\n)[ \t]*#[^\n]*"
#: Languages in which a line that begins with # is blank.
HASH_LINES = ("rust", "c", "cpp")
#: language: (header ends with its brace, function header, class header, decisions, strings and comments)
_STRINGS = {'"': r'"(?:[^"\\\n]|\\.)*+"', "'": r"'(?:[^'\\\n]|\\.)*+'", "`": r"`[^`]*+`", "//": r"//[^\n]*+", "/*": r"/\*.*?\*/", "#": r"#(?!\[)[^\n]*+", "=": r"#[^\n]*+"}
LANGUAGES = {
    "go": (False, r"\bfunc\b(?:\s*\([^()]*\))?\s*([A-Za-z_]\w*)?" + _LIST, None, ("if", "for", "case", "select", "&&", "||"), ('"', "'", "`", "//", "/*")),
    "rust": (False, r"\bfn\s+([A-Za-z_]\w*)(?:\s*<[^()]*>)?" + _LIST, r"\b(?:impl|trait)\s+([A-Za-z_][\w:]*)", ("if", "while", "for", "loop", "match", "&&", "||"), ('"', "//", "/*")),
    "kotlin": (False, r"\bfun\s+(?:<[^<>]*>\s*)?(?:[\w.]+\.)?([A-Za-z_]\w*)" + _LIST, r"\b(?:class|interface|object)\s+([A-Za-z_]\w*)", ("if", "for", "while", "when", "catch", "&&", "||"), ('"', "'", "//", "/*")),
    "swift": (False, r"\bfunc\s+([A-Za-z_]\w*)(?:\s*<[^()]*>)?" + _LIST, r"\b(?:class|struct|enum|protocol|extension)\s+([A-Za-z_][\w.]*)", ("if", "for", "while", "guard", "case", "catch", "&&", "||"), ('"', "//", "/*")),
    "java": (True, r"([A-Za-z_$]\w*)" + _ARGS + r"(?:throws\s+[\w.,\s]*?)?\{", r"\b(?:class|interface|enum|record)\s+([A-Za-z_$]\w*)", ("if", "for", "while", "case", "catch", "&&", "||"), ('"', "'", "//", "/*")),
    "csharp": (True, r"([A-Za-z_]\w*)" + _ARGS + r"(?:where\s+[^{;]+)?\{", r"\b(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)", ("if", "for", "foreach", "while", "case", "catch", "&&", "||", "??"), ('"', "'", "//", "/*")),
    "c": (True, r"([A-Za-z_]\w*)" + _ARGS + r"\{", None, ("if", "for", "while", "case", "&&", "||"), ('"', "'", "//", "/*")),
    "cpp": (True, r"([A-Za-z_][\w:~]*)" + _ARGS + r"(?:const\b|noexcept\b|override\b|final\b|\s)*\{", r"\b(?:class|struct)\s+([A-Za-z_]\w*)", ("if", "for", "while", "case", "catch", "&&", "||"), ('"', "'", "//", "/*")),
    "php": (False, r"\bfunction\s*&?\s*([A-Za-z_]\w*)?" + _LIST, r"\b(?:class|trait|interface)\s+([A-Za-z_]\w*)", ("if", "elseif", "for", "foreach", "while", "case", "catch", "&&", "||"), ('"', "'", "//", "/*", "#")),
}
#: Read by ``javascript`` from their tokens, not by a header's pattern.
SCRIPTS = ("javascript", "typescript")
_DEF = r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"
_CLASS = r"^class\s+([A-Za-z_]\w*)"
_PY_WORDS = r"(?<![A-Za-z0-9_])(?:if|elif|for|while|except|and|or)(?![A-Za-z0-9_])"


def _decisions(words: tuple[str, ...]) -> str:
    signs = "|".join(w.replace("|", r"\|").replace("?", r"\?") for w in words if not w.isalpha())
    return rf"\b(?:{'|'.join(w for w in words if w.isalpha())})\b|{signs}"


def _parameters(inside: Column) -> Column:
    """Parts between commas, brackets of any kind within them left out."""
    flat = inside
    for _ in range(3):
        flat = F.regexp_replace(flat, r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "")
    return F.when(js_trim(flat) == "", 0).otherwise(F.size(F.filter(F.split(flat, ","), lambda p: js_trim(p) != "")))


def _python_parameters(inside: Column) -> Column:
    """Parts between commas outside brackets, up to the header's first closing parenthesis: one left open hides the rest."""
    flat = inside
    for _ in range(3):
        flat = F.regexp_replace(flat, r"\[[^\[\]{}]*\]|\{[^\[\]{}]*\}", "")
    return F.when(js_trim(inside) == "", 0).otherwise(1 + F.regexp_count(F.regexp_replace(flat, r"(?s)[(\[{\]}].*$", ""), F.lit(",")))


def brace_functions(files: DataFrame, language: str) -> DataFrame:
    """Functions of files (file, content) in one of ``LANGUAGES`` or ``SCRIPTS``: file, name, line, end_line, lines, params, complexity, nesting.

    Decisions and braces belong to the innermost function around them. A function that is not closed is left out.
    """
    if language in SCRIPTS:
        return javascript.functions(files, language)
    inline, header, cls, words, hidden = LANGUAGES[language]
    cx = _decisions(words)
    whole = "|".join(f"({x})" for x in (r"\n", r"\{", r"\}", ";", cls or "(?!)", header, cx))
    source = only_php("content") if language == "php" else F.col("content")
    clean = spread(files).select("file", masked(source, "|".join(_STRINGS[h] for h in hidden)).alias("s"))
    if language in HASH_LINES:
        clean = clean.withColumn("s", F.regexp_replace("s", _LINE, "$1 "))
    tokens = clean.select("file", "s", F.posexplode(F.regexp_extract_all("s", F.lit(f"(?s){whole}"), F.lit(0))).alias("pos", "t")).drop("s")
    name, is_header = F.regexp_extract("t", f"(?s)^(?:{header})$", 1), F.regexp_like("t", F.lit(f"(?s)\\A(?:{header})\\z"))
    kind = F.when(F.col("t") == "\n", "newline").when(F.col("t") == "{", "open").when(F.col("t") == "}", "close").when(F.col("t") == ";", "semi")
    if cls:
        kind = kind.when(F.regexp_like("t", F.lit(f"(?s)\\A(?:{cls})\\z")), "class")
    x = tokens.withColumn("kind", kind.when(is_header, "header").otherwise("decision")).withColumn("name", F.when(F.col("kind") == "header", name))
    control = (F.col("kind") == "header") & F.col("name").isin(*CONTROL)
    x = x.withColumn("kind", F.when(control, "control").otherwise(F.col("kind"))) if inline else x

    w = Window.partitionBy("file").orderBy("pos")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("kind").isin("open", "control") | ((F.col("kind") == "header") if inline else F.lit(False))
    x = x.withColumn("line", F.coalesce(F.sum(newlines(F.col("t"))).over(past), F.lit(0)) + 1)
    x = x.where("kind != 'newline'").withColumns({"up": opens.cast("int"), "down": (F.col("kind") == "close").cast("int")})
    x = x.withColumn("level", F.sum(F.col("up") - F.col("down")).over(w) + F.col("down"))  # of an opening brace, or the one that closes
    # what an opening brace opens: the last header or class since the last brace or semicolon
    mark = F.when(F.col("kind").isin("header", "class", "semi", "open"), F.struct("kind", F.coalesce("name", F.regexp_extract("t", f"(?s)({cls or '(?!)'})", 2 if cls else 0)).alias("name"), "line", "pos", F.regexp_extract("t", f"(?s)^(?:{header})$", 2).alias("args")))
    x = x.withColumn("mark", F.last(mark, ignorenulls=True).over(past))
    if inline:
        what = F.when(F.col("kind") == "header", "function").when(F.col("kind") == "control", "block").when((F.col("kind") == "open") & (F.col("mark.kind") == "class"), "class").when(F.col("kind") == "open", "block")
        x = x.withColumns({"what": what, "fname": F.when(what == "class", F.col("mark.name")).otherwise(F.col("name")), "args": F.regexp_extract("t", f"(?s)^(?:{header})$", 2)})
    else:
        what = F.when((F.col("kind") == "open") & (F.col("mark.kind") == "header"), "function").when((F.col("kind") == "open") & (F.col("mark.kind") == "class"), "class").when(F.col("kind") == "open", "block")
        x = x.withColumns({"what": what, "fname": F.col("mark.name"), "args": F.col("mark.args"), "line": F.when(F.col("up") == 1, F.coalesce("mark.line", "line")).otherwise(F.col("line"))})
    x = _with_spans(x, ["function"], ["class"]).withColumn("args", F.coalesce("args", F.lit("")))
    counts = (F.col("kind") == "decision") | F.col("name").isin(*COUNTED)
    out = _by_function(x.withColumn("decisions", ((F.col("kind").isin("decision", "control")) & counts).cast("int")))
    own = F.when(F.coalesce("fname", F.lit("")) == "", "(anonymous)").otherwise(F.col("fname"))
    return _shaped(out.withColumn("fname", own), language)


def _with_spans(x: DataFrame, functions: list[str], classes: list[str], open_ended: bool = False) -> DataFrame:
    """For each token of (file, pos, what, fname, up, down, level): where what it opens ends, and what is around it.

    Adds end_pos and end_line (null if it isn't closed), fopen (it opens a function), owner (pos of the innermost function
    around it, its own if it opens one) and prefix (name of the innermost class). With ``open_ended``, functions and
    classes that are not closed count too.
    """
    brace = ((F.col("up") == 1) | (F.col("down") == 1)).cast("int")
    partner = Window.partitionBy("file", "brace", "level").orderBy("pos")
    x = x.withColumn("brace", brace).withColumns({"end_pos": F.lead("pos").over(partner), "end_line": F.lead("line").over(partner), "closes": F.lag("what").over(partner)})
    w = Window.partitionBy("file").orderBy("pos")
    whole = F.lit(True) if open_ended else F.col("end_pos").isNotNull()
    for name, kinds in (("f", functions), ("c", classes)):
        opens = F.coalesce((F.col("up") == 1) & F.col("what").isin(*kinds) & whole, F.lit(False))
        shuts = F.coalesce((F.col("down") == 1) & F.col("closes").isin(*kinds), F.lit(False))
        x = x.withColumns({f"{name}open": opens, f"{name}shut": shuts})
        x = x.withColumn(f"{name}depth", F.sum(F.col(f"{name}open").cast("int") - F.col(f"{name}shut").cast("int")).over(w))
    # at its own depth, the last that was opened is the one around a token
    around = lambda name, value: F.when(F.col(f"{name}depth") > 0, F.last(F.when(F.col(f"{name}open"), value), ignorenulls=True).over(Window.partitionBy("file", f"{name}depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.withColumns({"owner": around("f", F.col("pos")), "prefix": around("c", F.struct(F.col("fname").alias("name")))})


def _by_function(x: DataFrame) -> DataFrame:
    """One row for each function: its own columns, the decisions of its tokens and the deepest level of its blocks."""
    own = F.max(F.when(F.col("fopen"), F.struct("fname", "line", "end_line", "args", "level", "prefix")))
    block = F.when((F.col("what") == "block") & (F.col("up") == 1), F.col("level"))
    sums = x.where("owner is not null").groupBy("file", "owner").agg(own.alias("f"), F.sum("decisions").alias("decisions"), F.max(block).alias("deepest"))
    return sums.select("file", "f.*", "decisions", "deepest")


def _shaped(out: DataFrame, language: str) -> DataFrame:
    name = F.when(F.col("prefix").isNotNull(), F.concat("prefix.name", F.lit("."), "fname")).otherwise(F.col("fname"))
    return out.select(
        "file", name.alias("name"), "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("lines"), _parameters(F.col("args")).alias("params"),
        (1 + F.coalesce("decisions", F.lit(0))).alias("complexity"), F.greatest(F.coalesce("deepest", "level") - F.col("level"), F.lit(0)).alias("nesting"), F.lit(language).alias("language"),
    )


def only_php(content: Column | str) -> Column:
    """What stands between <?php or <?= and ?>, newlines of the rest kept in place."""
    x = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    parts = F.regexp_extract_all(x, F.lit(r"(?s)<\?(?:php|=).*?(?:\?>|\z)|.[^<]*+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"\A<\?(php|=)"), t).otherwise(F.regexp_replace(t, "[^\n]", " "))), "")


# Ruby's words that open a block, in the places where they do, and its decisions.
_RB_DEF = r"(?<![.\w:$@])def\s+(?:self\.)?([A-Za-z_][\w.]*[?!=]?)(?:[ \t]*\(([^)\n]*)\))?"
_RB_ENDLESS = r"(?<![.\w:$@])def\s+(?:self\.)?([A-Za-z_][\w?!]*)(?:\(([^)\n]*)\))?\s*=(?![=~>])[^\n]*"
_RB_CLASS = r"(?<![.\w:$@])(?:class|module)\b\s*([A-Z]\w*(?:::\w+)*)?"
_RB_OPEN = r"(?<![.\w:$@])(?:case|begin|for)\b|\n[ \t]*(?:if|unless|while|until)\b|[=(,;]\s*(?:if|unless|while|until)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?m:$)"
_RB_CX = r"\b(?:if|elsif|unless|while|until|when|rescue|and|or)\b|&&|\|\|"


def ruby_functions(files: DataFrame) -> DataFrame:
    """Functions of Ruby files (file, content), with the same columns; one that is not closed ends with its file."""
    hidden = r"(?m:^)=begin\b.*?(?m:^)=end\b[^\n]*|" + "|".join(_STRINGS[h] for h in ('"', "'", "="))
    text = F.coalesce("content", F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(f"(?s)(?:{hidden})|.[^\"'#=]*+"), F.lit(0))
    blank = F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit(f"(?s)\\A(?:{hidden})\\z")), F.regexp_replace(t, "[^\n]", " ")).otherwise(t))
    # every line has a newline before it, so that a word at its beginning differs from one behind a statement
    clean = spread(files).select("file", F.concat(F.lit("\n"), F.array_join(blank, "")).alias("s"))
    whole = "|".join(f"({x})" for x in (_RB_ENDLESS, _RB_DEF, _RB_CLASS, _RB_OPEN, r"(?<![.\w:$@])end\b", _RB_CX, r"\n"))
    x = clean.select("file", (F.size(lines("s")) - 1).alias("total"), F.posexplode(F.regexp_extract_all("s", F.lit(f"(?s){whole}"), F.lit(0))).alias("pos", "t"))
    is_a = lambda p: F.regexp_like("t", F.lit(f"(?s)\\A(?:{p})\\z"))
    kind = F.when(is_a(_RB_ENDLESS), "endless").when(is_a(_RB_DEF), "function").when(is_a(_RB_CLASS), "class").when(F.col("t") == "end", "end").when(F.trim("t") == "", "newline").when(is_a(_RB_OPEN), "block").otherwise("word")
    w = Window.partitionBy("file").orderBy("pos")
    x = x.withColumn("kind", kind).withColumn("line", F.coalesce(F.sum(newlines(F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("kind != 'newline'")
    x = x.withColumn("line", F.col("line") + newlines(F.regexp_extract("t", r"^(\s*)", 1)))
    up, down = F.col("kind").isin("function", "class", "block").cast("int"), (F.col("kind") == "end").cast("int")
    x = x.withColumns({"up": up, "down": down}).withColumn("level", F.sum(F.col("up") - F.col("down")).over(w) + F.col("down"))
    x = x.withColumn("decisions", F.when(F.col("kind").isin("block", "word"), F.regexp_count("t", F.lit(_RB_CX))).otherwise(0))
    part = lambda p, k: F.regexp_extract("t", f"(?s)^(?:{p})", k)
    cname = F.coalesce(F.nullif(part(_RB_CLASS, 1), F.lit("")), F.lit("class"))
    x = x.withColumns({"what": F.col("kind"), "fname": F.when(F.col("kind") == "class", cname).when(F.col("kind") == "endless", part(_RB_ENDLESS, 1)).otherwise(part(_RB_DEF, 1)), "args": F.when(F.col("kind") == "endless", part(_RB_ENDLESS, 2)).otherwise(part(_RB_DEF, 2))})
    x = _with_spans(x, ["function"], ["class"], open_ended=True).withColumn("end_line", F.coalesce("end_line", "total"))
    # a definition in one line is a function of its own
    endless = x.where("kind = 'endless'").select("file", "fname", "line", F.col("line").alias("end_line"), "args", "level", "prefix", F.regexp_count("t", F.lit(_RB_CX)).cast("long").alias("decisions"), F.lit(None).cast("long").alias("deepest"))
    return _shaped(_by_function(x).unionByName(endless), "ruby")


@F.pandas_udf(T.StructType([T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("around", "stop")]))
def _scopes(indents: pd.Series, heads: pd.Series) -> pd.DataFrame:
    """For each line of a file: the last head before it that it is indented deeper than, as are all lines between (-1: none);
    and the first later line that is indented no deeper than itself, or the number of lines."""
    arounds, stops = [], []
    for depth, head in zip(indents, heads, strict=True):
        around, stop, lines, open_heads = [], [len(depth)] * len(depth), [], []
        for k, d in enumerate(depth):
            while lines and depth[lines[-1]] >= d:
                stop[lines.pop()] = k
            while open_heads and depth[open_heads[-1]] >= d:
                open_heads.pop()
            around.append(open_heads[-1] if open_heads else -1)
            lines.append(k)
            if head[k]:
                open_heads.append(k)
        arounds.append(around)
        stops.append(stop)
    return pd.DataFrame({"around": arounds, "stop": stops})


def python_functions(files: DataFrame) -> DataFrame:
    """Functions of Python files (file, content), with the same columns.

    Depth is counted in the file's own unit of indentation, a tab as four spaces; nested functions are counted on their own.
    """
    code = lambda raw: F.regexp_replace(raw, r"^((?:[^\"'#]|\"[^\"]*\"|'[^']*')*+)#.*$", "$1")
    stripped = F.transform(lines(F.coalesce("content", F.lit(""))), lambda raw, n: F.struct((n + 1).alias("line"), code(raw).alias("c")))
    indent = lambda c: F.length(F.replace(F.regexp_extract(c, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    rows = F.transform(F.col("l"), lambda x: F.struct(x["line"].alias("line"), js_trim(x["c"]).alias("s"), indent(x["c"]).alias("indent")))
    found = F.transform(F.filter("l", lambda x: x["s"] != ""), lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), x["indent"].alias("indent"), F.nullif(F.regexp_extract(x["s"], _DEF, 1), F.lit("")).alias("def"), F.nullif(F.regexp_extract(x["s"], _CLASS, 1), F.lit("")).alias("cls")))
    whole = spread(files).select("file", stripped.alias("l")).select("file", rows.alias("l")).select("file", found.alias("l"))
    heads = F.transform("l", lambda x: x["def"].isNotNull() | x["cls"].isNotNull())
    # the unit: the smallest indent, or the smallest step between indents
    steps = F.array_sort(F.array_distinct("l.indent"))
    gaps = F.concat(F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda x, k: x - F.get(steps, k)), F.filter(steps, lambda x: x > 0))
    x = whole.select("file", "l", F.array_min(gaps).alias("unit"), _scopes(F.col("l.indent"), heads).alias("u"))
    # every line with its head, and heads with the last line of their bodies
    told = F.transform("l", lambda r, k: F.struct(r.alias("r"), F.get("l", F.get("u.around", k)).alias("o"), F.get("l", F.get("u.stop", k) - 1)["line"].alias("end")))
    x = x.select("file", "unit", F.explode(told).alias("x")).select("file", "unit", "x.r.*", "x.o", "x.end")
    is_def, plain = F.col("def").isNotNull(), F.col("def").isNull() & F.col("cls").isNull() & F.col("o.def").isNotNull()
    x = x.where(is_def | plain).withColumn("start", F.when(is_def, F.col("line")).otherwise(F.col("o.line")))
    own = F.max(F.when(is_def, F.struct("def", "s", "indent", "unit", "end", F.col("o.cls").alias("prefix"))))
    sums = x.groupBy("file", "start").agg(own.alias("f"), F.sum(F.when(plain, F.regexp_count("s", F.lit(_PY_WORDS)))).alias("decisions"), F.max(F.when(plain, F.col("indent"))).alias("deepest"))
    inner = F.regexp_extract("f.s", r"\(([^)]*)\)", 1)
    name = F.when(F.col("f.prefix").isNotNull(), F.concat("f.prefix", F.lit("."), "f.def")).otherwise(F.col("f.def"))
    depth = F.floor((F.coalesce("deepest", "f.indent") - F.col("f.indent")) / F.coalesce("f.unit", F.lit(4)) + 0.5)
    return sums.select("file", name.alias("name"), F.col("start").alias("line"), F.col("f.end").alias("end_line"), (F.col("f.end") - F.col("start") + 1).alias("lines"), _python_parameters(inner).alias("params"), (1 + F.coalesce("decisions", F.lit(0))).alias("complexity"), F.greatest(depth, F.lit(0)).cast("int").alias("nesting"), F.lit("python").alias("language"))


def imports(files: DataFrame) -> DataFrame:
    """Imports of JavaScript and TypeScript files: file, imp_ord, source."""
    forms = r"""(?:\bimport\s+(?:[\w$*{}\s,]+\s+from\s+)?|\bexport\s+[\w$*{}\s,]+\s+from\s+|\brequire\s*\(\s*|\bimport\s*\(\s*)["']([^"'\n]+)["']"""
    clean = masked("content", _STRINGS["//"] + "|" + _STRINGS["/*"])
    return spread(files).select("file", F.posexplode(F.regexp_extract_all(clean, F.lit(forms), F.lit(1))).alias("imp_ord", "source"))


def uses_data_loader(content: Column | str) -> Column:
    return F.regexp_like(F.col(content) if isinstance(content, str) else content, F.lit(r"\bnew\s+DataLoader\b|[\"']dataloader[\"']"))


def graphql_templates(files: DataFrame) -> DataFrame:
    """Texts of gql`...` and graphql`...` templates, their expressions cut out: file, tpl_ord, content."""
    found = F.regexp_extract_all("content", F.lit(r"(?i)(?<![\w$])(?:gql|graphql)(?:\.\w+)*\s*`([^`]*)`"), F.lit(1))
    return files.select("file", F.posexplode(F.transform(found, lambda t: F.regexp_replace(t, r"\$\{[^}]*\}", " "))).alias("tpl_ord", "content"))
