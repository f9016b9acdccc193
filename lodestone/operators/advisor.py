"""Rules that turn a project's facts into advice: severity, title and body, the worst first.

A rule is a row of ``RULES``; its condition and texts name facts. All rules meet all projects at once, as one array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rollup import COMPLEXITY, FILE_LINES, FUNCTION_LINES, NESTING
from lodestone.operators.scope import first_rows, keys, side_by_side

# Severities from the worst on, the length of the list, and the rules' texts.
SEVERITIES = ("high", "medium", "low", "success")
MAX_ADVICE = 10
#: rule, severity (or SQL that gives it), condition, title, body. {x} is a fact.
RULES = (
    ("complexity", "high", "complex is not null", "Break up complex functions ({risky_functions} found)", "\"{complex.name}\" in {complex.file} has cyclomatic complexity {complex.complexity} (recommended max {complexity_limit}). Split it into smaller single-purpose functions, replace nested if/else chains with early returns, and move each independent rule into its own well-named helper. Start with the biggest branch inside it."),
    ("long-function", "medium", "longest is not null", "Shorten long functions ({long_functions} found)", "\"{longest.name}\" in {longest.file} is {longest.lines} lines long (recommended max {function_limit}). Extract each logical step (validation, computation, output) into its own helper - short functions are easier to test, reuse and review."),
    ("nesting", "medium", "deepest is not null", "Flatten deeply nested code ({deep_functions} found)", "\"{deepest.name}\" in {deepest.file} nests {deepest.nesting} levels deep. Use guard clauses (return early on invalid input), extract inner loops into helpers, and invert conditions to keep the happy path at the top level."),
    ("long-file", "medium", "largest is not null", "Split oversized files ({long_file_count} found)", "{largest.path} is {largest.lines} lines (recommended max {file_limit}). Group related functions and move each group into its own module - one responsibility per file makes navigation and code review much faster."),
    ("duplication", "if(duplication_percentage > 10, 'high', 'medium')", "duplication_percentage > 3 and duplicate_blocks > 0", "Remove duplicated code ({duplication_percentage}% of lines)", "{duplicate_blocks} repeated block(s) were found. Extract the shared logic into one function or module and import it everywhere it is needed - every copy is a place where a future fix can be forgotten. The Duplicates tab lists the exact locations."),
    ("cycles", "high", "cycle_count > 0", "Break circular dependencies ({cycle_count} cycle(s))", "Files import each other in a loop: {chain}. Extract what both sides need into a third shared module, or use dependency injection so one side no longer imports the other. Cycles make code impossible to reuse in isolation."),
    ("markup", "low", "markup_issue_count > 0", "Clean up the HTML", "Found: {markup_parts}. Add alt attributes for accessibility and SEO, replace deprecated tags with CSS, and move onclick handlers into addEventListener calls in your scripts. Details are in the Overview issue tables."),
    ("style", "low", "style_issue_count > 0", "Tidy up the CSS", "Found: {style_parts}. Prefer more specific selectors over !important, merge duplicate rules into one place, and keep z-index values in a small ordered scale (1, 10, 100) so stacking stays predictable."),
    ("dangerous-sql", "high", "dangerous_sql > 0", "Guard dangerous SQL statements ({dangerous_sql} found)", "A DELETE or UPDATE without WHERE was found in {danger.file} (line {danger.line}) - it touches every row in the table. Add an explicit WHERE clause, and consider wrapping bulk changes in a transaction so they can be rolled back."),
    ("select-star", "low", "select_stars > 0", "Replace SELECT * ({select_stars} found)", "List only the columns you actually need. SELECT * transfers unnecessary data, breaks silently when the schema changes, and prevents covering indexes from being used."),
    ("parse-errors", "low", "parse_error_count > 0", "{parse_error_count} file(s) could not be fully parsed", "Some files were skipped or partially analyzed due to syntax the parser could not read. Check them for syntax errors - fixing them also makes the rest of this report more accurate."),
    ("all-clear", "success", None, "Your code is in great shape!", "No significant problems were found: functions are small, duplication is low and there are no dependency cycles. Keep it that way - re-run the analysis after big changes, keep functions under the limits, and add tests for the most complex parts."),
)
_MARKUP = (("missing-alt", "{n} image(s) without alt text"), ("deprecated-tag", "{n} deprecated tag(s)"), ("inline-handler", "{n} inline event handler(s)"), ("duplicate-id", "{n} duplicate id(s)"))
_STYLE = (("important", "{n} !important"), ("duplicate-property", "{n} duplicate propertie(s)"), ("duplicate-selector", "{n} duplicate selector(s)"), ("z-index", "{n} extreme z-index value(s)"))


def number(x: Column) -> Column:
    """As text, without .0 at the end."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def filled(template: str) -> Column:
    """A text with the facts that its braces name, in one pass."""
    parts = re.split(r"\{([\w.]+)\}", template)
    return F.concat(*(F.coalesce(number(F.col(p)), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def _parts(counts: tuple[tuple[str, str], ...], types: Column, total: Column) -> Column:
    """What a capped list holds, by type; the number of all if it holds none of these types."""
    n = lambda kind: F.size(F.filter(types, lambda t: t == kind))
    said = F.array_join(F.array_compact(F.array(*(F.when(n(kind) > 0, F.replace(F.lit(text), F.lit("{n}"), n(kind).cast("string"))) for kind, text in counts))), ", ")
    return F.when(said == "", total.cast("string")).otherwise(said)


def facts(summary: DataFrame, functions: DataFrame, files: DataFrame, markup: DataFrame, style: DataFrame, sql: DataFrame, blocks: DataFrame, cycles: DataFrame) -> DataFrame:
    """What the rules ask for, beside the summary's columns: one row a project.

    All lists are the report's own, cut to their lengths, with their rank: ``functions`` (name, file, complexity, lines,
    nesting), ``files`` (path, lines), ``markup`` and ``style`` (type), ``sql`` (type, file, line), ``blocks`` and
    ``cycles`` (path). Worst offenders come from these lists, and of equals the one that stands first.
    """
    own = keys(summary)

    def worst(rows: DataFrame, name: str, value: str, limit: int, *columns: str) -> DataFrame:
        over = rows.where(F.col(value) > limit)
        return over.groupBy(*own).agg(F.max_by(F.struct(*columns), F.struct(F.col(value), -F.col("rank"))).alias(name))

    fns = ("name", "file", "complexity", "lines", "nesting")
    types = lambda rows, name: rows.groupBy(*own).agg(F.collect_list("type").alias(name))  # noqa: E731  # capped lists
    danger = F.col("type").isin("delete-no-where", "update-no-where")
    of_sql = sql.groupBy(*own).agg(F.count_if(danger).alias("dangerous_sql"), F.count_if(F.col("type") == "select-star").alias("select_stars"), F.min_by(F.when(danger, F.struct("file", "line")), F.when(danger, F.col("rank"))).alias("danger"))
    first = cycles.groupBy(*own).agg(F.array_join(F.min_by("path", "rank"), " → ").alias("chain"))
    x = side_by_side(
        summary, worst(functions, "complex", "complexity", COMPLEXITY, *fns), worst(functions, "longest", "lines", FUNCTION_LINES, *fns), worst(functions, "deepest", "nesting", NESTING, *fns),
        worst(files, "largest", "lines", FILE_LINES, "path", "lines"), types(markup, "markup_types"), types(style, "style_types"), of_sql, blocks.groupBy(*own).agg(F.count("*").alias("duplicate_blocks")), first,
    )
    none = F.array().cast("array<string>")
    return x.withColumns({
        "markup_parts": _parts(_MARKUP, F.coalesce("markup_types", none), F.col("markup_issue_count")), "style_parts": _parts(_STYLE, F.coalesce("style_types", none), F.col("style_issue_count")),
        "complexity_limit": F.lit(COMPLEXITY), "function_limit": F.lit(FUNCTION_LINES), "file_limit": F.lit(FILE_LINES),
    })


def advise(known: DataFrame, most: int = MAX_ADVICE) -> DataFrame:
    """Advice (rank, rule, severity, title, body) by ``RULES`` over ``facts``, at most ``most`` rows a project; one says that
    all is well where no rule applies."""
    own = keys(known)

    def row(ord: int, rule: str, severity: str, title: str, body: str) -> Column:
        how_bad = F.lit(severity) if severity in SEVERITIES else F.expr(severity)
        return F.struct(F.array_position(F.array(*map(F.lit, SEVERITIES)), how_bad).cast("int").alias("worst"), F.lit(ord).alias("ord"), F.lit(rule).alias("rule"), how_bad.alias("severity"), filled(title).alias("title"), filled(body).alias("body"))

    said = F.array_compact(F.array(*(F.when(F.expr(when), row(k, rule, severity, title, body)) for k, (rule, severity, when, title, body) in enumerate(RULES) if when)))
    rule, severity, _, title, body = RULES[-1]
    x = known.select(*own, said.alias("said"), F.array(row(len(RULES), rule, severity, title, body)).alias("clear"))
    rows = x.select(*own, F.explode(F.when(F.size("said") > 0, F.col("said")).otherwise(F.col("clear"))).alias("r")).select(*own, "r.*")
    return first_rows(rows, most, "worst", "ord").select(*own, "rank", "rule", "severity", "title", "body")
