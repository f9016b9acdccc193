"""GraphQL schemas from SDL texts and introspection results, and what is wrong with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scope import keys, ranked, scoped, side_by_side
from lodestone.sources.tables import small, spread, written

# Fixed values.
BUILT_IN = ("String", "Int", "Float", "Boolean", "ID")
MAX_FIELDS = 20
ROOTS = ("Query", "Mutation", "Subscription")
_TYPE = r"(?s)\b(?:extend\s+)?(type|interface|input|enum)\s+([A-Za-z_]\w*)([^{}]*)\{([^{}]*)\}"
_UNION = r"\bunion\s+([A-Za-z_]\w*)\s*=\s*\|?\s*([A-Za-z_]\w*(?:\s*\|\s*[A-Za-z_]\w*)*)"
_SCHEMA, _INTERFACES, _WORD = r"(?s)\bschema\b[^{]*\{([^}]*)\}", r"implements\s+([^{@]*)", r"([A-Za-z_]\w*)"
_RESOLVERS = r"(?i)(^|/)resolvers?(/|\.)"
_KEYS = (r"(?m)^\s*(?:async\s+)?([A-Za-z_]\w*)\s*[:(]", r"(?m)[{,]\s*(?:async\s+)?([A-Za-z_]\w*)\s*[:(]", r"\b(?:exports\.|const\s+|let\s+|var\s+)([A-Za-z_]\w*)\s*=\s*(?:async\b|\(|function\b)")
INTROSPECTION_KINDS = {"OBJECT": "type", "INTERFACE": "interface", "INPUT_OBJECT": "input", "ENUM": "enum", "UNION": "union", "SCALAR": "scalar"}
MAX_LISTED_FIELDS = 60
_FIELD = r"(?s)([A-Za-z_]\w*)\s*(\([^)]*\))?\s*:\s*([\[\]A-Za-z_!][\w\[\]!]*)"


def stripped(sdl: Column) -> Column:
    """Without descriptions, strings and comments."""
    return F.regexp_replace(sdl, r'(?s)""".*?"""|"[^"\n]*"|#[^\n]*', " ")


def base_type(x: Column) -> Column:
    return F.regexp_extract(x, r"([A-Za-z_]\w*)", 1)


def definitions(sources: DataFrame) -> DataFrame:
    """(file, ord, kind, name, head, body) of the types in (file, content)."""
    found = spread(sources).select("file", F.posexplode(F.regexp_extract_all(stripped(F.col("content")), F.lit(_TYPE), F.lit(0))).alias("ord", "t"))
    part = lambda k: F.regexp_extract("t", _TYPE, k)
    return found.select("file", "ord", part(1).alias("kind"), part(2).alias("name"), part(3).alias("head"), part(4).alias("body"))


def types(sources: DataFrame) -> DataFrame:
    """(name, kind, source_files): definitions of one name are one type, of the kind it has first."""
    return _merged_types(definitions(sources).select("file", "ord", "kind", "name").unionByName(_others(sources)))


def _merged_types(found: DataFrame) -> DataFrame:
    d = scoped(found)
    at = F.struct("file", "ord")
    return d.groupBy(*keys(d), "name").agg(F.min_by("kind", at).alias("kind"), F.array_sort(F.collect_set("file")).alias("source_files"), F.min(at).alias("at"))


def _others(sources: DataFrame) -> DataFrame:
    """Unions and scalars, with the same columns."""
    s = stripped(F.col("content"))
    dealt = spread(sources)
    named = lambda pattern, kind: dealt.select("file", F.posexplode(F.regexp_extract_all(s, F.lit(pattern), F.lit(1))).alias("ord", "name")).select("file", "ord", F.lit(kind).alias("kind"), "name")
    return named(r"\bunion\s+([A-Za-z_]\w*)\s*=", "union").unionByName(named(r"\bscalar\s+([A-Za-z_]\w*)", "scalar"))


def fields(sources: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(type, name, raw_type, base_type, is_list, has_args): of fields that repeat, the first counts.

    With ``of``, those of types with the names in it alone: the others are left out before anything is shuffled.
    """
    found = _fields(sources)
    if of is not None:
        own = keys(of)
        found = scoped(found.withColumn("file", F.col("at.file"))).drop("file").join(small(written(of.select(*own, F.col("name").alias("type")).distinct(), "named")), [*own, "type"], "left_semi")
    return _merged_fields(found)


def _fields(sources: DataFrame) -> DataFrame:
    d = definitions(sources).where("kind != 'enum'")
    f = d.select("file", "ord", F.col("name").alias("type"), F.posexplode(F.regexp_extract_all("body", F.lit(_FIELD), F.lit(0))).alias("k", "t"))
    part = lambda k: F.regexp_extract("t", _FIELD, k)
    return f.select(F.struct("file", "ord", "k").alias("at"), "type", part(1).alias("name"), part(3).alias("raw_type"), base_type(part(3)).alias("base_type"), F.contains(part(3), F.lit("[")).alias("is_list"), (part(2) != "").alias("has_args"))


def _merged_fields(found: DataFrame) -> DataFrame:
    d = scoped(found.withColumn("file", F.col("at.file"))).drop("file")
    one = d.groupBy(*keys(d), "type", "name").agg(F.min(F.struct("at", "raw_type", "base_type", "is_list", "has_args")).alias("f"))
    return one.select(*keys(d), "type", "name", "f.raw_type", "f.base_type", "f.is_list", "f.has_args", "f.at")


def _values(sources: DataFrame) -> DataFrame:
    """Values of enums, as fields without a type."""
    d = definitions(sources).where("kind = 'enum'")
    v = d.select("file", "ord", F.col("name").alias("type"), F.posexplode(F.regexp_extract_all("body", F.lit(_WORD), F.lit(1))).alias("k", "name"))
    return v.select(F.struct("file", "ord", "k").alias("at"), "type", "name", F.lit("").alias("raw_type"), F.lit("").alias("base_type"), F.lit(False).alias("is_list"), F.lit(False).alias("has_args"))


def enum_values(sources: DataFrame) -> DataFrame:
    return _values(sources).select("type", F.col("name").alias("value")).distinct()


def implemented(sources: DataFrame) -> DataFrame:
    """(type, interface) pairs."""
    d = scoped(definitions(sources))
    return d.select(*keys(d), F.col("name").alias("type"), F.explode(F.regexp_extract_all(F.regexp_extract("head", _INTERFACES, 1), F.lit(_WORD), F.lit(1))).alias("interface")).distinct()


def union_members(sources: DataFrame) -> DataFrame:
    u = scoped(spread(sources))
    u = u.select(*keys(u), F.explode(F.regexp_extract_all(stripped(F.col("content")), F.lit(_UNION), F.lit(0))).alias("t"))
    members = F.transform(F.split(F.regexp_extract("t", _UNION, 2), r"\|"), lambda m: F.trim(m))
    return u.select(*keys(u), F.regexp_extract("t", _UNION, 1).alias("type"), F.explode(members).alias("member")).distinct()


def roots(sources: DataFrame) -> DataFrame:
    """(root, name): from a schema block, and by name for what none names."""
    return _merged_roots(_roots(sources), types(sources))


def _roots(sources: DataFrame) -> DataFrame:
    block = F.regexp_extract(stripped(F.col("content")), _SCHEMA, 1)
    named = F.array(*(F.struct(F.lit(r).alias("root"), F.regexp_extract(block, rf"\b{r.lower()}\s*:\s*([A-Za-z_]\w*)", 1).alias("name")) for r in ROOTS))
    return spread(sources).select("file", F.explode(named).alias("r")).select("file", "r.*").where("name != ''")


def _merged_roots(found: DataFrame, known: DataFrame) -> DataFrame:
    """What is named last counts; a root that is named nowhere is the type of its name."""
    d = scoped(found)
    own = keys(d)
    given = d.groupBy(*own, "root").agg(F.max_by("name", "file").alias("name"))
    named = known.where(F.col("name").isin(*ROOTS)).select(*own, F.col("name").alias("root"), "name")
    return given.unionByName(named.join(given.select(*own, "root"), [*own, "root"], "left_anti"))


def _schemas(files: DataFrame) -> DataFrame:
    """(file, s): the __schema of introspection results (file, content) that list types."""
    v = spread(files).select("file", F.try_parse_json("content").alias("v"))
    s = v.select("file", F.coalesce(F.try_variant_get("v", "$.data.__schema", "variant"), F.try_variant_get("v", "$.__schema", "variant")).alias("s"))
    return s.where(F.try_variant_get("s", "$.types", "array<variant>").isNotNull())


def _text(c: Column | str, path: str) -> Column:
    return F.try_variant_get(c, path, "string")


def _list(c: Column | str, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(c, p, "array<variant>") for p in paths))


def _described_types(files: DataFrame) -> DataFrame:
    """(file, ord, t, name, kind) of the types of introspection results; a kind that is not known is an object's."""
    t = _schemas(files).select("file", F.posexplode(_list("s", "$.types")).alias("ord", "t"))
    kinds = F.create_map(*(F.lit(x) for pair in INTROSPECTION_KINDS.items() for x in pair))
    t = t.withColumns({"name": _text("t", "$.name"), "given": _text("t", "$.kind")})
    t = t.where((F.col("name") != "") & ~F.col("name").startswith("__") & ~((F.col("given") == "SCALAR") & F.col("name").isin(*BUILT_IN)))
    return t.withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("given")), F.lit("type"))).drop("given")


def _described_fields(t: DataFrame) -> DataFrame:
    """Fields, input fields and enum values of described types, as ``_fields`` gives them."""
    f = t.select("file", "ord", F.col("name").alias("type"), F.posexplode(_list("t", "$.fields", "$.inputFields")).alias("k", "f"))
    deep = [".".join(["$", "type", *["ofType"] * k]) for k in range(8)]
    base = F.coalesce(*(_text("f", f"{p}.name") for p in deep), F.lit(""))
    is_list = F.coalesce(*(F.nullif(_text("f", f"{p}.kind") == "LIST", F.lit(False)) for p in deep), F.lit(False))
    raw = F.concat(base, F.when(is_list, " (list)").otherwise(""))
    of_fields = f.select(F.struct("file", "ord", "k").alias("at"), "type", _text("f", "$.name").alias("name"), raw.alias("raw_type"), base.alias("base_type"), is_list.alias("is_list"), F.coalesce(F.size(_list("f", "$.args")) > 0, F.lit(False)).alias("has_args"))
    v = t.where("kind = 'enum'").select("file", "ord", F.col("name").alias("type"), F.posexplode(_list("t", "$.enumValues")).alias("k", "v"))
    of_values = v.select(F.struct("file", "ord", "k").alias("at"), "type", _text("v", "$.name").alias("name"), F.lit("").alias("raw_type"), F.lit("").alias("base_type"), F.lit(False).alias("is_list"), F.lit(False).alias("has_args"))
    return of_fields.unionByName(of_values)


def introspected(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types (name, kind) and fields (type, name, base_type, is_list) of introspection results (file, content)."""
    t = _described_types(files)
    return t.select("name", "kind").distinct(), _described_fields(t).where("base_type != ''").select("type", "name", "base_type", "is_list").distinct()


@dataclass
class Registry:
    """What all sources say together: types (name, kind, source_files, at), fields (type, name, raw_type, base_type, is_list,
    has_args, at), members (type, member), interfaces (type, interface), roots (root, name), and the sources (file, kind)."""

    types: DataFrame
    fields: DataFrame
    members: DataFrame
    interfaces: DataFrame
    roots: DataFrame
    sources: DataFrame


def registry(sdl: DataFrame, schemas: DataFrame) -> Registry:
    """SDL texts and introspection results (file, content) as one schema; files sort in the order in which they are read.

    Of types, fields and enum values of one name the first counts, wherever it stands; a type keeps all its files. Members
    of a union that an introspection result lists replace those of SDL, the last result's if there are several.
    """
    described = _described_types(schemas)
    known = _merged_types(definitions(sdl).select("file", "ord", "kind", "name").unionByName(_others(sdl)).unionByName(described.select("file", "ord", "kind", "name")))
    found = _merged_fields(_fields(sdl).unionByName(_values(sdl)).unionByName(_described_fields(described)))
    listed = scoped(described.where("kind = 'union'").select("file", F.col("name").alias("type"), F.transform(_list("t", "$.possibleTypes"), lambda m: _text(m, "$.name")).alias("members")).where("members is not null"))
    own = keys(listed)
    last = listed.groupBy(*own, "type").agg(F.max_by("members", "file").alias("members"))
    members = union_members(sdl).join(last, [*own, "type"], "left_anti").unionByName(last.select(*own, "type", F.explode(F.array_distinct(F.array_compact("members"))).alias("member")))
    named = _schemas(schemas).select("file", F.explode(F.array(*(F.struct(F.lit(r).alias("root"), _text("s", f"$.{r.lower()}Type.name").alias("name")) for r in ROOTS))).alias("r")).select("file", "r.*").where("name != ''")
    sources = scoped(sdl.select("file", F.lit("SDL").alias("kind")).unionByName(_schemas(schemas).select("file", F.lit("introspection JSON").alias("kind"))))
    return Registry(known, found, members, implemented(sdl), _merged_roots(_roots(sdl).unionByName(named), known), sources)


def _led_to(found: DataFrame, known: DataFrame) -> DataFrame:
    """(base_type) of the known types that a field leads to, stored: a schema of many types may lead to few of them, very often."""
    own = keys(found)
    used = found.select(*own, "base_type").distinct()
    return small(written(known.select(*own, F.col("name").alias("base_type")).join(used.hint("merge"), [*own, "base_type"], "left_semi"), "targets"))


def relations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Fields whose type is a known one that is no scalar: from, field, to, is_list. ``found`` is read twice: give a table."""
    own = keys(found)
    asked = found.where(~F.col("base_type").isin(*BUILT_IN))
    hits = asked.join(_led_to(asked, known.where("kind != 'scalar'")), [*own, "base_type"])
    return hits.select(*own, F.col("type").alias("from"), F.col("name").alias("field"), F.col("base_type").alias("to"), "is_list")


def all_relations(r: Registry) -> DataFrame:
    """``relations``, and those of unions to their members and of types to their interfaces, where both are known."""
    own = keys(r.types)
    names = r.types.select(*own, F.col("name").alias("to"))
    more = r.members.select(*own, F.col("type").alias("from"), F.lit("(union member)").alias("field"), F.col("member").alias("to"))
    more = more.unionByName(r.interfaces.select(*own, F.col("type").alias("from"), F.lit("(implements)").alias("field"), F.col("interface").alias("to")))
    return relations(r.fields, r.types).unionByName(more.join(names.hint("merge"), [*own, "to"], "left_semi").select(*own, "from", "field", "to", F.lit(False).alias("is_list")))


def ranked_types(r: Registry, most: int = MAX_LISTED_FIELDS) -> DataFrame:
    """(name, kind, root, too_large, field_count, fields, source_files, rank): roots first, then by number of fields.

    ``fields`` are the first as declared: name, type, base_type, is_list.
    """
    own = keys(r.types)
    field = F.struct("at", "name", F.col("raw_type").alias("type"), "base_type", "is_list")
    counts = r.fields.groupBy(*own, F.col("type").alias("name")).agg(F.count("*").alias("field_count"), F.slice(F.array_sort(F.collect_list(field)), 1, most).alias("fields"))  # of one type
    fields = F.transform(F.coalesce("fields", F.array().cast(counts.schema["fields"].dataType)), lambda f: f.dropFields("at"))
    x = r.types.join(counts.hint("merge"), [*own, "name"], "left").join(r.roots.groupBy(*own, "name").agg(F.min("root").alias("root")), [*own, "name"], "left")
    x = x.withColumns({"field_count": F.coalesce("field_count", F.lit(0)), "fields": fields})
    x = x.withColumn("too_large", F.col("root").isNull() & (F.col("kind") != "enum") & (F.col("field_count") > MAX_FIELDS))
    return ranked(x, F.col("root").isNull(), F.desc("field_count"), "at").select(*own, "name", "kind", "root", "too_large", "field_count", "fields", "source_files", "rank")


def n_plus_one(found: DataFrame, known: DataFrame, root_names: DataFrame) -> DataFrame:
    """List fields of object types, roots aside, that lead to object types. ``found`` is read twice: give a table."""
    own_keys = keys(found)
    objects = written(known.where("kind in ('type', 'interface')").select(*own_keys, "name"), "objects")
    own = objects.join(root_names.select(*own_keys, "name"), [*own_keys, "name"], "left_anti").select(*own_keys, F.col("name").alias("type"))
    lists = found.where("is_list")
    hits = lists.join(_led_to(lists, objects), [*own_keys, "base_type"]).join(small(written(own, "owners")), [*own_keys, "type"])
    return hits.select(*own_keys, "type", F.col("name").alias("field"), F.col("base_type").alias("target"))


def oversized(found: DataFrame, known: DataFrame, root_names: DataFrame) -> DataFrame:
    own = keys(found)
    counts = found.groupBy(*own, "type").agg(F.count("*").alias("field_count")).where(F.col("field_count") > MAX_FIELDS)
    return counts.join(known.where("kind != 'enum'").select(*own, F.col("name").alias("type")).hint("merge"), [*own, "type"]).join(root_names.select(*own, F.col("name").alias("type")), [*own, "type"], "left_anti")


def resolver_keys(files: DataFrame) -> DataFrame:
    """Names that resolver files (file, content) define; files are taken by their path."""
    x = scoped(files)
    path = "file.path" if x.schema["file"].dataType.typeName() == "struct" else "file"
    named = x.where(F.col(path).rlike(_RESOLVERS))
    return named.select(*keys(x), F.explode(F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in _KEYS))).alias("key")).distinct()


def missing_resolvers(found: DataFrame, root_names: DataFrame, keys_found: DataFrame) -> DataFrame:
    """Fields of root types without a resolver; none are missing where there are no resolvers at all."""
    own = keys(found)
    asked = found.join(root_names.select(*own, F.col("name").alias("type"), "root"), [*own, "type"]).select(*own, "root", F.col("name").alias("key"))
    missing = asked.join(keys_found.hint("merge"), [*own, "key"], "left_anti")
    if own:
        return missing.join(keys_found.select(*own).distinct(), own, "left_semi")
    return missing.crossJoin(F.broadcast(keys_found.limit(1).select(F.lit(True).alias("any")))).drop("any")  # one row at most


def statistics(known: DataFrame, root_names: DataFrame) -> DataFrame:
    own = keys(known)
    marked = known.join(root_names.select(*own, "name", F.lit(True).alias("is_root")).distinct(), [*own, "name"], "left")
    kinds = ("type", "interface", "input", "enum", "union", "scalar")
    return marked.groupBy(*own).agg(*(F.count_if((F.col("kind") == k) & ((F.lit(k) != "type") | F.col("is_root").isNull())).alias(f"{k}_count") for k in kinds))


def operations(r: Registry) -> DataFrame:
    """(root, operations): how many fields each root type has."""
    own = keys(r.types)
    return r.roots.join(r.fields.select(*own, F.col("type").alias("name"), F.col("name").alias("field")), [*own, "name"]).groupBy(*own, "root").agg(F.count("*").alias("operations"))


def present(r: Registry) -> DataFrame:
    """Projects (or one row) in which there are types, and roots that a schema names or any field."""
    own = keys(r.types)
    one = lambda df: df.groupBy(*own).agg(F.count("*").alias("n")).where("n > 0").select(*own)
    content = r.roots.select(*own).unionByName(r.fields.select(*own)) if own else r.roots.select(F.lit(1).alias("x")).unionByName(r.fields.select(F.lit(1).alias("x")))
    return one(r.types).join(one(content), own, "left_semi") if own else side_by_side(one(r.types), one(content))
