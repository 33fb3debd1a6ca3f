"""Validation of JSON texts against a JSON Schema: every violation with its path.

The schema becomes a table of nodes (a ``$ref`` is the node it names, so definitions are compiled once).
Texts are parsed to VARIANT and walked one level of the schema at a time: a row is a value with its path and its
node, each level checks it and gives a row for each of its members or items. A value's violations travel with the
first row below it, so there is one scan and no shuffle. Nothing is done in lambdas, which Spark interprets: the
checks of a level are plain columns of its own nodes' keywords, compiled with the stage.

Keywords: type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength,
pattern, required, properties, patternProperties, additionalProperties, minProperties, maxProperties, items,
minItems, maxItems, uniqueItems, allOf, $ref within the document. Others that would restrict a value are refused.
A keyword restricts only values of its own type, as the standard has it. Patterns are Java's.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSED = "anyOf oneOf not if then else dependentRequired dependentSchemas propertyNames contains prefixItems unevaluatedItems unevaluatedProperties multipleOf $dynamicRef".split()
DEPTH = 32  # levels of a schema that refers to itself


class Nodes:
    """The compiled schema: rules by node, and where members and items lead."""

    def __init__(self, schema: dict):
        self.schema, self.rules, self.ids = schema, [], {}
        self.root = self.add(schema)

    def add(self, sub: dict | bool) -> int:
        if sub is True:
            sub = {}
        elif sub is False:
            sub = {"type": []}
        while "$ref" in sub:
            more = {k: v for k, v in sub.items() if k not in ("$ref", "$defs", "$schema", "$id", "title", "description")}
            target = self.find(sub["$ref"])
            if not more:
                sub = target
            else:
                sub = more | {"allOf": [*more.get("allOf", []), target]}
        if id(sub) in self.ids:
            return self.ids[id(sub)]
        if wrong := [k for k in REFUSED if k in sub]:
            raise ValueError(f"schema keywords without support: {', '.join(wrong)}")
        number = self.ids[id(sub)] = len(self.rules)
        self.rules.append({"own": sub})  # held, so its identity stays its own
        rule = self.rules[number]
        rule["members"] = {k: self.add(v) for k, v in sub.get("properties", {}).items()}
        rule["patterns"] = [(k, self.add(v)) for k, v in sub.get("patternProperties", {}).items()]
        rest = sub.get("additionalProperties", True)
        rule["rest"] = None if rest is True else -1 if rest is False else self.add(rest)
        rule["items"] = self.add(sub["items"]) if isinstance(sub.get("items"), dict) else None
        rule["also"] = [self.add(s) for s in sub.get("allOf", [])]
        return number

    def find(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise ValueError(f"no schema outside the document: {ref}")
        at = self.schema
        for part in ref[1:].strip("/").split("/"):
            at = at[part.replace("~1", "/").replace("~0", "~")] if part else at
        return at

    def next(self, n: int) -> list[int]:
        r = self.rules[n]
        return [*r["members"].values(), *[i for _, i in r["patterns"]], *([r["rest"]] if r["rest"] not in (None, -1) else []), *([r["items"]] if r["items"] is not None else [])]

    def together(self, n: int) -> list[int]:
        """A node and all that hold with it."""
        out = [n]
        for i in out:
            out += [a for a in self.rules[i]["also"] if a not in out]
        return out

    def depth(self) -> int:
        """Levels below the root; ``DEPTH`` where the schema refers to itself."""
        level, seen = {self.root}, 0
        while level and seen < DEPTH:
            level = {j for n in level for m in self.together(n) for j in self.next(m)}
            seen += 1
        return seen

    def meets(self, n: int) -> list[int]:
        """The nodes that a value of ``n`` is held against: those that hold with it and ask something."""
        return [m for m in self.together(n) if self.rules[m]["own"].keys() & CHECKED or self.rules[m]["rest"] == -1 or self.next(m)]

    def levels(self) -> list[tuple[list[int], bool]]:
        """For each level the nodes that its values can meet, and whether one value can meet several."""
        out = [(first := self.meets(self.root), len(first) > 1)]
        while len(out) < self.depth():
            level, several = out[-1]
            to = [self.meets(j) for n in level for j in self.next(n)]
            split = any(len(r["patterns"]) + bool(r["members"]) > 1 for r in (self.rules[n] for n in level) if r["patterns"])
            out.append((sorted({m for ms in to for m in ms}), several or split or any(len(ms) > 1 for ms in to)))
        return out


OF_MEMBERS, OF_ITEMS = {"required", "minProperties", "maxProperties"}, {"minItems", "maxItems", "uniqueItems"}
OF_SCALARS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern"}
CHECKED = {"type", "enum", "const"} | OF_MEMBERS | OF_ITEMS | OF_SCALARS
FOUND = "array<struct<path:string,message:string>>"


def _canonical(value) -> str:
    """JSON text as the engine writes a value of VARIANT: members by name, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _types(rule: dict) -> list[str]:
    named = rule["own"].get("type", [])
    return named if isinstance(named, list) else [named]


def _asks(rule: dict) -> set[str]:
    """What a node's checks need of a value."""
    own, told = rule["own"].keys(), set(_types(rule))
    names = {"names"} if own & OF_MEMBERS or "object" in told else set()
    size = {"size"} if own & OF_ITEMS or "array" in told else set()
    return names | size | ({"kind"} if own & OF_SCALARS or told - {"object", "array"} else set())


# names and size are NULL for values of other types; members and items themselves are not copied
FACTS = {
    "names": lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>")),
    "size": lambda v: F.array_size(F.try_variant_get(v, "$", "array<struct<>>")),
    "kind": F.schema_of_variant,
}


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _has_type(name: str, v: Column, kind: Column, names: Column, size: Column) -> Column:
    if name == "integer":
        number = F.try_variant_get(v, "$", "double")
        return _is_number(kind) & (number == F.floor(number))
    if name in ("object", "array", "number"):
        return {"object": names.isNotNull(), "array": size.isNotNull(), "number": _is_number(kind)}[name]
    plain = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    return kind == plain[name] if name in plain else F.lit(False)


def _checks(rule: dict, v: Column, kind: Column, names: Column, size: Column) -> list[Column]:
    """For each check of a node the message if a value fails, else NULL."""
    own, out = rule["own"], []

    def say(wrong: Column, message: Column) -> None:
        out.append(F.when(wrong, message))

    def limit(keyword: str, kind_of, wrong, words: str) -> None:
        if keyword in own:
            r = F.lit(kind_of(own[keyword]))
            say(wrong(r), F.concat(F.lit(words + " "), r.cast("string")))

    def of_number(wrong):
        return lambda r: _is_number(kind) & wrong(F.try_variant_get(v, "$", "double"), r)

    def of_text(wrong):
        return lambda r: (kind == "STRING") & wrong(F.try_variant_get(v, "$", "string"), r)

    if "type" in own:
        fits = F.lit(False)
        for name in _types(rule):
            fits = fits | F.coalesce(_has_type(name, v, kind, names, size), F.lit(False))
        say(~fits, F.lit("is not of type " + ", ".join(_types(rule))))
    if "enum" in own:
        allowed = [_canonical(e) for e in own["enum"]]
        say(~F.to_json(v).isin(*allowed) if allowed else F.lit(True), F.lit("is none of " + ", ".join(allowed)))
    if "const" in own:
        say(F.to_json(v) != _canonical(own["const"]), F.lit("is not " + _canonical(own["const"])))
    limit("minimum", float, of_number(lambda x, r: x < r), "is less than")
    limit("maximum", float, of_number(lambda x, r: x > r), "is more than")
    limit("exclusiveMinimum", float, of_number(lambda x, r: x <= r), "is not more than")
    limit("exclusiveMaximum", float, of_number(lambda x, r: x >= r), "is not less than")
    limit("minLength", int, of_text(lambda x, r: F.length(x) < r), "is shorter than")
    limit("maxLength", int, of_text(lambda x, r: F.length(x) > r), "is longer than")
    limit("pattern", str, of_text(lambda x, r: ~F.regexp_like(x, r)), "does not match")
    limit("minProperties", int, lambda r: F.array_size(names) < r, "has fewer members than")
    limit("maxProperties", int, lambda r: F.array_size(names) > r, "has more members than")
    limit("minItems", int, lambda r: size < r, "has fewer items than")
    limit("maxItems", int, lambda r: size > r, "has more items than")
    if own.get("uniqueItems"):
        texts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))
        say(F.array_size(F.array_distinct(texts)) < size, F.lit("has items twice"))
    for name in dict.fromkeys(own.get("required", [])):
        say(~F.array_contains(names, name), F.lit(f"lacks {name}"))
    return out


def _known(rule: dict, key: Column) -> Column:
    """Whether a node names a member or has a pattern for it."""
    known = key.isin(*rule["members"]) if rule["members"] else F.lit(False)
    for pattern, _ in rule["patterns"]:
        known = known | F.regexp_like(key, F.lit(pattern))
    return known


def _leads(nodes: Nodes, rule: dict, key: Column, pos: Column) -> list[tuple[Column, list[int]]]:
    """Where a node leads: conditions on a member or an item with the nodes that it then meets."""
    out = [(key == name, nodes.meets(n)) for name, n in rule["members"].items()]
    out += [(F.regexp_like(key, F.lit(pattern)), nodes.meets(n)) for pattern, n in rule["patterns"]]
    if rule["rest"] not in (None, -1):
        out.append((key.isNotNull() & ~_known(rule, key), nodes.meets(rule["rest"])))
    if rule["items"] is not None:
        out.append((key.isNull() & pos.isNotNull(), nodes.meets(rule["items"])))
    return [(condition, to) for condition, to in out if to]


def _cases(pairs: list[tuple[Column, Column]], kind: str) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out.cast(kind) if pairs else F.lit(None).cast(kind)


def _checked(nodes: Nodes, rows: DataFrame, own: list[str], level: list[int], at) -> DataFrame:
    """``rows`` with the violations of their values added; nodes that a value can't meet together share columns."""
    facts = {name: [n for n in level if name in _asks(nodes.rules[n])] for name in FACTS}
    rows = rows.select(*own, "_p", "_n", "_v", "_i", *[_cases([(at(ns), FACTS[name](F.col("_v")))] if ns else [], "array<string>" if name == "names" else "int" if name == "size" else "string").alias(f"_{name}") for name, ns in facts.items()])
    checks = {n: _checks(nodes.rules[n], F.col("_v"), F.col("_kind"), F.col("_names"), F.col("_size")) for n in level}
    shared = [{n: c[j] for n, c in checks.items() if j < len(c)} for j in range(max(map(len, checks.values()), default=0))]
    if rows.schema["_n"].dataType.typeName() == "array":
        shared = [{n: c} for n, cs in checks.items() for c in cs]
    said = [f"_m{j}" for j in range(len(shared))]
    rows = rows.select(*own, "_p", "_n", "_v", "_i", *[_cases([(at([n]), c) for n, c in s.items()], "string").alias(m) for s, m in zip(shared, said, strict=True)])
    if not said:
        return rows
    found = F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.col("_p").alias("path"), F.col(m).alias("message"))) for m in said])
    some = F.coalesce(*[F.col(m) for m in said]).isNotNull()
    return rows.select(*own, "_p", "_n", "_v", F.when(some, F.concat(F.coalesce("_i", F.array().cast(FOUND)), found)).otherwise(F.col("_i")).alias("_i"))


def _below(nodes: Nodes, rows: DataFrame, own: list[str], level: list[int], at, several: bool) -> DataFrame:
    """A row for each member and item with the node it meets. The violations so far go with the first; where nothing
    is below a row, it stays for them alone."""
    leading = [n for n in level if nodes.next(n) or nodes.rules[n]["rest"] == -1]
    rows = rows.withColumn("_v", _cases([(at(leading), F.col("_v"))] if leading else [], "variant"))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_pos", "_key", "_value"))
    key, pos = F.col("_key"), F.col("_pos")
    if several:
        none = F.array().cast("array<int>")
        to = F.concat(none, *[F.when(at([n]) & condition, F.array(*map(F.lit, ms))).otherwise(none) for n in leading for condition, ms in _leads(nodes, nodes.rules[n], key, pos)])
        to = F.nullif(F.array_distinct(to), none)
    else:
        to = _cases([(at([n]), _cases([(condition, F.lit(ms[0])) for condition, ms in _leads(nodes, nodes.rules[n], key, pos)], "int")) for n in leading], "int")
    so_far = F.when(F.coalesce(pos, F.lit(0)) == 0, F.col("_i"))
    for n in leading:
        if nodes.rules[n]["rest"] == -1:
            alien = F.struct(F.col("_p").alias("path"), F.concat(F.lit("must not have "), key).alias("message"))
            so_far = F.when(at([n]) & key.isNotNull() & ~_known(nodes.rules[n], key), F.concat(F.coalesce(so_far, F.array().cast(FOUND)), F.array(alien))).otherwise(so_far)
    name = F.coalesce(key, pos.cast("string"))
    path = F.when(F.col("_p") == "", name).otherwise(F.concat("_p", F.lit("/"), name))
    return rows.select(*own, path.alias("_p"), to.alias("_n"), F.col("_value").alias("_v"), so_far.alias("_i")).where("_n is not null or _i is not null")


def violations(df: DataFrame, json_column: str, schema: dict, keys: list[str]) -> DataFrame:
    """DQ1: (keys, path, message) of every violation; the path is of names and indices with slashes, empty for the
    whole. A text that is no JSON has one violation, a NULL none. Nodes that say the same of one value say it once."""
    nodes = Nodes(schema)
    levels = nodes.levels()
    own, text, v = [f"_k{i}" for i in range(len(keys))], F.col(json_column), F.col("_v")
    root, several = levels[0]
    start = F.array(*map(F.lit, root)) if several else F.lit(root[0] if root else None).cast("int")
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("is no JSON").alias("message")))
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], text.isNotNull().alias("_given"), F.try_parse_json(text).alias("_v"))
    rows = rows.select(*own, F.lit("").alias("_p"), F.when(v.isNotNull(), start).alias("_n"), "_v", F.when(F.col("_given") & v.isNull(), bad).cast(FOUND).alias("_i"))
    for (level, several), (_, next_several) in zip(levels, [*levels[1:], (None, None)], strict=True):

        def at(ns: list[int], several=several) -> Column:
            return F.arrays_overlap(F.col("_n"), F.array(*map(F.lit, ns))) if several else F.col("_n").isin(*ns)

        rows = _checked(nodes, rows, own, level, at)
        if next_several is not None:
            rows = _below(nodes, rows, own, level, at, next_several)
    found = rows.select(*own, F.explode(F.array_distinct("_i")).alias("_i")).where("_i is not null")
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "_i.path", "_i.message")
