"""A JSON schema compiled to one Column expression over VARIANT, with the path of each violation.

Keywords: type, enum, const, pattern, minLength, maxLength, minimum, maximum, required, properties, additionalProperties, items, uniqueItems, oneOf,
$ref into definitions. As in the standard a keyword speaks only of values of its type, and every violation is told, not the first alone.
The compiled expression is built-in functions only, so a gate over any number of records stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYWORDS = frozenset("type enum const pattern minLength maxLength minimum maximum required properties additionalProperties items uniqueItems oneOf $ref definitions".split())
NOTES = frozenset("$schema $id title description default examples $comment".split())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), an array of violations, with value computed once.

    By aggregate, which holds its types; get(transform(...), 0) works out the type of the whole body again with every row.
    """
    return F.aggregate(F.array(value), F.array().cast("array<string>"), lambda _, v: body(v))


def _said(broken: Column, path: Column, message: str) -> list[Column]:
    """A violation, null where there is none; in a list, which tells it from arrays of violations."""
    return [F.when(broken, F.concat(path, F.lit(f" {message}")))]


def _joined(parts: list[Column | list[Column]]) -> Column:
    """Violations in order as one array, which may hold nulls: single ones that follow each other stand in one array, as joining many arrays is slow."""
    arrays, run = [], []
    for part in [*parts, None]:
        if isinstance(part, list):
            run += part
            continue
        arrays += [F.array(*run)] if run else []
        run = []
        arrays += [part] if part is not None else []
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0] if arrays else F.array().cast("array<string>")


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolve(self, schema: dict, seen: tuple[str, ...] = ()) -> dict:
        """The schema itself, or what its reference points to."""
        if "$ref" not in schema:
            return schema
        place = schema["$ref"]
        if place in seen or not place.startswith("#/"):
            raise ValueError(f"reference {place} has no end" if place in seen else f"reference {place} leaves the schema")
        out = self.root
        for part in place[2:].split("/"):
            out = out[part]
        return self.resolve(out, (*seen, place))

    def check(self, value: Column, schema: dict | bool, path: Column, depth: int = 0, held: bool = False) -> Column:
        """Violations of a variant that is there; held: it is a variable or column, so that naming it again costs nothing."""
        if isinstance(schema, bool):
            return _joined([_said(F.lit(not schema), path, "boolean schema is false")])
        schema = self.resolve(schema)
        if unknown := schema.keys() - KEYWORDS - NOTES:
            raise ValueError(f"keywords not compiled: {sorted(unknown)}")
        if depth > 32:
            raise ValueError("the schema refers to itself without end")
        shown = F.when(path == "", F.lit("/")).otherwise(path)
        judged = lambda v: self._opened(v, schema, path, shown, depth)
        return judged(value) if held else _let(value, judged)

    def _opened(self, value: Column, schema: dict, path: Column, shown: Column, depth: int) -> Column:
        """Violations of a value that is at hand: its members or elements are taken out once, if the schema asks for them, and tell its kind as well.

        schema_of_variant reads all that is below a value, so it is asked only about values that are neither.
        """
        names = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
        parts, held = [], set()
        if "object" in names or schema.keys() & {"required", "properties", "additionalProperties"}:
            parts.append(F.try_variant_get(value, "$", "map<string,variant>").alias("members"))
            held.add("members")
        if "array" in names or "items" in schema or schema.get("uniqueItems"):
            parts.append(F.try_variant_get(value, "$", "array<variant>").alias("elements"))
            held.add("elements")
        opened = {f: None for f in ("members", "elements")}
        # what is neither is a scalar, or of no interest to this schema as object or array
        plain = {"string", "number", "integer", "boolean", "null"} & {*names} or schema.keys() & {"pattern", "minLength", "maxLength", "minimum", "maximum"}
        if not parts:
            if not plain:
                return _joined(self._parts(value, None, opened, schema, path, shown, depth))
            return _let(F.schema_of_variant(value), lambda kind: _joined(self._parts(value, kind, opened, schema, path, shown, depth)))

        def judged(x: Column) -> Column:
            there = {f: x[f] if f in held else None for f in opened}
            if not plain:
                return _joined(self._parts(value, None, there, schema, path, shown, depth))
            other = F.lit(True)
            for f in there.values():
                other = other & f.isNull() if f is not None else other
            return _let(F.when(other, F.schema_of_variant(value)).otherwise(""), lambda kind: _joined(self._parts(value, kind, there, schema, path, shown, depth)))

        return _let(F.struct(*parts), judged)

    def _parts(self, value: Column, kind: Column | None, opened: dict[str, Column | None], schema: dict, path: Column, shown: Column, depth: int) -> list[Column | list[Column]]:
        members, elements = opened["members"], opened["elements"]
        is_kind = {}
        if members is not None:
            is_kind["object"] = members.isNotNull()
        if elements is not None:
            is_kind["array"] = elements.isNotNull()
        if kind is not None:
            number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
            is_text, is_number = kind == "STRING", (kind == "BIGINT") | F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT")
            is_kind |= {"string": is_text, "number": is_number, "integer": (kind == "BIGINT") | is_number & (number == F.floor(number)), "boolean": kind == "BOOLEAN", "null": kind == "VOID"}
        out = []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = is_kind[names[0]]
            for name in names[1:]:
                fits = fits | is_kind[name]
            out.append(_said(~fits, shown, f"must be {','.join(names)}"))
        if "enum" in schema or "const" in schema:
            allowed = [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in (schema["enum"] if "enum" in schema else [schema["const"]])]
            out.append(_said(~F.coalesce(F.to_json(value), F.lit("null")).isin(*allowed), shown, "must be equal to one of the allowed values" if "enum" in schema else "must be equal to constant"))
        for key, broken, message in (
            ("pattern", lambda s: is_text & ~text.rlike(s), "must match pattern \"{}\""), ("minLength", lambda s: is_text & (F.length(text) < s), "must NOT have fewer than {} characters"),
            ("maxLength", lambda s: is_text & (F.length(text) > s), "must NOT have more than {} characters"), ("minimum", lambda s: is_number & (number < s), "must be >= {}"), ("maximum", lambda s: is_number & (number > s), "must be <= {}"),
        ):
            if key in schema:
                out.append(_said(broken(schema[key]), shown, message.format(schema[key])))
        if schema.keys() & {"required", "properties", "additionalProperties"}:
            out.append(F.when(is_kind["object"], _joined(self._members(members, schema, path, shown, depth))).otherwise(F.array().cast("array<string>")))
        if "items" in schema or schema.get("uniqueItems"):
            out.append(F.when(is_kind["array"], _joined(self._elements(elements, schema, path, shown, depth))).otherwise(F.array().cast("array<string>")))
        if "oneOf" in schema:
            branches = F.array(*[F.array_compact(self.check(value, s, path, depth + 1, held=True)) for s in schema["oneOf"]])

            def judged(found: Column) -> Column:
                fitting = F.size(F.filter(found, lambda b: F.size(b) == 0))
                missed = _said(fitting != 1, shown, "must match exactly one schema in oneOf")
                return _joined([F.when(fitting == 0, F.flatten(found)).otherwise(F.array().cast("array<string>")), missed])

            out.append(_let(branches, judged))
        return out

    def _members(self, members: Column, schema: dict, path: Column, shown: Column, depth: int) -> list[Column | list[Column]]:
        out, known = [], schema.get("properties", {})
        for name in schema.get("required", ()):
            out.append(_said(F.try_element_at(members, F.lit(name)).isNull(), shown, f"must have required property '{name}'"))
        for name, part in known.items():
            # null in JSON is a variant too, so what is null here isn't there
            inside = F.concat(path, F.lit(f"/{name}"))
            out.append(_let(F.try_element_at(members, F.lit(name)), lambda v, part=part, inside=inside: F.when(v.isNull(), F.array().cast("array<string>")).otherwise(self.check(v, part, inside, depth + 1, held=True))))
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(members)
            if more is False:
                out.append(F.transform(others, lambda e: F.concat(shown, F.lit(" must NOT have additional properties: "), e["key"])))
            else:
                out.append(F.flatten(F.transform(others, lambda e: self.check(e["value"], more, F.concat(path, F.lit("/"), e["key"]), depth + 1))))
        return out

    def _elements(self, elements: Column, schema: dict, path: Column, shown: Column, depth: int) -> list[Column | list[Column]]:
        out = []
        if "items" in schema:
            out.append(F.flatten(F.transform(elements, lambda v, i: self.check(v, schema["items"], F.concat(path, F.lit("/"), i.cast("string")), depth + 1, held=True))))
        if schema.get("uniqueItems"):
            texts = F.transform(elements, lambda v: F.to_json(v))
            out.append(_said(F.size(F.array_distinct(texts)) < F.size(elements), shown, "must NOT have duplicate items"))
        return out


def schema_violations(record: Column, schema: dict) -> Column:
    """array<string>: what a VARIANT breaks of a schema, each as "path message"; a record that is null (no JSON) breaks it as such."""
    return F.when(record.isNull(), F.array(F.lit("/ must be JSON"))).otherwise(F.array_compact(_Compiler(schema).check(record, schema, F.lit(""))))


def schema_judged(rows: DataFrame, text: str, schema: dict) -> DataFrame:
    """rows and `violations` of the JSON column `text` (empty: it keeps the schema), computed once a row."""
    # parsed as a column first: what stands within a lambda is evaluated wherever it is named
    parsed = rows.withColumn("__parsed", F.try_parse_json(text))
    return parsed.withColumn("violations", schema_violations(F.col("__parsed"), schema)).drop("__parsed")


def schema_gate(rows: DataFrame, text: str, schema: dict) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON column `text` keeps the schema, and the others as failures of PARSER_ERROR with their violations."""
    judged = schema_judged(rows, text, schema)
    bad = judged.where(F.size("violations") > 0).withColumns({"status": F.lit("PARSER_ERROR"), "reason": F.lit("OUTPUT_SCHEMA_VIOLATION")})
    return judged.where(F.size("violations") == 0).drop("violations"), bad


def schema_of(kind: T.DataType, rules: dict[str, dict], name: str = "", path: str = "", required: frozenset[str] = frozenset()) -> dict:
    """A JSON schema for the values of a Spark type: structs are objects of all their fields and no others, and null is allowed except where `required` names the path.

    rules (by path, else by field name) are laid over what the type gives.
    """
    if isinstance(kind, T.StructType):
        parts = {f.name: schema_of(f.dataType, rules, f.name, f"{path}.{f.name}".lstrip("."), required) for f in kind.fields}
        out = {"type": "object", "additionalProperties": False, "required": kind.names, "properties": parts}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": schema_of(kind.elementType, rules, name, f"{path}[]", required)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": schema_of(kind.valueType, rules, "", f"{path}{{}}", required)}
    else:
        out = {"type": "boolean" if isinstance(kind, T.BooleanType) else "integer" if isinstance(kind, T.IntegralType) else "number" if isinstance(kind, T.NumericType) else "string"}
    rule = rules.get(path, rules.get(name, {}))
    if path and path not in required and not ({"enum", "const"} & rule.keys()):
        out["type"] = [out["type"], "null"]
    return out | rule
