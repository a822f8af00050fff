"""JSON Schema as a Column: what a VARIANT value breaks, by path.

A schema is turned, once and on the driver, into one expression over a VARIANT column. Objects
are looked into by path, arrays by higher-order functions, so nothing leaves the JVM and
documents are checked wherever their rows are. Keywords that aren't known are refused, as a check
that passes over them would mean nothing; so are references to other files and to themselves.

A value of the wrong type has that one fault. ``additionalProperties`` closes an object if it is
false; a schema there isn't applied. ``format`` says nothing that is checked.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that carry a check, and those that only describe.
CHECKED = ("type", "required", "additionalProperties", "properties", "$ref", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "pattern", "minLength", "enum", "const", "allOf", "if", "then")
SILENT = ("$schema", "$id", "title", "$defs", "format")
#: What VARIANT calls the types of JSON.
KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "null": "^VOID"}
MOST = 100


class Refused(ValueError):
    """The schema says something that this check doesn't know."""


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one_of(value: Column, kind: Column, wanted: list) -> Column:
    hit = F.lit(False)
    for w in wanted:
        if isinstance(w, (list, dict)):
            raise Refused("const and enum of arrays or objects")
        name = "null" if w is None else "boolean" if isinstance(w, bool) else "string" if isinstance(w, str) else "number"
        same = kind.rlike(KINDS[name])
        if name == "number":
            same = same & (F.try_variant_get(value, "$", "double") == float(w))
        elif name != "null":
            same = same & (F.try_variant_get(value, "$", "string") == (str(w).lower() if name == "boolean" else w))
        hit = hit | same
    return F.coalesce(hit, F.lit(False))


def faults(schema: dict, value: Column, path: Column, root: dict | None = None, within: tuple[str, ...] = ()) -> Column:
    """The faults of a VARIANT as ``array<string>``, each beginning with its path."""
    root = schema if root is None else root
    for keyword in schema:
        if keyword not in CHECKED and keyword not in SILENT:
            raise Refused(f"keyword {keyword}")
    if "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/") or ref in within:
            raise Refused(f"reference {ref}")
        there = root
        for step in ref[2:].split("/"):
            there = there[step]
        return faults(there, value, path, root, (*within, ref))
    empty = F.array().cast("array<string>")
    where = F.when(path == "", "<root>").otherwise(path)

    def checks(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        say = lambda *parts: F.concat(where, F.lit(": "), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
        shown = F.to_json(v)
        rules: list[tuple[Column, Column]] = []  # what must not hold, and what is said then
        lists: list[Column] = []

        def only(name: str, wrong: Column, *said: Column | str) -> None:
            rules.append((kind.rlike(KINDS[name]) & wrong, say(*said)))

        if "const" in schema:
            rules.append((~_one_of(v, kind, [schema["const"]]), say(shown, f" isn't {json.dumps(schema['const'])}")))
        if "enum" in schema:
            rules.append((~_one_of(v, kind, schema["enum"]), say(shown, f" isn't one of {json.dumps(schema['enum'])}")))
        text, number, items = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "array<variant>")
        if "pattern" in schema:
            only("string", ~text.rlike(schema["pattern"]), shown, f" doesn't match {schema['pattern']}")
        if "minLength" in schema:
            only("string", F.length(text) < schema["minLength"], shown, f" is shorter than {schema['minLength']}")
        for keyword, wrong, said in (("minimum", lambda m: number < m, "less than"), ("maximum", lambda m: number > m, "more than"), ("exclusiveMinimum", lambda m: number <= m, "not more than")):
            if keyword in schema:
                only("number", wrong(float(schema[keyword])), shown, f" is {said} {schema[keyword]}")
        for keyword, wrong, said in (("minItems", lambda m: F.size(items) < m, "fewer than"), ("maxItems", lambda m: F.size(items) > m, "more than")):
            if keyword in schema:
                only("array", wrong(schema[keyword]), F.size(items).cast("string"), f" items are {said} {schema[keyword]}")
        of = schema.get("items")
        element = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        if isinstance(of, dict):
            inner = F.flatten(F.transform(items, lambda x, i: faults(of, x, element(i), root, within)))
            lists.append(F.when(kind.rlike(KINDS["array"]), inner).otherwise(empty))
        elif isinstance(of, list):
            for i, one in enumerate(of):
                lists.append(F.when(kind.rlike(KINDS["array"]) & (F.size(items) > i), faults(one, F.get(items, F.lit(i)), element(F.lit(i)), root, within)).otherwise(empty))
        key = lambda name: F.try_variant_get(v, '$["' + name.replace('"', '\\"') + '"]', "variant")
        for name in schema.get("required", []):
            only("object", key(name).isNull(), f"{name} is missing")
        properties = schema.get("properties", {})
        for name, one in properties.items():
            child = F.concat(F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit("."))), F.lit(name))
            inner = faults(one, key(name), child, root, within)
            lists.append(F.when(kind.rlike(KINDS["object"]) & key(name).isNotNull(), inner).otherwise(empty))
        if schema.get("additionalProperties", True) is False:
            names = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, properties)).cast("array<string>")))
            only("object", F.size(names) > 0, "unexpected ", F.array_join(names, ", "))
        own = F.array_compact(F.array(*[F.when(wrong, said) for wrong, said in rules])) if rules else empty
        every = F.concat(own, *lists) if lists else own
        if "type" in schema:
            types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            if unknown := [t for t in types if t not in KINDS]:
                raise Refused(f"type {unknown[0]}")
            fits = F.lit(False)
            for t in types:
                fits = fits | kind.rlike(KINDS[t])
            every = F.when(fits, every).otherwise(F.array(say(shown, f" isn't of type {' or '.join(types)}")))
        for one in schema.get("allOf", []):
            every = F.concat(faults(one, v, path, root, within), every)
        if "if" in schema:
            met = F.size(faults(schema["if"], v, path, root, within)) == 0
            then = faults(schema.get("then", {}), v, path, root, within)
            every = F.concat(F.when(met, then).otherwise(empty), every)
        return every

    return _bound(value, checks)


def document_faults(documents: DataFrame, schema: dict, *, document: str = "doc", key: str = "file", most: int | None = MOST) -> DataFrame:
    """``key, fault`` of ``documents(key, doc)`` with VARIANT documents, the first ``most`` of each by part and place
    (None: all). The elements of a document's own arrays are rows of their own, so that a large document's are
    checked by many tasks."""
    shell = dict(schema)
    shell["properties"] = {n: {k: v for k, v in p.items() if k != "items" or not isinstance(v, dict)} for n, p in schema.get("properties", {}).items()}
    part = lambda n: F.lit(n).cast("int").alias("part")
    out = documents.select(key, part(0), F.lit(0).alias("at"), F.posexplode(faults(shell, F.col(document), F.lit(""), schema)).alias("nth", "fault"))
    for n, (name, one) in enumerate(schema.get("properties", {}).items(), 1):
        of = one.get("items")
        if isinstance(of, dict):
            rows = documents.select(key, F.posexplode(F.try_variant_get(document, f'$["{name}"]', "array<variant>")).alias("at", "x"))
            rows = rows.repartition(key, "at")
            path = F.concat(F.lit(f"{name}["), F.col("at").cast("string"), F.lit("]"))
            out = out.unionByName(rows.select(key, part(n), "at", F.posexplode(faults(of, F.col("x"), path, schema)).alias("nth", "fault")))
    if most is not None:
        from pyspark.sql.window import Window as W

        out = out.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("part", "at", "nth"))).filter(F.col("r") <= most)
    return out.select(key, "part", "at", "fault")
