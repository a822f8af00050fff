"""Hand-written corrections: resolving what they refer to, applying them, closures, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators.spatial import around, box_join, point_box
from pathweave.session import cut_lineage

GEO_REF = r"^geo:(-?[0-9.]+),(-?[0-9.]+),r=([0-9.]+)$"


def resolve(refs: DataFrame, known: DataFrame, places: DataFrame) -> DataFrame:
    """``refs(overlay_id, ref_primary, ref_fallback)`` with ``resolved_to, resolution``.

    ``known(ref, id)`` are all spellings that name an entity (its id, ``osm:way/1``, ``osm:node/2``),
    ``places(id, p)`` where entities are. A primary or else fallback that is known is exact;
    otherwise the one place within the radius of a ``geo:`` reference is spatial, several are
    ambiguous, none has failed.
    """
    k1, k2 = known.select(F.col("ref").alias("ref_primary"), F.col("id").alias("first")), known.select(F.col("ref").alias("ref_fallback"), F.col("id").alias("second"))
    d = refs.join(k1, "ref_primary", "left").join(k2, "ref_fallback", "left")
    ref = F.when(F.col("ref_primary").startswith("geo:"), F.col("ref_primary")).otherwise(F.col("ref_fallback"))
    part = lambda i: F.nullif(F.regexp_extract("geo", GEO_REF, i), F.lit("")).cast("double")
    d = d.withColumn("geo", ref).withColumns({"gp": F.when(F.col("geo").rlike(GEO_REF), geo.point(part(1), part(2))), "r": part(3)})
    open_ = cut_lineage(d.filter(F.col("first").isNull() & F.col("second").isNull() & F.col("gp").isNotNull()).select("overlay_id", "gp", "r"))
    # each reference has a box of its own radius
    near = box_join(open_, places.select(F.col("id").alias("place_id"), F.col("p").alias("pp")), around(F.col("gp"), F.col("r")), point_box(F.col("pp")))
    near = near.filter(geo.haversine(F.col("gp"), F.col("pp")) <= F.col("r")).groupBy("overlay_id").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id"))
    d = d.join(near, "overlay_id", "left")
    exact = F.coalesce("first", "second")
    resolution = F.when(exact.isNotNull(), "exact").when(F.col("n") == 1, "spatial").when(F.col("n") > 1, "ambiguous").otherwise("failed")
    to = F.coalesce(exact, F.when(F.col("n") == 1, F.col("place_id")))
    return d.withColumn("resolution", resolution).withColumn("resolved_to", to).drop("first", "second", "geo", "gp", "r", "n", "place_id")


def repin(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """``entries(file, overlay_id, ref)`` with the content id of spatially resolved references in place of
    theirs. A reference that was a bare ``geo:`` text is replaced whole, its place is not kept."""
    fixed = refs.filter((F.col("resolution") == "spatial") & F.col("resolved_to").rlike("^(node|edge):")).select("file", "overlay_id", "resolved_to")
    d = entries.join(fixed, ["file", "overlay_id"], "left")
    return d.withColumn("repinned", F.col("resolved_to").isNotNull()).withColumn("ref", F.coalesce("resolved_to", "ref")).drop("resolved_to")


def repin_files(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``texts(file, body)`` of overlay files after ``refs(file, overlay_id, resolution, resolved_to)``: ``file, body,
    changed, repinned, skipped``, the last two as lists of ``overlay_id, what``, for each file that spatially resolved
    references name. Every entry with the id takes the content id: in the place of a plain text, or as the
    primary of a pair; a bare ``geo:`` text becomes a pair that keeps no place. A row without a body stands for
    a file that isn't there. Changed files are written anew, keys by name, two blanks to a level.

    Entries are rows here: each is judged and rewritten by itself, and a file is put together again from its own.
    """
    wanted = refs.filter("resolution = 'spatial'").select("file", "overlay_id", "resolved_to").distinct()
    files = wanted.select("file").distinct().join(texts, "file", "left").withColumn("doc", F.try_parse_json("body"))
    entries = files.select("file", F.posexplode(F.try_variant_get("doc", "$.entries", "array<variant>")).alias("at", "entry"))
    entries = entries.withColumn("overlay_id", F.try_variant_get("entry", "$.id", "string"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("entry", path, "variant"))
    text = F.when(kind("$.ref") == "STRING", F.try_variant_get("entry", "$.ref", "string"))
    shape = F.when(text.startswith("geo:"), "place").when(text.isNotNull(), "text").when(kind("$.ref.primary").isNotNull(), "pair")
    met = entries.withColumn("shape", shape).join(wanted.filter(F.col("resolved_to").rlike("^(node|edge):")), ["file", "overlay_id"], "left")
    met = met.withColumn("done", F.col("resolved_to").isNotNull() & F.col("shape").isNotNull())

    # what every wanted reference comes to
    fate = wanted.join(met.filter("done").select("file", "overlay_id", F.lit(True).alias("done")).distinct(), ["file", "overlay_id"], "left")
    fate = fate.join(files.select("file", F.col("body").isNull().alias("absent")), "file")
    why = (
        F.when(F.col("absent"), "file not found")
        .when(~F.coalesce(F.col("resolved_to").rlike("^(node|edge):"), F.lit(False)), F.concat(F.coalesce("resolved_to", F.lit("nothing")), F.lit(" is no content id")))
        .when(F.col("done").isNull(), "no such entry or reference")
    )
    fate = fate.select("file", F.struct("overlay_id", F.coalesce(why, "resolved_to").alias("what")).alias("row"), why.isNull().alias("good"))
    lists = fate.groupBy("file").agg(*[F.array_sort(F.collect_list(F.when(F.col("good") == good, F.col("row")))).alias(name) for name, good in (("repinned", True), ("skipped", False))])

    new = F.to_json(F.struct(F.col("resolved_to").alias("primary"), F.lit(None).cast("string").alias("fallback")), {"ignoreNullFields": "false"})
    quoted = F.to_json(F.array("resolved_to"))
    quoted = F.substring(quoted, 2, F.length(quoted) - 2)
    pair = _with_key(F.try_variant_get("entry", "$.ref", "map<string,variant>"), "primary", quoted)
    ref = F.when(F.col("shape") == "place", new).when(F.col("shape") == "text", quoted).otherwise(pair)
    line = F.when(F.col("done"), _with_key(F.try_variant_get("entry", "$", "map<string,variant>"), "ref", ref)).otherwise(F.to_json("entry"))
    rebuilt = met.select("file", "done", F.struct("at", line.alias("line")).alias("e")).groupBy("file").agg(F.bool_or("done").alias("changed"), F.array_sort(F.collect_list("e")).alias("es"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["line"]), ","), F.lit("]"))
    whole = F.parse_json(_with_key(F.try_variant_get("doc", "$", "map<string,variant>"), "entries", listed))
    d = files.join(rebuilt, "file", "left").join(lists, "file")
    body = F.when(F.col("changed"), F.concat(F.to_json(whole, {"pretty": "true"}), F.lit("\n"))).otherwise(F.col("body"))
    return d.select("file", body.alias("body"), F.coalesce("changed", F.lit(False)).alias("changed"), "repinned", "skipped")


def _with_key(values: Column, key: str, text: Column) -> Column:
    """The JSON text of an object in which ``key`` has the value that ``text`` spells."""
    return F.to_json(F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(text))))


def override(base: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``base`` with the non-null values that ``changes`` has for a key."""
    c = changes.select(key, *[F.col(x).alias(f"new_{x}") for x in columns])
    return base.join(c, key, "left").withColumns({x: F.coalesce(f"new_{x}", x) for x in columns}).drop(*[f"new_{x}" for x in columns])


def without_blocked(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    return edges.join(blocked.select("id"), "id", "left_anti")


def apply_entrances(entrances: DataFrame, actions: DataFrame) -> DataFrame:
    """``entrances(id, buildingId, position, provisional)`` after ``actions(action, id, buildingId, position)``:
    add, move, delete, promote."""
    a = actions.filter("action <> 'add'").groupBy("id").agg(F.bool_or(F.col("action") == "delete").alias("gone"), F.bool_or(F.col("action") == "promote").alias("sure"), F.max_by("position", F.when(F.col("action") == "move", 1)).alias("moved"))
    d = entrances.join(a, "id", "left").filter(~F.coalesce("gone", F.lit(False)))
    d = d.withColumns({"position": F.coalesce("moved", "position"), "provisional": F.when(F.coalesce("sure", F.lit(False)), False).otherwise(F.col("provisional"))}).drop("gone", "sure", "moved")
    return d.unionByName(actions.filter("action = 'add'").select("id", "buildingId", "position", F.lit(False).alias("provisional")), allowMissingColumns=True)


def closed_edges(closures: DataFrame, closure_edges: DataFrame, at: Column) -> DataFrame:
    """``closure_id, edge_id`` of closures in force at a time: from its begin until before its end."""
    active = closures.filter((F.col("from_utc") <= at) & (at < F.coalesce("to_utc", F.lit("9999-12-31").cast("timestamp"))))
    return active.select("closure_id").join(closure_edges, "closure_id")


def open_arcs(arcs: DataFrame, closed: DataFrame) -> DataFrame:
    return arcs.join(closed.select(F.col("edge_id").alias("edge")).distinct(), "edge", "left_anti")


def normalised(name: Column) -> Column:
    """Lower case, without accents and punctuation, single blanks."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N} ]", ""), " +", " "))


def search(aliases: DataFrame, query: str) -> DataFrame:
    """Buildings with an alias that begins with the query."""
    return aliases.filter(F.col("alias_norm").startswith(normalised(F.lit(query)))).groupBy("building_id").agg(F.min("alias").alias("alias")).orderBy("building_id")


def category(type_: Column, supplement: Column) -> Column:
    """The register's type first; the supplement's only where that is absent or says nothing."""
    said = lambda c: F.nullif(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))
    return F.coalesce(said(type_), said(supplement), F.lit("unknown"))


def trace_deviation(trace: DataFrame, routes: DataFrame) -> DataFrame:
    """``trace(route, seq, p)`` against ``routes(route, line)``: largest distance from the line, length error."""
    d = trace.join(routes, "route")
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"])
    g = d.groupBy("route").agg(F.max(geo.distance_to_line(F.col("p"), F.col("line"))).alias("max_m"), geo.length(line).alias("walked_m"), F.first(geo.length(F.col("line"))).alias("route_m"))
    return g.withColumn("length_error_m", F.col("walked_m") - F.col("route_m")).withColumn("correct", F.col("max_m") > 15.0)


def golden(found: DataFrame, expected: DataFrame, metres: float = 2.0) -> DataFrame:
    """Expected routes ``(request, node_ids, length_m)`` that ``found`` doesn't have."""
    f = found.select("request", F.col("node_ids").alias("got"), F.col("length_m").alias("got_m"))
    d = expected.join(f, "request", "left")
    return d.filter(~(F.col("node_ids").eqNullSafe(F.col("got")) & (F.abs(F.col("length_m") - F.col("got_m")) <= metres)) | F.col("got").isNull())
