"""Whole documents held as rows: JSON, GeoJSON, XML family, calendars, packages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import json_text as J
from sievework.functions import scores as S
from sievework.functions.xml_text import tag_scan
from sievework.operators.groups import number_within, running_sum, spread
from sievework.session import checkpoint_dir

# Shapefile parts, inflation limits and GeoJSON types.
REQUIRED_PARTS = (".shp", ".dbf", ".shx")
INFLATE_RATIO = 50
MIN_INFLATED = 64 * 1024 * 1024
MAX_INFLATED = 8 * 1024 * 1024 * 1024
GEOMETRY_TYPES = ("Feature", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString",
                  "MultiPolygon", "GeometryCollection")
GML_GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "MultiGeometry")
#: Hits whose branches one task counts.
HITS_PER_TASK = 100_000
KML_ROOT = "{http://www.opengis.net/kml/2.2}kml"


# --- JSON records ------------------------------------------------------------
def json_records(docs: DataFrame, text: str = "text", key: str = "file_id") -> DataFrame:
    """Documents with their records found: (key, path, layout, items).

    ``layout`` is ``pairs``, ``lists`` or ``objects``; documents without
    records are left out.
    """
    found = J.record_lists(spread(docs.select(key, text)), text).filter("records is not null")
    listed = J.computed(found, {"items": J.items_of(F.col("records"))}).drop(text, "records")
    facts = J.computed(listed, J.item_facts(F.col("items")))
    # A one-key wrapper around every record is taken off once.
    facts = J.computed(facts, {"shared": J.shared_key(F.col("keys"))})
    wraps = F.coalesce(J.wrap_objects(F.col("items"), F.col("values"), F.col("doubtful")), F.lit(False))
    facts = J.computed(facts, {"outer": F.when(F.col("shared").isNotNull() & wraps, F.col("shared"))})
    bare = facts.select(
        key,
        F.when(F.col("outer").isNotNull(), F.concat("path", F.lit("[]."), "outer")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("outer").isNotNull(), F.col("values")).otherwise(F.col("items")).alias("items"))
    inner = J.computed(J.computed(bare, {"u": F.col("items")}).drop("items"), J.item_facts(F.col("u")))
    paired = J.computed(inner, {"pair_key": F.when(
        F.coalesce(J.are_pair_lists(F.col("values")), F.lit(False)), J.shared_key(F.col("keys")))})
    has_pairs = F.col("pair_key").isNotNull()
    # After the search the first element is an object or a list.
    layout = F.when(has_pairs, "pairs").when(
        F.ltrim(F.get("u", F.lit(0))).startswith("["), "lists").otherwise("objects")
    path = F.when(has_pairs, F.concat("path", F.lit("[]."), "pair_key")).otherwise(F.col("path"))
    # Records in pair layout are replaced by their pair lists.
    return paired.select(
        key, path.alias("path"), layout.alias("layout"),
        F.when(has_pairs, F.col("values")).otherwise(F.col("u")).alias("items"))


def record_header(layout: Column, items: Column) -> Column:
    """Column names: first record's keys, list positions, or names as first seen."""
    width = F.array_max(F.transform(items, lambda i: F.coalesce(F.json_array_length(i), F.lit(0))))
    names = F.array_distinct(F.flatten(F.transform(
        items, lambda i: F.transform(J.pair_fields(i), lambda f: f["name"]))))
    numbered = F.when(width > 0, F.transform(
        F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Columna "), i.cast("string"))))
    return (
        F.when(layout == "pairs", names)
        .when(layout == "lists", F.coalesce(numbered, F.array().cast("array<string>")))
        .otherwise(F.json_object_keys(F.get(items, F.lit(0))))
    )


def record_rows(records: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per record: (key, path, row_no, header, tokens, irregular).

    From here on records are ordinary rows and leave their document.
    """
    headed = J.computed(records, {"header": record_header(F.col("layout"), F.col("items"))})
    rows = headed.select(key, "path", "layout", "header", F.posexplode("items").alias("pos", "item"))
    is_object = F.json_object_keys("item").isNotNull()
    staged = J.computed(rows, {
        "pairs": F.when(F.col("layout") == "pairs", J.pair_fields(F.col("item"))),
        "fields": F.when((F.col("layout") == "objects") & is_object, F.from_json("item", "map<string,string>")),
        "listed": F.when(F.col("layout") == "lists", F.from_json("item", "array<string>")),
    })

    def joined(name: Column) -> Column:
        mine = F.filter(F.col("pairs"), lambda p: (p["name"] == name) & (p["value"] != ""))
        return F.array_join(F.transform(mine, lambda p: p["value"]), J.JOINER)

    none = F.array().cast("array<string>")
    tokens = (
        F.when(F.col("layout") == "pairs", F.transform("header", joined))
        .when(F.col("layout") == "lists", F.coalesce(F.transform("listed", lambda c: F.coalesce(c, F.lit(""))), none))
        .when(F.col("fields").isNotNull(), F.transform(
            "header", lambda h: F.coalesce(F.try_element_at(F.col("fields"), h), F.lit(""))))
        .otherwise(F.array(F.coalesce("item", F.lit(""))))
    )
    present = F.when(F.col("layout") == "pairs", F.transform("pairs", lambda p: p["name"])).otherwise(F.map_keys("fields"))
    missing = F.size(F.array_except("header", F.coalesce(present, none))) > 0
    irregular = F.when(F.col("layout") == "lists", False).otherwise(F.coalesce(missing, F.lit(True)))
    return staged.select(
        key, "path", (F.col("pos") + 2).cast("bigint").alias("row_no"), "header",
        tokens.alias("tokens"), irregular.alias("irregular"))


def record_tables(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Size of each record table: rows, columns, irregular records."""
    return rows.groupBy(key, "path").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("header")).alias("columns"),
        F.count_if("irregular").alias("irregular_records"))


def json_outcome(docs: DataFrame, text: str = "text") -> DataFrame:
    """Shape of each document, and the verdict on those without records."""
    shaped = docs.withColumns(J.shape(F.col(text)))
    empty = F.coalesce(F.col("elements"), F.col("top_keys")) == 0
    code = F.when(F.col("kind").isNull(), "json-invalido").when(
        F.coalesce(empty, F.col("kind") == "null"), "sin-contenido")
    return shaped.withColumn("code", code).withColumn("score", F.when(F.col("code").isNotNull(), 0).otherwise(100))


def json_nodes(docs: DataFrame, text: str = "text", key: str = "file_id") -> DataFrame:
    """Every node below the root of every document, however deep: (key, path, name, leaf, ends, depth).

    The documents are walked level by level.  The frontier, one row per object
    or list still to be opened, is a table in the shared folder: nodes leave
    their document at the first level, so a wide document is spread over tasks
    from then on, and the walk ends with an empty frontier.  It is held as text,
    since a variant would carry the key dictionary of the whole document in
    each row.

    List positions are written as ``[n]`` and have no name; ``leaf`` is the
    text of a value, null for objects and lists; ``ends`` are the lengths of the
    paths above, each of which is a prefix of ``path``.  Null texts, texts
    that are no JSON and lone values have no nodes; a repeated document gives
    its nodes again.  The parser's limits (1 000 levels, 128 MB) hold.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/json-nodes-{uuid.uuid4().hex}"
    frontier = docs.select(key, F.lit("").alias("path"), F.array().cast("array<int>").alias("ends"), F.col(text).alias("branch"))
    depth = 1
    while True:
        level = f"{folder}/depth={depth}"
        _json_children(spread(frontier), key).write.parquet(level)
        opened = spark.read.parquet(level).filter("branch is not null")
        if opened.isEmpty():
            break
        frontier, depth = opened, depth + 1
    return spark.read.parquet(folder).select(key, "path", "name", "leaf", "ends", "depth")


def _json_children(frontier: DataFrame, key: str) -> DataFrame:
    """Members of each object and elements of each list, ``branch`` being the text of those to be opened in turn."""
    parsed = frontier.select(
        F.col(key).alias("__key"), F.col("path").alias("__path"), F.col("ends").alias("__ends"), J.parse(F.col("branch")).alias("__variant"))
    member = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__variant").outer())).select(
        "__key", "__path", "__ends", F.col("key").alias("name"), "pos", F.col("value").alias("__value"), F.to_json("value").alias("__text"))
    is_branch = F.col("__text").startswith("{") | F.col("__text").startswith("[")
    path = (
        F.when(F.col("name").isNull(), F.concat("__path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        .when(F.col("__path") == "", F.col("name")).otherwise(F.concat("__path", F.lit("."), "name")))
    # Only strings are written with quotes: theirs is the text within.
    plain = F.when(F.col("__text").startswith('"'), F.col("__value").cast("string")).otherwise(F.col("__text"))
    return member.select(
        F.col("__key").alias(key), path.alias("path"), "name", F.when(~is_branch, plain).alias("leaf"),
        F.concat("__ends", F.array(F.length("__path"))).alias("ends"), F.when(is_branch, F.col("__text")).alias("branch"))


def search_json(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose key or leaf value contains the needle; none for a blank one."""
    n = needle.strip().lower()
    hit = F.coalesce(F.lower("name").contains(n), F.lit(False)) | F.coalesce(F.lower("leaf").contains(n), F.lit(False))
    return nodes.filter(hit & F.lit(n != ""))


def open_json_paths(hits: DataFrame, key: str = "file_id") -> DataFrame:
    """Branches to unfold so that every hit is seen: (key, path, hits below), the root being the empty path."""
    # Nearly every branch is a group of its own, so what a task holds before the exchange follows from the hits it reads.
    tasks = -(-hits.count() // HITS_PER_TASK) or 1
    above = hits.repartition(tasks).select(key, "path", F.explode("ends").alias("end"))
    return above.groupBy(key, F.expr("left(path, end)").alias("path")).agg(F.count(F.lit(1)).alias("hits"))


# --- GeoJSON -------------------------------------------------------------------
def geojson_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Type, features, null geometries, verdict and score of each document."""
    # Features as text: one that is no object must not spoil the others.
    schema = "type STRING, features ARRAY<STRING>"
    kind = J.document_kind(F.col(text))
    staged = docs.withColumns({"__kind": kind, "__g": F.from_json(F.when(kind == "object", F.col(text)), schema)})
    is_collection = F.col("__g.type") == "FeatureCollection"
    features = F.coalesce(F.size("__g.features"), F.lit(0))
    features = F.when(features < 0, 0).otherwise(features)
    nulls = F.size(F.filter("__g.features", lambda f: F.get_json_object(f, "$.geometry").isNull()))
    nulls = F.when(features > 0, nulls).otherwise(0)
    counted = staged.withColumns({
        "type": F.col("__g.type"),
        "features": F.when(is_collection, features), "null_geometries": F.when(is_collection, nulls)})
    known = F.coalesce(F.col("type").isin(*GEOMETRY_TYPES), F.lit(False))
    code = (
        F.when(F.col("__kind").isNull(), "geojson-invalido")
        .when(F.col("__kind") != "object", "raiz-invalida")
        .when(F.col("null_geometries") > 0, "geometria-nula")
        .when(F.col("features") == 0, "sin-features")
        .when(F.col("features").isNull() & ~known, "tipo-desconocido")
    )
    score = (
        F.when(F.col("features").isNotNull(),
               F.lit(100) - F.when(F.col("null_geometries") > 0, 15).otherwise(0)
               - F.when(F.col("features") == 0, 10).otherwise(0))
        .when(known, 100).otherwise(0)
    )
    return counted.withColumns({"code": code, "score": score, "ok": code.isNull()}).drop("__kind", "__g")


def null_geometries(features: DataFrame, layer: str = "layer_id") -> DataFrame:
    """Records of a feature table without geometry, as row findings."""
    return features.filter("geometry is null or trim(geometry) = ''").select(
        F.col(layer).alias("file_id"), F.lit("geometria-nula").alias("code"), F.col("record_no").alias("row_no"))


def score_layers(layers: DataFrame, features: DataFrame, layer: str = "layer_id") -> DataFrame:
    """Feature layers: parts missing, null geometries, score and verdict.

    ``layers`` has ``missing_parts`` (array) and ``has_projection``.
    """
    empty = F.col("geometry").isNull() | (F.trim("geometry") == "")
    counts = features.groupBy(layer).agg(F.count(F.lit(1)).alias("features"), F.count_if(empty).alias("null_geometries"))
    joined = layers.join(counts, layer, "left").withColumns({
        "features": F.coalesce("features", F.lit(0)), "null_geometries": F.coalesce("null_geometries", F.lit(0))})
    side = F.size(F.filter("missing_parts", lambda p: p != ".shp"))
    penalised = side + F.when(F.col("has_projection"), 0).otherwise(1)
    has_error = F.array_contains("missing_parts", ".shp") | (F.col("null_geometries") > 0) | (F.col("features") == 0)
    return joined.withColumns({
        "score": S.layer_score(penalised, F.col("null_geometries"), F.col("features")), "ok": ~has_error})


def audit_manifest(members: DataFrame, archive: str = "archive_id") -> DataFrame:
    """Archives from their member list: missing parts and inflation check.

    ``members``: (archive, name, size, zip_size).  Only flags and sums are
    carried, so an archive with very many members is combined map-side.
    """
    name = F.lower("name")
    grouped = members.groupBy(archive).agg(
        *[F.bool_or(name.endswith(p)).alias(f"has{p}".replace(".", "_")) for p in (*REQUIRED_PARTS, ".prj")],
        F.sum("size").alias("inflated"), F.max("zip_size").alias("zip_size"))
    cap = F.least(F.lit(MAX_INFLATED), F.greatest(F.lit(MIN_INFLATED), F.col("zip_size") * INFLATE_RATIO))
    missing = F.array_compact(F.array(*[
        F.when(~F.col(f"has{p}".replace(".", "_")), p) for p in REQUIRED_PARTS]))
    code = F.when(~F.col("has_shp"), "shp-faltante").when(F.col("inflated") > cap, "paquete-desproporcionado")
    return grouped.select(
        archive, "inflated", missing.alias("missing_parts"), F.col("has_prj").alias("has_projection"),
        code.alias("code"), F.when(code == "shp-faltante", 0).cast("int").alias("score"))


# --- XML family ----------------------------------------------------------------
def _sum_counts(*names: str) -> Column:
    return sum((F.coalesce(F.try_element_at(F.col("counts"), F.lit(n)), F.lit(0)) for n in names[1:]),
               F.coalesce(F.try_element_at(F.col("counts"), F.lit(names[0])), F.lit(0)))


def xml_inventory(docs: DataFrame, text: str = "text") -> DataFrame:
    """Well-formedness, root, total elements and counts by local name, after repair where that was needed."""
    return tag_scan(docs, text, "__x", mend=True).select(
        *docs.columns, F.col("__x.ok").alias("well_formed"), F.col("__x.mended").alias("repaired"),
        F.col("__x.root").alias("root"), F.col("__x.total").alias("total_elements"), F.col("__x.counts").alias("counts"))


def entity_count(kind: Column) -> Column:
    """Entities a format is about; a plain XML document has none to count."""
    members = _sum_counts("featureMember", "featureMembers")
    return (
        F.when(kind == "RSS", _sum_counts("item"))
        .when(kind == "KML", _sum_counts("Placemark"))
        .when(kind == "RDF", _sum_counts("Description", "Dataset", "Distribution", "Catalog"))
        .when(kind == "GML", F.when(members == 0, _sum_counts("member")).otherwise(members))
    )


def gml_geometries() -> Column:
    return _sum_counts(*GML_GEOMETRIES)


def score_xml(inventory: DataFrame, kind: str = "kind") -> DataFrame:
    """Verdict per document: not well formed, wrong root, no entities, repaired."""
    k = F.col(kind)
    counted = inventory.withColumn("entities", F.when(F.col("well_formed"), entity_count(k)))
    code = (
        F.when(~F.coalesce(F.col("well_formed"), F.lit(False)), "xml-no-bien-formado")
        .when((k == "KML") & (F.col("root") != KML_ROOT), "raiz-invalida")
        .when(F.col("entities") == 0, "sin-entidades")
        .when(F.col("repaired"), "xml-reparado")
    )
    fatal = F.coalesce(code.isin("xml-no-bien-formado", "raiz-invalida", "sin-entidades"), F.lit(False))
    return counted.withColumns({"code": code, "score": F.when(fatal, 0).otherwise(100), "ok": ~fatal})


def service_inventory(inventory: DataFrame, service: str = "service") -> DataFrame:
    """Stored capability documents: layers or feature types offered."""
    local = F.regexp_replace("root", r"^\{.*\}", "")
    offered = F.when(F.col(service) == "WMS", _sum_counts("Layer")).otherwise(_sum_counts("FeatureType"))
    answers = F.coalesce(F.col("well_formed") & local.contains("Capabilities"), F.lit(False))
    counted = inventory.withColumn("offered", F.when(answers, offered))
    code = (
        F.when(F.col("offered").isNull(), "servicio-no-disponible")
        .when((F.col("offered") == 0) & (F.col(service) == "WMS"), "sin-capas")
        .when(F.col("offered") == 0, "sin-feature-types")
    )
    score = F.when(F.col("offered").isNull(), 0).when(F.col("offered") == 0, 50).otherwise(100)
    return counted.withColumns({"code": code, "score": score, "ok": code.isNull()})


# --- calendars -----------------------------------------------------------------
def calendar_components(docs: DataFrame, text: str = "text", key: str = "file_id") -> DataFrame:
    """One row per component of each calendar: (key, name)."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"(?im)^BEGIN:([A-Z-]+)\s*$"), F.lit(1))
    return docs.select(key, F.explode(names).alias("name")).withColumn("name", F.upper("name"))


def calendar_outcome(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds events, todos, components, bad_lines, codes, score and ok of each calendar."""
    lines = F.split(F.regexp_replace(F.col(text), r"\r?\n[ \t]", ""), r"\r?\n")
    bad = F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(r"^[A-Za-z0-9-]+(;[^:]*)?:")))
    components = F.regexp_extract_all(F.col(text), F.lit(r"(?im)^BEGIN:([A-Z-]+)\s*$"), F.lit(1))

    def count(name: str) -> Column:
        return F.size(F.filter(components, lambda c: F.upper(c) == name))

    counted = J.computed(docs, {
        "events": count("VEVENT"), "todos": count("VTODO"), "components": F.size(components), "bad_lines": bad, "__c": count("VCALENDAR")})
    broken = F.col("__c") == 0
    empty = (F.col("events") == 0) & (F.col("todos") == 0)
    kinds = F.array_compact(F.array(
        F.when(broken, "ical-invalido"), F.when(~broken & (F.col("bad_lines") > 0), "errores-linea"),
        F.when(~broken & empty, "sin-eventos")))
    return counted.withColumn("codes", kinds).withColumns({
        "score": F.when(broken, 0).otherwise(F.lit(100) - F.size("codes") * 5), "ok": F.size("codes") == 0}).drop("__c")


def audit_calendars(docs: DataFrame, text: str = "text", key: str = "file_id") -> DataFrame:
    """Events, tasks and malformed lines per calendar, with score and verdict."""
    return calendar_outcome(docs.select(key, text), text).drop(text)


# --- rings of shapes -------------------------------------------------------------
def rings_to_polygons(rings: DataFrame, shape: str = "shape_id", position: str = "ring_no",
                      area: str = "area", points: str = "n_points") -> DataFrame:
    """Adds ``polygon``: an outer ring opens one, holes join the one before.

    Rings of fewer than four points are no rings.  A leading hole opens a
    polygon of its own.  Shapes of any number of rings are handled in blocks.
    """
    valid = rings.filter(F.col(points) >= 4)
    ranked = number_within(valid, [shape], position, "__k")
    opens = F.when((F.col(area) >= 0) | (F.col("__k") == 1), 1).otherwise(0)
    summed = running_sum(ranked.withColumn("__o", opens), [shape], position, "__o", "polygon")
    return summed.withColumn("is_hole", F.col("__o") == 0).drop("__k", "__o")


# --- dispatch by format ------------------------------------------------------------
def audit_by_format(docs: DataFrame, audits: dict[str, Callable[[DataFrame], DataFrame]],
                    default: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each format through its own audit, results side by side.

    The registry is the extension point: format name to a function from
    documents to results.
    """
    parts = [audit(docs.filter(F.col("format") == fmt)) for fmt, audit in audits.items()]
    if default is not None:
        parts.append(default(docs.filter(~F.col("format").isin(*audits))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
