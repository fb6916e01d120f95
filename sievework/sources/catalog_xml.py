"""DCAT catalogue in RDF/XML.

The document is cut at the end of each dataset while it is read, so a large
catalogue is scanned by many tasks.  Stray markup inside descriptions is
escaped first: it would otherwise swallow what follows it.  Element and
attribute prefixes are dropped, since they are free to differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.json_text import computed
from sievework.functions.metadata import periodicity_months
from sievework.functions.text import category_of, license_label, mime_format
from sievework.functions.xml_text import escape_ampersands, repair_xml
from sievework.session import written_table
from sievework.sources.delimited import pin_splits, place_lines, split_table

_RESOURCE = "STRUCT<_resource: STRING, _VALUE: STRING>"
DATASET_SCHEMA = f"""
  _about STRING, title STRING, description STRING, theme ARRAY<{_RESOURCE}>, keyword ARRAY<STRING>,
  language STRING, publisher {_RESOURCE}, license {_RESOURCE}, issued STRING, modified STRING,
  spatial {_RESOURCE}, identifier {_RESOURCE}, contactPoint {_RESOURCE},
  accrualPeriodicity STRUCT<Frequency: STRUCT<value: STRUCT<DurationDescription:
    STRUCT<months: STRING, days: STRING, years: STRING>>>>,
  distribution ARRAY<STRUCT<Distribution: STRUCT<_about: STRING,
    format: STRUCT<IMT: STRUCT<_value: STRING, _label: STRING>>, accessURL: {_RESOURCE}>>>,
  malformed STRING
"""


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape_descriptions(xml: Column, tag: str = "dct:description") -> Column:
    """Escape ``<`` and ``>`` between each opening tag and its first closing tag."""
    close = f"</{tag}>"
    opening = rf"(?s)^.*?<{tag}[^>]*>"

    def safe(content: Column) -> Column:
        return F.replace(F.replace(content, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def repair(piece: Column) -> Column:
        return _bound(F.regexp_extract(piece, opening, 0), lambda head: F.when(
            head != "", F.concat(head, safe(F.substr(piece, F.length(head) + 1)))).otherwise(piece))

    return _bound(F.split(xml, close), lambda pieces: F.array_join(F.transform(
        pieces, lambda p, i: F.when(i < F.size(pieces) - 1, repair(p)).otherwise(p)), close))


def drop_prefixes(xml: Column) -> Column:
    names = F.regexp_replace(xml, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "$1")
    # Attributes one by one from the tag's name on, values whole: what looks like a prefix inside a value stays.
    attribute = r"""(\s+)(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*\s*=\s*(?:"[^"]*"|'[^']*'))"""
    return F.regexp_replace(names, r"(<[^\s<>/=!?\"']+|(?!^)\G)" + attribute, "$1$2$3")


def dataset_fragments(spark: SparkSession, path: str, tag: str = "dcat:Dataset") -> DataFrame:
    """(source, dataset_index, xml): one row per dataset element, in document order."""
    close = f"</{tag}>"
    pin_splits(spark)
    lines = spark.read.option("lineSep", close).text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"), "value")
    # Written first, so that its size is known: as a small table it goes to the lines, which stay where they were read.
    splits = written_table(split_table(lines).drop("n", "utf8", "first_line"), "splits")
    body = computed(place_lines(lines, splits), {"body": F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1)})
    return body.filter("body <> ''").select(
        F.col("file_id").alias("source"), (F.col("row_no") - 1).alias("dataset_index"),
        F.concat("body", F.lit(close)).alias("xml"))


def parse_datasets(fragments: DataFrame) -> DataFrame:
    """Fields of every dataset; loose ampersands are repaired, what still is no XML has ``d.malformed``.

    The parser itself overlooks prefixes.  Only what it rejects is rewritten by
    expressions, control characters included, and tried again.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    # Once each: a filter on the outcome would otherwise parse again.
    safe = computed(computed(fragments, {"__xml": escape_descriptions(F.col("xml"))}), {"__safe": escape_ampersands(F.col("__xml"))})
    read = computed(safe, {"__d": F.from_xml("__safe", DATASET_SCHEMA, {**options, "ignoreNamespace": "true"})})
    again = F.from_xml(F.when(F.col("__d.malformed").isNotNull(), repair_xml(drop_prefixes(F.col("__xml")))), DATASET_SCHEMA, options)
    tried = computed(read, {"d": F.when(F.col("__d.malformed").isNull(), F.col("__d")).otherwise(again)})
    return tried.drop("xml", "__xml", "__safe", "__d")


def rejected_datasets(parsed: DataFrame) -> DataFrame:
    """(source, dataset_index, xml) of the elements that could not be read."""
    return parsed.filter("d.malformed is not null").select("source", "dataset_index", F.col("d.malformed").alias("xml"))


def _text(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit(""))


def _resource(column: str) -> Column:
    """The resource attribute, else the text."""
    return F.coalesce(F.when(F.trim(F.col(f"{column}._resource")) != "", F.trim(F.col(f"{column}._resource"))),
                      F.trim(F.col(f"{column}._VALUE")), F.lit(""))


def _file_url(dist: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.trim(c))

    return F.coalesce(filled(dist["accessURL"]["_resource"]), filled(dist["accessURL"]["_VALUE"]),
                      filled(dist["_about"]), F.lit(""))


def catalog_files(parsed: DataFrame) -> DataFrame:
    """One row per listed file; files without an address are kept."""
    files = parsed.filter("d.malformed is null").select(
        "source", "dataset_index", F.coalesce("d._about", F.lit("")).alias("dataset_id"),
        _text("d.title").alias("dataset_title"), F.posexplode("d.distribution").alias("idx", "dist"))
    node = F.col("dist.Distribution")
    mime = F.coalesce(F.trim(node["format"]["IMT"]["_value"]), F.lit(""))
    return files.filter(node.isNotNull()).select(
        "source", "dataset_index", "dataset_id", "dataset_title", "idx",
        mime_format(mime).alias("format"), mime.alias("mime"), _file_url(node).alias("url"))


def catalog_datasets(parsed: DataFrame) -> DataFrame:
    """One row per readable dataset with every catalogue field."""
    nodes = F.coalesce(F.col("d.distribution"), F.array())
    themes = F.filter(F.transform(
        F.col("d.theme"), lambda t: F.coalesce(F.trim(t["_resource"]), F.trim(t["_VALUE"]), F.lit(""))),
        lambda t: t != "")
    themes = F.coalesce(themes, F.array().cast("array<string>"))
    keywords = F.coalesce(F.filter(F.transform("d.keyword", F.trim), lambda k: k != ""), F.array().cast("array<string>"))
    urls = F.filter(
        F.transform(nodes, lambda n: F.struct(
            mime_format(F.coalesce(n["Distribution"]["format"]["IMT"]["_value"], F.lit(""))).alias("format"),
            _file_url(n["Distribution"]).alias("url"))),
        lambda f: f["url"] != "")
    duration = "d.accrualPeriodicity.Frequency.value.DurationDescription"
    contact = F.when(_resource("d.contactPoint") != "", _resource("d.contactPoint")).when(
        F.col("d.contactPoint").isNotNull(), "presente").otherwise("")
    return parsed.filter("d.malformed is null").select(
        "source", "dataset_index", F.coalesce("d._about", F.lit("")).alias("dataset_id"),
        _text("d.title").alias("title"), _text("d.description").alias("description"),
        themes.alias("themes"), category_of(themes).alias("category"), keywords.alias("keywords"),
        _text("d.language").alias("language"), _resource("d.publisher").alias("publisher"),
        license_label(_resource("d.license")).alias("license"), _text("d.issued").alias("issued"),
        _text("d.modified").alias("modified"), _resource("d.spatial").alias("spatial"),
        _resource("d.identifier").alias("identifier"), contact.alias("contact_point"),
        periodicity_months(F.col(f"{duration}.months"), F.col(f"{duration}.days"),
                           F.col(f"{duration}.years")).alias("periodicity"),
        urls.alias("files"), F.array_distinct(F.transform(urls, lambda u: u["format"])).alias("formats"))


def read_catalog(spark: SparkSession, path: str, tag: str = "dcat:Dataset") -> tuple[DataFrame, DataFrame]:
    """(datasets, files) of a catalogue document."""
    parsed = parse_datasets(dataset_fragments(spark, path, tag))
    return catalog_datasets(parsed), catalog_files(parsed)
