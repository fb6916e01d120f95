"""Looking inside JSON documents held as text, row by row.

A document is one row, so everything here is an expression over that row and
needs no shuffle.  ``from_json`` into a map keeps the order of the keys and
the raw text of nested values; the variant beside it tells text from structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.issues import lookup
from sievework.functions.numbers import spanish_number

# Search depth, and what joins repeated values.
MAX_DEPTH = 4
JOINER = " · "


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are worked out exactly once per row.

    A plain projection may be merged into its consumers, which repeats a
    costly expression at each use; a one-element ``inline`` is not merged.
    """
    entry = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(entry)))


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


# First letters of a variant's type and what it is in JSON.
_KINDS = {"OBJE": "object", "ARRA": "list", "STRI": "string", "BOOL": "bool", "VOID": "null",
          "BIGI": "number", "DECI": "number", "DOUB": "number", "FLOA": "number"}


def kind_of(variant: Column) -> Column:
    """object, list, string, bool, number or null."""
    # One look-up rather than a chain of tests, each of which would walk the value.
    return lookup(F.substring(F.schema_of_variant(variant), 1, 4), _KINDS)


def shape(text: Column) -> dict[str, Column]:
    """Kind, element count, top-level keys and nested values of a document."""
    variant = parse(text)
    kind = kind_of(variant)
    is_object = kind == "object"
    values = F.map_values(F.from_json(F.when(is_object, text), "map<string,variant>"))
    nested = F.size(F.filter(values, lambda v: kind_of(v).isin("object", "list")))
    return {
        "kind": kind,
        "elements": F.when(kind == "list", F.json_array_length(text)),
        "top_keys": F.when(is_object, F.size(F.json_object_keys(text))),
        "nested_values": F.when(is_object, nested),
    }


def describe(text: Column) -> Column:
    """One-line description of a document for a reader."""
    s = shape(text)
    return (
        F.when(s["kind"] == "list", F.concat(F.lit("Array · "), spanish_number(s["elements"], 0), F.lit(" elementos")))
        .when(s["kind"] == "object", F.concat(F.lit("Objeto · "), spanish_number(s["top_keys"], 0), F.lit(" claves")))
        .when(s["kind"] == "bool", "Valor boolean")
        .when(s["kind"].isNotNull(), F.concat(F.lit("Valor "), s["kind"]))
    )


def document_kind(text: Column) -> Column:
    """Kind of a whole document; null when it is no JSON.

    The first character tells structure apart, so only validity is parsed for.
    """
    valid = parse(text)
    start = F.substring(F.ltrim(text), 1, 1)
    return F.when(valid.isNotNull(), F.when(start == "{", "object").when(start == "[", "list").otherwise(kind_of(valid)))


def _looks_nested(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def quotes_structure(text: Column) -> Column:
    """May some string of the document open with a brace or bracket?

    Members come as text without their quotes, so such a string would pass for
    an object or list.  It has to stand as ``"{``, ``"[`` or with an escape, and
    no other place of valid JSON has a quote before a brace but within a string.
    Where this is false, the first character of a member tells its kind.
    """
    return text.rlike(r'"[{\[]|\\u')


def _entries(text: Column, path: Column, order: Column, doubtful: Column) -> Column:
    """Members of an object that hold a structure: (path, order, text, kind), in document order."""
    # Entries rather than keys and values: within a lambda each mention parses again.
    raw = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.map_values(F.from_json(F.when(doubtful, text), "map<string,variant>"))
    numbered = F.transform(raw, lambda m, i: F.struct(m["key"].alias("k"), m["value"].alias("t"), i.alias("i")))
    kept = F.filter(numbered, lambda m: _looks_nested(m["t"]))
    return F.transform(kept, lambda m: F.struct(
        F.when(path == "", m["k"]).otherwise(F.concat(path, F.lit("."), m["k"])).alias("path"),
        F.concat(order, F.array(m["i"])).alias("order"), m["t"].alias("text"),
        F.when(doubtful, kind_of(F.get(typed, m["i"])))
        .otherwise(F.when(m["t"].startswith("{"), "object").otherwise("list")).alias("kind")))


def record_lists(df, text: str, out: str = "records"):
    """Adds the longest list of records in each document, its ``path`` and whether the document is ``doubtful``.

    Objects are searched down to four levels; a list counts when its first
    element is an object or a list; the first one met wins a tie; lists are
    not searched.
    """
    root = F.array(F.struct(
        F.lit("").alias("path"), F.array().cast("array<int>").alias("order"),
        F.col(text).alias("text"), document_kind(F.col(text)).alias("kind")))
    doubtful = F.col("__doubtful")
    levels, current = ["__l0"], computed(df, {"__l0": root, "__doubtful": quotes_structure(F.col(text))})
    for depth in range(1, MAX_DEPTH + 1):
        objects = F.filter(levels[-1], lambda e: e["kind"] == "object")
        nested = F.transform(objects, lambda e: _entries(e["text"], e["path"], e["order"], doubtful))
        current = computed(current, {f"__l{depth}": F.flatten(nested)})
        levels.append(f"__l{depth}")
    found = F.filter(F.concat(*levels), lambda e: (e["kind"] == "list") & _starts_with_record(e["text"]))
    ranked = F.array_sort(F.transform(found, lambda e: F.struct(
        (-F.json_array_length(e["text"])).alias("neg"), e["order"].alias("order"),
        e["path"].alias("path"), e["text"].alias("text"))))
    best = computed(current, {"__best": F.get(ranked, F.lit(0))})
    return best.select(*df.columns, F.col("__best.path").alias("path"), F.col("__best.text").alias(out), doubtful.alias("doubtful"))


def _starts_with_record(list_text: Column) -> Column:
    """The first element of a list opens with a brace or bracket; text would open with a quote."""
    return list_text.rlike(r"^\s*\[\s*[{\[]")


def item_facts(items: Column) -> dict[str, Column]:
    """Per record: its keys and the text of its first member.

    Null unless the first record has a single key: only then can the records
    share one, and nothing else needs these.
    """
    lone = F.when(F.size(F.json_object_keys(F.get(items, F.lit(0)))) == 1, items)
    values = F.transform(lone, lambda i: F.get(F.map_values(F.from_json(i, "map<string,string>")), F.lit(0)))
    return {"keys": F.transform(lone, F.json_object_keys), "values": values}


def wrap_objects(items: Column, values: Column, doubtful: Column) -> Column:
    """Is the only member of every record an object (and not text that looks like one)?"""
    both = F.arrays_zip(items.alias("i"), values.alias("v"))
    return F.forall(both, lambda b: b["v"].startswith("{") & (~doubtful | (kind_of(
        F.get(F.map_values(F.from_json(b["i"], "map<string,variant>")), F.lit(0))) == "object")))


def shared_key(keys: Column) -> Column:
    """The key, when every record has exactly one and it is the same."""
    name = F.get(F.get(keys, F.lit(0)), F.lit(0))
    alone = F.forall(keys, lambda k: k.isNotNull() & (F.size(k) == 1) & (F.get(k, F.lit(0)) == name))
    return F.when((F.size(keys) > 0) & F.coalesce(alone, F.lit(False)), name)


def items_of(list_text: Column) -> Column:
    """Elements of a list as JSON texts (strings without their quotes)."""
    return F.from_json(list_text, "array<string>")


def are_pair_lists(values: Column) -> Column:
    """Does every record hold a list of objects that carry a text ``name``?"""
    named = F.forall(values, lambda p: F.coalesce(
        (F.json_array_length(p) >= 0) & F.forall(
            F.from_json(p, "array<map<string,variant>>"),
            lambda m: kind_of(F.try_element_at(m, F.lit("name"))) == "string"),
        F.lit(False)))
    return named & F.exists(values, lambda p: F.json_array_length(p) > 0)


def pair_fields(pair_list: Column) -> Column:
    """Name/value pairs of one record as (name, value), in order.

    The value is the first member that is not the name.
    """
    def field(m: Column) -> Column:
        others = F.filter(F.map_keys(m), lambda k: k != "name")
        value = F.try_element_at(m, F.get(others, F.lit(0)))
        return F.struct(F.element_at(m, "name").alias("name"), F.coalesce(value, F.lit("")).alias("value"))

    return F.transform(F.from_json(pair_list, "array<map<string,string>>"), field)
