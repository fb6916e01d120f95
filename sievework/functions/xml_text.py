"""XML documents held as text: a scan of their tags, and repair.

Everything is an expression over the document's row.  Spark's own XML parser
decides whether a document is well formed up to the end of its root; tags are
then read off by one regular expression, which is safe on a document that
parses.  XPath would parse once per count and fail the job on a malformed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.json_text import computed

# What is no element: comments, CDATA sections (a bracket of theirs stays, as text), instructions, the document type.
_ASIDE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\](\])>|<\?.*?\?>|<!DOCTYPE[^\[>]*+(?:\[.*?\]\s*+)?>"
# A tag; possessive, so that neither many attributes nor long values cost stack.
_TAG = r"""<[^<>"'!?]++(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
# Text between tags, up to where the next one opens, and values of attributes: what is left are names.
_NOT_NAMES = r"""(>)[^<]*+|\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""
_CORRUPT = "_corrupt"
# Prefixes that need no declaration.
_BOUND = ("xml", "xmlns")


def parses(text: Column) -> Column:
    """Does Spark's XML parser accept the document up to the end of its root element?"""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return F.from_xml(text, f"{_CORRUPT} string", options)[_CORRUPT].isNull()


def _roots(tags: Column) -> Column:
    """Elements at the top level of a list of tags, an end tag too many counting as one: depth below 2**32, roots above it."""
    one = F.lit(1 << 32).cast("bigint")
    final = F.aggregate(tags, F.lit(0).cast("bigint"), lambda state, tag: F.when(
        tag.startswith("</"), state + F.when(state % one == 0, one).otherwise(-1)).otherwise(
        state + F.when(state % one == 0, one).otherwise(0) + F.when(tag.endswith("/>"), 0).otherwise(1)))
    return F.floor(final / one)


def _run_lengths(values: Column) -> Column:
    """How often each value of a sorted array stands in it, as a map."""
    last = F.size(values)
    starts = F.when(last > 0, F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1))))
    return F.map_from_entries(F.transform(starts, lambda i, k: F.struct(
        F.get(values, i).alias("key"), (F.coalesce(F.get(starts, k + 1), last) - i).alias("value"))))


def tag_scan(docs: DataFrame, text: str, out: str, mend: bool = False) -> DataFrame:
    """Adds ``out``: (ok, mended, root, total, counts by local name) of each document.

    ``root`` is ``{namespace}name``.  Not ok: what the parser rejects, more than
    one root or text behind it, prefixes nobody declares.  Null text gives null.
    With ``mend`` a document the parser rejects is repaired and tried again.
    A prefix counts as declared wherever the document declares it, and entities
    of a document type are not expanded, so their use is not well formed; the
    parser's own limits (1 000 attributes of one tag, 1 000 levels) hold.
    """
    c = F.col
    judged = computed(docs, {"__valid": F.when(c(text).isNotNull(), parses(c(text)))})
    if mend:
        judged = computed(judged, {"__mended": F.when(~c("__valid"), repair_xml(c(text)))})
        judged = computed(judged, {"__again": F.when(c("__mended").isNotNull(), parses(c("__mended")))})
        use = F.when(c("__valid"), c(text)).when(c("__again"), c("__mended"))
    else:
        use = F.when(c("__valid"), c(text))
    used = computed(judged, {"__used": use})
    aside = c("__used").contains("<!") | c("__used").contains("<?")
    bare = computed(used, {"__bare": F.when(aside, F.regexp_replace("__used", _ASIDE, "$1")).otherwise(c("__used"))})
    # No value of an attribute and no text holds a <, so every one left opens a tag.
    read = computed(bare, {
        "__elements": F.regexp_extract_all("__bare", F.lit(r"<([^\s/>]++)"), F.lit(1)), "__last": F.substring_index("__bare", "</", -1)})
    # Wanted where there are colons, for prefixes.
    named = computed(read, {"__names": F.when(c("__bare").contains(":"), F.regexp_replace("__bare", _NOT_NAMES, "$1"))})
    tags = F.regexp_extract_all("__bare", F.lit(f"({_TAG})"), F.lit(1))
    root = F.get("__elements", F.lit(0))
    prefixes = F.regexp_extract_all("__names", F.lit(r"(?:<|\s)([^\s:/<>]++):"), F.lit(1))
    declared = F.regexp_extract_all("__names", F.lit(r"\sxmlns:([^\s/<>]++)"), F.lit(1))
    free = F.size(F.array_except(prefixes, F.concat(declared, F.array(*map(F.lit, _BOUND)))))
    bound = F.when(c("__names").contains(":"), free == 0).otherwise(True)
    # A root whose name stands once, and whose first end tag is the last of all, holds everything; otherwise tags are counted through.
    closes = F.length("__bare") - F.length("__last") - 1 == F.instr(c("__bare"), F.concat(F.lit("</"), root))
    lone = closes & (F.size(F.filter("__elements", lambda e: e == root)) == 1) & (
        F.regexp_extract("__last", r"^([^\s>]++)\s*+>\s*+$", 1) == root)
    single = F.when(lone, True).otherwise((_roots(tags) == 1) & c("__bare").rlike(f"(?:{_TAG})\\s*+$"))
    known = c("__used").isNotNull()
    prefix = F.when(F.instr(root, ":") > 0, F.concat(F.lit(":\\Q"), F.substring_index(root, ":", 1), F.lit("\\E"))).otherwise("")
    uri = F.call_function("regexp_extract", F.regexp_extract("__bare", _TAG, 0), F.concat(
        F.lit("\\sxmlns"), prefix, F.lit(r"""\s*=\s*(["'])(.*?)\1""")), F.lit(2))
    settled = computed(named, {
        "__ok": F.when(c(text).isNotNull(), F.when(known, bound & single).otherwise(False)),
        "__uri": F.when(c("__bare").contains("xmlns"), uri).otherwise(""),
        "__locals": F.sort_array(F.when(c("__names").contains(":"), F.transform("__elements", lambda e: F.substring_index(e, ":", -1)))
                                 .otherwise(c("__elements")))})
    local = F.substring_index(root, ":", -1)
    facts = {
        "root": F.when(c("__uri") != "", F.concat(F.lit("{"), c("__uri"), F.lit("}"), local)).otherwise(local),
        "total": F.size("__elements"), "counts": _run_lengths(c("__locals"))}
    mended = c("__ok") & ~c("__valid")
    return computed(settled, {out: F.struct(
        c("__ok").alias("ok"), mended.alias("mended"),
        *[F.when(c("__ok"), value).alias(name) for name, value in facts.items()])}).select(*docs.columns, out)


def escape_ampersands(text: Column) -> Column:
    """Escape loose ampersands; texts with none but those of the five named entities are left as they are."""
    rest = text
    for name in ("amp", "lt", "gt", "quot", "apos"):
        rest = F.replace(rest, F.lit(f"&{name};"), F.lit(""))
    escaped = F.regexp_replace(text, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")
    return F.when(rest.contains("&"), escaped).otherwise(text)


def repair_xml(text: Column) -> Column:
    """Escape loose ampersands and drop control characters XML does not allow."""
    escaped = F.regexp_replace(text, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")
    return F.regexp_replace(escaped, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
