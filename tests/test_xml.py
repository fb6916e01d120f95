"""Tag scan against the standard library's parser, and its plan."""

import random
import xml.etree.ElementTree as ET
from collections import Counter

from pyspark.sql import functions as F

from sievework.functions.xml_text import tag_scan
from sievework.operators.documents import xml_inventory

DOCUMENTS = [
    "<a><b/></a>", "<a><b></a>", "<a>A & B</a>", "<a>x\x01</a>", "<a>", "<a/><b/>", "<a/>tail", "  <a/>  ", "<a></a><a></a>",
    "<a x='1' x='2'/>", "<p:a/>", "<a x=1/>", "<a b='<'/>", "<a b='>' c=\"/>\"/>", "<!-- <c> --><a/>", "<a>&nbsp;</a>", "", "plain",
    "<a><![CDATA[ <b> & ]]></a>", "<a><!-- -- --></a>", "<?xml version='1.0' encoding='utf-8'?><a/>", " <?xml version='1.0'?><a/>",
    "<a>]]></a>", "<a><b><c></b></c></a>", "<a xmlns:p='u'><p:b/></a>", "<a>&#0;</a>", "<a>&#x41;</a>", "<a><?pi <x>?></a>",
    "<a b='1'c='2'/>", "<1a/>", "<a\n/>", "<é>ñ</é>", "<a/><!-- end -->", "<a x='&'/>", "<a></a >", "<a><a/></a>", "<a><a/></a><a/>",
    "<a x:y='1'/>", "<a xmlns:x='u' x:y='1'/>", "<a xml:lang='es'/>", "<x xmlns='d'><y/></x>", "<k:x xmlns='d' xmlns:k='e'><y/></k:x>",
    "<a>don't \"quote\"<b/>it's</a>", "<!DOCTYPE a [<!ELEMENT a ANY>]><a/>", "<!DOCTYPE a SYSTEM 'x'><a/>", "<a/> x>", "<a>" + "<b>t</b>" * 3000 + "</a>",
    "<a " + " ".join(f"x{k}='{k}'" for k in range(900)) + "/>", "<a x='" + "v" * 100_000 + "'><!--" + "-x" * 50_000 + "--></a>",
    "<a>" * 200 + "</a>" * 200,
]


def plain(text):
    """(ok, root, total, counts) by a full parse."""
    if text is None:
        return None, None, None, None
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError:
        return False, None, None, None
    counts = Counter(e.tag.split("}")[-1] for e in root.iter())
    return True, root.tag, sum(counts.values()), dict(counts)


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.x for r in tag_scan(rows, "text", "x").collect()}
    return [(got[k].ok, got[k].root, got[k].total, got[k].counts) for k in range(len(texts))]


def test_scan_equals_a_parse(spark):
    for text, got in zip([*DOCUMENTS, None], scanned(spark, [*DOCUMENTS, None])):
        assert got == plain(text), text and text[:80]


def test_random_markup(spark):
    rng = random.Random(7)
    parts = ["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "t", "<!--<a>-->", "<![CDATA[</b>]]>", "&amp;", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(600)]
    wrapped = texts + [f"<r>{t}</r>" for t in texts] + ["<a>" + t + "</a>" for t in DOCUMENTS]
    for text, got in zip(wrapped, scanned(spark, wrapped)):
        assert got == plain(text), text[:80]


def test_repair_and_plan(spark):
    rows = spark.createDataFrame([(1, "<a>R & D<b/></a>"), (2, "<a>\x02</a>"), (3, "<a><b></a>"), (4, "<a/>"), (5, None)], "id int, text string")
    out = xml_inventory(rows)
    got = {r.id: (r.well_formed, r.repaired, r.total_elements) for r in out.collect()}
    assert got == {1: (True, True, 2), 2: (True, True, 1), 3: (False, False, None), 4: (True, False, 1), 5: (None, None, None)}
    plan = out.select(F.sum("total_elements"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
