"""What a payload really is, from its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic numbers.
MAGIC_ZIP = "504B"
MAGIC_GZIP = "1F8B"
MAGIC_JPEG = "FFD8FF"
MAGIC_ECW = "65777620"
MAGIC_OLE2 = "D0CF11E0A1B11AE1"
# End-of-central-directory record and how far from the end it may start.
ZIP_END = "504B0506"
ZIP_END_REACH = 0xFFFF + 22
HEAD_BYTES = 512
# Signatures of common file types: (hex prefix, extension).
SIGNATURES = (
    ("89504E470D0A1A0A", "png"), ("474946383961", "gif"), ("474946383761", "gif"), ("25504446", "pdf"),
    ("504B0304", "zip"), ("1F8B08", "gz"), ("425A68", "bz2"), ("377ABCAF271C", "7z"),
    ("526172211A07", "rar"), ("49492A00", "tif"), ("4D4D002A", "tif"),
)


def _bytes(content: Column) -> Column:
    return content.cast("binary")


def starts_with(content: Column, magic: str) -> Column:
    return F.hex(F.substring(_bytes(content), 1, len(magic) // 2)) == magic


def head_text(content: Column, n: int = HEAD_BYTES) -> Column:
    """First bytes as Latin-1 text without leading white space."""
    head = F.decode(F.substring(_bytes(content), 1, n), "ISO-8859-1")
    return F.regexp_replace(head, "^[\\s ﻿]+", "")


def looks_like_html(content: Column) -> Column:
    return F.lower(head_text(content)).rlike("^(<!doctype html|<html)")


def sniff(content: Column) -> Column:
    """vacio, zip, gzip, html, xml, json, texto or binario."""
    head = head_text(content)
    return (
        F.when(F.octet_length(_bytes(content)) == 0, "vacio")
        .when(starts_with(content, MAGIC_ZIP), "zip")
        .when(starts_with(content, MAGIC_GZIP), "gzip")
        .when(looks_like_html(content), "html")
        .when(head.startswith("<"), F.when(head.rlike(r"(?i)<html\b"), "html").otherwise("xml"))
        .when(head.rlike(r"^[{\[]"), "json")
        .when(F.substring(head, 1, 64).rlike("^[\\x09\\x0a\\x0d\\x20-\\x7e -￿]*$"), "texto")
        .otherwise("binario")
    )


def is_jpeg(content: Column) -> Column:
    return starts_with(content, MAGIC_JPEG)


def is_ecw(content: Column) -> Column:
    return starts_with(content, MAGIC_ECW)


def is_ole2(content: Column) -> Column:
    return starts_with(content, MAGIC_OLE2)


def looks_textual(content: Column) -> Column:
    """No control bytes besides tab, line feed and carriage return."""
    head = F.decode(F.substring(_bytes(content), 1, 1024), "ISO-8859-1")
    return ~head.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")


def service_exception(content: Column) -> Column:
    """(code, locator, text) when the body is a map-service exception, else null."""
    body = F.decode(_bytes(content), "ISO-8859-1")

    def found(pattern: str, group: int = 1) -> Column:
        text = F.regexp_extract(body, pattern, group)
        return F.when(text != "", text)

    code = F.coalesce(found(r'(?i)exceptionCode\s*=\s*"([^"]*)"'), found(r'(?i)code\s*=\s*"([^"]*)"'))
    message = F.coalesce(
        found(r"(?is)<(?:\w+:)?ExceptionText[^>]*>(.*?)</(?:\w+:)?ExceptionText>"),
        found(r"(?is)<(?:\w+:)?ServiceException(?![A-Za-z])[^>]*>(.*?)</(?:\w+:)?ServiceException>"))
    text = F.trim(F.regexp_replace(message, r"\s+", " "))
    known = F.when(text != "", text)
    is_exception = body.rlike("(?i)ExceptionReport|ServiceException")
    return F.when(is_exception & (known.isNotNull() | code.isNotNull()), F.struct(
        code.alias("code"), found(r'(?i)locator\s*=\s*"([^"]*)"').alias("locator"),
        F.coalesce(known, F.lit("El servicio devolvió un error sin descripción.")).alias("text")))


def is_truncated_zip(content: Column) -> Column:
    """A ZIP whose end record is nowhere in its last 64 KB."""
    raw = _bytes(content)
    tail = F.hex(F.when(F.octet_length(raw) > ZIP_END_REACH, F.substring(raw, -ZIP_END_REACH, ZIP_END_REACH)).otherwise(raw))
    # The record must start on a whole byte: pairs of hex digits before it.
    complete = tail.rlike(f"^(?:[0-9A-F]{{2}})*?{ZIP_END}")
    return starts_with(content, MAGIC_ZIP) & (F.octet_length(raw) >= 22) & ~complete


def diagnose_payload(content: Column, http_status: Column) -> Column:
    """Why a body is not the expected file: (reason, detail, origin)."""
    kind = sniff(content)
    exc = service_exception(content)
    where = F.when(exc["locator"].isNotNull(), F.concat(F.lit(", parámetro "), exc["locator"])).otherwise("")
    suffix = F.when(exc["code"].isNotNull(), F.concat(F.lit(" ("), exc["code"], where, F.lit(")"))).otherwise("")

    def answer(reason: str, origin: str, detail: Column | None = None) -> Column:
        return F.struct(F.lit(reason).alias("reason"),
                        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
                        F.lit(origin).alias("origin"))

    markup = kind.isin("xml", "html")
    return (
        F.when(markup & exc.isNotNull(), answer("service-exception", "publicador", F.concat(exc["text"], suffix)))
        .when(http_status.isin(404, 410), answer("gone", "publicador"))
        .when(http_status.isin(401, 403), answer("denied", "publicador"))
        .when(http_status >= 500, answer("server-error", "publicador"))
        .when(http_status >= 400, answer("rejected", "publicador"))
        .when(kind == "vacio", answer("empty", "publicador"))
        .when(kind == "html", answer("web-page", "publicador"))
        .when(kind == "xml", answer("xml-document", "publicador"))
        .when(kind == "json", answer("json-document", "publicador"))
        .when((kind == "zip") & is_truncated_zip(content), answer("truncated-zip", "portal"))
        .otherwise(answer("other-content", "desconocido", kind))
    )


def detected_type(content: Column) -> Column:
    """Extension the bytes stand for, or null when nothing is recognised."""
    found = None
    for magic, ext in SIGNATURES:
        test = starts_with(content, magic)
        found = F.when(test, ext) if found is None else found.when(test, ext)
    head = head_text(content, 1024)
    return (
        found.when(is_jpeg(content), "jpg")
        .when(looks_like_html(content), "html")
        .when(is_ecw(content), "ecw")
        .when(F.regexp_replace(head, "^ï»¿\\s*", "").startswith("<?xml"), "xml")
        .when(head.rlike(r"^[{\[]") & looks_textual(content), "json")
    )


def type_conformance(declared: Column, detected: Column) -> Column:
    """(score, code, ok) of the declared format against the detected type."""
    def result(score: int, code: str | None, ok: bool) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(code).cast("string").alias("code"), F.lit(ok).alias("ok"))

    return (
        F.when(detected.isNull(), result(0, "tipo-no-identificado", False))
        .when(detected == "html", result(0, "no-es-archivo", False))
        .when(declared.isin("BIN", "OTRO"), result(80, "tipo-detectado", True))
        .when(F.lower(declared) == detected, result(100, None, True))
        .otherwise(result(60, None, True))
    )
