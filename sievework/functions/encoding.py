"""Text encodings: byte-order marks, UTF-8 validity, and the cp1252 fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte-order marks, longest first.
BOMS = (
    ("EFBBBF", "utf_8_sig"), ("FFFE0000", "utf_32_le"), ("0000FEFF", "utf_32_be"),
    ("FFFE", "utf_16_le"), ("FEFF", "utf_16_be"),
)


def _cp1252_extras() -> tuple[str, str]:
    """Characters cp1252 has where ISO-8859-1 has control codes (0x80-0x9F)."""
    src, dst = [], []
    for b in range(0x80, 0xA0):
        try:
            dst.append(bytes([b]).decode("cp1252"))
            src.append(chr(b))
        except UnicodeDecodeError:
            continue
    return "".join(src), "".join(dst)


_LATIN1, _CP1252 = _cp1252_extras()


def decode_cp1252(value: Column) -> Column:
    """Bytes (or a line holding raw bytes) as cp1252 text."""
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), _LATIN1, _CP1252)


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def bom_encoding(content: Column) -> Column:
    head = F.hex(F.substring(content.cast("binary"), 1, 4))
    out = None
    for mark, name in BOMS:
        test = head.startswith(mark)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_utf8(content: Column) -> Column:
    """Valid UTF-8, tolerating a last character cut short (up to three bytes)."""
    raw = content.cast("binary")
    size = F.octet_length(raw)
    valid = F.is_valid_utf8(raw.cast("string"))
    for cut in (1, 2, 3):
        tail = F.hex(F.substring(raw, -cut, cut))
        lead = tail.rlike({1: "^[C-F]", 2: "^[EF][0-9A-F][89AB]", 3: "^F[0-9A-F][89AB][0-9A-F][89AB]"}[cut])
        head = F.substr(raw, F.lit(1), size - cut).cast("string")
        valid = valid | ((size >= cut) & lead & F.is_valid_utf8(head))
    return valid


def detect_encoding(content: Column) -> Column:
    """Mark, else UTF-8 when it decodes, else cp1252."""
    return F.coalesce(bom_encoding(content), F.when(is_utf8(content), "utf-8").otherwise("cp1252"))


def is_cp1252(encoding: Column) -> Column:
    return encoding == "cp1252"


# Whole code units in hex digits, surrogates only in pairs; anything else is no such text.
_UNITS = {
    "utf_16_le": "^(?:..(?!D[89A-F])..|..D[89AB]..D[C-F])*+$",
    "utf_16_be": "^(?:(?!D[89A-F])....|D[89AB]..D[C-F]..)*+$",
    "utf_32_le": "^(?:(?!..D[89A-F])....(?:0[0-9A-F]|10)00)*+$",
    "utf_32_be": "^(?:(?!0000D[89A-F])00(?:0[0-9A-F]|10)....)*+$",
}


WIDE = tuple(_UNITS)


def unit_bytes(encoding: str) -> int:
    return 4 if "32" in encoding else 2


def line_feed(encoding: str) -> tuple[str, int]:
    """Where to cut for a line feed: the separator for the text reader, and the zero bytes before it.

    A separator that begins like its own middle can be missed where a read
    ends inside it, so big-endian files are cut at the last byte alone.
    """
    zeros = unit_bytes(encoding) - 1
    return ("\n" + "\0" * zeros, 0) if encoding.endswith("le") else ("\n", zeros)


def decode_units(raw: Column, encoding: str) -> Column:
    """Bytes of a part of a UTF-16 or UTF-32 file, cut at whole units, as text.

    Units that are no text each become U+FFFD, as does an incomplete last one.
    """
    digits = 2 * unit_bytes(encoding)
    bad = {"utf_16_le": "FDFF", "utf_16_be": "FFFD", "utf_32_le": "FDFF0000", "utf_32_be": "0000FFFD"}[encoding]
    good = _UNITS[encoding][1:-1]
    text = F.hex(raw)
    mended = F.when(text.rlike(_UNITS[encoding]), raw).otherwise(
        F.unhex(F.regexp_replace(text, rf"\G({good})(.{{1,{digits}}})", f"$1{bad}")))
    if digits == 4:
        return F.decode(mended, f"UTF-16{encoding[-2:].upper()}")
    # The charset has no order of its own; a mark in front names it and is dropped.
    mark = F.unhex(F.lit("FFFE0000" if encoding.endswith("le") else "0000FEFF"))
    return F.decode(F.concat(mark, mended), "UTF-32")


def decode_text(content: Column) -> Column:
    """Text of a whole file's bytes, whatever its encoding, without the mark.

    Null where a mark promises UTF-16 or UTF-32 and the bytes do not keep it.
    """
    raw = content.cast("binary")
    found = detect_encoding(raw)
    out = F.when(found.isin("utf-8", "utf_8_sig"), strip_bom(raw.cast("string")))
    for name, units in _UNITS.items():
        size = 2 if "16" in name else 4
        body = F.substr(raw, F.lit(size + 1))
        kept = F.hex(body).rlike(units)
        charset = f"UTF-16{name[-2:].upper()}" if size == 2 else "UTF-32"
        out = out.when(found == name, F.when(kept, F.decode(body if size == 2 else raw, charset)))
    return out.otherwise(decode_cp1252(raw))
