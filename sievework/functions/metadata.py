"""Metadata side of a dataset: gaps, freshness and the metadata score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions.issues import lookup
from sievework.functions.numbers import round_half_up
from sievework.functions.text import openness

_MS_PER_MONTH = 1000 * 60 * 60 * 24 * dims.DAYS_PER_MONTH


def _missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _no_items(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def metadata_gaps(
    title: Column, description: Column, license_name: Column, publisher: Column, issued: Column,
    modified: Column, language: Column, spatial: Column, themes: Column, keywords: Column,
    periodicity: Column, formats: Column, identifier: Column, contact_point: Column,
) -> Column:
    """Array of gap codes in report order."""
    no_open = ~F.exists(formats, lambda f: f.isin(*dims.OPEN_FORMATS))
    tests = {
        "sin-titulo": _missing(title),
        "sin-descripcion": _missing(description),
        "sin-licencia-identificada": license_name == dims.DEFAULT_LICENSE,
        "sin-organismo": _missing(publisher),
        "sin-fecha-publicacion": _missing(issued),
        "sin-idioma": _missing(language),
        "sin-cobertura": _missing(spatial),
        "sin-tematica": _no_items(themes),
        "sin-palabras-clave": _no_items(keywords),
        "sin-fecha-actualizacion": _missing(modified),
        "sin-periodicidad": F.coalesce(periodicity <= 0, F.lit(True)),
        "licencia-restrictiva": license_name == "IGCYL-NC",
        "sin-formato-abierto": ~_no_items(formats) & no_open,
        "sin-identificador": _missing(identifier),
        "sin-punto-contacto": _missing(contact_point),
    }
    return F.array_compact(F.array(*[F.when(tests[c], c) for c in dims.METADATA_GAPS]))


def completeness_ratio(gaps: Column) -> Column:
    wanted = dims.COMPLETENESS_GAPS
    missing = F.size(F.filter(gaps, lambda g: g.isin(*wanted)))
    return (F.lit(len(wanted)) - missing) / F.lit(len(wanted))


def iso_timestamp(text: Column) -> Column:
    """Date or date-time text in ISO form; null when it is neither."""
    return F.coalesce(
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))),
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T"), text.try_cast("timestamp")),
    )


def reference_date(modified: Column, issued: Column) -> Column:
    return F.coalesce(iso_timestamp(modified), iso_timestamp(issued))


def reference_kind(modified: Column, issued: Column) -> Column:
    return (
        F.when(iso_timestamp(modified).isNotNull(), "modified")
        .when(iso_timestamp(issued).isNotNull(), "issued")
        .otherwise("none")
    )


def months_since(reference: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(reference)) / F.lit(_MS_PER_MONTH)


def periods_late(reference: Column, periodicity: Column, now: Column) -> Column:
    """Elapsed update periods to one decimal, never negative."""
    ratio = months_since(reference, now) / periodicity
    return F.when(periodicity > 0, F.greatest(F.lit(0.0), F.floor(ratio * 10 + 0.5) / 10))


def freshness_diagnosis(modified: Column, issued: Column, periodicity: Column, now: Column) -> Column:
    reference = reference_date(modified, issued)
    late = periods_late(reference, periodicity, now)
    return (
        F.when(reference.isNull(), "sin-fecha")
        .when(F.coalesce(periodicity <= 0, F.lit(True)), "sin-periodicidad")
        .when(late <= 1, "al-dia")
        .when(iso_timestamp(modified).isNull(), "no-verificable")
        .otherwise("vencido")
    )


def format_part(formats: Column) -> Column:
    """Best openness, plus a little for offering up to three formats."""
    best = F.array_max(F.transform(formats, openness))
    diversity = F.least(F.size(formats), F.lit(3)) / 3 * 100
    return F.when(_no_items(formats), F.lit(0.0)).otherwise(best * 0.8 + diversity * 0.2)


def freshness_part(reference: Column, periodicity: Column, now: Column) -> Column:
    ratio = months_since(reference, now) / periodicity
    return (
        F.when(reference.isNull(), 40)
        .when(F.coalesce(periodicity <= 0, F.lit(True)), 80)
        .when(ratio <= 1, 100).when(ratio <= 2, 75).when(ratio <= 4, 50).otherwise(25)
    )


def license_part(license_name: Column) -> Column:
    return lookup(license_name, dims.LICENSE_POINTS, dims.DEFAULT_LICENSE_POINTS)


def metadata_score(
    gaps: Column, formats: Column, modified: Column, issued: Column,
    periodicity: Column, license_name: Column, now: Column,
) -> Column:
    w = dims.METADATA_WEIGHTS
    reference = reference_date(modified, issued)
    return round_half_up(
        completeness_ratio(gaps) * 100 * w["completeness"]
        + format_part(formats) * w["formats"]
        + freshness_part(reference, periodicity, now) * w["freshness"]
        + license_part(license_name) * w["license"]
    )


def periodicity_months(months: Column, days: Column, years: Column) -> Column:
    m, d, y = (c.try_cast("double") for c in (months, days, years))
    return F.coalesce(
        F.when(m > 0, m), F.when(d > 0, d / dims.DAYS_PER_MONTH), F.when(y > 0, y * 12)
    )
