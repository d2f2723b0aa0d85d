"""Byte-exact JSON forms, fingerprints and the checks only Python can state exactly."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the format events and documents write times in.
ISO = "%Y-%m-%dT%H:%M:%S"


def line_form(value: object) -> str:
    """Sorted keys, a space after each separator, other scripts unescaped: the form of a log line."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def compact_form(value: object) -> str:
    """Sorted keys, no spaces: the form fingerprints are taken of."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(premisa: object, busqueda: object, crudos: object) -> str:
    """Identity of an inference's three inputs."""
    return sha(compact_form({"premisa": premisa, "busqueda": busqueda, "resultados_crudos": crudos}))


def is_iso(value: object) -> bool:
    """A text that one of Python's two ISO readers takes."""
    if not isinstance(value, str):
        return False
    text = value.strip()
    for reader in (lambda s: datetime.strptime(s, ISO), datetime.fromisoformat):
        try:
            reader(text)
            return True
        except ValueError:
            continue
    return False


def _parsed(text: str | None, form) -> str | None:
    if text is None:
        return None
    try:
        return form(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _line_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _parsed(t, line_form), na_action="ignore")


@F.pandas_udf(T.StringType())
def _compact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _parsed(t, compact_form), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fingerprint_udf(premisa: pd.Series, busqueda: pd.Series, crudos: pd.Series) -> pd.Series:
    def one(p: str | None, b: str | None, c: str | None) -> str | None:
        try:
            return fingerprint(p, json.loads(b) if b is not None else None, json.loads(c) if c is not None else None)
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(premisa.where(premisa.notna(), None), busqueda.where(busqueda.notna(), None), crudos.where(crudos.notna(), None))], dtype="object")


@F.pandas_udf(T.BooleanType())
def _iso_udf(texts: pd.Series) -> pd.Series:
    return texts.map(is_iso).astype(bool)


@F.pandas_udf(T.DoubleType())
def _round_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda x: round(x, 3), na_action="ignore").astype(float)


def canonical_line(text: Column) -> Column:
    """Line form of JSON text; null for null and for what is no JSON."""
    return _line_udf(text)


def event_line(event: Column, *nested: str) -> Column:
    """Line form of an event given as JSON text, the ``nested`` fields read as JSON; one that is no JSON stays a text."""

    def one(text: str) -> str:
        fields = json.loads(text)
        for n in nested:
            if fields[n] is not None:
                try:
                    fields[n] = json.loads(fields[n])
                except ValueError:
                    pass
        return line_form(fields)

    @F.pandas_udf(T.StringType())
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return lines(event)


def canonical_compact(text: Column) -> Column:
    """Compact form of JSON text; null for null and for what is no JSON."""
    return _compact_udf(text)


def line_sha(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def huella(premisa: Column, busqueda: Column, crudos: Column) -> Column:
    """Fingerprint of a premise and two JSON texts; null where one of them is no JSON."""
    return _fingerprint_udf(premisa, busqueda, crudos)


def iso_ok(text: Column) -> Column:
    """Is the text a time Python's ISO readers take?  Null is not."""
    return F.coalesce(_iso_udf(text), F.lit(False))


def round3(value: Column) -> Column:
    """Three digits, half to even on the exact binary value."""
    return _round_udf(value)
