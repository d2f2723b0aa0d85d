import hashlib
from urllib.parse import parse_qsl, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canteria.functions import document, text
from canteria.functions.canonical import compact_form, fingerprint, is_iso, iso_ok, line_form, round3

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_white_space(spark):
    values = [f"{c}a{c}" for c in SPACES] + [SPACES, "", None, "a b"]
    assert column(spark, values, text.py_strip) == [None if v is None else v.strip() for v in values]
    assert column(spark, values, text.is_blank) == [not (v or "").strip() for v in values]


def test_hashes_and_triggers(spark):
    values = [None, "", " sha256:AB ", "AB", "a:b:c", ":", "MATERIALIZAR", "\tx"]
    assert column(spark, values, text.norm_hash) == [document.bare_hash(v) for v in values]
    assert column(spark, values, text.is_pending) == [v in (None, "", "MATERIALIZAR") for v in values]
    assert column(spark, ["explicito:x", "implicito-de:", "Explicito:", None, ""], text.gatillo_ok) == [True, True, False, False, False]


def test_ids(spark):
    df = spark.createDataFrame([("a", None, "ñ")], "x string, y string, z string")
    assert df.select(text.det_id(F.col("x"), F.col("y"), F.col("z")).alias("o")).first().o == document.det_id("a", None, "ñ") == hashlib.sha256("a\x1f\x1fñ".encode()).hexdigest()


URLS = [
    "http://Site.Test/path/?utm_source=x&b=2&a=1#frag", "https://site.test/path?a=1&b=2", "HTTPS://u:p@H.test:443//a//?x=%20y&x=+&y", "http://h.test:0/", "http://h.test", "https://h.test/?fbclid=1&_GA=2", " http://h.test/a b ",
    "http://h.test/?q=~*é&r=%C3%A9&s=%zz", "http://h.test/x;y?a=b=c&&d", "http://h.test?x#y?z", "//h.test/x", "http://h.test/#", "http://h.test/?a", "https://h.test:8443/A/B/", "ftp://h.test/x/", "http://h.test:0080/x",
]


def test_canonical_url(spark):
    assert column(spark, URLS, text.canonical_url) == [document.canonical(u) for u in URLS]
    assert column(spark, [None, "http://h:99999/", "http://h:x/"], text.canonical_url) == [None] * 3


def test_canonical_url_is_stable(spark):
    once = column(spark, URLS, text.canonical_url)
    assert column(spark, once, text.canonical_url) == once


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab/?&=#%+2~*é.:@AZ_", max_size=25), min_size=1, max_size=40))
def test_canonical_url_like_the_library(spark, tails):
    urls = ["http://h.test/" + t for t in tails]
    assert column(spark, urls, text.canonical_url) == [document.canonical(u) for u in urls]


@settings(max_examples=200, deadline=None)
@given(st.text("ab/?&=#%+2~*é.:@AZ_", max_size=25))
def test_one_canonical_url_keeps_what_it_names(tail):
    before, after = urlsplit("http://H.test/" + tail), urlsplit(document.canonical("http://H.test/" + tail))
    assert (after.scheme, after.hostname, after.port, after.fragment) == ("https", "h.test", None, "")
    kept = parse_qsl(after.query, keep_blank_values=True)
    assert kept == sorted(kept) and set(kept) <= set(parse_qsl(before.query, keep_blank_values=True))
    assert len(kept) == len([k for k, _ in parse_qsl(before.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in text.TRACKING_NAMES])
    assert after.path == ("/" + before.path.strip("/") if before.path.strip("/") else "/") or after.path == before.path.rstrip("/")


@pytest.mark.parametrize("url", ["http://h:99999/", "http://h:x/", "http://h:-1/"])
def test_one_url_with_a_bad_port_is_refused(url):
    with pytest.raises(ValueError, match="no port"):
        document.canonical(url)


def test_json_forms():
    value = {"b": [1.0, "é"], "a": None}
    assert line_form(value) == '{"a": null, "b": [1.0, "é"]}'
    assert compact_form(value) == '{"a":null,"b":[1.0,"é"]}'
    assert fingerprint("p", ["b"], [{"x": 1}]) == hashlib.sha256('{"busqueda":["b"],"premisa":"p","resultados_crudos":[{"x":1}]}'.encode()).hexdigest()


def test_iso(spark):
    values = ["2026-6-1T1:2:3", "2026-W01-1", "20260601", "2026-06-01T00:00:00Z", " 2026-06-01 ", "2026-06-01T24:00:00x", "", None, "x"]
    assert column(spark, values, iso_ok) == [is_iso(v) for v in values] == [True, True, True, True, True, False, False, False, False]


def test_rounding(spark):
    values = [1 / 16, 3 / 80, 0.5, 2 / 3, None]
    assert column(spark, values, round3, "double") == [None if v is None else round(v, 3) for v in values]


def test_a_clean_url_with_a_line_break_is_still_trimmed(spark):
    assert column(spark, ["https://h.test/x\n", "https://h.test/x\r\n", "https://h.test/x"], text.canonical_url) == ["https://h.test/x"] * 3
