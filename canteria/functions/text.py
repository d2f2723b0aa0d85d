"""Text functions on the JVM side: white space, hashes, ids and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters a Python ``str.strip`` removes, as a regex class.
SPACE_CLASS = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\p{Z}]"

# Query parameters that only track the visitor.
TRACKING_NAMES = ("fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_eid", "mc_cid", "igshid", "_ga")
TRACKING_PREFIX = "utm_"

# The mark of a snapshot still to be fetched, and the two trigger forms.
PENDING = "MATERIALIZAR"
TRIGGERS = ("explicito:", "implicito-de:")

UNIT_SEPARATOR = "\x1f"


def py_strip(c: Column) -> Column:
    """Remove every kind of outer white space, not only U+0020."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space alone; never null."""
    return F.coalesce(py_strip(c) == "", F.lit(True))


def norm_hash(c: Column) -> Column:
    """Trimmed, and without what stands before the first colon; null gives ''."""
    s = py_strip(c)
    return F.coalesce(F.regexp_replace(s, "^[^:]*:", ""), F.lit(""))


def is_pending(c: Column) -> Column:
    """A content hash that is null, empty or the placeholder."""
    return c.isNull() | c.isin(PENDING, "")


def gatillo_ok(c: Column) -> Column:
    """A trigger begins with one of two prefixes, case-sensitive; null does not."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(c, F.lit(t)) for t in TRIGGERS]), F.lit(False))


def triplet_ok(premisa: Column, busqueda: Column, crudos: Column) -> Column:
    """A premise that is not blank and two JSON arrays that are not empty; never null."""
    filled = [F.coalesce(F.json_array_length(c) > 0, F.lit(False)) for c in (busqueda, crudos)]
    return ~is_blank(premisa) & filled[0] & filled[1]


def signature(model: Column, ts: Column) -> Column:
    """model@ts, a null written ``None``."""
    return F.concat(F.coalesce(model, F.lit("None")), F.lit("@"), F.coalesce(ts, F.lit("None")))


def unit_join(*parts: Column) -> Column:
    """Parts joined by U+001F; a null part keeps its place as ''."""
    return F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def det_id(*parts: Column) -> Column:
    """Deterministic id: SHA-256 of the unit-joined parts."""
    return F.sha2(unit_join(*parts), 256)


def content_hash(c: Column) -> Column:
    """SHA-256 of bytes or of the UTF-8 of text, lower-case hex."""
    return F.sha2(c.cast("binary"), 256)


def key_bytes(c: Column) -> Column:
    """An injective, compact form of a text id: 64 lower-case hex digits become
    33 bytes, any other text keeps its bytes behind another tag."""
    hex64 = c.rlike("^[0-9a-f]{64}\\z")
    return F.when(hex64, F.concat(F.lit(b"\x01"), F.unhex(F.when(hex64, c)))).otherwise(F.concat(F.lit(b"\x00"), c.cast("binary")))


def key_text(c: Column) -> Column:
    """The inverse of :func:`key_bytes`."""
    body = c.substr(F.lit(2), F.length(c))
    return F.when(c.substr(1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(body.cast("string"))


def _is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*TRACKING_NAMES) | F.startswith(low, F.lit(TRACKING_PREFIX))


def _unquote(c: Column) -> Column:
    # A percent sign that begins no escape stands for itself.
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quote(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _let(value: Column, body) -> Column:
    """``body`` over a value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# scheme ":" "//" authority path "?" query "#" fragment
URL_PARTS = "^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#[\\s\\S]*)?$"
BRACKETED = "^\\[([^\\]]*)\\](?::([\\s\\S]*))?$"
#: A URL that is its own canonical form: no query, lower-case host, no slash at the end.
_CANONICAL = "^https://[a-z0-9.\\-]+(?::[1-9][0-9]{0,3})?/(?:[!-~&&[^?#]]*[!-~&&[^?#/]])?\\z"


def _netloc(authority: Column) -> Column:
    """Host in lower case with a port other than 0; null for a port that is no number up to 65535."""

    def of(host_port: Column) -> Column:
        is_v6 = F.startswith(host_port, F.lit("["))
        host = F.lower(F.when(is_v6, F.regexp_extract(host_port, BRACKETED, 1)).otherwise(F.substring_index(host_port, ":", 1)))
        port = F.when(is_v6, F.regexp_extract(host_port, BRACKETED, 2)).otherwise(F.regexp_extract(host_port, "^[^:]*:([\\s\\S]*)$", 1))
        number = F.when(port.rlike("^[0-9]{1,9}$"), port).cast("int")
        return F.when((port == "") | (number == 0), host).when(number <= 65535, F.concat_ws(":", host, number.cast("string")))

    return _let(F.regexp_extract(authority, "^(?:[\\s\\S]*@)?([\\s\\S]*)$", 1), of)


def _query(query: Column) -> Column:
    """Parameters without the tracking ones, sorted by name and value."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _unquote(F.substring_index(p, "=", 1)).alias("k"),
            _unquote(F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "^[^=]*=([\\s\\S]*)$", 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~_is_tracking(p["k"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(_quote(p["k"]), F.lit("="), _quote(p["v"]))), "&")


def _assemble(p: Column) -> Column:
    path, netloc, tail = p["path"], p["netloc"], p["tail"]
    bare = F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    base = F.when(netloc == "", F.concat(F.lit("https:"), bare)).otherwise(F.concat(F.lit("https://"), netloc, F.when(F.startswith(bare, F.lit("/")), F.lit("")).otherwise(F.lit("/")), bare))
    return F.when(tail == "", base).otherwise(F.concat(base, F.lit("?"), tail))


def canonical_url(url: Column) -> Column:
    """Conservative canonical form of a URL, wholly inside the JVM.

    White space outside and line breaks inside go; the scheme becomes
    ``https``; user info and fragment go; the host is lower-cased and a port
    other than 0 stays; trailing slashes of the path go unless it is the root;
    tracking parameters go and the rest is sorted by name and value.  Null
    gives null; so does a port that is no number up to 65535.
    """
    cleaned = F.regexp_replace(F.regexp_replace(py_strip(url), "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")
    parts = _let(cleaned, lambda s: F.struct(_netloc(F.regexp_extract(s, URL_PARTS, 1)).alias("netloc"), F.regexp_extract(s, URL_PARTS, 2).alias("path"), _query(F.regexp_extract(s, URL_PARTS, 3)).alias("tail")))
    return F.when(url.rlike(_CANONICAL), url).otherwise(_let(parts, _assemble))
