"""Text, identifier and URI expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"

# The characters Unicode counts as white space.
WHITE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# RDF type URIs that mark properties and classes.
PROPERTY_TYPES = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property",
    "http://www.w3.org/2002/07/owl#ObjectProperty",
    "http://www.w3.org/2002/07/owl#DatatypeProperty",
)
CLASS_TYPES = (
    "http://www.w3.org/2002/07/owl#Class",
    "http://www.w3.org/2000/01/rdf-schema#Class",
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Bind an expression to a name that ``body`` may use many times; it is
    evaluated once per row instead of once per use or per array element."""
    return F.transform(F.array(value), body)[0]


def strip(value: Column | str) -> Column:
    """Trim every kind of white space from both ends; null becomes ''."""
    return F.btrim(F.coalesce(as_col(value), F.lit("")), F.lit(WHITE))


def rstrip(value: Column | str) -> Column:
    return F.rtrim(as_col(value), F.lit(WHITE))


def is_blank(value: Column | str) -> Column:
    return strip(value) == ""


def not_blank(value: Column | str) -> Column:
    return strip(value) != ""


def nullable_trim(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def collapse(value: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return strip(F.regexp_replace(F.coalesce(as_col(value), F.lit("")), rf"{SPACE}+", " "))


def clip_text(value: Column | str, n: int = 240) -> Column:
    """Collapse, then keep n characters plus '...' (so up to n + 3)."""
    text = collapse(value)
    return F.when(F.length(text) > n, F.concat(rstrip(F.left(text, F.lit(n))), F.lit("..."))).otherwise(text)


def shorten(value: Column | str, n: int = 220) -> Column:
    """Collapse, then cut to n characters including the '...'."""
    text = collapse(value)
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def preview_text(value: Column | str, n: int) -> Column:
    """Cut without collapsing; null and '' pass through."""
    c = as_col(value)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def _last_segment(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def short_uri(value: Column | str) -> Column:
    c = F.coalesce(as_col(value), F.lit(""))
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(_last_segment(c))


def short_name(value: Column | str) -> Column:
    c = strip(value)
    return (
        F.when(c.contains(":"), F.substring_index(c, ":", -1))
        .when(c.contains("/"), _last_segment(c))
        .otherwise(c)
    )


def norm_predicate(value: Column | str) -> Column:
    return F.btrim(F.btrim(F.lower(strip(value)), F.lit('"')), F.lit("'"))


def normalize_schema_uri(value: Column | str) -> Column:
    c = strip(value)
    home = "http://schema.org/"
    return (
        F.when(c == "", F.lit(""))
        .when(c.startswith("https://schema.org/"), F.replace(c, F.lit("https://schema.org/"), F.lit(home)))
        .when(c.startswith(home), c)
        .when(c.startswith("schema:"), F.concat(F.lit(home), F.substring_index(c, "schema:", -1)))
        .when(c.startswith("http://") | c.startswith("https://"), c)
        .otherwise(F.concat(F.lit(home), c))
    )


def infer_kind(uri: Column | str) -> Column:
    c = strip(uri)
    return (
        F.when(c.startswith("concept:"), F.lit("Class"))
        .when(c.startswith("relation:"), F.lit("Property"))
        .otherwise(F.lit("Unknown"))
    )


def infer_kind_by_namespace(uri: Column | str) -> Column:
    return F.when(strip(uri).contains("schema.org"), F.lit("Property")).otherwise(F.lit("Class"))


def classify_types(types: Column | str) -> Column:
    """Kind from a set of rdf:type URIs; Property beats Class."""
    c = as_col(types)
    has = lambda uris: F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(u) for u in uris])), F.lit(False))
    return (
        F.when(has(PROPERTY_TYPES), F.lit("Property"))
        .when(has(CLASS_TYPES), F.lit("Class"))
        .otherwise(F.lit("Unknown"))
    )


def strip_token(value: Column | str) -> Column:
    return F.btrim(strip(value), F.lit("`'\" \t\r\n,.;"))


def split_identifier(value: Column | str) -> Column:
    """Lower-cased words of a snake, kebab or camel case name."""
    c = F.regexp_replace(F.coalesce(as_col(value), F.lit("")), r"[_\\-]+", " ")
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(c), rf"{SPACE}+"), lambda t: t != "")


def contains_term(text: Column | str, term: Column | str, leading: int | None = 3) -> Column:
    """Whether a text mentions a name: its words joined, or each of its ``leading``
    first words (None: all of them)."""
    return mentions(F.lower(collapse(text)), split_identifier(term), leading)


def mentions(hay: Column, words: Column, leading: int | None = 3) -> Column:
    """contains_term of a lower-case text without runs of blanks and a name's words."""
    return (
        (hay != "")
        & (F.size(words) > 0)
        & (
            F.contains(hay, F.array_join(words, " "))
            | F.forall(words if leading is None else F.slice(words, 1, leading), lambda w: F.contains(hay, w))
        )
    )


def safe_term(value: Column | str) -> Column:
    given = F.coalesce(F.nullif(as_col(value), F.lit("")), F.lit("Unnamed"))
    return F.coalesce(
        F.nullif(F.regexp_replace(strip(given), "[^a-zA-Z0-9_]", "_"), F.lit("")), F.lit("Unnamed")
    )


def slug(value: Column | str) -> Column:
    return F.lower(F.btrim(F.regexp_replace(as_col(value), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def clean_title(value: Column | str) -> Column:
    return collapse(F.regexp_replace(as_col(value), rf"^[\d\.]+{SPACE}*", ""))


def title_id(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(clean_title(value)), "[^a-z0-9]", "")


def title_candidates(value: Column | str) -> Column:
    name = strip(value)
    base = strip(F.translate(name, "_", " "))
    capital = F.concat(F.upper(F.left(base, F.lit(1))), F.substring(base, 2, 1 << 30))
    spaced = strip(F.translate(F.regexp_replace(name, r"(?<!^)([A-Z])", " $1"), "_", " "))
    return F.array_distinct(F.filter(F.array(base, capital, spaced), lambda t: t != ""))


def page_range(start: Column | str, end: Column | str) -> Column:
    a, b = strip(as_col(start).cast("string")), strip(as_col(end).cast("string"))
    return (
        F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("-"), b))
        .otherwise(F.coalesce(F.nullif(a, F.lit("")), b))
    )


# Error fragments after which a model call is tried again.
RETRY_MARKERS = (
    "timeout", "timed out", "connection", "network", "temporarily unavailable",
    "server error", "rate limit", "empty response", "empty response body", "expecting value",
)


# The wider list of the concept stage's runs.
CONCEPT_RETRY_MARKERS = (
    "timeout", "timed out", "connection", "network", "temporarily unavailable", "server error", "server disconnected",
    "remoteprotocolerror", "readerror", "rate limit", "empty response", "expecting value", "502", "503", "504",
)


def tag_retryable(error: Column | str, markers=RETRY_MARKERS) -> Column:
    low = F.lower(F.coalesce(as_col(error), F.lit("")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return hit
