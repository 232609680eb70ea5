"""URLs of adverts: canonical form, identity, page numbers, building searches, finding the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorlens.functions import text as tx
from motorlens.functions import vocab as v

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(without_fragment(url), "\\?(.*)$", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(without_fragment(url), "\\?.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters and parameters that have no value."""
    kept = F.filter(F.split(query_of(url), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*v.TRACKING))
    base = F.regexp_replace(without_fragment(url), "\\?.*$", "")
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def listing_id(url: Column) -> Column:
    """UUID in the path, else an identifying parameter, else the longest run of five or more digits in the last piece of
    the path (model ids `cat_ma..mo..` aside), else that piece."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    params = F.filter(F.split(query_of(url), "&"), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*v.ID_PARAMS) & (F.trim(F.regexp_extract(p, "=(.*)$", 1)) != ""))
    tail = F.regexp_extract(path, "([^/]*)$", 1)
    digits = F.regexp_extract_all(F.regexp_replace(tail, "(?i)cat_ma\\d+mo\\d+", ""), F.lit("(\\d{5,})"), 1)
    longest = F.aggregate(digits, F.lit(""), lambda a, d: F.when(F.length(d) > F.length(a), d).otherwise(a))
    return F.coalesce(
        F.nullif(F.lower(F.regexp_extract(path, f"({UUID})", 1)), F.lit("")),
        F.substring(F.trim(F.regexp_extract(F.get(params, 0), "=(.*)$", 1)), 1, 120),
        F.nullif(longest, F.lit("")), F.nullif(F.substring(tail, 1, 120), F.lit("")), F.substring(url, 1, 120),
    )


def page_number(url: Column, param: str = "page") -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(query_of(url), f"(?:^|&){param}=(\\d+)", 1).try_cast("int"), F.lit(1)))


def with_page(url: Column, number: Column, param: str = "page") -> Column:
    kept = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~p.startswith(f"{param}="))
    pieces = F.concat(kept, F.array(F.concat(F.lit(f"{param}="), number)))
    return F.concat(F.regexp_replace(without_fragment(url), "\\?.*$", ""), F.lit("?"), F.array_join(pieces, "&"))


def search_url(template: str, **values: Column) -> Column:
    """Fill a template's `{name}` fields with slugs, drop parameters without a value, and tidy what is left over."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(tx.slugify(value.cast("string")), F.lit("")))
    out = F.regexp_replace(out, "(?<=[?&])[^=&]+=(?=&|$)", "")
    out = F.regexp_replace(F.regexp_replace(out, "\\?&+", "?"), "&{2,}", "&")
    return F.regexp_replace(F.regexp_replace(out, "(?<!:)/{2,}", "/"), "[?&/]+$", "")


def source_for(url: Column, sources: tuple[str, ...]) -> Column:
    """The source whose name is a label of the host (hyphens aside); the longest wins, NULL if none does."""
    labels = F.filter(F.split(F.replace(host_of(url), F.lit("-"), F.lit("")), "\\."), lambda x: ~x.isin("www", "m", "com", "fr", "de"))
    out = F.lit(None).cast("string")
    for s in sorted(sources, key=len):
        out = F.when(F.array_contains(labels, s.replace("-", "").split(".")[0]), F.lit(s)).otherwise(out)
    return out


def media_type(content: Column) -> Column:
    """Image type by its first bytes, or NULL."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), F.lit("image/jpeg")).when(h.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(h.startswith("474946383761") | h.startswith("474946383961"), F.lit("image/gif")).when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), F.lit("image/webp"))
    )
