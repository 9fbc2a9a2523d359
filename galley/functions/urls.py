"""Canonical URLs and sites, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say where a visitor came from, for links to import and for matching two sources.
IMPORT_PARAMETERS = (
    "_ga _gl _hsenc _hsmi cmpid dclid fbclid gclid gclsrc igsh igshid mbid msclkid ncid oly_anon_id oly_enc_id rb_clickid ref ref_ "
    "ref_src referrer s_cid sc_cid smid smtyp source srsltid ttclid twclid vero_id wickedid yclid"
).split()
IMPORT_PREFIXES = ("utm_", "mc_", "pk_", "hsa_", "__hs")
MATCH_PARAMETERS = (
    "fbclid gclid dclid gbraid wbraid msclkid yclid igshid igsh ref ref_src ref_url referrer _ga _gl si s_cid cmpid ncid smid smtyp "
    "sr_share share spm trk rss mbid"
).split()
MATCH_PREFIXES = ("utm_", "mc_", "hsa_", "pk_", "trk_")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def site(url: Column) -> Column:
    """The host in lower case without ``www.``; a link without a scheme counts as https. Null if there is none."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(full, _PARTS, 2)), r"^www\.", ""), F.lit(""))


def canonical(url: Column, parameters: list[str], prefixes: tuple[str, ...]) -> Column:
    """https, host in lower case without ``www.``, no default port, tracking parameter, fragment, doubled or last slash.

    The remaining parameters are sorted. Null for what is not http or https. Hosts are taken as they are written, and percent
    escapes are left alone.
    """
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"\.+$", ""), r"^www\.", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.rtrim(F.regexp_replace(part(4), "/{2,}", "/"), F.lit("/"))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    tracked = lambda p: key(p).isin(*parameters) | F.rlike(key(p), F.lit(f"^({'|'.join(prefixes)})"))
    query = F.array_sort(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~tracked(p)))
    whole = F.concat(
        F.lit("https://"), host, port, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    )
    return F.when(F.lower(part(1)).isin("http", "https") & (host != ""), whole)


def import_url(url: Column) -> Column:
    """The identity of a link to import; a missing scheme is https."""
    raw = F.btrim(url)
    raw = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(
        ~F.rlike(raw, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), F.concat(F.lit("https://"), raw)
    ).otherwise(raw)
    return canonical(raw, IMPORT_PARAMETERS, IMPORT_PREFIXES)


def match_url(url: Column) -> Column:
    """The identity by which records of two sources match."""
    return canonical(F.btrim(url), MATCH_PARAMETERS, MATCH_PREFIXES)
