"""URL, domain, text and hash keys. Null counts as the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as browsers count them; the JVM's \\s is ASCII only.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

_SECOND_LEVEL = {
    "uk": "ac co gov ltd me net org plc", "au": "com edu gov id net org", "nz": "co govt net org", "jp": "ac co go ne or",
    "in": "co firm gen ind net org", "za": "co gov net org", "br": "com gov net org", "mx": "com", "sg": "com", "hk": "com",
    "tr": "com", "cn": "com", "tw": "com", "kr": "co or",
}
#: Public suffixes of two labels; a pragmatic few.
SUFFIXES = tuple(f"{second}.{top}" for top, seconds in sorted(_SECOND_LEVEL.items()) for second in seconds.split())
_TRACKERS = ("_ga", "_hsenc", "_hsmi", "fbclid", "gclid", "igshid", "mc_eid", "mkt_tok", "msclkid", "ref_src", "yclid")
#: Query keys that say where a click came from.
TRACKING = "^(utm_.*|" + "|".join(_TRACKERS) + ")$"
_SCHEME = "^[a-z][-+.a-z0-9]*://"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), f"^{BLANK}+|{BLANK}+\\z", "")


def clean_host(c: Column) -> Column:
    """Lower case, without scheme, path, user, port and final dots."""
    s = F.lower(trimmed(c))
    s = F.regexp_replace(F.regexp_replace(s, _SCHEME, ""), "^//", "")
    s = F.regexp_replace(F.regexp_extract(s, "^[^/?#]*", 0), "(?s)^.*@", "")
    return F.regexp_replace(F.regexp_extract(s, "^[^:]*", 0), "\\.+$", "")


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, "^www\\.", "")


#: The whole of a numeric host or one of two labels, else three labels under a two-label suffix, else two.
_REGISTRABLE = "^[0-9]+(?:\\.[0-9]+)*$|^[^.]*(?:\\.[^.]*)?\\z|[^.]*\\.(?:" + "|".join(s.replace(".", "\\.") for s in SUFFIXES) + ")\\z|[^.]*\\.[^.]*\\z"


def registrable(host: Column) -> Column:
    """The last two labels, or three under a two-label suffix; numeric hosts stay whole. It mentions the host once, as
    within a lambda each mention would be read anew."""
    return F.regexp_extract(host, _REGISTRABLE, 0)


def normalize_domain(c: Column) -> Column:
    return registrable(without_www(clean_host(c)))


def is_tracking(key: Column) -> Column:
    return F.lower(key).rlike(TRACKING)


def normalize_url(c: Column) -> Column:
    """https, the host less one 'www.', the path less final slashes, other parameters in order, no fragment."""
    raw = trimmed(c)
    host = without_www(clean_host(c))
    rest = F.regexp_replace(F.regexp_replace(raw, "(?i)" + _SCHEME, ""), "^//", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "(?s)#.*$", ""), "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    query = F.regexp_extract(rest, "(?s)^[^?]*\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, "^[^=]*", 0))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(F.lit("https://"), host, path, tail))


def same_domain(a: Column, b: Column) -> Column:
    return normalize_domain(a) == normalize_domain(b)


def is_normalized_domain(c: Column) -> Column:
    return (text_or_empty(c) != "") & (normalize_domain(c) == text_or_empty(c))


def normalize_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), f"{BLANK}+", " ")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as eight hexadecimal digits."""

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))

    def char(h: Column, x: Column) -> Column:
        code = F.ascii(x).cast("long")
        beyond = code - 65536
        high = F.lit(55296).cast("long") + F.shiftright(beyond, 10)
        low = F.lit(56320).cast("long") + beyond.bitwiseAND(F.lit(1023).cast("long"))
        return F.when(code < 65536, step(h, code)).otherwise(step(step(h, high), low))

    chars = F.filter(F.split(text_or_empty(c), ""), lambda x: x != "")
    return F.lpad(F.lower(F.hex(F.aggregate(chars, F.lit(2166136261).cast("long"), char))), 8, "0")


def query_id(c: Column) -> Column:
    """q-, a slug of at most 40 characters, and a hash of the normalised text."""
    t = normalize_text(c)
    slug = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 40), "-+$", "")
    return F.concat(F.lit("q-"), F.when(slug != "", F.concat(slug, F.lit("-"))).otherwise(""), fnv1a(t))


def terms_hash(terms: Column) -> Column:
    """Of a query's terms in any order; repetitions count."""
    clean = F.array_sort(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.lower(trimmed(x))), lambda x: x != ""))
    return F.when(F.size(clean) == 0, "noqt").otherwise(fnv1a(F.array_join(clean, "\n")))


def cache_key(domain: Column, html: Column, terms: Column, extractor: Column) -> Column:
    return F.concat_ws("|", normalize_domain(domain), fnv1a(html), terms_hash(terms), extractor)


def reuse_key(url: Column, terms: Column, extractor: Column) -> Column:
    return F.concat_ws("|", normalize_url(url), terms_hash(terms), extractor)


def jitter(seed: Column) -> Column:
    """A small number around 0, within 0.05, from the first four bytes of a SHA-256."""
    unit = F.conv(F.substring(F.sha2(text_or_empty(seed), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return (unit - 0.5) * 0.1


# --- the same in DuckDB's SQL

SQL_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_host(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({sql_trim(x)}), '{_SCHEME}', ''), '^//', '')"
    s = f"regexp_replace(regexp_extract({s}, '^[^/?#]*', 0), '(?s)^.*@', '')"
    return f"regexp_replace(regexp_replace(regexp_extract({s}, '^[^:]*', 0), '\\.+$', ''), '^www\\.', '')"


def sql_domain(x: str) -> str:
    h = sql_host(x)
    some = ", ".join(f"'{s}'" for s in SUFFIXES)
    part = lambda n: f"array_to_string(string_split({h}, '.')[-{n}:], '.')"
    return f"CASE WHEN regexp_matches({h}, '^[0-9]+(\\.[0-9]+)*$') OR len(string_split({h}, '.')) <= 2 THEN {h} WHEN {part(2)} IN ({some}) THEN {part(3)} ELSE {part(2)} END"


def sql_url(x: str) -> str:
    raw, host = sql_trim(x), sql_host(x)
    rest = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({raw}, '(?i){_SCHEME}', ''), '^//', ''), '(?s)#.*$', ''), '^[^/?]*', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^?]*', 0), '/+$', '')"
    query = f"regexp_extract({rest}, '(?s)^[^?]*\\?(.*)$', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(regexp_extract(p, '^[^=]*', 0)), '{TRACKING}')))"
    return f"CASE WHEN {host} = '' THEN '' ELSE 'https://' || {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def sql_fnv1a(x: str) -> str:
    """For texts of the basic plane."""
    codes = f"list_transform(list_filter(string_split(coalesce({x}, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"lpad(lower(to_hex(list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)))), 8, '0')"
