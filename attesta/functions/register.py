"""The key functions as SQL functions of a session, written in SQL so that they stay in the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from attesta.functions import keys, stats
from attesta.functions.keys import SUFFIXES

_HOST = (r"""regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_extract(
  regexp_replace(regexp_replace(lower(regexp_replace(coalesce(x, ''), '^BLANK+|BLANK+$', '')), '^[a-z][-+.a-z0-9]*://', ''), '^//', ''), '^[^/?#]*', 0), '^.*@', ''), '^[^:]*', 0), '\\.+$', ''), '^www\\.', '')""").replace("BLANK", keys.BLANK.replace("\\", "\\\\"))

_REST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '^BLANK+|BLANK+$', ''), '(?i)^[a-z][-+.a-z0-9]*://', ''), '^//', ''), '(?s)#.*$', ''), '^[^/?]*', '')""".replace("BLANK", keys.BLANK.replace("\\", "\\\\"))
_KEPT = f"""array_sort(filter(split(regexp_extract({_REST}, '(?s)^[^?]*\\\\?(.*)$', 1), '&'), p -> p <> '' AND NOT lower(regexp_extract(p, '^[^=]*', 0)) RLIKE '{keys.TRACKING.replace(chr(92), chr(92) * 2)}'))"""


def register(spark: SparkSession) -> list[str]:
    """Makes temporary functions cite_host, cite_domain, cite_url, cite_fnv1a, cite_flip_rate (of runs in order), cite_wilson_low and cite_wilson_high."""
    some = ", ".join(f"'{s}'" for s in SUFFIXES)
    z2 = stats.Z**2
    one = "((({0} ^ {1}) * 16777619L) & 4294967295L)"
    middle, half = f"(s / n + {z2} / (2 * n))", f"{stats.Z} * sqrt(s / n * (1 - s / n) / n + {z2} / (4 * n * n))"
    bodies = {
        "cite_host(x STRING) RETURNS STRING": _HOST,
        "cite_domain(x STRING) RETURNS STRING": f"""CASE WHEN cite_host(x) RLIKE '^[0-9]+(\\\\.[0-9]+)*$' OR regexp_count(cite_host(x), '\\\\.') < 2 THEN cite_host(x)
          WHEN substring_index(cite_host(x), '.', -2) IN ({some}) THEN substring_index(cite_host(x), '.', -3) ELSE substring_index(cite_host(x), '.', -2) END""",
        "cite_fnv1a(x STRING) RETURNS STRING": f"lpad(lower(hex(aggregate(filter(split(coalesce(x, ''), ''), c -> c <> ''), 2166136261L, (h, c) -> IF(ascii(c) < 65536, {one.format('h', 'CAST(ascii(c) AS BIGINT)')}, {one.format(one.format('h', '(55296L + shiftright(CAST(ascii(c) AS BIGINT) - 65536L, 10))'), '(56320L + ((CAST(ascii(c) AS BIGINT) - 65536L) & 1023L))')})))), 8, '0')",
        "cite_url(x STRING) RETURNS STRING": f"""CASE WHEN cite_host(x) = '' THEN '' ELSE concat('https://', cite_host(x), regexp_replace(regexp_extract({_REST}, '^[^?]*', 0), '/+$', ''),
          IF(size({_KEPT}) > 0, concat('?', array_join({_KEPT}, '&')), '')) END""",
        "cite_flip_rate(cited ARRAY<BOOLEAN>) RETURNS DOUBLE": "IF(size(cited) < 2, 0D, CAST(size(filter(sequence(1, greatest(size(cited) - 1, 1)), i -> cited[i] <> cited[i - 1])) AS DOUBLE) / (size(cited) - 1))",
        "cite_wilson_low(s DOUBLE, n DOUBLE) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN greatest(0D, ({middle} - {half}) / (1 + {z2} / n)) ELSE 0D END",
        "cite_wilson_high(s DOUBLE, n DOUBLE) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN least(1D, ({middle} + {half}) / (1 + {z2} / n)) ELSE 1D END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]


__all__ = ["keys", "register"]
