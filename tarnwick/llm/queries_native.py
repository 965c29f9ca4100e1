"""Queries of the operators that use DataFrame functions only: URL filters and secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import secret_scans, url_filters

# Fixed rules of the contract: verdict, then host and path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by RULES, else by the list of canonical urls that several pages share."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.url_filter(pages, RULES, url_filters.repeated_urls(pages)).select("page_id", "host", "path", "canonical", "rule", "verdict")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the contract's spans and those that the linking adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_scans.secret_scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|sessionid)='))), '&') AS query
  FROM cut
), named AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/+)$', '')
         || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    canonical IS NOT NULL AND count(*) OVER (PARTITION BY canonical) >= 2 AS listed FROM named
)
SELECT page_id, host, path, canonical, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def _sql_spans(kind: str, pattern: str, rank: int, keep: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""{kind}_m AS (SELECT k, regexp_extract_all(t, '{pattern}', 0) AS m, list_transform(string_split_regex(t, '{pattern}'), lambda p: length(p)) AS g FROM d),
{kind} AS (SELECT k, '{kind}' AS kind, {rank} AS r, m[i] AS m, (coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM {kind}_m, (SELECT unnest(range(1, 100000)) AS i) WHERE i <= len(m) AND {keep})"""


_kind = secret_scans
OP3_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),\n"
    + ",\n".join([
        _sql_spans("assign", _kind.ASSIGN, 0, f"length(regexp_extract(m[i], '{_kind.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= {_kind.ASSIGN_LEAST}"),
        _sql_spans("access", _kind.ACCESS, 1, f"length(m[i]) >= {_kind.ACCESS_LEAST}"),
        _sql_spans("hex", _kind.HEX, 2, "true"),
        _sql_spans("key", _kind.KEY, 3, "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')"),
        _sql_spans("endpoint", _kind.ENDPOINT.replace(r"\x00-\x20", r"\x00-\x20"), 4, "true"),
    ])
    + f""",
strong AS (SELECT *, s + length(m) AS e FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex)),
linked AS (SELECT *, s + length(m) AS e FROM key WHERE
  EXISTS (SELECT 1 FROM strong a WHERE a.k = key.k AND a.r = 1 AND key.s <= a.e + {_kind.SCOPE} AND a.s <= key.s + length(key.m) + {_kind.SCOPE})
  AND NOT EXISTS (SELECT 1 FROM strong b WHERE b.k = key.k AND b.s < key.s + length(key.m) AND key.s < b.e)),
secrets AS (SELECT * FROM strong WHERE r <> 1 UNION ALL SELECT * FROM linked),
ends AS (SELECT *, s + length(m) AS e FROM endpoint WHERE
  EXISTS (SELECT 1 FROM strong a WHERE a.k = endpoint.k AND a.r = 1 AND endpoint.s <= a.e + {_kind.SCOPE} AND a.s <= endpoint.s + length(endpoint.m) + {_kind.SCOPE})
  AND EXISTS (SELECT 1 FROM secrets a WHERE a.k = endpoint.k AND endpoint.s <= a.e + {_kind.SCOPE} AND a.s <= endpoint.s + length(endpoint.m) + {_kind.SCOPE})),
every AS (SELECT * FROM strong UNION ALL SELECT * FROM linked UNION ALL SELECT * FROM ends),
told AS (SELECT k, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r <= 2) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM every GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (k)
"""
)

QUERIES = {"op2_url_filters": op2_url_filters, "op3_secret_scans": op3_secret_scans}
ORACLE_SQL = {"op2_url_filters": OP2_SQL, "op3_secret_scans": OP3_SQL}
