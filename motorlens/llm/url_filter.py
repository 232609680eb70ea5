"""Operator 5, URL filters: rules indexed by their rarest literal token.

A URL is cut into host and path; rules are regular expressions over host + path. Each rule names literal tokens
(`[A-Za-z0-9]+` runs that every match must contain whole). The rules' tokens are counted over all URLs, each rule is filed
under its rarest one, and the tokens of a URL fetch the rules that may match it; only those run their expression. Rules
without literals are tried on every URL.

Site rules (a host with its subdomains, and a path prefix) override: the longest one decides. Otherwise the URL is blocked
if a pattern rule matches, and allowed if none does. NULL URLs, and URLs without `://`, have an empty host and path, match
no rule and are allowed. Repeated rows come back as often as they come in; only the id and url columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool = False


def site(verdict: str, host: str, path: str) -> Rule:
    """A rule for host and all its subdomains, for paths that start with path."""
    whole = path[: path.rfind("/") + 1]  # what follows the last slash may go on in the URL
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host) + re.findall(TOKEN, whole)))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True)


#: The rules of the query.
SITES = (site("block", "com", "/en/"), site("allow", "example.com", "/en/7"), site("allow", "net", "/de/"), site("block", "example.net", "/de/8"), site("block", "org", "/es/"))
#: Patterns that block where no site rule speaks. The expressions are valid in Java, Python and RE2.
PATTERNS = (
    Rule("spam farm", "block", r"^(?:[^/]*[.-])?spam-farm[.-]", ("spam", "farm")),
    Rule("pills", "block", r"^(?:[^/]*[.-])?cheap-pills[.-]", ("cheap", "pills")),
    Rule("casino", "block", r"^(?:[^/]*[.-])?casino[.-]", ("casino",)),
    Rule("poker", "block", r"^(?:[^/]*[.-])?poker[.-]", ("poker",)),
    Rule("porn", "block", r"^(?:[^/]*[.-])?porn[.-]", ("porn",)),
    Rule("xxx", "block", r"^(?:[^/]*[.-])?xxx(?:[./-]|$)", ("xxx",)),
    Rule("malware", "block", r"^(?:[^/]*[.-])?malware[.-]", ("malware",)),
    Rule("login", "block", r"/wp-login[.]php$", ("wp", "login", "php")),
    Rule("cart", "block", r"/cart/checkout(?:/|$)", ("cart", "checkout")),
)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(rest)), "^[^?#]*", 0)


def token_counts(keys: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules; as many rows as the rules have tokens."""
    known = sorted({t for r in rules for t in r.literals})
    if not known:
        return {}
    tokens = F.array_intersect(F.regexp_extract_all("key", F.lit(f"({TOKEN})"), 1), F.array(*map(F.lit, known)))
    return {r["token"]: r["n"] for r in keys.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """rarest token -> rule numbers, and the rules without tokens."""
    by_token: dict[str, list[int]] = {}
    always = []
    for k, r in enumerate(rules):
        if r.literals:
            by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            always.append(k)
    return by_token, always


def judge(urls: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITES + PATTERNS) -> DataFrame:
    """urls with host, path, rule (name of the site rule that decided), verdict and pattern (name of the first pattern rule
    that matched where no site rule did). Input columns of these names are replaced."""
    u = F.coalesce(F.col(url), F.lit(""))
    held = urls.select(*[c for c in urls.columns if c not in {"host", "path", "rule", "verdict", "pattern"} or c == url], host(u).alias("_host"), path(u).alias("_path"))
    by_token, always = index(rules, token_counts(held.select(F.concat("_host", "_path").alias("key")), rules))

    @F.arrow_udf("rule string, verdict string, pattern string")
    def decide(keys: pa.Array) -> pa.Array:
        compiled = [re.compile(r.pattern) for r in rules]
        tokens, out = re.compile(TOKEN), ([], [], [])
        for key in keys.to_pylist():
            near = {k for t in set(tokens.findall(key)) if t in by_token for k in by_token[t]}
            hits = [rules[k] for k in sorted({*near, *always}) if compiled[k].search(key)]
            best = max((r for r in hits if r.site), key=lambda r: (len(r.name), r.name), default=None)
            other = next((r for r in hits if not r.site), None) if best is None else None
            for column, v in zip(out, (best and best.name, best.verdict if best else other.verdict if other else "allow", other and other.name)):
                column.append(v)
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in out], ["rule", "verdict", "pattern"])

    got = held.withColumn("_got", decide(F.concat("_host", "_path")))
    rest = [c for c in held.columns if c not in ("_host", "_path")]
    return got.select(*rest, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_got.rule").alias("rule"), F.col("_got.verdict").alias("verdict"), F.col("_got.pattern").alias("pattern"))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    values = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in SITES)
    blocked = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in PATTERNS)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM a),
c AS (SELECT row_number() OVER () AS k, page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM b),
r(rh, rp, v) AS (VALUES {values}),
m AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN m USING (k)
"""


SQL = _sql()
