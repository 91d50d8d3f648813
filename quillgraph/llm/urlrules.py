"""URL rules indexed by their rarest literal token.

A rule is a host and a path, like example.com/en/. It becomes a regular expression over host and path.
Each rule is filed under that one of its whole literal tokens which the fewest URLs hold; the tokens of a
URL fetch the candidate rules, and only those run. A rule without a whole literal token is always a candidate.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, read

#: (verdict, host and path)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Rules in one pass over the URLs; more are judged in further passes of the same task, block by block.
BLOCK = 50_000

TOKEN = re.compile(r"[A-Za-z0-9]+")
ABSOLUTE = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: str | None) -> tuple[str, str]:
    m = ABSOLUTE.search(url) if url else None
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def whole_tokens(rule: str) -> list[str]:
    """The rule's tokens that stand alone in any URL it fits: those not at its open end."""
    host, _, path = rule.partition("/")
    path = "/" + path
    return [m[0] for m in TOKEN.finditer(host)] + [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]


def pattern(rule: str) -> re.Pattern[str]:
    """Over host + path: the path, if there is one, starts at the first slash."""
    host, _, path = rule.partition("/")
    return re.compile(rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", re.S)


def judge(rules: tuple[tuple[str, str], ...], seen: dict[str, int], default: str) -> Callable[[str, str], tuple[str | None, str]]:
    by_token: dict[str | None, list[tuple[int, int, str, str, re.Pattern[str]]]] = defaultdict(list)
    for i, (verdict, rule) in enumerate(rules):
        key = min(whole_tokens(rule), key=lambda t: (seen.get(t, 0), t), default=None)
        by_token[key].append((-len(rule), i, verdict, rule, pattern(rule)))

    def of(host: str, path: str) -> tuple[str | None, str]:
        whole = host + path
        found = [r for t in {None, *TOKEN.findall(whole)} for r in by_token.get(t, ())]
        for _, _, verdict, rule, fits in sorted(found, key=lambda r: r[:2]):
            if fits.match(whole):
                return rule, verdict
        return None, default

    return of


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens is. One row per token of the rules comes to the driver."""
    if not tokens:
        return {}
    of = F.explode(F.array_distinct(F.split(F.concat_ws("", F.lit(""), "url"), "[^A-Za-z0-9]+")))
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    # the rules are on the driver and go to every task anyway, so their tokens may
    counts = pages.select(of.alias("token")).join(F.broadcast(wanted), "token", "left_semi").groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    The longest rule that fits wins (the earlier of equally long ones). Without a rule the verdict is `default`.
    A url that is null or without :// has empty host and path, so no rule fits it. Repeated rows each get a row.
    """
    seen = token_counts(pages, sorted({t for _, r in rules for t in whole_tokens(r)}))

    def make():
        blocks = [judge(rules[i : i + BLOCK], seen, default) for i in range(0, len(rules), BLOCK)]

        def one(url: str | None) -> tuple[str, str, str | None, str]:
            host, path = host_path(url)
            found = [f(host, path) for f in blocks]
            return (host, path, *max((f for f in found if f[0] is not None), key=lambda f: len(f[0]), default=(None, default)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = zip(*map(one, batch[1].to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch[0], *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

        return work

    return arrow_pass(pages.select(F.col("page_id").cast("long"), "url"), make, "page_id long, host string, path string, rule string, verdict string")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) FROM rules r
          WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule
  FROM parts p)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.verdict, 'allow') AS verdict
FROM judged j LEFT JOIN rules r ON j.rule = r.rhost || r.rpath
"""
