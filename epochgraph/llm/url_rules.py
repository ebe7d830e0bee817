"""URL verdicts by rules that are indexed under their rarest literal token, in DataFrame operations only.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that any URL it fits must hold. Token frequencies
are counted over all URLs; each rule is filed under its rarest token. A URL's tokens fetch candidate rules by a join, and only
candidates run their expression. Rules without a literal are candidates for every URL.

Each distinct URL is judged once, so a URL that fills a third of the table costs no more than another; the verdicts come back
by a join on the URL, whose skewed side adaptive execution can split.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast (a few hundred bytes each); beyond it the join shuffles.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host, path and the rest of the URL, the host in lower case; ``tokens`` must be in whatever it fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int = 0  # of the place rules that fit the heaviest wins; patterns weigh nothing


def place_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and paths that begin with ``path``."""
    whole = f"{re.split('[^a-z0-9]', path.lower())[-1]}"
    tokens = [t for t in re.split("[^a-z0-9]+", f"{host}{path}".lower()) if t]
    if whole:  # the path's last token may go on in the URL
        tokens = tokens[:-1]
    return Rule(f"{host}{path}", verdict, rf"^([^/?#]*\.)?{_quoted(host)}{_quoted(path)}", tuple(dict.fromkeys(tokens)), len(host) + len(path))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: Of rules that fit, the longest decides.
PLACES = (
    place_rule("allow", "org", "/"),
    place_rule("block", "example.org", "/es/"),
    place_rule("block", "example.org", "/en/1"),
    place_rule("allow", "com", "/fr/"),
    place_rule("block", "com", "/de/"),
)

#: For URLs that no place rule fits: any of these blocks.
PATTERNS = (
    Rule("spam farms", "block", r"^([^/?#]*[.])?spam-farm[.]", ("spam", "farm")),
    Rule("link farms", "block", r"^([^/?#]*[.])?link-farm[.]", ("link", "farm")),
    Rule("log-in pages", "block", r"/login([/?#.]|$)", ("login",)),
    Rule("carts", "block", r"/cart([/?#.]|$)", ("cart",)),
    Rule("comment replies", "block", r"[?&]replytocom=[0-9]+", ("replytocom",)),
    Rule("session ids", "block", r"[?&;]phpsessid=", ("phpsessid",)),
    Rule("print views", "block", r"[?&]print=(1|true)(&|#|$)", ("print",)),
    Rule("casinos", "block", r"^([^/?#]*[.])?casino[.-]", ("casino",)),
    Rule("adult sites", "block", r"^([^/?#]*[.])?adult-", ("adult",)),
    Rule("pill shops", "block", r"^[^/?#]*-pills[.]", ("pills",)),
    Rule("betting", "block", r"^[^/?#]*-bets[.]", ("bets",)),
    Rule("numeric hosts", "block", r"^[0-9]+([.][0-9]+){3}(:[0-9]+)?([/?#]|$)", ()),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A to Z lowered; empty if there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judged(url: Column) -> Column:
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit("")))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"))


def index(urls: DataFrame, rules: tuple[Rule, ...]) -> list[tuple]:
    """(token, name, verdict, pattern, weight) of each rule under its rarest token; no token for rules without literals."""
    known = sorted({t for r in rules for t in r.tokens})
    rows = urls.select(F.explode(_tokens(_judged(F.col("url")))).alias("token")).filter(F.col("token").isin(known)).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in rows.collect()}  # at most one row for each token of the rules
    return [(min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else "", r.name, r.verdict, r.pattern, r.weight) for r in rules]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", places: tuple[Rule, ...] = PLACES, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, pattern_rule) for every row.

    ``rule`` is the longest place rule that fits, else null, and decides; else the first pattern rule by name that fits does, else
    ``default``. Null URLs and those without ``://`` have empty host and path, fit nothing and get the default. Repeated rows
    and null ids come back as they are; other columns are not looked at. URLs are taken whole, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    urls = rows.select("url").filter(F.contains("url", F.lit("://"))).distinct()
    rules = places + patterns
    filed = pages.sparkSession.createDataFrame(index(urls, rules), "token string, name string, verdict string, pattern string, weight int")
    filed = F.broadcast(filed) if len(rules) <= BROADCAST_RULES else filed
    probes = urls.select("url", _judged(F.col("url")).alias("text")).select("url", "text", F.explode(F.array_union(_tokens(F.col("text")), F.array(F.lit("")))).alias("token"))
    fitting = probes.join(filed, "token").filter(F.expr("text rlike pattern"))
    place = F.when(F.col("weight") > 0, F.struct("weight", "name", "verdict"))
    other = F.when(F.col("weight") == 0, F.struct("name", "verdict"))
    best = fitting.groupBy("url").agg(F.max(place).alias("place"), F.min(other).alias("other"))
    found = rows.join(best, "url", "left")
    return found.select(
        id_col,
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("place.name").alias("rule"),
        F.coalesce("place.verdict", "other.verdict", F.lit(default)).alias("verdict"),
        F.col("other.name").alias("pattern_rule"),
    )


#: The same in DuckDB's SQL, over ``pages`` and with every rule run on every URL.
ORACLE_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*(.*)$', 1, 's'), '') AS rest,
         row_number() OVER () AS n
  FROM pages
), places(name, host, path, verdict) AS (
  VALUES {places}
), patterns(name, pattern) AS (
  VALUES {patterns}
), placed AS (
  SELECT p.n, arg_max(r.name, length(r.name)) AS rule, arg_max(r.verdict, length(r.name)) AS verdict
  FROM parts p JOIN places r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n
), patterned AS (
  SELECT p.n, min(r.name) AS pattern_rule
  FROM parts p JOIN patterns r ON p.host || p.rest <> '' AND regexp_matches(p.host || p.rest, r.pattern)
  GROUP BY p.n
)
SELECT page_id, host, path, rule, coalesce(placed.verdict, CASE WHEN pattern_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern_rule
FROM parts LEFT JOIN placed USING (n) LEFT JOIN patterned USING (n)
""".format(
    upper=UPPER,
    lower=LOWER,
    places=", ".join(f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in PLACES),
    patterns=", ".join(f"('{r.name}', '{r.pattern}')" for r in PATTERNS),
)
