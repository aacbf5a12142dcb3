"""URL filter whose rules are indexed by their rarest literal token.

A rule has a host, a path prefix and a verdict. Its literal tokens are the labels of its host and the
complete segments of its path. Each rule is filed under the token that the fewest distinct addresses
hold; an address fetches the rules filed under its own tokens and only those run their regular
expression. Columns and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import lower_ascii
from lexiloom.session import settled


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens; the last piece of a path is cut short by any prefix and never counts.

    The empty token stands in every address and in every rule, for rules without any other.
    """
    segments = F.split(path, "/")
    whole = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    marked = lambda parts, mark: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), marked(F.split(host, r"\."), "h "), marked(whole, "p ")))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their text, regular expression on host and path together, and tokens."""
    host, path = lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    return rules.select(
        F.concat(host, path).alias("rule"), F.col("verdict"), F.length(host).alias("host_length"),
        F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(host), F.when(path == "", F.lit(r"(?:/|\z)")).otherwise(_quoted(path)))
        .alias("pattern"),
        _tokens(host, path).alias("tokens")).distinct()


def indexed(rules: DataFrame, address_tokens: DataFrame) -> DataFrame:
    """One row per compiled rule with its rarest token over the given (address, token) rows."""
    wanted = rules.select("rule", "verdict", "host_length", "pattern", F.explode("tokens").alias("token"))
    # The rules are a configuration table; settled() broadcasts it only if its counted size is small.
    named = settled(wanted.select("token").distinct())
    seen = address_tokens.join(named, "token").groupBy("token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)), F.col("token"))
    everywhere = F.col("token") == ""
    return (wanted.join(seen, "token", "left")
            .groupBy("rule", "verdict", "host_length", "pattern")
            .agg(F.min_by("token", F.struct(everywhere, rarity)).alias("token")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (same-named columns are replaced).

    A null url, or one without ``://``, has empty host and path and so matches no rule with a host. Of the
    rules that fit, the longest wins, then the longer host; between equal texts
    the greater verdict (``block`` beats ``allow``). Without any, ``rule`` is null and the verdict is ``default``. Repeated rows are all
    kept. An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*(F.col(f"`{c}`") for c in kept)).withColumns(
        {"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    addresses = parsed.select("host", "path").distinct()
    tokens = addresses.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    index = settled(indexed(compiled(rules), tokens.select("token")))
    # Two rules of equal length and host that fit one address have the same text.
    best = F.struct(F.length("rule"), F.col("host_length"), F.col("verdict"))
    fitting = (tokens.join(index, "token")
               .filter(F.expr("concat(host, path) rlike pattern"))
               .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), best).alias("hit")))
    return (parsed.join(fitting, ["host", "path"], "left")
            .select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))
