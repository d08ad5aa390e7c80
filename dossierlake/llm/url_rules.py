"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An index of up to this many rules is broadcast (below 10 MB); a longer one is shuffled.
BROADCAST_RULES = 50_000
#: Key of rules without a literal token, which every URL has to meet.
ANY = "*"

#: Words of hosts that the default patterns block.
BLOCKED_WORDS = ("adult", "casino", "bets", "pills", "porn", "spam", "track", "viagra", "warez")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens_of(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def path_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) for a host, its subdomains and the paths that start alike.

    A path that ends inside a word may go on in the URL, so its last word is no literal token.
    """
    listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    rule = F.concat("host", "path")
    return spark.range(1).select(F.inline(listed)).select(
        rule.alias("rule"),
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?\Q"), F.replace(rule, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")).alias("regex"),
        tokens_of(F.regexp_replace(rule, "[A-Za-z0-9]+$", "")).alias("tokens"),
        F.lit(1).alias("rank"),
        F.length(rule).alias("length"),
    )


def word_rules(spark: SparkSession, words: tuple[str, ...] = BLOCKED_WORDS, verdict: str = "block") -> DataFrame:
    """Patterns that find a whole word in the host."""
    listed = F.array(*[F.lit(w) for w in words])
    return spark.range(1).select(F.explode(listed).alias("rule")).select(
        "rule",
        F.lit(verdict).alias("verdict"),
        F.concat(F.lit(r"^(?:[^/]*[^a-z0-9/])?\Q"), "rule", F.lit(r"\E(?:[^a-z0-9]|$)")).alias("regex"),
        F.array("rule").alias("tokens"),
        F.lit(0).alias("rank"),
        F.length("rule").alias("length"),
    )


def _backwards(name: Column) -> Column:
    """A text that sorts the other way round: every byte taken from 255, and an end above all bytes."""
    digits = F.translate(F.hex(F.encode(name, "UTF-8")), "0123456789ABCDEF", "fedcba9876543210")
    return F.concat(digits, F.lit("g"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The best rule of every URL: highest ``rank``, then longest, then first by name.

    ``rules`` has rule, verdict, regex (over host + path), tokens (words without which the regex
    cannot match), rank and length. Every rule is kept under the token that is rarest among all
    URLs; a URL fetches the rules of its own tokens and runs only their expressions. Columns: the
    id, url, host, path, rule, rank and verdict (``default`` without a rule).

    A null URL has empty host and path and meets only rules without tokens. Repeated rows are all
    returned. Null ids are kept. An empty table gives no rows, and so do further columns no harm:
    only the two named are read.
    """
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    words = F.explode(F.concat(F.array(F.lit(""), F.lit(ANY)), tokens_of(F.concat("host", "path"))))
    seen = urls.select("*", words.alias("token"))

    total = rules.count()
    small = total <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    # rank, length and name, so that every number of rules has the same order
    placed = rules.withColumn("place", F.struct("rank", "length", _backwards(F.col("rule")).alias("name"), F.col("rule").alias("rule")))
    literal = placed.select("place", F.explode("tokens").alias("token"))
    found = seen.join(hint(literal.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        literal.join(hint(found), "token", "left")
        .groupBy("place")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("key"))
    )
    index = placed.select("place", "regex").join(rarest, "place", "left").select("place", "regex", F.coalesce("key", F.lit(ANY)).alias("key"))

    fits = F.when(F.regexp_like(F.concat("host", "path"), F.col("regex")), F.col("place"))
    # the empty token stands for the row itself and keeps no rule: it counts repeated rows
    met = seen.join(hint(index), F.col("token") == F.col("key"), "left")
    judged = met.groupBy("page_id", "url", "host", "path").agg(
        F.max(fits).alias("place"), F.count(F.when(F.col("token") == "", F.lit(1))).alias("copies")
    )
    return (
        judged.join(hint(placed.select("place", "rule", "verdict", "rank")), "place", "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("page_id", "url", "host", "path", "rule", "rank", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
