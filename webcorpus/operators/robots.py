"""robots.txt rules as a table and the check of URLs against them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.functions import urls as U
from webcorpus.operators.elements import arrow_rows

RULE_SCHEMA = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("entry", T.IntegerType()),
    T.StructField("agents", T.ArrayType(T.StringType())), T.StructField("allow", T.BooleanType()),
    T.StructField("prefix", T.StringType()), T.StructField("pos", T.IntegerType()),
])


def _entries(body: str) -> list[dict]:
    """Groups of agents with their rules, in file order; groups without rules do not count."""
    groups: list[dict] = []
    current: dict | None = None
    for line in (body or "").splitlines():
        if not line:
            if current and not current["closed"]:
                current = None
            elif current:
                groups.append(current)
                current = None
            continue
        name, found, value = line.partition("#")[0].strip().partition(":")
        if not found:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if current and current["closed"]:
                groups.append(current)
                current = None
            current = current or {"agents": [], "rules": [], "closed": False}
            current["agents"].append(value)
        elif current and name in ("allow", "disallow"):
            # An empty Disallow forbids nothing.
            current["rules"].append((name == "allow" or value == "", value))
            current["closed"] = True
        elif current and name in ("crawl-delay", "request-rate"):
            current["closed"] = True
    if current and current["closed"]:
        groups.append(current)
    return groups


def robots_rules(files: DataFrame) -> DataFrame:
    """Rule rows of robots files (origin, body). Only the first group for ``*`` is the default."""

    def rows(file: dict) -> Iterator[tuple]:
        pos = 0
        default_seen = False
        for entry, group in enumerate(_entries(file["body"])):
            if "*" in group["agents"]:
                if default_seen:
                    continue
                default_seen = True
            for allow, prefix in group["rules"] or [(True, "")]:
                yield (file["origin"], entry, group["agents"], allow, prefix, pos)
                pos += 1

    return files.select("origin", "body").mapInArrow(arrow_rows(rows, RULE_SCHEMA), RULE_SCHEMA)


def _agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """One row per origin: the rules that govern an agent, in file order."""
    name = agent.split("/")[0].lower()
    default = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.lit(name).contains(F.lower(a)))
    rank = F.when(~default & named, F.lit(0)).when(default, F.lit(1))
    candidates = rules.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    chosen = candidates.groupBy("origin").agg(F.min(F.struct("_rank", "entry")).alias("chosen"))
    governing = candidates.join(chosen, "origin").filter(F.col("entry") == F.col("chosen.entry"))
    # A robots file is one input row, which bounds its rule list.
    return governing.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("pos", "allow", "prefix"))).alias("_rules")
    )


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Add ``robots_ok``: the first matching rule decides; no file and no match allow."""
    target = U.unquote(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", ""))
    path = F.when(target == "", F.lit("/")).otherwise(target)
    matching = F.filter(
        "_rules", lambda r: (r["prefix"] == "*") | path.startswith(U.unquote(r["prefix"]))
    )
    joined = urls.withColumn("_origin", U.url_origin(url)).join(
        _agent_rules(rules, agent).withColumnRenamed("origin", "_origin"), "_origin", "left"
    )
    return joined.withColumn(
        "robots_ok", F.coalesce(F.get(matching, 0)["allow"], F.lit(True))
    ).drop("_origin", "_rules")
