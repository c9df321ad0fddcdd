"""Role and mode policy, and capability gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions.urls import _col

Matrix = dict[str, tuple[str, ...]]


def reversible_roles(matrix: Matrix | None = None) -> list[str]:
    table = fixed.ALLOWED_MODES if matrix is None else matrix
    return [role for role, modes in table.items() if fixed.MODE_REVERSIBLE in modes]


def resolve_mode(
    role: Column | str, requested: Column | str, matrix: Matrix | None = None,
    default: str = fixed.DEFAULT_MODE,
) -> Column:
    """``struct(mode, denied)``: an explicit mode is allowed or denied, never swapped.

    Without a request the default applies, or else the most private mode the role has.
    """
    table = fixed.ALLOWED_MODES if matrix is None else matrix
    wanted = _col(requested)
    permitted = F.coalesce(
        F.try_element_at(
            F.create_map(*[
                x for name, modes in table.items()
                for x in (F.lit(name), F.array(*[F.lit(m) for m in modes]).cast("array<string>"))
            ]),
            _col(role),
        ),
        F.array().cast("array<string>"),
    )
    preferred = F.get(
        F.filter(
            F.array(*[F.lit(m) for m in (default, *fixed.FALLBACK_MODES)]),
            lambda m: F.array_contains(permitted, m),
        ),
        0,
    )
    mode = F.when(wanted.isNull(), preferred).when(F.array_contains(permitted, wanted), wanted)
    return F.struct(mode.alias("mode"), mode.isNull().alias("denied"))


def effective_role(session: Column | str, requested: Column | str) -> Column:
    """The requested role if it ranks no higher than the session's, else the session's."""
    ranks = F.create_map(*[F.lit(x) for pair in fixed.ROLE_RANK.items() for x in pair])
    wanted, own = _col(requested), _col(session)
    lower = F.try_element_at(ranks, wanted) <= F.try_element_at(ranks, own)
    return F.when(F.coalesce(lower, F.lit(False)), wanted).otherwise(own)


def capability_table(spark, capabilities: dict[str, tuple] | None = None) -> DataFrame:
    rows = [(role, *caps) for role, caps in (capabilities or fixed.CAPABILITIES).items()]
    return spark.createDataFrame(
        rows,
        "role string, max_tier int, can_proxy boolean, can_capture boolean, can_solve boolean, "
        "can_crawl boolean, can_paginate boolean, can_data_tree boolean",
    )


def check_capabilities(
    requests: DataFrame, capabilities: dict[str, tuple] | None = None, sidekick: bool = False
) -> DataFrame:
    """Add ``denials``, the list of refused wishes, and ``allowed``.

    ``requests`` holds role, tier_hint, capture_api, proxy, captcha_api_url,
    captcha_api_key, crawl_depth, paginate, data_tree and cookies_browser. An unknown
    role has the lowest role's capabilities.
    """
    known = list((capabilities or fixed.CAPABILITIES).keys())
    caps = capability_table(requests.sparkSession, capabilities).withColumnRenamed("role", "_role")
    gated = requests.withColumn(
        "_role", F.when(F.col("role").isin(*known), F.col("role")).otherwise(F.lit(fixed.ROLE_BASIC))
    # The table has one row per role, so broadcasting it is safe at any scale.
    ).join(F.broadcast(caps), "_role")

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    def wish(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))

    rules = [
        (F.col("tier_hint") > F.col("max_tier"), "tier"),
        (wish("capture_api") & ~F.col("can_capture"), "capture"),
        (given("proxy") & ~F.col("can_proxy"), "proxy"),
        (given("captcha_api_url") & given("captcha_api_key") & ~F.col("can_solve"), "solver"),
        ((F.coalesce("crawl_depth", F.lit(0)) > 0) & ~F.col("can_crawl"), "crawl"),
        (wish("paginate") & ~F.col("can_paginate"), "paginate"),
        (wish("data_tree") & (~F.col("can_data_tree") | F.lit(sidekick)), "data_tree"),
        (given("cookies_browser") & ((F.col("role") != fixed.ROLE_ADMIN) | F.lit(sidekick)), "browser_cookies"),
    ]
    denials = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name in rules]))
    return (
        gated.withColumn("denials", denials)
        .withColumn("allowed", F.size("denials") == 0)
        .select(*requests.columns, "denials", "allowed")
    )
