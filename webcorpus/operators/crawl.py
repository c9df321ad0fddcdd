"""Bounded breadth-first traversal over a corpus of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U
from webcorpus.functions.text import bundle_section, heading_title, strip, title_from_markdown
from webcorpus.functions.text import llms_txt as llms_column
from webcorpus.operators.links import link_array
from webcorpus.operators.robots import robots_allowed
from webcorpus.session import bucketed, cut_lineage, discard

EMPTY_CRAWL_ERROR = "the crawl brought no page"
FEW_HOSTS = 100_000  # names of hosts that may be sent to every task


def page_index(
    pages: DataFrame, same_domain: bool = True, drop_chrome: bool = True, hosts: DataFrame | None = None,
    content_dedup: bool = True, followed: DataFrame | None = None,
) -> DataFrame:
    """(url, digest, links) per page: all a traversal needs, so bodies are read once.

    ``pages`` holds (url, html) and optionally final_url, against which links resolve, and
    content, the raw bytes that tell copies apart. With ``hosts`` (host), other sites' pages
    are left out before their links are extracted. With ``followed`` (url) only those pages
    have links, and the others NULL.
    """
    base = "final_url" if "final_url" in pages.columns else "url"
    content = "content" if "content" in pages.columns else "html"
    if not content_dedup:
        content = "url"
    if hosts is not None:
        # Dealt by host, the pages of one large site would all be read by one task, so few hosts are sent to the pages.
        hosts = F.broadcast(hosts) if hosts.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS else hosts
        pages = pages.withColumn("host", U.url_host("url")).join(hosts, "host", "left_semi").drop("host")
    links = link_array(F.coalesce("html", F.lit("")), base, same_domain, drop_chrome)
    if followed is not None:
        pages = pages.join(followed.select("url", F.lit(True).alias("_followed")).distinct(), "url", "left")
        links = F.when(F.col("_followed"), links)
    facts = pages.select("url", F.unhex(F.sha2(F.col(content).cast("binary"), 256)).alias("digest"), links.alias("links"))
    return facts.groupBy("url").agg(F.min(F.struct("digest", "links")).alias("p")).select(
        "url", "p.digest", "p.links"
    )


def crawl(
    pages: DataFrame, seeds: DataFrame, max_pages: int = 10, max_depth: int = 1,
    same_domain: bool = True, drop_chrome: bool = True,
    robots: DataFrame | None = None, agent: str = "webcorpus", content_dedup: bool = True,
) -> DataFrame:
    """Pages each job reaches: (job_id, ord, url, depth, parent), in breadth-first order.

    ``seeds`` holds (job_id, url) and optionally max_pages, max_depth and scope_path. A page
    that is missing or barred is skipped but stays seen; a copy of content the job already
    has is neither counted nor followed; the parent is the first page to link to a URL.

    One round per level. Within a round, copies and repeated URLs fall to aggregations that
    combine before the shuffle, and the page cap is a top-k per job, so a job with a huge
    frontier never gathers in one task. Each round ends in a checkpoint.
    """
    defaults = {"max_pages": F.lit(max_pages), "max_depth": F.lit(max_depth),
                "scope_path": F.lit(None).cast("string")}
    jobs = cut_lineage(
        seeds.select(
            "job_id", "url", *[F.coalesce(c, v).alias(c) if c in seeds.columns else v.alias(c) for c, v in defaults.items()]
        )
    )
    bounds = jobs.agg(F.max("max_pages").alias("pages"), F.max("max_depth").alias("depth")).first()
    if bounds.pages is None:
        return jobs.select("job_id", F.lit(0).alias("ord"), "url", F.lit(0).alias("depth"),
                           F.lit(None).cast("string").alias("parent")).limit(0)
    hosts = jobs.select(U.url_host("url").alias("host")).distinct() if same_domain else None
    # Written once, in buckets: a level sends its own URLs to them, and reads digests of those it asks for and
    # links of those it accepts. The index does not move again.
    # The pages of the last level are not followed: one level below the seeds, only the seeds' links count.
    followed = jobs.select("url") if bounds.depth <= 1 else None
    index = bucketed(page_index(pages, same_domain, drop_chrome, hosts, content_dedup, followed), "url")
    if robots is not None:
        robots = cut_lineage(robots)
    limits = jobs.select("job_id", "max_pages", "max_depth", "scope_path")

    # ``at`` is the place of a URL's first link: the linking page's number, then the link's own, in one number.
    frontier = jobs.select("job_id", "url", F.lit(0).cast("long").alias("at"))
    seen = frontier.select("job_id", "url")
    found: DataFrame | None = None
    digests: DataFrame | None = None
    above: DataFrame | None = None
    done: list[DataFrame] = []
    for depth in range(int(bounds.depth) + 1):
        if robots is not None:
            frontier = robots_allowed(frontier, robots, agent).filter("robots_ok").drop("robots_ok")
        fetched = frontier.join(index.select("url", "digest"), "url")
        fresh = fetched.groupBy("job_id", "digest").agg(F.min(F.struct("at", "url")).alias("p")).withColumn("at", F.col("p.at"))
        if digests is not None:
            fresh = fresh.join(digests, ["job_id", "digest"], "left_anti")
            have = found.groupBy("job_id").agg(F.max("ord").alias("_have"))
            fresh = fresh.join(have, "job_id")
        else:
            fresh = fresh.withColumn("_have", F.lit(0))
        turn = F.row_number().over(Window.partitionBy("job_id").orderBy("at"))
        chosen = (
            fresh.withColumn("_turn", turn)
            .filter(F.col("_turn") <= int(bounds.pages))
            .join(limits, "job_id")
            .filter((F.col("_have") + F.col("_turn") <= F.col("max_pages")) & (F.col("max_depth") >= depth))
            .select(
                "job_id", (F.col("_have") + F.col("_turn")).alias("ord"), F.col("p.url").alias("url"),
                F.lit(depth).alias("depth"), F.shiftright("at", 32).cast("int").alias("_from"), "digest", "max_depth", "scope_path",
            )
        )
        if above is None:
            chosen = chosen.withColumn("parent", F.lit(None).cast("string"))
        else:
            # The parent's URL is looked up for accepted pages only; links carry its number.
            named = above.select("job_id", F.col("ord").alias("_from"), F.col("url").alias("parent")).dropDuplicates(["job_id", "_from"])
            chosen = chosen.join(named, ["job_id", "_from"], "left")
        accepted = cut_lineage(chosen.drop("_from"))
        rows = accepted.select("job_id", "ord", "url", "depth", "parent")
        found = rows if found is None else found.unionByName(rows)
        marks = accepted.select("job_id", "digest")
        digests = marks if digests is None else digests.unionByName(marks)
        above = accepted
        if depth == int(bounds.depth):
            break
        # Links are fetched for the accepted pages only.
        linked = (
            accepted.filter(F.col("max_depth") > depth).join(index.select("url", "links"), "url")
            .select("job_id", "ord", "scope_path", F.posexplode("links").alias("pos", "url"))
            .filter(F.col("scope_path").isNull() | U.in_scope("url", F.col("scope_path")))
        )
        place = F.shiftleft(F.col("ord").cast("long"), 32) + F.col("pos")
        frontier = (
            linked.groupBy("job_id", "url").agg(F.min(place).alias("at"))
            .join(seen, ["job_id", "url"], "left_anti")
        )
        if depth + 1 < int(bounds.depth) or robots is not None:
            # Read more than once; the last one goes straight into the last round.
            frontier = cut_lineage(frontier)
            done.append(frontier)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.select("job_id", "url"))
    discard(index, *done)  # every round is written
    return found


def dedup_content(
    pages: DataFrame, order: str, content: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """First row per SHA-256 of the content, by ``order`` (a unique column).

    The aggregation carries only digest and order, so a third of the table being one page
    costs one partial result per task; the rows come back through a semi join on ``order``.
    """
    first = pages.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(
        F.min(order).alias(order)
    )
    columns = keep or pages.columns
    return pages.select(*columns).join(first.select(order), order, "left_semi")


def page_tree(crawled: DataFrame, bodies: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Adjacency rows of crawled pages with bytes, title, child count and path from the root.

    ``crawled`` holds (job_id, ord, url, depth, parent), ``bodies`` (url, text). A page whose
    parent was not kept is a root. Levels are followed to the last, or to ``max_depth``; a page
    above itself hangs in the air and is left out.
    """
    texts = bodies.join(crawled.select("url").distinct(), "url", "left_semi")
    described = crawled.join(
        texts.select(
            "url", F.octet_length("text").cast("bigint").alias("bytes"), heading_title("text").alias("title")
        ), "url", "left",
    )
    present = crawled.select("job_id", F.col("url").alias("parent"), F.lit(True).alias("has_parent"))
    linked = described.join(present, ["job_id", "parent"], "left").withColumn(
        "parent",
        F.when(F.coalesce("has_parent", F.lit(False)) & (F.col("parent") != F.col("url")), F.col("parent")),
    ).drop("has_parent")
    linked = cut_lineage(linked)
    children = linked.groupBy("job_id", F.col("parent").alias("url")).agg(F.count("*").alias("children"))
    described = linked.join(children, ["job_id", "url"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    # Each level meets the nodes below it by their parent, so they are dealt by it once.
    nodes = bucketed(described, "job_id", "parent")
    discard(linked)
    level = nodes.filter(F.col("parent").isNull()).withColumn("path", F.array("url"))
    below = nodes.filter(F.col("parent").isNotNull())
    out = level = cut_lineage(level)
    steps = 0
    while (max_depth is None or steps < max_depth) and not level.isEmpty():
        above = level.select("job_id", F.col("url").alias("parent"), F.col("path").alias("_above"))
        level = cut_lineage(
            below.join(above, ["job_id", "parent"])
            .withColumn("path", F.concat("_above", F.array("url"))).select(*out.columns)
        )
        out, steps = out.unionByName(level), steps + 1
    discard(nodes)
    return out.select("job_id", "ord", "url", "depth", "parent", "bytes", "title", "children", "path")


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Totals per job of a data tree: nodes, endpoints, markdown characters, records, roots."""
    return nodes.groupBy("job_id").agg(
        F.count("*").alias("nodes"), F.sum("endpoints_count").alias("api_endpoints"),
        F.sum("markdown_chars").alias("markdown_total_chars"), F.sum("records_count").alias("records"),
        F.sum(F.when(F.col("parent").isNull(), 1).otherwise(0)).alias("roots"),
    )


def bundle(
    pages: DataFrame, job: str = "job_id", order: str = "ord", url: str = "url", md: str = "content_md"
) -> DataFrame:
    """One markdown text per job, a heading per page. The text is one value, so a job's pages meet in one row."""
    section = F.struct(F.col(order).alias("o"), bundle_section(url, md).alias("s"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), fixed.BUNDLE_RULE
    )
    return pages.groupBy(job).agg(F.concat(strip(joined), F.lit("\n")).alias("content_md"))


def llms_txt(docs: DataFrame, body: str = "content_md", source_url: str = "source_url") -> DataFrame:
    """Add ``llms_txt``: the body under its own title and its source."""
    return docs.withColumn("llms_txt", llms_column(body, title_from_markdown(body), source_url))


def frontier_dedup(
    pushes: DataFrame, visited: DataFrame | None = None, crawl_id: str = "crawl_id", seq: str = "seq"
) -> DataFrame:
    """Pushes that enter the queue: the first of each URL not visited before, with its turn order.

    ``pushes`` holds (crawl_id, seq, url, depth); a later worker passes the ``visited`` it
    found. Entries leave the queue by ``seq``, first in first out.
    """
    first = pushes.groupBy(crawl_id, "url").agg(F.min(F.struct(seq, "depth")).alias("p")).select(
        crawl_id, "url", f"p.{seq}", "p.depth"
    )
    return first if visited is None else first.join(visited, [crawl_id, "url"], "left_anti")


def frontier_counts(queued: DataFrame, popped: DataFrame, crawl_id: str = "crawl_id") -> DataFrame:
    """Per crawl: visited (ever queued) and pending (not yet popped)."""
    done = popped.select(crawl_id, "url", F.lit(1).alias("_done"))
    return queued.join(done, [crawl_id, "url"], "left").groupBy(crawl_id).agg(
        F.count("*").alias("visited"), F.sum(F.when(F.col("_done").isNull(), 1).otherwise(0)).alias("pending")
    )


def job_summary(pages: DataFrame, job: str = "job_id", order: str = "ord") -> DataFrame:
    """Facts of each finished job: first page's URL, status, type, tier; totals over all pages."""
    first = F.min_by(
        F.struct("url", "status_code", "content_type", "tier", "tier_name", "escalation", "proxy"), order
    )

    def of(name: str) -> Column:
        return F.col(f"first.{name}")

    return pages.groupBy(job).agg(
        first.alias("first"), F.sum("bytes").alias("bytes"), F.count("*").alias("pages")
    ).select(
        job, of("url").alias("final_url"), of("status_code").alias("http_status"),
        of("content_type").alias("content_type"), "bytes", "pages",
        F.coalesce(of("tier"), F.lit(0)).alias("tier"), of("tier_name").alias("tier_name"),
        of("escalation").alias("escalation"),
        (F.coalesce(of("proxy"), F.lit("")) != "").alias("proxied"),
    )
