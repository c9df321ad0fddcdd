"""End-to-end batch jobs: admit, gather, convert, protect, format, summarise."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U
from webcorpus.functions.text import llms_txt, strip, title_from_markdown
from webcorpus.operators import assets, crawl, links, markdown, privacy
from webcorpus.operators.json_nodes import rank_endpoints, score_endpoints
from webcorpus.operators.policy import resolve_mode
from webcorpus.operators.records import flatten_records
from webcorpus.session import cut_lineage, discard
from webcorpus.sources.pages import one_capture

FETCH_ERROR = "the page could not be fetched"
EMPTY_ERROR = "no usable content was found"
DENIED_ERROR = "the role does not allow this privacy mode"
Complete = Callable[[list[str], list[str]], list[str]]


def gather(requests: DataFrame, pages: DataFrame, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gathered pages, errors) of jobs: a paging sweep, a traversal or one page each.

    ``requests`` holds (job_id, url, crawl_depth, max_pages, paginate, crawl_scope).
    Gathered rows are (job_id, ord, url, depth, parent).
    """
    sweep = F.coalesce(F.col("paginate"), F.lit(False))
    requests = requests.withColumn("crawl_depth", F.coalesce("crawl_depth", F.lit(0))).withColumn("max_pages", F.coalesce("max_pages", F.lit(1)))
    wide = (F.coalesce("crawl_depth", F.lit(0)) > 0) | (F.coalesce("max_pages", F.lit(1)) > 1)
    sweeps = requests.filter(sweep).select("job_id", "url", F.greatest("max_pages", F.lit(1)).alias("max_pages"))
    crawls = requests.filter(~sweep & wide).select(
        "job_id", "url", "max_pages", F.col("crawl_depth").alias("max_depth"),
        F.when(F.col("crawl_scope") == "path", U.scope_prefix("url")).alias("scope_path"),
    )
    singles = requests.filter(~sweep & ~wide).select("job_id", "url")
    most = sweeps.agg(F.max("max_pages")).first()[0] or 0
    nothing = F.lit(None).cast("string").alias("parent")
    found = singles.join(pages.select("url").distinct(), "url", "left_semi").select(
        "job_id", F.lit(1).alias("ord"), "url", F.lit(0).alias("depth"), nothing
    )
    if most:
        # A chain's first steps do not depend on where it is cut, so one run serves all jobs.
        swept = links.paginate(pages, sweeps.select(F.col("job_id").alias("seed"), "url"), int(most))
        found = found.unionByName(
            swept.withColumnRenamed("seed", "job_id").join(sweeps.drop("url"), "job_id")
            .filter(F.col("step") <= F.col("max_pages"))
            .select("job_id", F.col("step").alias("ord"), "url", F.lit(0).alias("depth"), nothing)
        )
    if not crawls.isEmpty():
        found = found.unionByName(crawl.crawl(pages, crawls, robots=robots))
    found = cut_lineage(found)
    missing = requests.join(found.select("job_id").distinct(), "job_id", "left_anti")
    errors = missing.select(
        "job_id",
        F.when(~sweep & wide, F.lit(crawl.EMPTY_CRAWL_ERROR)).otherwise(F.lit(FETCH_ERROR)).alias("error"),
    )
    return found, errors


def _page_columns(pages: DataFrame) -> DataFrame:
    defaults = {
        "content_type": F.lit("text/html"), "status_code": F.lit(200), "tier": F.lit(0),
        "tier_name": F.lit(None).cast("string"), "proxy": F.lit(None).cast("string"),
        "escalation": F.array().cast("array<string>"),
    }
    return pages.select(
        "url", "html", *[F.col(c) if c in pages.columns else v.alias(c) for c, v in defaults.items()]
    )


def _within_reach(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """The pages that jobs can come to: those asked for by URL, those of crawled hosts, all for paging sweeps."""
    sweep = F.coalesce(F.col("paginate"), F.lit(False))
    wide = (F.coalesce("crawl_depth", F.lit(0)) > 0) | (F.coalesce("max_pages", F.lit(1)) > 1)
    if not requests.filter(sweep).isEmpty():
        return pages
    asked = requests.select("url").distinct()
    near = pages.join(asked, "url", "left_semi")
    if requests.filter(wide).isEmpty():
        return near
    hosts = requests.filter(wide).select(U.url_host("url").alias("_host")).distinct()
    on_hosts = pages.withColumn("_host", U.url_host("url")).join(hosts, "_host", "left_semi").drop("_host")
    return on_hosts.unionByName(near.withColumn("_host", U.url_host("url")).join(hosts, "_host", "left_anti").drop("_host"))


def run_jobs(
    requests: DataFrame, pages: DataFrame, schema: dict | None = None, complete: Complete | None = None,
    robots: DataFrame | None = None, with_files: bool = True,
) -> DataFrame:
    """Envelope rows for job requests over a page corpus; failures are rows, never exceptions.

    ``requests`` holds job_id, url, role, privacy_mode, output_format and the gather columns. Texts of
    reversible jobs are masked for good here; :func:`run_reversible_jobs` keeps what takes them back.
    """
    return _run(requests, pages, schema, complete, robots, with_files, None)[0]


def run_reversible_jobs(
    requests: DataFrame, pages: DataFrame, secret: str, created_at: datetime, ttl_s: int = 24 * 3600,
    schema: dict | None = None, complete: Complete | None = None, robots: DataFrame | None = None, with_files: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(envelopes, token maps) of jobs. The envelope of a reversible job with personal data carries its
    ``mapping_ref``, and :func:`privacy.revert` restores its text from the maps. JSON answers get their
    values back at once and keep no map. Write both with :func:`store_version`.
    """
    return _run(requests, pages, schema, complete, robots, with_files, (secret, created_at, ttl_s))


def store_version(base: str, version: int, tables: dict[str, DataFrame]) -> None:
    """Write tables that belong together as one version; readers see all of them or none.

    A version is valid once its mark is written, which is last. The same version again replaces it.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    marks = spark.createDataFrame([(name,) for name in sorted(tables)], "name string")
    marks.coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/version={version}")


def stored_version(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the given or the last valid version."""
    if version is None:
        version = spark.read.parquet(f"{base}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{base}/{name}/version={version}")


def _run(
    requests: DataFrame, pages: DataFrame, schema: dict | None, complete: Complete | None, robots: DataFrame | None,
    with_files: bool, keep: tuple[str, datetime, int] | None,
) -> tuple[DataFrame, DataFrame | None]:
    resolved = cut_lineage(
        requests.withColumn("_m", resolve_mode("role", "privacy_mode")).withColumn("mode", F.col("_m.mode")).drop("_m")
    )
    admitted = resolved.filter(F.col("mode").isNotNull())
    # One capture per URL, chosen once and only where a job can come: bodies, links, facts and files come from it.
    reachable = _within_reach(pages, admitted)
    stored = cut_lineage(_page_columns(one_capture(reachable, "fetched_at" if "fetched_at" in pages.columns else None)))
    found, gather_errors = gather(admitted, stored.select("url", "html"), robots)
    wanted = stored.join(found.select("url").distinct(), "url", "left_semi")
    body = wanted.withColumn("text", F.col("html"))
    converted = cut_lineage(
        markdown.to_markdown(body.select("url", "content_type", "text"), key="url").drop("route")
    )
    sections = found.join(converted, "url", "left")
    page_count = found.groupBy("job_id").agg(F.count("*").alias("_n"))
    single = sections.join(page_count.filter("_n = 1"), "job_id").select("job_id", "content_md")
    many = crawl.bundle(sections.join(page_count.filter("_n > 1"), "job_id"))
    combined = single.unionByName(many)
    usable = F.coalesce(strip("content_md"), F.lit("")) != ""
    empty_errors = combined.filter(~usable).select("job_id", F.lit(EMPTY_ERROR).alias("error"))
    ready = cut_lineage(
        combined.filter(usable).join(
            admitted.select("job_id", F.col("url").alias("source_url"), "role", "mode", "output_format"), "job_id"
        )
    )

    prose, maps = ready.filter(F.col("output_format") != fixed.FORMAT_JSON), None
    reversible = F.col("mode") == fixed.MODE_REVERSIBLE
    no_ref = F.lit(None).cast("string").alias("mapping_ref")
    texts = privacy.apply_privacy(prose if keep is None else prose.filter(~reversible), "job_id", "content_md").withColumn("mapping_ref", no_ref)
    if keep is not None:
        masked, maps = privacy.mask_reversible(prose.filter(reversible), *keep, key="job_id", text="content_md")
        kept = masked.withColumns({"content_md": F.col("masked"), "anonymised": F.lit(True), "mapping_ref": F.col("ref")})
        texts = texts.unionByName(kept.select(*texts.columns))
    llms = llms_txt("content_md", title_from_markdown("content_md"), "source_url")
    output = texts.select(
        "job_id", "mode",
        F.when(F.col("output_format") == fixed.FORMAT_LLMS_TXT, llms).otherwise(F.col("content_md")).alias("content_md"),
        "anonymised", "entities", F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("answer"), "mapping_ref",
    )
    if schema and complete:
        answers = privacy.private_extract(
            ready.filter(F.col("output_format") == fixed.FORMAT_JSON), schema, complete, "job_id", "content_md"
        )
        output = output.unionByName(
            answers.join(ready.select("job_id", "mode"), "job_id").select(
                "job_id", "mode", F.lit(None).cast("string").alias("content_md"), "anonymised", "entities",
                "error", F.col("json").alias("answer"), no_ref,
            )
        )
    else:
        output = output.unionByName(
            ready.filter(F.col("output_format") == fixed.FORMAT_JSON).select(
                "job_id", "mode", F.lit(None).cast("string").alias("content_md"),
                F.lit(False).alias("anonymised"), F.lit(0).alias("entities"),
                F.lit("json output needs a schema and a completion function").alias("error"),
                F.lit(None).cast("string").alias("answer"), no_ref,
            )
        )
    per_page = F.to_json(
        F.struct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ord", "url", F.col("content_md").alias("markdown")))),
                lambda p: F.struct(p["url"].alias("url"), p["markdown"].alias("markdown")),
            ).alias("pages")
        )
    )
    direct_many = output.filter(
        (F.col("mode") == fixed.MODE_DIRECT) & F.col("content_md").isNotNull()
    ).join(page_count.filter("_n > 1"), "job_id").select("job_id")
    pages_json = sections.join(direct_many, "job_id", "left_semi").groupBy("job_id").agg(
        per_page.alias("pages_json")
    )
    facts = wanted.select(
        "url", F.octet_length("html").cast("bigint").alias("bytes"), "content_type", "status_code", "tier",
        "tier_name", "escalation", "proxy",
    )
    summary = crawl.job_summary(found.join(facts, "url"))
    done = output.join(pages_json, "job_id", "left").join(summary, "job_id", "left")
    if with_files:
        done = done.join(job_files(admitted, found, stored), "job_id", "left")
    else:
        done = done.withColumn("files", F.lit(None).cast("string"))

    failed = gather_errors.unionByName(empty_errors).unionByName(
        resolved.filter(F.col("mode").isNull()).select("job_id", F.lit(DENIED_ERROR).alias("error"))
    )
    everything = resolved.join(done.drop("mode"), "job_id", "left").join(
        failed.withColumnRenamed("error", "_failure"), "job_id", "left"
    )
    error = F.coalesce("_failure", "error")
    ok = error.isNull()
    meta = F.map_filter(
        F.create_map(
            F.lit("final_url"), F.col("final_url"), F.lit("http_status"), F.col("http_status").cast("string"),
            F.lit("content_type"), F.col("content_type"), F.lit("bytes"), F.col("bytes").cast("string"),
            F.lit("pages"), F.col("pages").cast("string"), F.lit("tier_name"), F.col("tier_name"),
            F.lit("escalation"), F.to_json("escalation"), F.lit("proxied"), F.col("proxied").cast("string"),
            F.lit("entities"), F.col("entities").cast("string"), F.lit("files"), F.col("files"),
        ),
        lambda _, v: v.isNotNull() & ok,
    )
    envelopes = everything.select(
        "job_id", F.col("url").alias("source_url"), F.coalesce("mode", "privacy_mode").alias("privacy_mode"),
        "role", "output_format", F.when(ok, fixed.STATUS_OK).otherwise(fixed.STATUS_ERROR).alias("status"),
        "tier", F.when(ok, F.col("content_md")).alias("content_md"),
        F.when(ok, F.coalesce("answer", "pages_json")).alias("content_json"),
        F.when(ok, F.col("mapping_ref")).alias("mapping_ref"),
        F.coalesce(F.when(ok, F.col("anonymised")), F.lit(False)).alias("anonymised"),
        error.alias("error"), meta.alias("meta"),
    )
    return envelopes, maps


def job_files(requests: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, files): the merged manifest of each job as JSON, masked unless the mode is direct."""
    manifest = assets.harvest_assets(pages.select("url", "html").join(found.select("url").distinct(), "url", "left_semi"))
    per_job = found.select("job_id", F.col("ord").alias("page_order"), F.col("url").alias("page_url")).join(
        manifest, "page_url"
    ).drop("page_url")
    merged = cut_lineage(
        assets.merge_assets(per_job, requests.join(found.select("job_id").distinct(), "job_id", "left_semi")
                            .select("job_id", "url"))
        .join(requests.select("job_id", "mode"), "job_id")
    )
    direct = merged.filter(F.col("mode") == fixed.MODE_DIRECT).withColumn("masked", F.lit(False))
    hidden = privacy.mask_assets(merged.filter(F.col("mode") != fixed.MODE_DIRECT)).withColumn("masked", F.lit(True))
    item = F.struct("kind", "pos", "url", "name", "ext", "via", "provider", "dl_video", "dl_gallery", "masked")
    return direct.unionByName(hidden).groupBy("job_id").agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("files")
    )


def data_tree(
    pages: DataFrame, captured: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(nodes, records) of deep crawls: each node with its markdown, records and responses.

    Rendered pages (url, html) and their data responses as :func:`read_endpoints` gives
    them. A node's records come from its largest response,
    not from the best-scored one.
    """
    nodes = cut_lineage(
        crawl.crawl(pages, seeds, max_pages, max_depth, content_dedup=False)
    )
    visited = nodes.select("url").distinct()
    text = markdown.main_markdown(pages.select("url", "html").join(visited, "url", "left_semi"))
    # Kept on the way, so that the bodies' shuffles before and after the ranks do not lie side by side.
    scored = cut_lineage(
        score_endpoints(captured.join(visited.withColumnRenamed("url", "page_url"), "page_url", "left_semi"))
        .select("page_url", "seq", "bytes", "is_json", "data_score", "body")
    )
    ranked = rank_endpoints(scored)
    # The largest is marked where the responses of a page stand together for their ranks; no other body is kept.
    by_size = Window.partitionBy("page_url").orderBy(F.col("is_json").desc(), F.col("bytes").desc(), "rank")
    largest = F.col("is_json") & (F.row_number().over(by_size) == 1)
    ranked = cut_lineage(
        ranked.withColumn("_largest", largest).select("page_url", "_largest", F.when(F.col("_largest"), F.col("body")).alias("body"))
    )
    discard(scored)
    flat = cut_lineage(flatten_records(ranked.filter("_largest").select(F.col("page_url").alias("doc"), "body")))
    counts = ranked.groupBy("page_url").agg(F.count("*").alias("endpoints_count"))
    record_counts = flat.groupBy("doc").agg(F.count("*").alias("records_count"))
    described = (
        nodes.join(text, "url", "left")
        .join(counts.withColumnRenamed("page_url", "url"), "url", "left")
        .join(record_counts.withColumnRenamed("doc", "url"), "url", "left")
        .select(
            "job_id", "ord", "url", "depth", "parent", F.coalesce("content_md", F.lit("")).alias("content_md"),
            F.length(F.coalesce("content_md", F.lit(""))).alias("markdown_chars"),
            F.coalesce("endpoints_count", F.lit(0)).alias("endpoints_count"),
            F.coalesce("records_count", F.lit(0)).alias("records_count"),
        )
    )
    records = nodes.select("job_id", "ord", F.col("url").alias("doc")).join(flat, "doc")
    return described, records.withColumnRenamed("doc", "url")
