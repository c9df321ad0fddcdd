"""Asset manifests: files, media and embeds of pages, merged per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U
from webcorpus.operators.elements import HEAD_CHARS, html_elements
from webcorpus.operators.json_nodes import json_nodes

_ITEM = (
    "struct<rule:int,at:int,sub:int,kind:string,raw:string,name:string,via:string,provider:string>"
)
ITEM_COLUMNS = ("kind", "pos", "url", "name", "ext", "via", "provider", "dl_video")


def _item(
    rule: int, kind: Column, raw: Column, at: Column | None = None, sub: int = 0,
    name: Column | None = None, via: Column | None = None, provider: Column | None = None,
) -> Column:
    empty = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule).alias("rule"), (F.col("el") if at is None else at).alias("at"),
        F.lit(sub).alias("sub"), kind.alias("kind"), raw.alias("raw"),
        (empty if name is None else name).alias("name"),
        (empty if via is None else via).alias("via"),
        (empty if provider is None else provider).alias("provider"),
    ).cast(_ITEM)


def _candidates(elements: DataFrame) -> DataFrame:
    """What each element offers, in rule order: a, video, audio, img, object, iframe and embed."""
    tag, label = F.col("tag"), F.nullif(F.col("text"), F.lit(""))
    attrs = F.col("attrs")
    staged = (
        elements.withColumn(
            "_raw",
            F.when(tag == "a", attrs["href"]).when(tag == "object", attrs["data"]).otherwise(attrs["src"]),
        )
        .withColumn("_kind", U.asset_kind(U.url_ext("_raw")))
        .withColumn("_frame", tag.isin("iframe", "embed"))
        .withColumn("_real", F.when(F.col("_frame"), U.unwrap_viewer("_raw")))
        .withColumn("_real_kind", U.asset_kind(U.url_ext("_real")))
        .withColumn("_player", F.when(F.col("_frame"), U.embed_provider("_raw")))
    )
    raw, kind, document = F.col("_raw"), F.col("_kind"), F.lit("document")
    download = attrs["download"]
    item = (
        F.when(
            tag == "a",
            F.when(kind.isNotNull(), F.array(_item(1, kind, raw, name=label))).when(
                download.isNotNull(),
                F.array(_item(1, document, raw, name=F.coalesce(F.nullif(download, F.lit("")), label))),
            ),
        )
        .when(
            tag == "video",
            F.array(
                _item(2, F.lit("video"), raw, sub=0),
                _item(2, F.lit("image"), attrs["poster"], sub=2),
            ),
        )
        .when(
            (tag == "source") & (F.col("media_tag") == "video"),
            F.array(_item(2, F.lit("video"), raw, at=F.col("media"), sub=1)),
        )
        .when(
            (tag == "source") & (F.col("media_tag") == "audio"),
            F.array(_item(3, F.lit("audio"), raw, at=F.col("media"), sub=1)),
        )
        .when(tag == "audio", F.array(_item(3, F.lit("audio"), raw)))
        .when(tag == "img", F.array(_item(4, F.lit("image"), raw)))
        .when(tag == "object", F.array(_item(5, F.coalesce(kind, document), raw)))
        .when(
            F.col("_real").isNotNull(),
            F.array(
                _item(6, F.coalesce("_real_kind", document), F.col("_real"),
                      via=F.lit(fixed.VIEWER_NOTE))
            ),
        )
        .when(
            F.col("_player").isNotNull(),
            F.array(_item(6, F.lit("embed"), raw, name=F.col("_player.name"),
                          provider=F.col("_player.provider"))),
        )
        .when(F.col("_frame") & kind.isNotNull(), F.array(_item(6, kind, raw)))
    )
    return staged.withColumn("item", F.explode(item))


def _ranked(items: DataFrame, keys: list[str], caps: dict[str, int] | None) -> DataFrame:
    """Position per kind, and the per-kind cap where one is set."""
    order = Window.partitionBy(*keys, "kind").orderBy("_order")
    ranked = items.withColumn("pos", F.row_number().over(order))
    if not caps:
        return ranked
    cap = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in caps.items()])
    # The literal bound lets Spark cut each kind before the shuffle; the exact cap follows.
    return ranked.filter(F.col("pos") <= max(caps.values())).filter(F.col("pos") <= cap)


def harvest_assets(
    pages: DataFrame, url: str = "url", html: str = "html",
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """Manifest rows per page: kind, pos, url, name, ext, via, provider, dl_video.

    All rules read one pass over the elements. Rows of one page stay together until the
    de-duplication, so its partial aggregation already shrinks them to the manifest.
    """
    keys = [c for c in pages.columns if c != html]
    elements = html_elements(
        pages, html, columns=("el", "tag", "attrs", "text", "media", "media_tag"),
        tags=("a", "video", "source", "audio", "img", "object", "iframe", "embed"),
    )
    items = (
        _candidates(elements)
        .select(*keys, "item.*")
        .filter(F.coalesce(F.col("raw"), F.lit("")) != "")
        .withColumn("_abs", U.url_join(url, F.trim("raw")))
    )
    embed = F.col("kind") == "embed"
    resolved = items.filter(
        embed | F.lower("_abs").startswith("http://") | F.lower("_abs").startswith("https://")
    ).withColumn("_url", F.when(embed, F.col("_abs")).otherwise(U.cut_fragment("_abs")))
    distinct = (
        resolved.groupBy(*keys, "kind", F.col("_url").alias("_asset"))
        .agg(
            F.min(
                F.struct(F.struct("rule", "at", "sub").alias("order"), "name", "via", "provider")
            ).alias("first")
        )
        .withColumn("_order", F.col("first.order"))
    )
    name = F.when(F.col("kind") == "embed", F.col("first.name")).otherwise(
        F.substring(F.coalesce("first.name", U.url_name("_asset")), 1, HEAD_CHARS)
    )
    return _ranked(distinct, keys, caps).select(
        *[F.col(k).alias("page_url") if k == url else F.col(k) for k in keys],
        "kind", "pos", F.col("_asset").alias("url"), name.alias("name"),
        F.when(F.col("kind") != "embed", U.url_ext("_asset")).alias("ext"),
        F.col("first.via").alias("via"), F.col("first.provider").alias("provider"),
        F.coalesce(F.col("first.provider").isin(*fixed.DOWNLOADABLE_EMBEDS), F.lit(False)).alias(
            "dl_video"
        ),
    )


def json_files(docs: DataFrame, base: str = "base_url", body: str = "body") -> DataFrame:
    """File URLs among the strings of captured JSON (doc, base_url, body); images are left out."""
    nodes = json_nodes(docs, body, ("scalar", "visit"), types=("string",))
    text = F.col("scalar")
    low = F.lower(text)
    kind = U.asset_kind(U.url_ext(text))
    found = (
        nodes.filter(low.startswith("http://") | low.startswith("https://") | low.startswith("/"))
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull() & (F.col("kind") != "image"))
        .withColumn("url", U.cut_fragment(U.url_join(base, F.trim(text))))
        .filter(F.lower("url").startswith("http://") | F.lower("url").startswith("https://"))
    )
    return (
        found.groupBy("doc", "kind", "url")
        .agg(F.min("visit").alias("visit"))
        .select("doc", "kind", "url", "visit", U.url_name("url").alias("name"),
                U.url_ext("url").alias("ext"))
    )


def merge_assets(
    manifests: DataFrame, seeds: DataFrame, caps: dict[str, int] | None = None
) -> DataFrame:
    """One manifest per job, distinct by URL over all kinds, seed media first.

    ``manifests`` holds (job_id, page_order) and manifest rows; ``seeds`` holds
    (job_id, url). A URL counts under the kind of its first appearance.
    """
    kind_rank = F.array_position(F.array(*[F.lit(k) for k in fixed.ASSET_KINDS]), F.col("kind"))
    rest = [c for c in ITEM_COLUMNS if c not in ("pos", "url")]
    first = (
        manifests.groupBy("job_id", "url")
        .agg(
            F.min(
                F.struct(F.struct("page_order", kind_rank.alias("k"), "pos").alias("order"), *rest)
            ).alias("first")
        )
        .select("job_id", "url", F.col("first.order").alias("_order"),
                *[F.col(f"first.{c}").alias(c) for c in rest])
    )
    kept = _ranked(first, ["job_id"], caps).withColumn("dl_gallery", F.lit(False)).drop("_order")
    known = kept.filter(F.col("kind") == "embed").select("job_id", "url")

    def seed_rows(label: Column, prefix: str, at: int, video: bool) -> DataFrame:
        return seeds.select(
            "job_id", "url", F.lit("embed").alias("kind"), F.lit(at).alias("pos"),
            F.concat(F.lit(prefix), F.initcap(label)).alias("name"),
            F.lit(None).cast("string").alias("ext"), F.lit(None).cast("string").alias("via"),
            label.alias("provider"), F.lit(video).alias("dl_video"),
            F.lit(not video).alias("dl_gallery"),
        ).filter(F.col("provider").isNotNull())

    videos = seed_rows(U.video_provider("url"), "Video de ", 0, True).join(
        known, ["job_id", "url"], "left_anti"
    )
    galleries = seed_rows(U.gallery_provider("url"), "Galería de ", -1, False)
    return kept.unionByName(videos).unionByName(galleries)
