"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.sources.envelopes import public_view


def write_results(envelopes: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Finished envelopes, one folder per output format, without per-job secrets."""
    safe = public_view(envelopes) if "meta" in envelopes.columns else envelopes
    safe.write.mode(mode).partitionBy("output_format").format(format).save(path)


def export_records(records: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> None:
    """Flat records as CSV with a header or as JSON lines."""
    if format not in ("csv", "json"):
        raise ValueError("records go out as csv or json")
    writer = records.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)


def write_jdbc(envelopes: DataFrame, url: str, table: str, **options: str) -> None:
    """Merged envelopes into a database table; maps and arrays go as JSON text."""
    flat = envelopes.select(
        *[
            F.to_json(f.name).alias(f.name)
            if f.dataType.typeName() in ("map", "array", "struct")
            else F.col(f.name)
            for f in envelopes.schema.fields
        ]
    )
    flat.write.mode("append").format("jdbc").option("url", url).option("dbtable", table).options(**options).save()
