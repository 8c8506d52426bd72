"""Landed pages of source records: envelope, duplicates, page checks, batch ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def envelope(df: DataFrame, payload: str, source: str, fmt: Column, fetched_at: Column) -> DataFrame:
    """Wrap a payload with source, fetch time, format, size and SHA-256 checksum."""
    body = F.col(payload).cast("binary")
    return df.select(
        "*", F.lit(source).alias("source_name"), fetched_at.alias("fetched_at"), fmt.alias("format"),
        F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("checksum"),
    )


def dedupe_pages(pages: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """One page per checksum, the one with the lowest key, and none already in ``seen``.

    A min-by aggregate, so a third of all pages being one copy costs one row per task.
    """
    once = pages.groupBy("checksum").agg(F.min_by(F.struct(*pages.columns), key).alias("_p")).select("_p.*")
    return once if seen is None else once.join(seen.select("checksum"), "checksum", "left_anti")


def page_valid(records: str, required: Sequence[str]) -> Column:
    """True when the page has records and every record has the required fields."""
    complete = F.forall(records, lambda r: _all([r[name].isNotNull() for name in required]))
    return F.coalesce((F.size(records) > 0) & complete, F.lit(False))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def validate_pages(pages: DataFrame, records: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted pages, rejected pages): one bad record rejects its whole page. No shuffle."""
    marked = pages.withColumn("_ok", page_valid(records, required))
    return marked.where("_ok").drop("_ok"), marked.where("NOT _ok").drop("_ok")


def page_log(
    pages: DataFrame, key: str, records: str, required: Sequence[str], transform: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Per page: accepted, records in, records out of the transform. A failing page is a row, not an error."""
    marked = pages.select(key, page_valid(records, required).alias("accepted"), F.size(records).cast("long").alias("records_in"), records)
    exploded = marked.where("accepted").select(key, F.explode(records).alias("r")).select(key, "r.*")
    out = transform(exploded).groupBy(key).agg(F.count(F.lit(1)).alias("records_out"))
    return marked.drop(records).join(out, key, "left").withColumn("records_out", F.coalesce("records_out", F.lit(0)))


def ingest_batch(
    pages: DataFrame, source: str, records: str, required: Sequence[str], transform: Callable[[DataFrame], DataFrame],
    store: Callable[[DataFrame], None] | None = None, rejects: Callable[[DataFrame], None] | None = None, tries: int = 3,
) -> DataFrame:
    """Validate, transform and store pages; one row per stage with ok, records and error.

    One lazy plan is written once; the counts of the earlier stages are observed
    on the way. Without ``store`` it is a dry run that only counts. A failed
    store is repeated up to ``tries`` times, on top of Spark's own task retries.
    """
    spark = pages.sparkSession
    fetched, valid, done = Observation(), Observation(), Observation()
    seen = pages.observe(fetched, F.count(F.lit(1)).alias("n"))
    good, _ = validate_pages(seen, records, required)
    rows = good.observe(valid, F.count(F.lit(1)).alias("n")).select(F.explode(records).alias("r")).select("r.*")
    out = transform(rows).observe(done, F.count(F.lit(1)).alias("n"))
    error = None
    for attempt in range(tries):
        try:
            out.write.format("noop").mode("overwrite").save() if store is None else store(out)
            error = None
            break
        except Exception as exc:  # recorded in the log; the last failure stays
            error = f"{type(exc).__name__}: {str(exc)[:200]}"
    if rejects is not None and error is None:
        rejects(validate_pages(pages, records, required)[1])
    schema = "source STRING, stage STRING, ok BOOLEAN, records BIGINT, error STRING"
    if error is not None:
        return spark.createDataFrame([(source, "store", False, None, error)], schema)
    return spark.createDataFrame([
        (source, "fetch", True, fetched.get["n"], None), (source, "validate", True, valid.get["n"], None),
        (source, "transform", True, done.get["n"], None), (source, "store", store is not None, done.get["n"] if store else 0, None),
    ], schema)


def run_log(runs: DataFrame, source: str | None = None, status: str | None = None) -> DataFrame:
    """Runs of a source and status, newest first."""
    from fieldloom.operators.filters import filter_attrs

    return filter_attrs(runs, {"source_name": source, "status": status}).orderBy(F.desc("started_at"), "source_name")


def search_catalogue(
    df: DataFrame, domain: str | None = None, status: str | None = None, text: str | None = None
) -> DataFrame:
    """Catalogue rows by domain membership, status and a substring of name or description."""
    if domain is not None:
        df = df.where(F.array_contains("domains", domain))
    if status is not None:
        df = df.where(F.col("status") == status)
    if text is not None:
        df = df.where(F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower()))
    return df
