"""Review rules: decisions, acceptance, queues, windows, provenance and jurisdiction checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.functions.numeric import in_window
from paneloom.functions.text import clean, first_prefix, matched_terms


def review_decisions(df: DataFrame, status: str, length: Column, short: int = 200) -> DataFrame:
    """review_status and reason: failed rows rejected, short ones accepted as short, others accepted."""
    failed = F.col(status) != "success"
    decision = F.when(failed, "rejected").otherwise("accepted")
    reason = F.when(failed, "parse_failed").when(length < short, "short_but_official").otherwise("")
    return df.withColumn("review_status", decision).withColumn("review_reason", reason)


def accepted(df: DataFrame, status: str, text: str, window: str) -> DataFrame:
    """Parsed, accepted, inside the window, and with a text."""
    return df.where((F.col(status) == "success") & (F.col("review_status") == "accepted") & F.col(window) & (clean(text) != ""))


def windowed(df: DataFrame, dates: Sequence[str], first: str, last: str, name: str = "in_window") -> DataFrame:
    """Flag by the first of several dates that is there."""
    return df.withColumn(name, in_window(F.coalesce(*(F.col(d).try_cast("date") for d in dates)), first, last))


def source_windows(source: Column, day: Column, windows: dict[str, tuple[str, str]]) -> Column:
    """Inside the window of the row's own source; other sources are outside."""
    out = F.lit(False)
    for name, (first, last) in windows.items():
        out = out | (F.coalesce(source == name, F.lit(False)) & in_window(day, first, last))
    return out


def relabel_outside(df: DataFrame, window: str, status: str, review: str, outside: str = "skipped_out_of_scope") -> DataFrame:
    """Rows outside the window stay, with another status and up for review."""
    return df.withColumn(status, F.when(~F.col(window), outside).otherwise(F.col(status))).withColumn(review, F.when(~F.col(window), "needs_review").otherwise(F.col(review)))


def review_queue(df: DataFrame, reasons: dict[str, tuple[Column, int]]) -> DataFrame:
    """Rows with at least one reason: reasons in order, and a severity that adds their weights."""
    text = F.concat_ws(";", *(F.when(c, F.lit(n)) for n, (c, _) in reasons.items()))
    weight = sum((F.when(c, w).otherwise(0) for c, w in reasons.values()), F.lit(0))
    return df.withColumn("review_reasons", text).withColumn("severity", weight).where("review_reasons != ''")


def jurisdiction_flags(df: DataFrame, applies: Column, title: str, agency: str, unit: str, prefixes: list[tuple[str, str]], central_terms: Sequence[str], central: str = "central") -> DataFrame:
    """Two checks on rows the condition names: a title that begins with another unit, and words of the centre.

    Each check that fires adds its reason, suggestion and evidence; suggestions are distinct, in order.
    """
    named = first_prefix(clean(title), prefixes)
    other = applies & (named != "") & (named != F.coalesce(F.col(unit), F.lit("")))
    words = F.array_join(matched_terms(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(agency), F.lit(""))), list(central_terms)), ";")
    mentions = applies & (words != "")
    out = df.withColumn("review_reason", F.concat_ws(";", F.when(other, "title_names_other_unit"), F.when(mentions, "mentions_centre")))
    out = out.withColumn("review_suggestion", F.array_join(F.array_distinct(F.array_compact(F.array(F.when(other, named), F.when(mentions, F.lit(central))))), ";"))
    out = out.withColumn("review_evidence", F.concat_ws(";", F.when(other, F.concat(F.lit("title_prefix="), named)), F.when(mentions, F.concat(F.lit("central_terms="), words))))
    return out.withColumn("needs_review", F.col("review_reason") != "")


def expand_pages(batches: DataFrame, pages: Column, batch: str) -> DataFrame:
    """A row for each page of each batch, with a zero-padded id."""
    out = batches.withColumn("page_no", F.explode(F.sequence(F.lit(1), pages.cast("int"))))
    return out.withColumn("page_id", F.concat_ws("_", F.col(batch).cast("string"), F.lpad(F.col("page_no").cast("string"), 4, "0")))


def stop_reasons(pages: DataFrame, start: str, time_sorted: Column | None = None, listed: str = "listed", oldest: str = "oldest", page_no: str = "page_no", page_count: str = "page_count") -> DataFrame:
    """Why paging ends at a page: nothing listed, last page, or (sorted by time) items older than the start; else empty.

    pages has a row for each page, also for one without items (``crawl.list_pages``); listed counts its items, dated or
    not, and oldest is the oldest of their days, if any has one.
    """
    by_time = time_sorted if time_sorted is not None else F.lit(True)
    crossed = by_time & F.coalesce(F.col(oldest) < F.lit(start).cast("date"), F.lit(False))
    last = F.coalesce(F.col(page_no) >= F.col(page_count), F.lit(True))
    return pages.withColumn("stop_reason", F.when(F.col(listed) == 0, "empty_list").when(last, "reached_page_count").when(crossed, "page_crossed_target_start_date").otherwise(""))


def gates(spark, checks: Sequence[tuple[str, bool | str, str]]) -> DataFrame:
    """(check, status, evidence) rows of a readiness report; a check's result is whether it passed, or its status."""
    status = lambda x: x if isinstance(x, str) else "pass" if x else "fail"
    return spark.createDataFrame([(n, status(ok), e) for n, ok, e in checks], "check string, status string, evidence string")


def require_gates(report: DataFrame) -> None:
    """Raise if any check failed: what comes after must not run."""
    failed = [r["check"] for r in report.where("status != 'pass'").collect()]
    if failed:
        raise ValueError(f"checks failed: {failed}")


def delimited_counts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """How often each part of a delimited column occurs."""
    parts = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), "\\Q" + separator + "\\E", -1)).alias("value")).where("value != ''")
    return parts.groupBy("value").agg(F.count(F.lit(1)).alias("records"))
