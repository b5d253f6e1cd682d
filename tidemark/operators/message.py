"""Message texts and their fit to a limit. Wording comes from a template; lengths are in code points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import one_line

LIMIT = 5000
ELLIPSIS = "…"


@dataclass(frozen=True)
class Template:
    """The parts of a message; blocks are joined by an empty line."""

    header: str = "[Digest] "
    bullet: str = "# "
    mark: str = "[important] "
    indent: str = "  "
    affected: str = "For: "
    source: str = "Source: "
    omitted_before: str = "And "
    omitted_after: str = " more, of lesser importance, were left out."
    closing: str = "Summaries are machine-made; check the source before acting."
    empty: str = "Nothing new."


def entry_block(t: Template, number: Column) -> Column:
    """An entry's block; lines of empty fields are left out."""
    line = lambda label, c: F.when(F.coalesce(one_line(F.col(c)), F.lit("")) != "", F.concat(F.lit(t.indent + label), one_line(F.col(c))))
    head = F.concat(F.lit(t.bullet), number.cast("string"), F.lit(". "), F.when(F.col("importance_rank") == 3, t.mark).otherwise(""), one_line(F.col("headline")))
    return F.concat_ws("\n", head, F.concat(F.lit(t.indent), one_line(F.col("summary"))), line(t.affected, "affected"), line("", "date_note"), F.concat(F.lit(t.indent + t.source), one_line(F.col("source_url"))))


def omitted_line(t: Template, n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit(t.omitted_before), n.cast("string"), F.lit(t.omitted_after)))


def fit(entries: DataFrame, t: Template, header: Column, omitted: Column, limit: int = LIMIT) -> DataFrame:
    """Per digest: digest_id, n_kept, dropped, message, kept; the entries that fit, least important dropped first. `kept` has
    their item_ids, where entries have one.

    Dropping one entry after another removes the lowest importance, the last of equal ones, so what is left is
    always a prefix of (importance, position). The length for every prefix follows from running sums, and the
    longest that fits is taken. A lone entry that is too long has its summary cut, and then the whole text is.
    """
    limit = min(limit, LIMIT)
    by = W.partitionBy("digest_id").orderBy(F.desc("importance_rank"), "idx")
    rows = entries.withColumns({"header": header, "omitted": omitted, "k": F.row_number().over(by), "size": F.count("*").over(W.partitionBy("digest_id"))})
    rows = rows.withColumn("bare", F.char_length(entry_block(t, F.lit(""))) + 2)
    total_digits = _digits_up_to(F.col("k"))
    left = F.col("omitted") + F.col("size") - F.col("k")
    tail = F.coalesce(F.char_length(omitted_line(t, left)) + 2, F.lit(0))
    length = F.char_length("header") + F.sum("bare").over(by.rowsBetween(W.unboundedPreceding, 0)) + total_digits + tail + len(t.closing) + 2
    rows = rows.withColumn("length", length)
    best = F.max(F.when(F.col("length") <= limit, F.col("k"))).over(W.partitionBy("digest_id"))
    rows = rows.withColumn("keep", F.coalesce(best, F.lit(1))).where("k <= keep")
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("digest_id").orderBy("idx")))
    over = F.greatest(F.col("length") - limit, F.lit(0))
    alone = F.col("keep") == 1
    summary = one_line(F.col("summary"))
    keep_chars = F.greatest(F.char_length(summary) - over - 1, F.lit(0))
    cut = F.when(keep_chars > 0, F.concat(F.left(summary, keep_chars), F.lit(ELLIPSIS))).otherwise("")
    rows = rows.withColumn("summary", F.when(alone & (over > 0), cut).otherwise(F.col("summary")))
    block = F.struct("number", entry_block(t, F.col("number")).alias("text"))
    out = rows.groupBy("digest_id").agg(F.first("header").alias("header"), F.first("omitted").alias("omitted"), F.first("size").alias("size"), F.count("*").alias("n_kept"), F.sort_array(F.collect_list(block)).alias("blocks"), *([F.collect_list("item_id").alias("kept")] if "item_id" in entries.columns else []))
    text = F.concat_ws("\n\n", "header", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), omitted_line(t, F.col("omitted") + F.col("size") - F.col("n_kept")), F.lit(t.closing))
    fits = F.char_length(text) <= limit
    return out.select("digest_id", F.col("n_kept").cast("int"), (F.col("size") - F.col("n_kept")).cast("int").alias("dropped"), F.when(fits, text).otherwise(F.concat(F.left(text, F.lit(max(0, limit - 1))), F.lit(ELLIPSIS))).alias("message"), *(["kept"] if "item_id" in entries.columns else []))


def _digits_up_to(k: Column) -> Column:
    """Digits of all numbers from 1 to k."""
    return sum((F.greatest(k - (10**d - 1), F.lit(0)) for d in range(1, 5)), k).cast("long")


def empty_message(t: Template, header: Column) -> Column:
    return F.concat_ws("\n\n", header, F.lit(t.empty), F.lit(t.closing))


#: Lines and characters of a notification.
OPS_LINES, OPS_CHARS = 20, 3000


def ops_body(lines: Column, max_lines: int = OPS_LINES, max_chars: int = OPS_CHARS) -> Column:
    """A notification's body: at most `max_lines` lines, the number of the rest, and at most `max_chars`."""
    rest = F.size(lines) - max_lines
    shown = F.array_join(F.slice(lines, 1, max_lines), "\n")
    return F.left(F.concat(shown, F.when(rest > 0, F.concat(F.lit("\n... "), rest.cast("string"), F.lit(" more"))).otherwise("")), F.lit(max_chars))


def fit_urgent(entries: DataFrame, t: Template, header: Column, limit: int = LIMIT) -> DataFrame:
    """As `fit`, but entries are dropped from the end, whatever their importance."""
    return fit(entries.withColumn("importance_rank", F.lit(3)), t, header, F.lit(0), limit)


def webhook_kind(url: Column) -> Column:
    """The kind of a webhook by its host: slack, discord or plain."""
    return F.when(url.rlike(r"^https://hooks\.slack\.com/"), "slack").when(url.rlike(r"^https://(discord|discordapp)\.com/api/webhooks/"), "discord").otherwise("plain")
