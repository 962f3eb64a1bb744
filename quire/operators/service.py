"""Rules of a recognition service as columns: options, waiting, retries, deletion, limits of reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jobs import ENDED

ENGINES, OUTPUTS, DEFAULT_OUTPUTS = ("lines",), ("json", "md", "html", "pdf_flow", "pdf_positional", "pdf_searchable", "docx"), ("md", "html", "json")
IMAGES, IMAGE_CHARS, ANSWER_BYTES = 2, 12_000_000, 2_000_000


def options(raw: Column, docx: bool = False) -> Column:
    """(code, reason, engine, outputs) of a job's options, a JSON object: 200, or 400 with what is wrong with them.

    Without an engine or outputs the defaults hold; a DOCX file is made only where that is switched on.
    """
    text = F.when(F.btrim(F.coalesce(raw, F.lit(""))) == "", F.lit("{}")).otherwise(raw)
    keys = F.json_object_keys(text)
    engine = F.coalesce(F.get_json_object(text, "$.engine"), F.lit(ENGINES[0]))
    listed = F.from_json(F.get_json_object(text, "$.outputs"), "array<string>")
    given = F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), "outputs")
    outputs = F.when(given, listed).otherwise(F.array(*map(F.lit, DEFAULT_OUTPUTS)))
    strange = F.sort_array(F.array_distinct(F.array_except(outputs, F.array(*map(F.lit, OUTPUTS)))))
    without = F.filter(outputs, lambda x: x != "docx")
    kept = outputs if docx else F.when(F.size(without) > 0, without).otherwise(F.array(F.lit("pdf_positional")))
    reason = (
        F.when(keys.isNull(), "options are no JSON object")
        .when(~engine.isin(*ENGINES), "unknown engine")
        .when(outputs.isNull() | (F.size(outputs) == 0) | F.exists(outputs, lambda x: x.isNull()), "outputs are no list of names")
        .when(F.size(strange) > 0, F.concat(F.lit("unsupported outputs: "), F.array_join(strange, ", ")))
    )
    return F.struct(F.when(reason.isNull(), 200).otherwise(400).alias("code"), reason.alias("reason"), F.when(reason.isNull(), engine).alias("engine"), F.when(reason.isNull(), kept).alias("outputs"))


def answer(size: Column, pages: Column, admitted: Column, status: Column, most_bytes: int = 200 << 20, most_pages: int = 300) -> Column:
    """What a request that waits for its job is answered: an HTTP status.

    pages is null for a file that can't be read; status is the job's when the time to wait is over.
    """
    return (
        F.when(size == 0, 400)
        .when(size > most_bytes, 413)
        .when(pages.isNull(), 422)
        .when(pages > most_pages, 413)
        .when(~admitted, 429)
        .when(status == "failed", 422)
        .when(status == "completed", 200)
        .otherwise(504)
    )


def keeps_input(status: Column) -> Column:
    """Whether the file of a request must stay: a worker may still need it."""
    return F.coalesce(status.isin("queued", "running"), F.lit(False))


def deletion(status: Column) -> Column:
    """(code, action) for a request to delete a job: a waiting one is cancelled, an ended one goes, a running one is refused."""
    code = F.when(status == "queued", 200).when(status.isin(*ENDED), 204).when(status == "running", 409).otherwise(404)
    return F.struct(code.alias("code"), F.when(code == 200, "cancelled").when(code == 204, "removed").otherwise("none").alias("action"))


def retries(failures: Column, most: int = 3, shrink: float = 0.7) -> Column:
    """(attempts, scale, failed) of a page from the kinds of its failures in order: "memory", or any other, which ends it.

    A page is tried up to ``most`` times; the last try has a lower resolution.
    """
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(failures), F.lit(1))), lambda i: F.coalesce(F.get(failures, i - 1) != "memory", F.lit(False)))
    stop = F.coalesce(F.array_min(ends), F.lit(most + 1))
    attempts = F.least(F.lit(most), stop, F.size(failures) + 1)
    failed = F.size(failures) >= attempts
    return F.struct(attempts.cast("int").alias("attempts"), F.when((attempts == most) & (most > 1), shrink).otherwise(1.0).alias("scale"), failed.alias("failed"))


def sendable(images: Column) -> Column:
    """Whether a review may carry these pictures: two at most, embedded, of bounded size."""
    embedded = F.forall(images, lambda x: F.coalesce(x.startswith("data:image/jpeg;base64,") | x.startswith("data:image/png;base64,"), F.lit(False)))
    size = F.aggregate(images, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    return (F.size(images) <= IMAGES) & embedded & (size <= IMAGE_CHARS)


def usable_answer(size: Column, finish: Column) -> Column:
    """Whether an answer of a language model is whole and of bounded size."""
    return F.coalesce((size <= ANSWER_BYTES) & (finish == "stop"), F.lit(False))
