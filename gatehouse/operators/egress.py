"""Sanitising of outgoing answers: projections only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.links import LINK_WITH_QUERY, REMOTE_IMAGE, URL_WITH_QUERY
from gatehouse.functions.pii import PII_PATTERNS
from gatehouse.functions.text import fill, listed
from gatehouse.operators.pii import redact_pii, replace_counted
from gatehouse.settings import DEFAULT, Settings


def sanitize_egress(
    answers: DataFrame,
    text: str = "text",
    patterns=PII_PATTERNS,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Cleans `text`; adds `images_removed`, `links_removed`, `pii_redacted`, `pii_counts`,
    `clean` and `egress_summary`.

    Images come first, so that an image whose URL has a query counts once, as an image.
    """
    texts = settings.messages
    rows = answers.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    stages = (
        (REMOTE_IMAGE, texts.image_marker, "images_removed", "]("),
        (LINK_WITH_QUERY, texts.link_marker, "_links", "]("),
        (URL_WITH_QUERY, texts.link_marker, "_urls", "://"),
    )
    for pattern, mark, count, needed in stages:
        likely = F.contains(F.col(text), F.lit(needed))
        rows = replace_counted(rows, text, pattern, mark, count, likely)
    rows = redact_pii(rows, text, patterns, settings)
    counters = ("images_removed", "links_removed", "pii_redacted")
    parts = [
        F.when(F.col(counter) > 0, fill(template, counter))
        for counter, template in zip(
            counters, (texts.image_part, texts.link_part, texts.pii_part), strict=True
        )
    ]
    return (
        rows.withColumn("links_removed", F.col("_links") + F.col("_urls"))
        .withColumnsRenamed({"total": "pii_redacted", "counts": "pii_counts"})
        .withColumn("clean", F.greatest(*counters) == 0)
        .withColumn(
            "egress_summary",
            F.when(F.col("clean"), F.lit(texts.ok)).otherwise(fill(texts.egress, listed(*parts))),
        )
        .drop("_links", "_urls", "summary", *[f"n_{kind}" for kind, _ in patterns])
    )
