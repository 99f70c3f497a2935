"""From answers of web servers to what fetch jobs say of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, pages


def results(answers: DataFrame) -> DataFrame:
    """What a fetch says (see worker.Fetch) of answers (document_id, url, final_url, status, content_type, body).

    A page that is gone, by its status or by what it says, is a dead link and fails for good, as does what is no page. An answer to a
    robot, a login wall or a page without text is to be tried again, maybe by another reader. pdf: the text of a PDF is in body.
    """
    found = answers.withColumn("kind", pages.fetch_class(F.col("status"))).withColumn("pdf", pages.is_pdf(F.col("content_type"), F.col("url")))
    read = (F.col("kind") == "ok") & ~F.col("pdf") & pages.is_readable(F.col("content_type"))
    # a Python function runs on every row, whatever stands around it: other bodies are not sent to it
    page = markdown.extracted(F.when(read, F.col("body")))
    found = found.withColumn("read", read).withColumn("page", F.when(read, page))
    end = F.coalesce("final_url", "url")
    gone = pages.gone(F.col("page.title"), F.col("url"), end)
    wall = pages.login_wall(F.col("page.markdown"), F.coalesce("page.title", F.lit("")), F.col("url"), end)
    dead = F.when(F.col("kind") == "dead", F.concat(F.lit("dead link: HTTP "), F.col("status").cast("string"))).when(F.col("read") & gone.isNotNull(), F.concat(F.lit("dead link: "), gone))
    text = F.when(F.col("pdf") & (F.col("kind") == "ok"), pages.pdf_markdown(F.col("body"))).when(F.col("read"), F.col("page.markdown"))
    unread = (F.col("kind") == "ok") & ~F.col("pdf") & ~F.col("read")
    error = (
        F.when(dead.isNotNull(), dead)
        .when(F.col("kind") == "anti_bot", F.concat(F.lit("refused: HTTP "), F.col("status").cast("string")))
        .when(F.col("kind") != "ok", F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(unread, F.concat(F.lit("unsupported content type: "), F.coalesce("content_type", F.lit(""))))
        .when(F.col("pdf") & (F.length(text) < 200), "PDF without text")
        .when(F.col("read") & wall.isNotNull(), F.concat(F.lit("login wall: "), wall))
        .when(F.coalesce(text, F.lit("")) == "", "no text")
    )
    return found.select(
        "document_id", error.isNull().alias("ok"), (error.isNotNull() & dead.isNull() & ~unread).alias("retry"), error.alias("error"), F.when(error.isNull(), text).alias("markdown"), F.col("page.title").alias("title"), F.col("page.author").alias("author"),
        F.col("page.language").alias("language"), F.when(F.col("pdf"), "pdf").otherwise("article").alias("content_type"), F.try_to_timestamp("page.published").alias("published_at"), "final_url",
        F.to_json(F.struct(F.col("page.site").alias("site"))).alias("meta"),
    )
