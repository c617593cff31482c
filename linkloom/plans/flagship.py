"""Flagship: pages -> entries -> dedup (A1) -> page text (J1 + H1) ->
cleaning (T17) -> tf-idf keywords (W4) -> top-5 keywords per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import urls as U
from linkloom.operators import clean as C
from linkloom.operators import entries as E
from linkloom.operators import html as H
from linkloom.operators import keywords as K
from linkloom.session import cut_lineage
from linkloom.sources.tables import entries_dup, load


def flagship(spark: SparkSession, sf_dir: str, top_n: int = 5, max_tokens: int | None = None) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    ents = E.dedup_entries(entries_dup(entries_from(pages)))
    # one page a url, chosen on the narrow columns; its text joins on the url
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    text = H.visible_text(pages).join(first, "page_id").select("url", F.col("visible_text").alias("scraped"))
    # stage boundary after the HTML scan
    with_text = cut_lineage(ents.join(text, "url", "left"))
    cleaned = C.clean_entries(with_text, None, max_tokens=max_tokens)
    # stage boundary: the HTML scan and cleaning run once, not again for the
    # keyword scorer's document count (reliable checkpoint, survives executor loss)
    docs = cut_lineage(cleaned.select(
        "pos", "domain",
        T.title_plus_text(U.base_title(F.col("title"), F.col("domain")), F.col("clean_text")).alias("text")))
    kw = K.keywords(docs, "pos", "text", 10)
    per_domain = (kw.join(docs.select("pos", "domain"), "pos")
                  .groupBy("domain", "keyword").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_docs")))
    w = Window.partitionBy("domain").orderBy(F.desc("score"), F.asc("keyword"))
    return (per_domain.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
            .select("domain", "rank", "keyword", F.round("score", 4).alias("score"), "n_docs"))


def entries_from(pages: DataFrame) -> DataFrame:
    from linkloom.sources.tables import entries_from_pages
    return entries_from_pages(pages)
