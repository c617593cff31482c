"""Bookmark export sources.

Each export file is one row of ``spark.read.text(wholetext=True)``; a
``mapInPandas`` pass turns it into one row per link (the per-file parse is
the only Python), and dates, domains and filters are column expressions.
Many files parse in parallel; one file is one task, as the format is a
single document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import drop_local_urls, epoch_date, onetab_date, url_domain
from linkloom.operators.ranking import rank_within_group
from linkloom.sources.formats import detect_format, file_kind

LINK_SCHEMA = ("file string, link_idx long, group_local long, href string, title string, "
               "raw_date string, add_date string, last_modified string, folder string")
FOLDER_SCHEMA = "file string, ordinal long, path string"


def read_export_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) one row per export file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"),
                                                       F.col("value").alias("content"))


def _onetab_scan(batches):
    import pandas as pd
    from linkloom.functions.htmltree import onetab_links, parse
    for b in batches:
        rows = []
        for f, content in zip(b["file"], b["content"]):
            for i, (g, href, title, date_text) in enumerate(onetab_links(parse(content))):
                rows.append((f, i, g, href, title, date_text, None, None, None))
        yield pd.DataFrame(rows, columns=LINK_SCHEMA_COLS)


def _netscape_scan(batches):
    import pandas as pd
    from linkloom.functions.htmltree import netscape_scan
    for b in batches:
        rows = []
        for f, content in zip(b["file"], b["content"]):
            has_root, links, _ = netscape_scan(content)
            if not has_root:
                raise ValueError(f"Expected a primary <dl> tag in {f}")
            for i, (ordinal, folder, href, title, add, mod) in enumerate(links):
                rows.append((f, i, ordinal, href, title, add, add, mod, folder))
        yield pd.DataFrame(rows, columns=LINK_SCHEMA_COLS)


def _folder_scan(batches):
    import pandas as pd
    from linkloom.functions.htmltree import netscape_scan
    for b in batches:
        rows = []
        for f, content in zip(b["file"], b["content"]):
            _, _, folders = netscape_scan(content)
            rows.extend((f, o, p) for o, p in folders)
        yield pd.DataFrame(rows, columns=["file", "ordinal", "path"])


LINK_SCHEMA_COLS = [c.strip().split(" ")[0] for c in LINK_SCHEMA.split(",")]


#: links and groups of one file fit below this; file ordinals stand above it
FILE_STEP = 2 ** 32


def file_ordinals(files: DataFrame) -> DataFrame:
    """(file, ordinal): 0, 1, ... in file-name order, over any number of files
    (range-partitioned ranks, no single-task window)."""
    names = files.select("file").distinct().withColumn("_all", F.lit(0))
    return rank_within_group(names, "_all", ["file"], "_rank").select("file", (F.col("_rank") - 1).alias("_ordinal"))


def _with_ids(links: DataFrame, ordinals: DataFrame) -> DataFrame:
    """pos and group_ids, unique over all files of a read."""
    base = F.col("_ordinal") * FILE_STEP
    return links.join(ordinals, "file").withColumn("group_ids", F.array(base + F.col("group_local"))) \
        .withColumn("pos", base + F.col("link_idx")).drop("_ordinal")


def parse_onetab(files: DataFrame, ordinals: DataFrame | None = None) -> DataFrame:
    """S1 on (file, content) rows."""
    links = files.select("file", "content").mapInPandas(_onetab_scan, LINK_SCHEMA)
    out = _with_ids(links, file_ordinals(files) if ordinals is None else ordinals).select(
        "pos", F.col("href").alias("url"), "title", url_domain(F.col("href")).alias("domain"),
        onetab_date(F.col("raw_date")).alias("date"), "raw_date", "group_ids",
        F.lit(None).cast("string").alias("folder"), "file")
    return drop_local_urls(out)


def parse_netscape(files: DataFrame, ordinals: DataFrame | None = None) -> DataFrame:
    """S2 on (file, content) rows; local URLs are kept (as the original)."""
    links = files.select("file", "content").mapInPandas(_netscape_scan, LINK_SCHEMA)
    return _with_ids(links, file_ordinals(files) if ordinals is None else ordinals).select(
        "pos", F.col("href").alias("url"), "title", url_domain(F.col("href")).alias("domain"),
        epoch_date(F.col("add_date"), F.col("last_modified")).alias("date"), "raw_date", "group_ids",
        "folder", "file")


def parse_entries(files: DataFrame, ordinals: DataFrame | None = None) -> DataFrame:
    """S4 files of a mixed folder, on (file, content) rows: a JSON array of entries, or one entry a line."""
    whole = F.from_json("content", f"array<{_struct(ENTRY_JSON_SCHEMA)}>")
    lines = F.transform(F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != ""),
                        lambda x: F.from_json(x, _struct(ENTRY_JSON_SCHEMA)))
    rows = F.when(F.ltrim("content").startswith("["), whole).otherwise(lines)
    x = files.select("file", F.posexplode(rows).alias("link_idx", "e"))
    x = x.join(file_ordinals(files) if ordinals is None else ordinals, "file")
    return x.select((F.col("_ordinal") * FILE_STEP + F.col("link_idx")).alias("pos"), "e.url", "e.title", "e.domain",
                    F.expr("try_to_timestamp(e.date)").cast("timestamp_ntz").alias("date"), "e.raw_date", "e.group_ids",
                    "e.folder", "file")


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{c.split()[0]}: {c.split(None, 1)[1]}" for c in ddl.split(", ")) + ">"


def parse_folder_paths(files: DataFrame) -> DataFrame:
    """S3: every folder path of the export tree (pre-order), with depth; the
    bare ROOT row of the original is dropped (Q2)."""
    f = files.select("file", "content").mapInPandas(_folder_scan, FOLDER_SCHEMA)
    return f.select("file", "ordinal", "path", F.size(F.split("path", "/")).alias("depth"))


def read_onetab(spark: SparkSession, path: str) -> DataFrame:
    return parse_onetab(read_export_files(spark, path))


def read_netscape(spark: SparkSession, path: str) -> DataFrame:
    return parse_netscape(read_export_files(spark, path))


def read_folder_paths(spark: SparkSession, path: str) -> DataFrame:
    return parse_folder_paths(read_export_files(spark, path))


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """Mixed folder: .json files hold entries (S4), the others are routed by S5
    detection; unsupported files fail.  pos and group_ids are unique over all files."""
    files = read_export_files(spark, path)
    files = files.withColumn("format", F.when(file_kind(F.col("file")) == "json", "json").otherwise(
        detect_format(F.col("content"))))
    bad = files.filter(F.col("format") == "unsupported").select("file").limit(1).collect()
    if bad:
        raise ValueError(f"unsupported export format: {bad[0][0]}")
    ordinals = file_ordinals(files)
    parts = [parse(files.filter(F.col("format") == kind), ordinals) for kind, parse in
             (("onetab", parse_onetab), ("netscape", parse_netscape), ("json", parse_entries))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ENTRY_JSON_SCHEMA = ("url STRING, title STRING, domain STRING, date STRING, raw_date STRING, "
                     "group_ids ARRAY<BIGINT>, folder STRING")


def read_entries_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Entries written earlier (JSON Lines, or a JSON array with multi_line)."""
    df = spark.read.schema(ENTRY_JSON_SCHEMA + ", pos BIGINT").option("multiLine", multi_line).json(path)
    return df.withColumn("date", F.expr("try_to_timestamp(date)").cast("timestamp_ntz"))


def write_entries_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S4 sink: JSON Lines, one part per task; sets are arrays, dates ISO strings."""
    out = df.withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"))
    out.write.mode(mode).json(path)
