"""Full-text documents and public files as Spark tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Hosts a document may come from, private paths and credential shapes.
HOSTS = ("arxiv.org", "export.arxiv.org", "www.arxiv.org")
PRIVATE_PARTS = (".secrets", ".runtime", ".state", "__pycache__", ".pytest_cache")
CREDENTIAL = r"\bsk-[A-Za-z0-9]{24,}\b|\bSCT\d{5,}[A-Za-z0-9]{16,}\b"


def trusted_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*HOSTS), F.lit(False))


def html_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Stored HTML files (name = version id) up to the size limit; larger ones keep only an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    fits = F.col("length") <= max_bytes
    return files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("version_id"),
                        F.when(fits, F.make_valid_utf8(F.col("content").cast("string"))).alias("html"), F.when(~fits, "source_too_large").alias("error"))


def pdf_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Stored PDF files with a magic-number check. Turning them into page text needs a
    PDF library, which is not part of this environment."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    is_pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    error = F.when(F.col("length") > max_bytes, "source_too_large").when(~is_pdf, "pdf_response_invalid")
    return files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("version_id"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def public_findings(files: DataFrame) -> DataFrame:
    """Private path parts or credential-shaped text in files (path, content) to be published."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    private = (F.arrays_overlap(parts, F.array(*map(F.lit, PRIVATE_PARTS))) | F.contains(F.col("path"), F.lit("/app/log/"))
               | (name == ".env") | (name.startswith(".env.") & (name != ".env.example")))
    leaked = F.decode("content", "ISO-8859-1").rlike(CREDENTIAL)
    return files.select("path", F.when(private, "private_path").when(leaked, "credential_shape").alias("finding")).where("finding IS NOT NULL")
