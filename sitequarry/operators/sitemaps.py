"""Sitemap files: gapless numbers deal the addresses over files of a size, each written whole by one task, and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.frontier import placed
from sitequarry.operators.runs import sitemap_rows

# Fixed values of the format.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
TAIL = "</urlset>"
INDEX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
MOST = 50_000


def sitemap_lines(rows: DataFrame, per_file: int = MOST) -> DataFrame:
    """file, place, line: the lines of every file in order, with its head and tail. rows: id, xml."""
    numbered = placed(rows.select(F.lit(0).alias("all"), "id", "xml"), "all", ["id", "xml"])
    body = numbered.select(F.floor((F.col("place") - 1) / per_file).cast("int").alias("file"), "place", F.col("xml").alias("line"))
    ends = body.groupBy("file").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    head = ends.select("file", (F.col("first") - 0.5).alias("place"), F.lit(HEAD).alias("line"))
    tail = ends.select("file", (F.col("last") + 0.5).alias("place"), F.lit(TAIL).alias("line"))
    return body.withColumn("place", F.col("place").cast("double")).unionByName(head).unionByName(tail)


def write_sitemaps(urls: DataFrame, images: DataFrame, folder: str, base: str, per_file: int = MOST, lastmod: str | None = None) -> int:
    """Files sitemap-1.xml, sitemap-2.xml and so on with per_file addresses each, and sitemap.xml, their index; the number
    of files.

    The folder must not exist. Every file is the work of one task, of bounded size; the driver renames the files, a name
    for each. Without pages there is one file without addresses.
    """
    spark = urls.sparkSession
    lines = sitemap_lines(sitemap_rows(urls, images, dated=True, lastmod=lastmod), per_file)
    work = f"{folder}/_files"
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "line").write.partitionBy("file").text(work)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for part in files.listStatus(path(work)):
        name = part.getPath().getName()
        if name.startswith("file="):
            found = [f.getPath() for f in files.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            if len(found) != 1:
                raise RuntimeError(f"{name} was written in {len(found)} parts")
            files.rename(found[0], path(f"{folder}/sitemap-{int(name[5:]) + 1}.xml"))
            n += 1
    files.delete(path(work), True)
    if not n:
        _one(spark, folder, "sitemap-1.xml", [HEAD, TAIL], files, path)
        n = 1
    entries = [f"<sitemap><loc>{base.rstrip('/')}/sitemap-{i + 1}.xml</loc></sitemap>" for i in range(n)]
    _one(spark, folder, "sitemap.xml", [INDEX_HEAD, *entries, "</sitemapindex>"], files, path)
    return n


def _one(spark, folder: str, name: str, lines: list[str], files, path) -> None:
    """A small file from the driver's own lines."""
    out = files.create(path(f"{folder}/{name}"), True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def read_sitemaps(spark, folder: str) -> DataFrame:
    """file, loc: what the written files list."""
    rows = spark.read.text(f"{folder}/sitemap-*.xml").select(F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).cast("int").alias("file"), F.regexp_extract("value", "<loc>([^<]*)</loc>", 1).alias("loc"))
    return rows.filter("loc <> ''")

