"""The index's text formats: titles, postings, clusters, key/value lines; writing and reading.

Writers give a frame with one column `value`, for df.write.text(); readers take such a frame, from spark.read.text().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import normalize_title, to_number
from ..functions.wire import parse_kv


def title_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, mag) as `ID:title mag`; a null title is empty."""
    return docs.select(F.format_string("%s:%s %d", "doc_id", F.coalesce("title", F.lit("")), "mag").alias("value"))


def read_titles(lines: DataFrame) -> DataFrame:
    """`ID:title mag` -> (doc_id, title, mag, sqrt_mag); titles come back with letters and digits only, lower-cased."""
    parts = lines.where("value rlike '^[^:]*:.* [^ ]*$'").select(F.split_part("value", F.lit(":"), F.lit(1)).alias("doc_id"), F.regexp_extract("value", "^[^:]*:(.*) [^ ]*$", 1).alias("title"), F.regexp_extract("value", " ([^ ]*)$", 1).alias("mag"))
    mag = to_number("mag", "bigint")
    return parts.select(F.lower(F.regexp_replace("doc_id", "[^A-Za-z0-9]", "")).alias("doc_id"), normalize_title("title").alias("title"), mag.alias("mag"), F.sqrt(mag).alias("sqrt_mag"))


def postings_lines(postings: DataFrame) -> DataFrame:
    """postings(term, df, postings) as `term df:ID,tf|ID,tf|`."""
    each = F.transform("postings", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(","), p["tf"].cast("string"), F.lit("|")))
    return postings.select(F.concat("term", F.lit(" "), F.col("df").cast("string"), F.lit(":"), F.array_join(each, "")).alias("value"))


def read_postings(lines: DataFrame) -> DataFrame:
    """`term df:ID,tf|..` -> (term, df, doc_id, tf), one row per posting; lines of fewer than two fields are skipped."""
    head = lines.select(F.split("value", "[ :]", 3).alias("p")).where("size(p) >= 2 and p[0] <> ''")
    each = head.select(F.col("p")[0].alias("term"), to_number(F.col("p")[1], "bigint").alias("df"), F.explode(F.filter(F.split(F.coalesce(F.get("p", F.lit(2)), F.lit("")), "\\|"), lambda x: x != "")).alias("e"))
    return each.select("term", "df", F.split_part("e", F.lit(","), F.lit(1)).alias("doc_id"), to_number(F.split_part("e", F.lit(","), F.lit(2)), "bigint").alias("tf"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """clusters(cluster_id, sqrt_mag, n, doc_ids) as `sqrt_mag n:id,id,`; vacated (null) members are left out of the
    list but still counted in n.  Lines carry cluster_id, to be written in its order."""
    ids = F.transform(F.filter("doc_ids", lambda x: x.isNotNull()), lambda x: F.concat(x, F.lit(",")))
    return clusters.select("cluster_id", F.concat(F.format_string("%1.8f", "sqrt_mag"), F.lit(" "), F.col("n").cast("string"), F.lit(":"), F.array_join(ids, "")).alias("value"))


def read_clusters(lines: DataFrame) -> DataFrame:
    """`sqrt_mag n:id,id,` (with cluster_id, the line's number) -> (cluster_id, sqrt_mag, n, doc_ids)."""
    head, tail = F.split_part("value", F.lit(":"), F.lit(1)), F.split_part("value", F.lit(":"), F.lit(2))
    return lines.select("cluster_id", to_number(F.split_part(head, F.lit(" "), F.lit(1))).alias("sqrt_mag"), to_number(F.split_part(head, F.lit(" "), F.lit(2)), "int").alias("n"), F.filter(F.split(tail, ","), lambda x: x != "").alias("doc_ids"))


def read_kv(lines: DataFrame) -> DataFrame:
    """`key|value` -> (key, value)."""
    return lines.select(parse_kv("value").alias("kv")).select("kv.key", "kv.value")
