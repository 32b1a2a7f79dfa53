"""The queries of this subpackage, over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .distinctive import distinctive_terms, terms_of_weight
from .leakage import leaks
from .linkage import clusters_of, saved_clusters
from .markup import clean_text, markup_residue, structure
from .mixing import mix_report, mix_selection, piece_sizes, token_sizes
from .neardup import duplicate_groups, duplicate_pairs
from .neighbors import nearest, record_pairs, similar_pairs
from .quality import text_kinds
from .termstats import term_frequencies


def _tables(names: str, f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()))


def p9_found(documents: DataFrame, stopword: DataFrame) -> DataFrame:
    kinds = text_kinds(documents, stopword)
    return kinds.where("kind <> 'prose' and not marked").select("doc_id", "kind")


def p9_statistics(documents: DataFrame, stopword: DataFrame) -> DataFrame:
    kinds = text_kinds(documents, stopword)
    return kinds.select("doc_id", "words", "mean_word_length", "symbol_share", "punct_share", "stop_share", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _tables("vectors", lambda v: record_pairs(*similar_pairs(v))),
        "p1_neighbours": _tables("vectors", nearest),
        "p2_found": _tables("documents", lambda d: duplicate_pairs(d, k=3, threshold=0.6)),
        "p2_groups": _tables("documents", duplicate_groups),
        "p3_found": _tables("documents", markup_residue),
        "p3_text": _tables("documents", clean_text),
        "p3_page_text": _tables("page", lambda p: clean_text(p, id_col="id", id_type="string")),
        "p3_structure": _tables("documents", structure),
        "p4_found": _tables("tf", lambda tf: terms_of_weight(tf, 0.12).select("doc_id", "term")),
        "p4_scores": _tables("tf", lambda tf: distinctive_terms(tf).select("doc_id", "term", "tf", "df", F.round("score", 6).alias("score"))),
        "p5_found": _tables("vectors clusters", saved_clusters),
        "p5_clusters": _tables("vectors", lambda v: clusters_of(v)[1]),
        "p6_found": _tables("tf", lambda tf: term_frequencies(tf).where("mark is not null").select("term", "mark")),
        "p6_frequencies": _tables("tf", lambda tf: term_frequencies(tf).select("term", "total", "df", "mark")),
        "p7_found": _tables("documents benchmark", lambda d, b: leaks(d, b).select("doc_id", "item_id")),
        "p7_report": _tables("documents benchmark", lambda d, b: leaks(d, b).select("doc_id", "item_id", "longest_run", F.round("share", 6).alias("share"))),
        "p8_found": _tables("documents mix_target", lambda d, t: mix_report(piece_sizes(d), t).where("short").select("source")),
        "p8_mix": _tables("documents mix_target", lambda d, t: mix_selection(token_sizes(d), t).withColumnRenamed("id", "doc_id")),
        "p8_shares": _tables("documents mix_target", lambda d, t: mix_report(token_sizes(d), t)),
        "p9_found": _tables("documents stopword", p9_found),
        "p9_statistics": _tables("documents stopword", p9_statistics),
    }


_CLEAN = r"""c AS (
    SELECT doc_id, term, max(tf) AS tf FROM (
        SELECT doc_id, lower(regexp_replace(term, '^\s+|\s+$', '', 'g')) AS term, tf FROM tf WHERE doc_id IS NOT NULL AND tf IS NOT NULL)
    WHERE term <> '' GROUP BY doc_id, term),
n AS (SELECT count(DISTINCT doc_id) AS records, sum(tf) AS everything FROM c),
l AS (SELECT doc_id, sum(tf) AS length FROM c GROUP BY doc_id),
f AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term)"""
_MARK = "CASE WHEN df < 4 THEN 'rare' WHEN df > 0.4 * records THEN 'common' END"
_SHINGLES = r"""w AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + %d], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - %d)) AS i FROM w WHERE len(w) > %d)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH v AS (SELECT CAST(doc_id AS BIGINT) AS d, term, max(weight) AS w FROM vectors
                WHERE term IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) AND weight <> 0 GROUP BY 1, 2),
            n AS (SELECT d, sqrt(sum(w * w)) AS size FROM v GROUP BY d),
            p AS (SELECT a.d AS doc_a, b.d AS doc_b, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.term = b.term AND a.d < b.d GROUP BY 1, 2)
            SELECT doc_a, doc_b FROM p JOIN n x ON x.d = doc_a JOIN n y ON y.d = doc_b WHERE dot / (x.size * y.size) >= 0.9""",
        "p2_found": "WITH " + _SHINGLES % (2, 1, 2) + """, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
            SELECT doc_a, doc_b FROM p JOIN z x ON x.doc_id = doc_a JOIN z y ON y.doc_id = doc_b WHERE p.n >= 0.6 * (x.n + y.n - p.n)""",
        "p4_found": f"""WITH {_CLEAN} SELECT doc_id, term FROM c JOIN l USING (doc_id) JOIN f USING (term), n
            WHERE df >= 2 AND records > 1 AND (tf / length) * ln(records / df) / ln(records) >= 0.12""",
        "p4_scores": f"""WITH {_CLEAN}, m AS (SELECT doc_id, term, tf, df, (tf + 50.0 * (total / everything)) / (length + 50.0) AS p, total / everything AS q
            FROM c JOIN l USING (doc_id) JOIN f USING (term), n WHERE df >= 2)
            SELECT doc_id, term, tf, df, round(p * ln(p / q), 6) AS score FROM m""",
        "p6_found": f"WITH {_CLEAN} SELECT term, {_MARK} AS mark FROM f, n WHERE {_MARK} IS NOT NULL",
        "p6_frequencies": f"WITH {_CLEAN} SELECT term, CAST(total AS BIGINT) AS total, df, {_MARK} AS mark FROM f, n",
        "p7_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE passage IS NOT NULL),
            x AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
            y AS (SELECT DISTINCT doc_id, hash(w[k:k + 11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (h)""",
        "p8_found": r"""WITH z AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '\S+')), 0)) AS size FROM documents GROUP BY source)
            SELECT m.source FROM mix_target m LEFT JOIN z ON m.source = z.source WHERE coalesce(z.size, 0) * m.max_repeats < m.target_share * (SELECT sum(size) FROM z)""",
    }
