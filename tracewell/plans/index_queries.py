"""Queries of the stored indexes; what they give is held against scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.indexes import TextIndex, VectorIndex
from ..registry import query, table
from .data_queries import _BM25, _COS, _TOK, _probe
from .lineage import new_folder


def _texts(spark, d):
    return TextIndex.build(table(spark, d, "documents"), new_folder(spark, "text-index"), "doc_id", block=64, folders=16)


@query("r01_indexed_search", _BM25)
def r01_indexed(spark, d):
    """R-01 by postings: blocks whose bound is too low are not read."""
    return _texts(spark, d).search("the that", 20)


@query("r01_indexed_all", _BM25.replace(" limit 20", ""))
def r01_indexed_all(spark, d):
    """R-01 by postings, every text that holds the words."""
    return _texts(spark, d).search("the that")


@query("s16_index_terms", f"""with t as (select doc_id, {_TOK} as w from documents), s as (select avg(len(w)) as a from t), p as (select term, doc_id, dl, count(*) as f from (select doc_id, len(w) as dl, unnest(w) as term from t) group by all)
select term, cast(count(*) as bigint) as df, round(max(f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 6) as most from p, s group by 1""")
def s16_terms(spark, d):
    """S-16: the index's words, their texts and the most they add to a score."""
    return _texts(spark, d).terms().select("term", "df", F.round("most", 6).alias("most"))


@query("r02_indexed_search", f"select vec_id, score, cast(row_number() over (order by score desc, vec_id) as int) as rank from ({_COS}) order by rank limit 10")
def r02_indexed(spark, d):
    """R-02 by cells: what the triangle inequality rules out is not read."""
    index = VectorIndex.build(table(spark, d, "embeddings"), new_folder(spark, "vector-index"), 64, "vec_id", cells=32)
    return index.search(_probe(spark, d), 10)
