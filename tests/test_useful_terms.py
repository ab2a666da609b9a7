"""A concept is shown by its terms that are not common, by all of them only where it has no others."""

from docfathom.operators import ranking


def test_common_terms_do_not_cover_a_concept(spark):
    known = spark.createDataFrame([(1, 0, 1, "烧录", 5, 100), (1, 0, 1, "系统", 8, 100), (1, 1, 1, "镜像", 50, 100), (1, 1, 1, "文件", 60, 100), (2, 0, 2, "rare", 1, 100), (2, 0, 2, "common", 90, 100)], "query_id long, concept_id int, min_hits int, term string, df long, n long")
    useful = ranking.useful_terms(known)
    assert sorted(r.term for r in useful.collect()) == sorted(["烧录", "镜像", "文件", "rare"])
    post = spark.createDataFrame([(1, "系统"), (2, "烧录"), (3, "文件"), (4, "rare"), (4, "common")], "doc_id long, term string")
    hits = ranking.concept_hits(useful.select("query_id", "concept_id", "min_hits", "term"), post)
    # A document of common terms only is no hit, and two terms asked for are never met by one.
    assert sorted((r.query_id, r.concept_id, r.doc_id) for r in hits.collect()) == [(1, 0, 2), (1, 1, 3)]
