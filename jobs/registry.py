"""The jobs as queries: each runs twice into one new folder under the shared one and returns what stands there then."""

from __future__ import annotations

import uuid

from massloom.plans import search_queries
from massloom.session import shared_folder

from . import candidate_rankings, provenance_catalogue
from .common import config_of


def job1_provenance_catalogue(spark, sf_dir):
    out, config = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}", config_of("provenance_catalogue")
    for _ in range(2):
        provenance_catalogue.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint", config)
    return provenance_catalogue.read_catalogue(spark, out)


def job2_candidate_rankings(spark, sf_dir):
    out, config = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}", config_of("candidate_rankings")
    for _ in range(2):
        candidate_rankings.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", out, config)
    return candidate_rankings.read_rankings(spark, out)


QUERIES = {f.__name__: f for f in (job1_provenance_catalogue, job2_candidate_rankings)}

_NAMES = "[trim(x) FOR x IN string_split(concat_ws('|', source, lang), '|') IF trim(x) <> '']"
SQL = {
    "job1_provenance_catalogue": f"""
WITH records AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t, {_NAMES} AS names FROM documents),
sets AS (SELECT sha256(t) AS record_key, min(doc_id) AS first_doc, count(*)::bigint AS n_records, max(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END)::bigint AS n_words, list_sort(list_distinct(flatten(list(names)))) AS names FROM records GROUP BY 1)
SELECT record_key, first_doc, n_records, n_words, array_to_string(names, '|') AS collections, len([x FOR x IN names IF x IN ('src1', 'en')])::bigint AS n_approved,
CASE WHEN list_has_any(names, ['src1', 'en']) THEN 'approved' WHEN len([x FOR x IN names IF x NOT IN ('src1', 'en', 'src2', 'de', 'src0', 'src3', 'fr')]) > 0 THEN 'needs_review'
WHEN list_has_any(names, ['src2', 'de', 'src0']) THEN 'review_required' WHEN list_has_any(names, ['src3', 'fr']) THEN 'excluded' ELSE 'no_provenance' END AS disposition FROM sets""",
    "job2_candidate_rankings": f"SELECT qk AS query, rk AS candidate, score, rank, CASE WHEN fallback THEN 'fallback' ELSE 'matched' END AS branch FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY score DESC, rk) AS rank FROM {search_queries._RESTRICTED}) WHERE rank <= 25",
}
