"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from . import alignment, centroids, exact, fingerprints, language, mixing, neardup, quality, repeats, sentencepieces, toxicity, urls, webpages


def queries() -> dict:
    return {
        "op1_pareto_mixing": mixing.query,
        "op2_near_duplicates": neardup.query,
        "op3_exact_dedup": exact.query,
        "op4_language_id": language.query,
        "op5_toxicity": toxicity.query,
        "op6_sentencepiece": sentencepieces.query,
        "op7_quality": quality.query,
        "op8_url_filter": urls.query,
        "op9_html_extraction": webpages.query,
        "op10_fingerprints": fingerprints.query,
        "op11_substrings": repeats.query,
        "op12_centroids": centroids.query,
        "op13_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pareto_mixing": mixing.SQL, "op2_near_duplicates": neardup.SQL, "op3_exact_dedup": exact.SQL, "op8_url_filter": urls.SQL, "op11_substrings": repeats.SQL, "op12_centroids": centroids.SQL}
