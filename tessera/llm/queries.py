"""The numbered queries, one for each operator, with the SQL that DuckDB runs for them where there is one."""

from __future__ import annotations

from . import collocations, divergence, embeddings, html, language, lines, media, mixing, ownership, packing, simhash, suffixes, urls
from .common import table


def op6_source_mixing(spark, sf_dir):
    return mixing.allocate(table(spark, sf_dir, "documents")).drop("before", "virtual_finish")


QUERIES = {
    "op1_packing": packing.query,
    "op2_line_dedup": lines.query,
    "op3_embedding_dedup": embeddings.query,
    "op4_html_extraction": html.query,
    "op5_suffix_dedup": suffixes.query,
    "op6_source_mixing": op6_source_mixing,
    "op7_simhash": simhash.query,
    "op8_media": media.query,
    "op9_url_filters": urls.query,
    "op10_language_id": language.query,
    "op11_secret_ownership": ownership.query,
    "op12_collocations": collocations.query,
    "op13_source_divergence": divergence.query,
}

ORACLES = {
    "op2_line_dedup": lines.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op9_url_filters": urls.ORACLE,
    "op11_secret_ownership": ownership.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
