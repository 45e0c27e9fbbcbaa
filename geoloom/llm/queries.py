"""The registered queries of the subpackage."""

from geoloom.llm import (
    bpe_query, chat_query, decontaminate_query, html_query, jaccard_query, langid_query, licenses_query, merkle_query, neighbours_query,
    quality_query, substrings_query, urls_query, whitening_query,
)

MODULES = [bpe_query, chat_query, jaccard_query, neighbours_query, urls_query, licenses_query, decontaminate_query,
           quality_query, langid_query, html_query, substrings_query, whitening_query, merkle_query]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
