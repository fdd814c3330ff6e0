"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from . import alignment, decontaminate, exact_dedup, html_text, jaccard_join, merkle, metric_join, mixing, substring_dedup, token_counts, toxicity, url_filter, warc

MODULES = [decontaminate, jaccard_join, substring_dedup, html_text, mixing, url_filter, toxicity, warc, exact_dedup, token_counts, merkle, alignment, metric_join]

QUERIES = {k: v for m in MODULES for k, v in vars(m).items() if k.startswith("op") and k[2].isdigit()}
ORACLE_SQL = {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
