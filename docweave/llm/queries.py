"""The corpus operators' queries over whole tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from .common import table
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fingerprints import op1_fingerprints
from .html_extract import op4_html_extract
from .licenses import op10_licenses
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import op9_mix_sources
from .packing import op8_pack
from .simhash import op2_simhash
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity


def _over_documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_fingerprints": _over_documents(op1_fingerprints),
        "op2_simhash": _over_documents(op2_simhash),
        "op3_toxicity": lambda spark, sf_dir: op3_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_html_extract": lambda spark, sf_dir: op4_html_extract(table(spark, sf_dir, "pages")),
        "op5_line_dedup": _over_documents(op5_line_dedup),
        "op6_token_counts": _over_documents(op6_token_counts),
        "op7_exact_dedup": _over_documents(op7_exact_dedup),
        "op8_best_fit_packing": _over_documents(op8_pack),
        "op9_mix_sources": _over_documents(op9_mix_sources),
        "op10_licenses": _over_documents(op10_licenses),
    }


def oracle_sql():
    return {"op5_line_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL}
