"""The registered queries of this subpackage and the SQL that stands for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import op5_embedding_duplicates
from .filter_audit import OP12_SQL, op12_filter_audit
from .html_tree import op1_html
from .language import op7_language
from .line_dedup import OP13_SQL, op13_line_dedup
from .media import op10_media
from .minhash import op3_near_duplicates
from .mixing import OP2_SQL, op2_mix_sources
from .packing import op6_pack_sequences
from .periodic_runs import op11_periodic_runs
from .pii import op9_pseudonyms
from .quality import op4_quality
from .secret_scan import op8_secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_mix_sources, op3_near_duplicates, op4_quality, op5_embedding_duplicates, op6_pack_sequences, op7_language, op8_secrets, op9_pseudonyms, op10_media, op11_periodic_runs, op12_filter_audit, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op12_filter_audit": OP12_SQL, "op13_line_dedup": OP13_SQL}
