"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_cgk_decontamination
from .divergence import op7_js_quality
from .licenses import op9_diagonal_licenses
from .mixing import op8_sainte_lague
from .neardup import op6_probminhash
from .pii import op5_weak_supervision_pii
from .quality import op3_nbsvm_quality
from .runs import op11_lyndon_runs
from .simhash import op13_simhash
from .suffix import op1_suffix_dedup
from .tokens import op2_repair_tokens
from .urls import OP4_SQL, op4_temporal_lists
from .vocabulary import OP12_SQL, op12_transducer_audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_repair_tokens": op2_repair_tokens,
    "op3_nbsvm_quality": op3_nbsvm_quality,
    "op4_temporal_lists": op4_temporal_lists,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op6_probminhash": op6_probminhash,
    "op7_js_quality": op7_js_quality,
    "op8_sainte_lague": op8_sainte_lague,
    "op9_diagonal_licenses": op9_diagonal_licenses,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op11_lyndon_runs": op11_lyndon_runs,
    "op12_transducer_audit": op12_transducer_audit,
    "op13_simhash": op13_simhash,
}
ORACLE: dict[str, str] = {"op4_temporal_lists": OP4_SQL, "op12_transducer_audit": OP12_SQL}
