"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op3_chat
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op1_fingerprints
from .langid import op8_language
from .minhash import op7_minhash
from .mixing import OP5_SQL, op5_mixing
from .packing import op4_packing
from .periodic import op13_periodic_runs
from .quality_rank import op10_quality_rank
from .quality_rules import op6_quality_rules
from .sharding import op11_sharding
from .suffix_dedup import op2_suffix_dedup
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash": op7_minhash,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rank": op10_quality_rank,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {"op5_mixing": OP5_SQL, "op9_url_filter": OP9_SQL, "op12_filter_audit": OP12_SQL}
