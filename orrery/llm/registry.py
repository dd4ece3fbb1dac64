"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from importlib.util import find_spec

from orrery.llm.decontamination import op2_decontamination
from orrery.llm.importance import OP12_SQL, op12_importance
from orrery.llm.license_scan import op7_license_scan
from orrery.llm.mixing import OP8_SQL, op8_mixing
from orrery.llm.near_dedup import op9_near_dedup
from orrery.llm.neighbours import op4_nearest
from orrery.llm.pii import op6_pii
from orrery.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from orrery.llm.sharding import op10_sharding
from orrery.llm.substring_dedup import op1_substring_dedup
from orrery.llm.suffix_dedup import op11_suffix_dedup
from orrery.llm.toxicity import op3_toxicity
from orrery.llm.url_filter import OP5_SQL, op5_url_filter


def queries() -> dict:
    """The operators, and the pipeline where its module is shipped as well."""
    pipeline = {}
    if find_spec("corpus_pipeline"):
        import corpus_pipeline

        pipeline["pipeline"] = corpus_pipeline.run
    return pipeline | {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_nearest": op4_nearest,
        "op5_url_filter": op5_url_filter,
        "op6_pii": op6_pii,
        "op7_license_scan": op7_license_scan,
        "op8_mixing": op8_mixing,
        "op9_near_dedup": op9_near_dedup,
        "op10_sharding": op10_sharding,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_importance": op12_importance,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op8_mixing": OP8_SQL, "op12_importance": OP12_SQL, "op13_prefix_trie": OP13_SQL}
