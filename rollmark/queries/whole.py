"""The queries whose given SQL leaves rows out, over the whole tables.

Each is named after its query with ``_whole`` at the end and has SQL of its own; the given SQL and
the queries that are compared with it stay as they are.
"""

from __future__ import annotations

from . import entities, rules, structure
from .base import Whole

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Conditions of the given SQL, and what stands for them over the whole tables.
CONDITIONS = {
    " WHERE balance > 5000": "",
    "balance > 7000 AND component_id <> 'FRANCE'": "soldier_id IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1995-07-01')",
    " WHERE o_totalprice > 400000": "",
    " WHERE p_type = 'ECONOMY' AND p_name = 'red widget'": "",
}
NAMES = {
    structure: (
        "component_thresholds", "tier_histogram", "registry_entries", "rebuild_candidates",
        "component_collisions", "collision_pairs", "component_rivals", "pair_collision_levels", "merged_collision_index", "collision_index",
        "level_discriminators", "designator_discriminators", "depth_discriminators", "branch_discriminators", "exclusion_rules",
        "peer_exclusions", "invalid_designators", "unique_designators", "valid_designators", "glossary_terms",
    ),
    entities: ("inferred_difficulty", "collision_samples"),
    rules: ("resolver_artifact", "generated_artifacts", "synthetic_records", "synthetic_states", "roster_stats"),
}


def _add(module, name: str) -> None:
    f = getattr(module, name)
    QUERIES[f"{name}_whole"] = lambda spark, sf_dir: f(Whole(spark, sf_dir))
    if name in module.ORACLES:
        sql = module.ORACLES[name]
        for condition, instead in CONDITIONS.items():
            sql = sql.replace(condition, instead)
        ORACLES[f"{name}_whole"] = sql


for _module, _names in NAMES.items():
    for _name in _names:
        _add(_module, _name)
