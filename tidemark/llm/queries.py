"""Queries and SQL of the subpackage, for __spark_entry__.py."""

from __future__ import annotations

from tidemark.llm import clusters, decontaminate, katz, language, licenses, lines, packing, quality, repair, sharding, simhash, token_files, weighted
from tidemark.llm.common import tidied

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_shard": sharding.op2_shard,
    "op3_token_files": token_files.op3_token_files,
    "op4_pack": packing.op4_pack,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language": language.op6_language,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_katz": katz.op8_katz,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_fingerprints": weighted.op11_fingerprints,
    "op12_repair": repair.op12_repair,
    "op13_clusters": clusters.op13_clusters,
}
QUERIES = {name: tidied(query) for name, query in QUERIES.items()}
ORACLES = {"op1_license_scan": licenses.sql(), "op7_quality_rules": quality.sql(), "op10_decontaminate": decontaminate.sql(), "op12_repair": repair.sql(), "op13_clusters": clusters.sql()}
