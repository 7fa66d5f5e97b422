"""The queries of this subpackage and the SQL of those that SQL can express."""

from tessera.llm import chat, decontaminate, line_templates, merkle, mil, negatives, ngram_join, packing, pii, quality_rules, secrets, suffix_dedup, tokenbin

MODULES = [mil, quality_rules, decontaminate, ngram_join, line_templates, chat, secrets, suffix_dedup, packing, pii, tokenbin, merkle, negatives]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
