"""The queries of the training-text operators, and SQL for those that SQL can express."""

from tablarium.llm import (
    chat, decontamination, licenses, line_quality, packing, personal_data, quality_rules, resampling, secrets, simhash, substrings, whitening,
)

MODULES = (quality_rules, chat, secrets, decontamination, substrings, simhash, licenses, personal_data, packing, resampling, whitening, line_quality)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
