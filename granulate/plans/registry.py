"""All registered queries of the core and their SQL twins."""

from __future__ import annotations

from granulate.plans import audits, curation, fields, forms, measurement, phantoms, readers

FLAGSHIP = "validation_agreement"
MODULES = [measurement, curation, audits, forms, readers, phantoms, fields]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
