"""DataFrame operators: pairing, agreement, distribution, splits, audits, curation."""
