"""DataFrame operators: repair, sizing, pricing, ranking, merging, audits."""
