"""Every registered query with its checking SQL."""

from __future__ import annotations

from . import genetics, replicates

FLAGSHIP = "ld_decay_chrom"


def queries() -> dict:
    return {**{n: q for n, (q, _) in genetics.PLANS.items()}, **{n: q for n, (q, _) in replicates.PLANS.items()}}


def oracle_sql() -> dict[str, str]:
    return {n: sql for plans in (genetics.PLANS, replicates.PLANS) for n, (_, sql) in plans.items() if sql is not None}
