"""All checks by key."""

from checks import cleaning, finance, jobs, reshaping, sources, statistics
from checks.framework import build

CHECKS = [*sources.CHECKS, *cleaning.CHECKS, *reshaping.CHECKS, *statistics.CHECKS, *finance.CHECKS, *jobs.CHECKS, *finance.JOB_CHECKS]
QUERIES, ORACLES = build(CHECKS)
