"""quarry — business-question analytics as plain Spark DataFrame plans.

Layout:
    quarry.sources    reading tables, declared schemas, literal fixtures, writes
    quarry.functions  column expressions (cleaning, list tokens, exact decimals, calendar)
    quarry.operators  reusable DataFrame operators (ranking, anchors, rules, profiles, audits)
    quarry.plans      the four case studies and the catalogue over the driver tables
    quarry.streaming  intentionally empty: the studied workloads are batch only
"""

from quarry.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
