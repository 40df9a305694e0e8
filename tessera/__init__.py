"""tessera: Spark jobs for a small data platform's analytics, checks, reconciliation, search and stream state.

Every operator takes and returns a DataFrame (or a Column for scalar functions); planning is left to Catalyst.
"""

from tessera.session import build_session, configure

__all__ = ["build_session", "configure"]
