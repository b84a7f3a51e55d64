"""Named query plans. Importing a plan module registers its queries."""


def load_all():
    from . import report  # noqa: F401  (first: registration order = report order)
    from . import adhoc, at_scale, explorer, ingestion, outputs, questions  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
