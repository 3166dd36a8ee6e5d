"""Registered queries. ``load`` imports the modules that register them."""


def load() -> None:
    from siftwork.catalog import filters, ingest, matching, review, scoring, text  # noqa: F401
