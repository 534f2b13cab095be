"""Queries over the driver's tables, by theme; importing the package registers all of them."""

from corpusmill.plans import checks, choosing, evidence, logs, quality, records, relational, retrieval, runs, sourcing, streams, texts  # noqa: F401
from corpusmill.plans.catalogue import QUERIES, SQL  # noqa: F401
