"""All registered queries of the library: name -> (query, SQL or None)."""

from __future__ import annotations

from hearweave.plans import catalog_doubts, catalog_jobs, catalog_review, catalog_whole, catalog_words

ALL = {**catalog_words.QUERIES, **catalog_review.QUERIES, **catalog_jobs.QUERIES, **catalog_doubts.QUERIES, **catalog_whole.QUERIES}
