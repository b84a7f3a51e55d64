"""Operators of a training-data pipeline (language-model scoring, quality, sharding, decontamination, HTML extraction,
byte-level BPE, near-duplicate and substring removal, language identification) as Spark jobs.

Nothing else in the library imports this subpackage. ``catalog`` holds the registered queries."""
