"""scorecube – assessment-results analytics on Spark DataFrames.

Layers:
  sources/    raw yearly releases -> conformed cells; test-fixture cells from the star schema
  functions/  column-expression helpers (parsing, labels, formatting)
  operators/  generic, column-parametrised DataFrame operators
  sinks/      sorted fact table, sidecar lists, per-entity documents, manifests
  plans/      named queries composed from operators (+ their SQL oracles)
  streaming/  incremental (availableNow) ingestion of newly arrived yearly releases
  jobs        batch entry points (python -m scorecube.jobs ingest|documents|report|explore|sql)
"""

__version__ = "0.1.0"
