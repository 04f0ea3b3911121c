"""All queries of the engine, and DuckDB SQL for those it can express."""

from . import alignments, likelihoods, scalars

QUERIES = scalars.Q | alignments.Q | likelihoods.Q
ORACLES = scalars.S | alignments.S | likelihoods.S
