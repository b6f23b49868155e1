"""The registered queries of the engine's own operators, and their SQL."""

from tessella.plans import checks, corpus, evidence, extras, runs

CORE_QUERIES = {**corpus.QUERIES, **evidence.QUERIES, **runs.QUERIES, **extras.QUERIES, **checks.QUERIES}
CORE_SQL = {**corpus.SQL, **evidence.SQL, **runs.SQL, **extras.SQL, **checks.SQL}
