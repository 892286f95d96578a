"""The pipeline as a registered query."""

import corpus_pipeline


def queries():
    return {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
