"""Training-data operators: token, text, archive and audio work at corpus scale.

Nothing outside this subpackage imports it.  Operators take a DataFrame and
return a DataFrame; ``queries`` holds the thin contract queries.  All Python
stages run on Arrow batches; anything that is read twice or whose lineage
should end is written to the folder named by ``spark.checkpoint.dir``.
"""
