"""Developer-quality analytics as composable PySpark DataFrame operators.

``functions``  column expressions
``sources``    readers and row parsers
``operators``  DataFrame -> DataFrame building blocks
``plans``      the chains a user calls (extract, grade, persist, rank, search, suggest, analyse)
``streaming``  the same chains over micro-batches
"""
