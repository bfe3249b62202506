"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing else in the package imports this one.  ``queries`` holds the thin
registered queries and their SQL.
"""
