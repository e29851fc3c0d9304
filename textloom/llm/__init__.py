"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``textloom.llm.queries`` holds the
registered queries and their SQL.
"""
