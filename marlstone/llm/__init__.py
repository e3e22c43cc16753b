"""Operations of a training-data pipeline over a ``documents`` table.

Every operator takes DataFrames and returns DataFrames; ``queries`` binds them
to the tables of a folder.  Nothing outside this subpackage imports it.
"""
