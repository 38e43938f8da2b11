"""Operations of a training-data pipeline over text corpora.

Nothing outside this package imports it.  ``queries`` lists its queries.
"""
