"""Operations for preparing language-model training data, each a Spark job.

Every operator takes a DataFrame with an id and a text (or vector) column and
reads only those two, so extra columns of any name are harmless.  Rows with a
null text count as empty text; empty tables give empty results.
"""
