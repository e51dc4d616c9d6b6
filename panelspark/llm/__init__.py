"""Operators for large text corpora: DataFrame in, DataFrame out.  Nothing outside this subpackage imports it."""
