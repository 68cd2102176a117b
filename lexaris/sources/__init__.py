"""Readers and writers of the text formats, and models as folders of Parquet tables."""
