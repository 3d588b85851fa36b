"""Operators of a training-data pipeline over the document, page, embedding and conversation tables."""
