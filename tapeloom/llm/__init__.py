"""Operators for training-data pipelines over documents and web pages; the rest of the library never imports them."""
