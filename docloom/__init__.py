"""Retrieval, answering and evaluation over document collections, as DataFrame transformations."""
