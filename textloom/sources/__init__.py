"""Readers of textloom: collections of JSON lines, gazetteers, caches, capture indexes and archives."""

from textloom.sources.files import captures, collection, documents, whole_corpus

__all__ = ["captures", "collection", "documents", "whole_corpus"]
