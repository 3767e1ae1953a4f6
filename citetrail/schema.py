"""Tables of an analysis and the values of its enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of sources, of corroboration and of entities.
SOURCE_TYPES = ["primary-study", "press-release", "wire-service", "secondary-reporting", "opinion", "official-statement", "data-source", "interview"]
CORROBORATION = ["strong", "partial", "none", "unverified"]
ENTITY_TYPES = ["person", "organization", "place", "event", "document", "concept"]

LINK = T.StructType().add("href", "string").add("text", "string").add("internal", "boolean")
PAGE = T.StructType().add("url", "string").add("success", "boolean").add("markdown", "string").add("title", "string").add("links", T.ArrayType(LINK)).add("metadata", T.MapType(T.StringType(), T.StringType())).add("fetched_at", "timestamp")
TRIPLE = T.StructType().add("subject", "string").add("subjectType", "string").add("predicate", "string").add("object", "string").add("objectType", "string").add("context", "string")
CLAIM = T.StructType().add("claim", "string").add("entities", T.ArrayType(T.StringType())).add("attribution", "string").add("triples", T.ArrayType(TRIPLE))
UNLINKED = T.StructType().add("description", "string").add("canonicalKey", "string").add("sourceType", "string").add("publisher", "string").add("date", "string")
CLASSIFICATION = (
    T.StructType().add("title", "string").add("sourceType", "string").add("publisher", "string").add("date", "string").add("snippet", "string").add("sourceUrls", T.ArrayType(T.StringType())).add("unlinkedSources", T.ArrayType(UNLINKED))
)
