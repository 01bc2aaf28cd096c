"""Canonical RDF term forms as Column expressions.

IRIs are bare, blank nodes are ``_:label``, literals keep their quotes and any
``@lang`` or ``^^type`` suffix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def canonical(term: Column) -> Column:
    """Trim, and strip the angle brackets of an IRI; other terms stay as they are."""
    t = F.trim(term)
    return F.when(t.startswith("<") & t.endswith(">"), t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def expand_prefix(term: Column, prefixes: dict[str, str] | Column) -> Column:
    """Expand ``name:local`` where the name is declared, in a dict or a map column; literals, blank nodes and unknown names stay.

    >>> # expand_prefix(F.lit("ex:a"), {"ex": "http://e/"}) evaluates to "http://e/a"
    """
    if isinstance(prefixes, dict):
        if not prefixes:
            return term
        prefixes = F.create_map(*[F.lit(x) for pair in sorted(prefixes.items()) for x in pair])
    name = F.substring_index(term, ":", 1)
    local = term.substr(F.length(name) + 2, F.length(term))
    closed = term.startswith('"') | term.startswith("_:") | term.startswith("<") | ~term.contains(":")
    return F.when(closed, term).otherwise(F.coalesce(F.concat(F.try_element_at(prefixes, name), local), term))


def term_kind(term: Column) -> Column:
    return F.when(term.startswith('"'), "literal").when(term.startswith("_:"), "blank").otherwise("iri")


def literal_value(term: Column) -> Column:
    """The text between the quotes; null for IRIs and blank nodes."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'^"(.*)"[^"]*$', 1))


def literal_lang(term: Column) -> Column:
    return F.nullif(F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))


def literal_datatype(term: Column) -> Column:
    return F.nullif(F.regexp_extract(term, r'"\^\^<?([^>]+)>?$', 1), F.lit(""))
