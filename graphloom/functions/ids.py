"""Deterministic ids and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_MODULE = ("", "__init__", "__root__")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.regexp_replace(path, r"^[./]+", ""))


def repository_id(path: Column) -> Column:
    return F.concat(F.lit("repository:"), F.lower(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)))


def repository_id_of_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def symbol_id(kind: str, *parts: Column) -> Column:
    """module:<mod>, class:<mod>:<name>, function:<mod>:<name>, method:<mod>:<cls>:<name>."""
    return F.concat_ws(":", F.lit(kind), *parts)


def module_name(path: Column) -> Column:
    """``a/b.py`` is a.b, ``a/__init__.py`` is a, ``__init__.py`` at the root is __init__."""
    dotted = F.translate(F.regexp_replace(path, r"\.\w+$", ""), "/", ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def qualified_name(module: Column, symbol: Column) -> Column:
    bare = module.isNull() | module.isin(*NO_MODULE)
    return F.when(bare, symbol).otherwise(F.concat_ws(".", module, symbol))


def class_of(node_id: Column) -> Column:
    """The class part of ``method:<mod>:<cls>:<name>``, null for other ids."""
    return F.when(node_id.startswith("method:"), F.element_at(F.split(node_id, ":"), 3))
