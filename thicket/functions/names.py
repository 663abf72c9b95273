"""Functions on gene and node names, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def species_of(gene):
    """What follows the last underscore; the whole name if there is none."""
    return F.element_at(F.split(gene, "_"), -1)


def pure_name(name):
    """A name without copy marks: cut at the first bar, stars removed, an internal node's closing sign put back."""
    cut = F.element_at(F.split(name, r"\|"), 1)
    bare = F.replace(cut, F.lit("*"), F.lit(""))
    return F.when(name.startswith("<") & ~bare.endswith(">"), F.concat(bare, F.lit(">"))).otherwise(bare)


def repaired(name):
    """A name without the signs that carry structure."""
    return F.translate(name, "|<>", ".")


def is_number(text):
    """Whether a name reads as a number, and so is a support value."""
    return text.try_cast("double").isNotNull()


def with_semicolon(newick):
    """A Newick string that ends with one semicolon."""
    return F.concat(F.rtrim(F.regexp_replace(newick, r";?\s*$", "")), F.lit(";"))


def without_annotations(newick):
    """A Newick string without bracketed comments."""
    return F.regexp_replace(newick, r"'?\[[^\]]*\]'?", "")


#: Signs that names may not hold, for they carry structure, and the mark of grafts.
ILLEGAL, GRAFT = "|<>", "P*"


def species_problem(name, is_leaf):
    """Why a species tree can't have a node's name, null if it can: a leaf needs one without structure signs, an inner one goes in angle brackets."""
    bare = F.substring(name, F.lit(2), F.greatest(F.lit(0), F.length(name) - 2))
    held = lambda x: F.translate(x, ILLEGAL, "") != x
    empty = F.coalesce(name, F.lit("")) == ""
    leaf = F.when(empty, "empty leaf name").when(held(name), "illegal sign in a leaf name")
    enclosed = name.startswith("<") & name.endswith(">") & (F.length(name) > 1)
    inner = F.when(empty, None).when(~enclosed, "inner name without brackets").when(held(bare) | bare.startswith(GRAFT), "illegal sign in an inner name")
    return F.when(is_leaf, leaf).otherwise(inner)


def repaired_species(name, is_leaf):
    """A species tree's name put right: structure signs go or become dots, inner names get brackets and no graft's mark."""
    inner = F.translate(F.regexp_replace(F.regexp_replace(name, "^<", ""), ">$", ""), ILLEGAL, ".")
    plain = F.when(inner.startswith("P"), F.replace(F.replace(inner, F.lit("P"), F.lit("p")), F.lit("*"), F.lit("."))).otherwise(inner)
    return F.when(is_leaf, repaired(name)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("<"), plain, F.lit(">")))
