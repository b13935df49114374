"""Policy text as column expressions: is it one, which terms does it hold, where do they point."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailpolicy.functions.text import spaced, strip
from mailpolicy.modes import REFERENCE, STRICT, is_reference

# Fixed values of the policy syntax.
QUALIFIERS = ["+", "-", "?", "~"]
MECHANISMS = ["a", "mx", "include", "ip4", "ip6", "ptr", "all", "exp", "redirect", "exists"]

# How a term, its qualifier taken off, names its mechanism. Look-ahead leaves the name as the whole match.
_NAME = {
    REFERENCE: (
        r"^(include(?=[^:]*:)|redirect(?=[^=]*=)|a(?=:|\z)|mx|exists|ptr"
        r"|ip4(?=[^:]*:)|ip6(?=[^:]*:)|exp(?=[^=]*=)|all)"
    ),
    STRICT: (
        r"(?is)^(include(?=:.)|redirect(?==.)|a(?=[:/]|\z)|mx(?=[:/]|\z)|exists(?=:|\z)|ptr(?=:|\z)"
        r"|ip4(?=:.)|ip6(?=:.)|exp(?==.)|all(?=\z))"
    ),
}


def is_policy(rr_type: Column, text: Column, mode: str = STRICT) -> Column:
    """Does a TXT answer hold a policy (FLT1)? Strict mode wants a space or the end after the version."""
    lowered = F.lower(text)
    prefix = F.startswith(lowered, F.lit("v=spf1"))
    if not is_reference(mode):
        prefix = (lowered == "v=spf1") | F.startswith(lowered, F.lit("v=spf1 "))
    return F.coalesce((rr_type == "TXT") & prefix, F.lit(False))


def split_terms(text: Column, mode: str = STRICT) -> Column:
    """Terms of a policy without the version and without empty tokens (TRM1-2).

    Reference mode splits at spaces only, strict mode at any whitespace.
    """
    def is_version(t: Column) -> Column:
        t = t if is_reference(mode) else F.lower(t)
        return F.startswith(t, F.lit("v")) & F.contains(t, F.lit("="))

    text = text if is_reference(mode) else spaced(text)
    return F.filter(F.split(text, " "), lambda t: (t != "") & ~is_version(t))


def qualifier(term: Column) -> Column:
    """Leading qualifier of a term, empty if none is written."""
    first = F.left(term, F.lit(1))
    return F.when(first.isin(*QUALIFIERS), first).otherwise("")


def unqualified(term: Column, mode: str = STRICT) -> Column:
    """Term without its qualifier (TRM3, Q1): reference mode cuts one character if a sign stands anywhere in it."""
    if not is_reference(mode):
        return F.when(qualifier(term) != "", F.substr(term, F.lit(2))).otherwise(term)
    signed = reduce(lambda a, b: a | b, [F.contains(term, F.lit(q)) for q in QUALIFIERS])
    return strip(F.when(signed, F.substr(term, F.lit(2))).otherwise(term))


def mechanism(term: Column, mode: str = STRICT) -> Column:
    """Mechanism an unqualified term names, empty if none (TRM4, Q6)."""
    if is_reference(mode):
        return F.regexp_extract(term, _NAME[REFERENCE], 1)
    return F.lower(F.regexp_extract(term, _NAME[STRICT], 1))


def value(term: Column, mech: Column, name: Column, mode: str = STRICT) -> Column:
    """What a term points to (TRM5, Q3); ``name`` is the owner and stands in where a term leaves the target out."""
    def after(sep: str) -> Column:
        if is_reference(mode):
            return F.split_part(term, F.lit(sep), F.lit(2))
        return F.substr(term, F.locate(sep, term) + 1)

    return (
        F.when(mech == "all", F.lit("all"))
        .when(mech == "redirect", F.btrim(after("="), F.lit(' "')))
        .when(mech == "exp", F.btrim(after("="), F.lit('"')))
        .when(mech == "", None)
        .when(F.contains(term, F.lit(":")), after(":"))
        .otherwise(name)
    )


def name_terms(text: Column, mode: str = STRICT) -> Column:
    """Terms of a policy as ``array<struct<term, mechanism>>``, for questions that need no value."""
    bare = F.transform(split_terms(text, mode), lambda t: unqualified(t, mode))
    return F.transform(bare, lambda t: F.struct(t.alias("term"), mechanism(t, mode).alias("mechanism")))


def parse_terms(text: Column, name: Column, mode: str = STRICT) -> Column:
    """All terms of a policy as ``array<struct<qualifier, mechanism, value>>`` (TRM1-5).

    Each step is an array of its own, so that what the next step uses twice is evaluated once.
    """
    bare = F.transform(
        split_terms(text, mode),
        lambda t: F.struct(qualifier(t).alias("qualifier"), unqualified(t, mode).alias("term")),
    )
    named = F.transform(bare, lambda s: s.withField("mechanism", mechanism(s["term"], mode)))
    return F.transform(
        named,
        lambda s: F.struct(
            s["qualifier"].alias("qualifier"),
            s["mechanism"].alias("mechanism"),
            value(s["term"], s["mechanism"], name, mode).alias("value"),
        ),
    )


def is_external(target: Column, name: Column, mode: str = STRICT) -> Column:
    """Does an include target lie outside the owner's name (TRM7, Q2)? Strict mode respects label borders."""
    if is_reference(mode):
        return ~F.endswith(target, name)
    target, name = F.lower(target), F.lower(name)
    return (target != name) & ~F.endswith(target, F.concat(F.lit("."), name))
