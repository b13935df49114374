"""Evaluator messages: take the quoted parts out, name the class, name the report label."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailpolicy.modes import STRICT, is_reference

# Message fragments, all of which must occur, and the class they give; the first match decides.
# A null class leaves the message out.
ERROR_CLASSES = [
    (["Invalid directive"], "Invalid directive"),
    (["Too many DNS lookups"], None),
    (["Unknown directive"], "Unknown directive"),
    (["Invalid IP"], "Invalid IP"),
]
WARNING_CLASSES = [
    (["SPF record", "long"], "SPF record too long"),
    (
        ["directive is not last in ", " policy - ignoring  subsequent directives."],
        "all directive is not last in <h> policy - ignoring  subsequent directives.",
    ),
    (["Ignored", " policy with"], "'redirect' ignored because of 'all' mechanism"),
    (["Unable to look up TXT record for"], "Unable to look up TXT record"),
]

# Class fragment and the label it is reported under; classes without a label are not reported.
ERROR_LABELS = [
    ("Invalid IP", "Invalid value"),
    ("Unknown directive", "Unknown mechanism"),
    ("Multiple SPF policies", "Multiple SPF records"),
    ("Recursive inclusion", "Recursive value"),
    ("Invalid directive", "Missing values for a and mx"),
    ("Invalid definition", "Missing values for ip4 and ip6"),
]
WARNING_LABELS = [
    ("No MX record for domain", "Missing MX"),
    ("Unable to look up TXT record", "Missing TXT"),
]

# Error text fragments and the evaluation outcome they stand for; the first match decides.
OUTCOMES = [
    (["No TXT record found"], "not_deployed"),
    (["No SPF record found"], "not_deployed"),
    (["Unable to look up TXT record for", "NXDOMAIN"], "nonexistent_name"),
    (["Unable to look up TXT record for"], "name_server_failure"),
    (["Multiple SPF policies found for"], "multiple_policies"),
]


def _first_match(text: Column, rules: list, otherwise: Column) -> Column:
    def holds(fragments: list) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(text, F.lit(f)) for f in fragments])

    chain = F
    for fragments, result in rules:
        chain = chain.when(holds(fragments), F.lit(result).cast("string"))
    return chain.otherwise(otherwise)


def template(message: Column, mode: str = STRICT) -> Column:
    """Message with its quoted parts emptied.

    Reference mode first turns runs of spaces into one (Q20), then removes each quoted part wherever it occurs in the
    message, in the order of the quotes (Q11).
    """
    if not is_reference(mode):
        return F.regexp_replace(message, r"'[^']*'", "''")
    message = F.regexp_replace(message, " {2,}", " ")
    quoted = F.regexp_extract_all(message, F.lit(r"'([^']*)'"), F.lit(1))
    return F.aggregate(quoted, message, lambda acc, q: F.replace(acc, q, F.lit("")))


def error_classes(messages: Column, mode: str = STRICT) -> Column:
    """Classes of an array of error messages, each once (AGG23, SET4)."""
    return _classes(messages, ERROR_CLASSES, mode)


def warning_classes(messages: Column, mode: str = STRICT) -> Column:
    """Classes of an array of warnings, each once (AGG24, SET4)."""
    return _classes(messages, WARNING_CLASSES, mode)


def _classes(messages: Column, rules: list, mode: str) -> Column:
    # two steps, so that a message is emptied once and not once per rule
    emptied = F.transform(messages, lambda m: template(m, mode))
    named = F.transform(emptied, lambda m: _first_match(m, rules, m))
    return F.array_distinct(F.filter(named, lambda c: c.isNotNull()))


def error_label(cls: Column) -> Column:
    """Report label of an error class, null if it has none (MSR5)."""
    return _first_match(cls, [([f], label) for f, label in ERROR_LABELS], F.lit(None))


def warning_label(cls: Column) -> Column:
    """Report label of a warning class, null if it has none (MSR6)."""
    return _first_match(cls, [([f], label) for f, label in WARNING_LABELS], F.lit(None))


def outcome(error: Column) -> Column:
    """Evaluation outcome an error text stands for, null if none (AGG15-18)."""
    return _first_match(error, OUTCOMES, F.lit(None))
