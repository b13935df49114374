"""The two ways every affected operator can count.

``reference`` gives the numbers the published analysis gives, quirks included;
``strict`` gives what that analysis evidently meant. ``strict`` is the default.
"""

REFERENCE = "reference"
STRICT = "strict"


def is_reference(mode: str) -> bool:
    if mode not in (REFERENCE, STRICT):
        raise ValueError(f"mode must be '{REFERENCE}' or '{STRICT}', not {mode!r}")
    return mode == REFERENCE
