"""Regular expressions with ASCII word borders in every engine."""

from __future__ import annotations

_BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_borders(pattern: str, ignore_case: bool = True) -> str:
    """``pattern`` with every ``\\b`` an ASCII word border, as RE2 and browsers read it.

    The JVM's own border counts accented letters as word characters, which changes verdicts on
    French text. Case folding, where asked for, covers accented letters.
    """
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", _BORDER)
