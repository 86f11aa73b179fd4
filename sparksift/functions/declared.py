"""Lines that declare a name, as regular expressions made from one table of keywords."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

IDENTIFIER = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Keyword:
    """What a keyword declares, the words that may stand before it (in this order), and what must follow a top-level name."""

    kind: str | None
    before: tuple[str, ...] = ()
    then: str = ""


# Declaring keywords of script languages, and those of other languages that only single lines are looked at for.
KEYWORDS = {
    "function": Keyword("function", ("export", "default", "async"), "("),
    "class": Keyword("class", ("export",)),
    "interface": Keyword("interface", ("export",)),
    "enum": Keyword("enum", ("export",)),
    "type": Keyword("type_alias", ("export",), "="),
    "const": Keyword("variable", ("export",), "="),
    "let": Keyword("variable", ("export",), "="),
    "var": Keyword("variable", ("export",), "="),
    "def": Keyword(None),
    "fn": Keyword(None),
    "module": Keyword(None),
}


def line_pattern() -> str:
    """Any keyword at a line's beginning, in any case; the first group is the name."""
    by_words = sorted(KEYWORDS, key=lambda k: KEYWORDS[k].before)
    forms = []
    for before, words in groupby(by_words, key=lambda k: KEYWORDS[k].before):
        forms.append("".join(rf"(?:{w}\s+)?" for w in before) + f"(?:{'|'.join(words)})")
    return rf"(?i)^\s*(?:{'|'.join(forms)})\s+({IDENTIFIER})"


def top_level_pattern() -> str:
    """Groups ``before``, ``word``, ``name`` and ``then`` of a declaration in the first column; ``is_top_level`` says whether they fit."""
    words = "|".join(k for k, v in KEYWORDS.items() if v.kind)
    return rf"(?m)^(?P<before>(?:(?:export|async)\s+)*)(?P<word>{words})\s+(?P<name>{IDENTIFIER})\s*(?P<then>[(=]?)"


def is_top_level(before: str, word: str, then: str) -> bool:
    """Whether the words before fit the keyword, each once and in order, and what follows the name is what it asks for."""
    allowed, words = [w for w in KEYWORDS[word].before if w != "default"], before.split()
    return words == [w for w in allowed if w in words] and KEYWORDS[word].then in ("", then)
