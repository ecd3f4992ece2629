"""Formulas repaired: a scanner with a stack of braces, and rules that are applied in order until nothing changes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Characters that formulas need as markup.
_RAISED = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ", "0123456789+-n", strict=True))
_LOWERED = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-", strict=True))
_SIGNS = {"×": r"\times ", "÷": r"\div ", "≤": r"\le ", "≥": r"\ge ", "≠": r"\ne ", "√": r"\sqrt ", "π": r"\pi ", "·": r"\cdot ", "−": "-", "∞": r"\infty ", "°": r"^{\circ}"}
#: A piece of a formula: a command, an escaped sign, a run of raised or lowered characters, or one character.
_PIECE = re.compile(r"\\[A-Za-z]+\*?|\\.|[" + "".join(_RAISED) + "]+|[" + "".join(_LOWERED) + r"]+|[\s\S]")
_SPACES = re.compile(r"[ \t]+")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([a-z]+\*?)\}")
#: What a rule can change: a text without any of these is left as it is by all of them.
_CHANGEABLE = re.compile(r"[\\{}" + "".join(_RAISED) + "".join(_LOWERED) + "".join(_SIGNS) + "]")


def pieces(text: str) -> Iterator[str]:
    return (m.group() for m in _PIECE.finditer(text))


def newlines(text: str) -> str:
    """A backslash and n that once was a line break: before a capital or a space, where no command begins with it; of several in a row each. Backslashes before a digit are none either."""
    text = re.sub(r"(?:\\n)+(?=[A-Z\s])", lambda m: "\n" * (len(m[0]) // 2), text)
    return re.sub(r"\\+(?=[0-9])", "", text)


def marked_up(text: str) -> str:
    """Characters outside the fonts of formulas as commands; runs of raised or lowered ones as one group."""
    out = []
    for piece in pieces(text):
        for table, sign in ((_RAISED, "^"), (_LOWERED, "_")):
            if piece[0] in table:
                piece = sign + "{" + "".join(table[c] for c in piece) + "}"
        out.append(_SIGNS.get(piece, piece))
    return "".join(out)


def inline(text: str) -> str:
    """Environments that only stand on their own as the one that may stand in a line."""
    return re.sub(r"\\(begin|end)\{align\*?\}", r"\\\1{aligned}", text)


def balanced(text: str) -> str:
    """Every brace closed and none closed twice: what is open at the end is closed there, what closes nothing goes. Environments
    likewise, by name."""
    out: list[str] = []
    open_: list[str] = []
    depth: Counter[str] = Counter()  # of each in open_
    at = 0
    while at < len(text):
        if m := _ENVIRONMENT.match(text, at):
            if m[1] == "begin":
                open_.append(m[2])
                depth[m[2]] += 1
                out.append(m[0])
            elif depth[m[2]]:
                while open_[-1] != m[2]:
                    depth[open_[-1]] -= 1
                    out.append(_closing(open_.pop()))
                depth[open_.pop()] -= 1
                out.append(m[0])
            else:
                out.append(" ")  # what goes ends a command
            at = m.end()
            continue
        piece = _PIECE.match(text, at).group()
        at += len(piece)
        if piece == "{":
            open_.append("{")
            depth["{"] += 1
        elif piece == "}":
            if not open_ or open_[-1] != "{":
                out.append(" ")  # what goes ends a command
                continue
            depth[open_.pop()] -= 1
        elif piece in (r"\{", r"\}"):
            piece = r"\lbrace " if piece == r"\{" else r"\rbrace "
        elif piece in (r"\begin", r"\end"):
            out.append(" ")  # what goes ends a command
            continue  # without a name
        elif piece == r"\\" and text.startswith(("begin", "end"), at):
            piece = r"\\ "  # a line break before a word
        out.append(piece)
    return "".join(out) + "".join(_closing(x) for x in reversed(open_))


def _closing(name: str) -> str:
    return "}" if name == "{" else rf"\end{{{name}}}"


#: In their order; each is a text to a text, and what one does none undoes.
RULES: list[tuple[str, Callable[[str], str]]] = [("newline", newlines), ("markup", marked_up), ("environment", inline), ("braces", balanced)]


def parted(text: str) -> tuple[str, str, str | None]:
    """(formula, prose, what was done): a field in dollars is what stands between them, several become lines of one formula and
    the prose around them goes; a lone dollar goes. An escaped dollar beside others may be money or not, so all of them go and the rest stays."""
    if "$" not in text:
        return text, "", None
    if r"\$" in text:
        return text.replace(r"\$", " ").replace("$", " "), "", "escaped_dollar"
    parts = re.split(r"\$+", text)
    if len(parts) % 2 == 0:
        return " ".join(parts), "", "lone_dollar"
    formulas, prose = [p.strip() for p in parts[1::2] if p.strip()], " ".join(p.strip() for p in parts[::2] if p.strip())
    whole = formulas[0] if len(formulas) == 1 else r"\begin{aligned}" + r" \\ ".join(formulas) + r"\end{aligned}" if formulas else ""
    return whole, prose, "prose" if prose else "dollars"


def is_prose(text: str) -> bool:
    """No command, no sign of arithmetic and no digit, or a long text without a command or an equation."""
    return not re.search(r"\\[A-Za-z]+|[=+\-×÷^_]|\d", text) or (len(text) > 40 and not re.search(r"\\[A-Za-z]|[=^_]", text))


def repair(text: str | None, description: str | None = None) -> tuple[str | None, str | None, list[str]]:
    """(formula, description, repairs): null where nothing but prose is left, which goes to the description."""
    if text is None:
        return None, description, []
    done: list[str] = []
    text, prose, what = parted(text)
    if what:
        done.append(what)
    for _ in range(len(text) + 2 if _CHANGEABLE.search(text) else 0):
        before = text
        for name, rule in RULES:
            if (after := rule(text)) != text:
                text = after
                if name not in done:
                    done.append(name)
        if text == before:
            break
    text = "\n".join(_SPACES.sub(" ", line).strip() for line in text.split("\n")).strip()
    if text and is_prose(text):
        prose = f"{text} {prose}".strip()
        text = ""
        done.append("prose_only")
    described = " ".join(x for x in (description, prose) if x) or None
    return text or None, described, done


_REPAIR = StructType([StructField("formula", StringType()), StructField("description", StringType()), StructField("repairs", ArrayType(StringType()))])


@F.pandas_udf(_REPAIR)
def _repaired(text: pd.Series, description: pd.Series) -> pd.DataFrame:
    rows = [repair(*(x if isinstance(x, str) else None for x in pair)) for pair in zip(text, description, strict=True)]
    return pd.DataFrame(rows, columns=["formula", "description", "repairs"])


def repaired(text: Column, description: Column) -> Column:
    """struct(formula, description, repairs) of a formula as it was found and the words beside it. A second
    repair changes nothing, and no repair brings a fault that `notation_fault` names. Null stays null."""
    return _repaired(text, description)
