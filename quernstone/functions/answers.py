"""Answers: the number a key states, grading, printed options, keys that name an option."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions import col


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(c: Column | str) -> Column:
    """Lower case, white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " "))


def answer_norm(c: Column | str) -> Column:
    """Lower case without white space and commas."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[\s,]", "")


def numeric_answer(c: Column | str) -> Column:
    """The number an answer key states, or null where a person has to look.

    A plain number, also with commas or a percent sign, a fraction or a mixed one, which keeps its
    sign; of `left = right` the right, but only where the left names no variable: an
    equation may be the answer itself. More than one `=` is no number.
    """
    shape = r"^(-?\d+)?\s*\\d?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}$"

    def fraction(parts: Column, negative: Column) -> Column:
        whole, over, under = (parts[i].try_cast("double") for i in range(3))
        part = F.try_divide(over, under)
        size = F.abs(whole) + F.abs(part)
        return F.when(whole.isNull(), part).when(negative, -size).otherwise(size)

    def of_value(v: Column) -> Column:
        split = bound(F.split(F.regexp_replace(v, shape, "$1~$2~$3"), "~"), lambda p: fraction(p, F.startswith(v, F.lit("-"))))
        bare = F.trim(F.regexp_replace(F.regexp_replace(v, r"[,$]|\\?%", ""), r"^\\text\{.*?\}", ""))
        simple = bound(bare, lambda b: F.when(b.rlike(r"^-?\d+(\.\d+)?$"), b.try_cast("double")))
        return F.when(v.rlike(shape), split).otherwise(simple)

    def of_sides(sides: Column) -> Column:
        named = F.regexp_replace(F.element_at(sides, 1), r"\\[a-zA-Z]+", " ").rlike("[a-zA-Z]")
        value = F.trim(F.regexp_replace(F.element_at(sides, -1), r"\\[,;! $]|\\left|\\right", ""))
        return F.when((F.size(sides) > 2) | ((F.size(sides) == 2) & named), None).otherwise(bound(value, of_value))

    return bound(F.split(F.regexp_replace(F.trim(col(c)), r"^\$+|\$+$", ""), "="), of_sides)


# How numbers stand within a key of several parts.
_LITERAL = r"(-?\d[\d,]*(?:\.\d+)?)"


def _number_forms(value: Column) -> Column:
    """How a number is written: whole ones bare, with commas and with noughts, others shortly and with two or three places."""
    n = value.try_cast("bigint")
    whole = F.array(n.cast("string"), F.format_number(n, 0), F.concat(n.cast("string"), F.lit(".0")), F.format_string("%.2f", value))
    return F.when(value == F.floor(value), whole).otherwise(F.array(format_answer(value), F.format_string("%.2f", value), F.format_string("%.3f", value), format_answer(F.round(value, 6))))


def answer_forms(key: Column | str) -> Column:
    """Every text that the answer of a key could be known by: the key itself and the ways to write its number, or, where the key is
    no single number, each number in it and the ways to write that. Bare 0, 1 and -1 within a longer key are none: they
    stand everywhere and give nothing away. A null or empty key has no forms."""

    def of(raw: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(raw, F.lit(_LITERAL), 1), lambda t: F.struct(t.alias("t"), F.replace(t, F.lit(","), F.lit("")).try_cast("double").alias("v")))
        told = F.filter(parts, lambda p: p["v"].isNotNull() & ~((F.abs(p["v"]) <= 1) & (p["v"] == F.floor(p["v"]))))
        several = F.flatten(F.transform(told, lambda p: F.concat(F.array(p["t"]), _number_forms(p["v"]))))
        forms = bound(numeric_answer(raw), lambda v: F.concat(F.array(raw), F.when(v.isNull(), several).otherwise(_number_forms(v))))
        return F.array_sort(F.filter(F.array_distinct(F.array_compact(forms)), lambda f: (f != "") & (~f.isin("0", "1") | (F.length(raw) == 1))))

    none = F.array().cast("array<string>")
    return bound(F.trim(F.coalesce(col(key), F.lit(""))), lambda raw: F.when(raw == "", none).otherwise(of(raw)))


def states_any(text: Column, forms: Column) -> Column:
    """Whether one of the forms stands in the text by itself, not within a longer number or word."""
    quoted = F.transform(forms, lambda f: F.regexp_replace(f, r"([^\p{L}\p{N}\s])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?<![\w.])(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)"))
    return F.coalesce((F.size(forms) > 0) & F.regexp_like(text, pattern), F.lit(False))


def close_enough(given: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(given - expected) <= tolerance * F.greatest(F.lit(1.0), F.abs(expected))


def format_answer(value: Column) -> Column:
    """A plain decimal, never with an exponent, that numeric_answer reads back."""
    text = value.cast("string")
    exact = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.try_cast("bigint").cast("string")).when(~F.contains(text, F.lit("E")), text).otherwise(exact)


def grade(kind: Column, answer: Column, expected: Column, options: Column) -> Column:
    """True, false, or null for what was not attempted or cannot be graded.

    options: an array of texts; the letter of an option stands for its text. Numbers are equal
    within a tolerance, other answers when their plain texts are.
    """
    a, e = plain(answer), plain(expected)
    texts = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda t, i: F.struct(F.chr(F.lit(97) + i).alias("letter"), plain(t).alias("text")))
    named = lambda o, v: (o["letter"] == v) | (o["text"] == v)
    chosen = (a == e) | F.exists(texts, lambda o: named(o, e) & named(o, a))
    given, right = numeric_answer(answer), numeric_answer(expected)
    numeric = F.when(given.isNull() | right.isNull(), a == e).otherwise(close_enough(given, right))
    return F.when((kind == "essay") | (a == "") | expected.isNull(), None).when(kind == "mcq", chosen).otherwise(numeric)


# Printed options ----------------------------------------------------------------------

# How options are tagged in print.
_LETTER = r"^\s*\(?([a-fA-F])\)[.)]?\s+|^\s*([a-fA-F])[.)]\s+"
_NUMBER = r"^\s*\(?([1-9])\)[.)]?\s+|^\s*([1-9])[.)]\s+"


def without_tag(option: Column) -> Column:
    """`(a) 17`, `a. 17` and `1) 17` as `17`."""
    bare = F.regexp_replace(option, _LETTER, "")
    return F.trim(F.when(bare != option, bare).otherwise(F.regexp_replace(option, _NUMBER, "")))


def option_text(option: Column) -> Column:
    return F.regexp_replace(plain(without_tag(option)), r"^[ .]+|[ .]+$", "")


def tag_sequence(options: Column) -> Column:
    """letter if the printed tags run a, b, c ..., number if they run 1, 2, 3 ..., else null."""
    tag = lambda pattern: F.transform(options, lambda o: F.lower(F.concat(F.regexp_extract(o, pattern, 1), F.regexp_extract(o, pattern, 2))))
    letters = F.transform(options, lambda o, i: F.chr(F.lit(97) + i))
    numbers = F.transform(options, lambda o, i: (i + 1).cast("string"))
    return F.when(tag(_LETTER) == letters, "letter").when(tag(_NUMBER) == numbers, "number")


def degenerate_options(options: Column) -> Column:
    """Why nobody could choose among these options, or null; null options are none, which is not for this to say."""

    def fault(texts: Column) -> Column:
        return (
            F.when(F.exists(texts, lambda t: t == ""), "empty_option")
            .when(F.size(F.array_distinct(texts)) < F.size(texts), "equal_options")
            .when(F.exists(texts, lambda t: ~t.rlike(r"[\p{L}\p{N}]")), "wordless_option")
        )

    return bound(F.transform(options, option_text), fault)


# How a key names an option: by a letter, `choice a`, `alternative 2`; a bare number; several answers.
_BY_LETTER, _BY_CHOICE, _BY_ALTERNATIVE = r"^\(?([a-eA-E])\)?[.:]?$", r"(?i)^\s*choices?\s+([a-f])\b", r"(?i)^\s*alternative\s+([1-9])\b"
_ORDINAL, _SEVERAL = r"^[-−+]?\d[\d,]*(\.\d+)?$", r"(?i);|\band\b|,\s*\w+\s*,"


def option_of_key(key: Column, options: Column) -> Column:
    """struct(option, how): the one option (from 0) that a key names and how, or null and why not. Null options are none.

    Texts, their number and the key's own text are bound once, so no branch computes them again."""
    why = lambda code: F.struct(F.lit(None).cast("int").alias("option"), F.lit(code).alias("how"))

    def found(b: Column) -> Column:
        k, n, texts, nk = b["k"], b["n"], b["texts"], b["nk"]
        place = lambda pattern: F.ascii(F.lower(F.regexp_extract(k, pattern, 1))) - 97
        at = lambda index, how, past: bound(index.cast("int"), lambda i: F.when(i < n, F.struct(i.alias("option"), F.lit(how).alias("how"))).otherwise(why(past)))
        by_text = lambda same: (
            F.when(same == 1, F.struct((F.array_position(texts, nk) - 1).cast("int").alias("option"), F.lit("by_text").alias("how")))
            .when(same > 1, why("text_of_several"))
            .when(k.rlike(_ORDINAL) & F.coalesce(tag_sequence(options) == "number", F.lit(False)), why("ordinal_or_value"))
            .when(k.rlike(_SEVERAL) & (F.length(nk) > 3), why("several_answers"))
            .otherwise(why("unresolved"))
        )
        return (
            F.when((k == "") | (n < 2), why("no_key_or_options"))
            .when(k.rlike(_BY_LETTER), at(place(_BY_LETTER), "by_letter", "letter_past_end"))
            .when(k.rlike(_BY_CHOICE), at(place(_BY_CHOICE), "by_choice", "letter_past_end"))
            .when(k.rlike(_BY_ALTERNATIVE), at(F.regexp_extract(k, _BY_ALTERNATIVE, 1).try_cast("int") - 1, "by_alternative", "alternative_past_end"))
            .otherwise(bound(F.size(F.filter(texts, lambda t: (t != "") & (t == nk))), by_text))
        )

    k = F.trim(F.coalesce(key, F.lit("")))
    parts = F.struct(k.alias("k"), F.coalesce(F.size(options), F.lit(0)).alias("n"), F.coalesce(F.transform(options, option_text), F.array().cast("array<string>")).alias("texts"), option_text(k).alias("nk"))
    return bound(parts, found)


def key_provenance(source: Column, key: Column) -> Column:
    """What stands behind an answer key, by the family of its citation; null without a key. The phrases are fixed values."""
    low = F.lower(F.coalesce(source, F.lit("")))
    has = lambda *parts: F.greatest(*[F.contains(low, F.lit(p)) for p in parts], F.lit(False))
    return (
        F.when(F.coalesce(key, F.lit("")) == "", None)
        .when(has("answer_key_grid", "answer_grid", "answer key", "answers to practice", "answers to selected", "answer section", "official answer"), "printed_grid")
        .when(has("ans.", "bold at the head", "problem set answer", "inline solution", "answer choice"), "printed_inline_answer")
        .when(has("solution_note"), "solution_note_derivation")
        .when(has("hint_verdict"), "hint_verdict_derivation")
        .when(low != "", "other_cited")
        .otherwise("uncited")
    )


def errata_code(text: Column) -> Column:
    low = F.lower(F.trim(text))
    has = lambda part: F.contains(low, F.lit(part))
    return F.when(has("confirmed_book_erratum"), "confirmed_book_erratum").when(has("proven_wrong"), "proven_wrong").when(has("raster image") | has("math image"), "key_is_raster_image").otherwise("other")


def notation_fault(text: Column) -> Column:
    """The first reason why a formula would not render, or null."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (
        F.when(count(r"\{") != count(r"\}"), "unbalanced_braces")
        .when(count(r"\\begin\b") != count(r"\\end\b"), "unbalanced_begin_end")
        .when(text.rlike(r"\\[0-9]"), "backslash_digit")
        .when(F.contains(text, F.lit("$")), "dollar_delimiter_in_math_field")
        .when(text.rlike(r"\\begin\{align\*?\}"), "align_env_needs_display_mode")
        .when(text.rlike(r"\\n[A-Za-z]"), "newline_escaped_into_control_sequence")
    )


# Arithmetic in texts ------------------------------------------------------------------


def step_direction(formula: Column) -> Column:
    """1 where a single `a + b = c` or `a - b = c` states more than a, -1 where it states
    less; null for everything else, also for no change."""
    bare = F.regexp_replace(F.regexp_replace(formula, r"\\text\{[^}]*\}", " "), r"\\[a-zA-Z]+|[{}\\]", " ")
    equation = F.regexp_replace(F.trim(bare), "[.;,]+$", "")
    shape = r"^(-?\d+)\s*([+-])\s*(-?\d+)\s*=\s*(-?\d+)$"
    number = lambda g: F.regexp_extract(equation, shape, g).try_cast("bigint")
    change = F.signum(number(4) - number(1)).cast("int")
    return F.when((F.regexp_count(bare, F.lit("=")) == 1) & equation.rlike(shape) & (change != 0), change)


#: Words that say a quantity goes up or down.
UP_WORDS = r"(?i)\b(increase|increased|increasing|add|adds|added|adding|carry|carried|carries|surplus|more than|raise|raised)\b"
DOWN_WORDS = r"(?i)\b(lessen|lessened|reduce|reduced|reducing|subtract|subtracted|subtracting|borrow|borrowed|deficiency|deduct|less than|lower)\b"


def prose_contradicts(prose: Column, formula: Column) -> Column:
    """Whether words of one direction only stand beside arithmetic of the other."""
    up, down = prose.rlike(UP_WORDS), prose.rlike(DOWN_WORDS)
    said = F.when(up & ~down, 1).when(down & ~up, -1)
    return F.coalesce(said != step_direction(formula), F.lit(False))


def constant_term(polynomial: Column) -> Column:
    """The last term without a letter of what stands left of `=`; 0 if all have one, null if it is no whole number."""
    body = F.regexp_replace(F.element_at(F.split(polynomial, "="), 1), r"[ \\]", "")
    terms = F.filter(F.regexp_extract_all(body, F.lit(r"([+-]?[^+-]+)"), 1), lambda t: ~t.rlike("[a-zA-Z]"))
    return F.when(F.size(terms) == 0, F.lit(0).cast("bigint")).otherwise(F.get(terms, F.size(terms) - 1).try_cast("bigint"))


#: Tokens of a formula, the greatest power, and bits of a number on the way, that are worked out.
MOST_TOKENS, MOST_POWER, MOST_BITS = 1_000, 64, 4_096
_TOKENS = re.compile(r"\d+|\*\*|[-+*/()]")
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "sign": 3, "**": 4}


@F.pandas_udf(StringType())
def exact_value(formulas: pd.Series) -> pd.Series:
    """The exact value of whole numbers joined by + - * / ** and brackets, as a fraction; null for all else, also for a
    division by zero, over MOST_TOKENS tokens, a power over MOST_POWER, and where a number would have over MOST_BITS bits."""
    return formulas.map(lambda text: None if text is None else _value(text))


def _value(text: str) -> str | None:
    tokens = _TOKENS.findall(text)
    if not tokens or len(tokens) > MOST_TOKENS or "".join(tokens) != "".join(text.split()):
        return None
    numbers: list[int | Fraction] = []  # a fraction only where a division leaves a rest
    waiting: list[str] = []  # operators and open brackets
    operand = True  # whether a number has to come
    try:
        for t in tokens:
            if t.isdigit():
                if not operand:
                    return None
                numbers.append(_small(int(t)))
                operand = False
            elif t == "(" or (operand and t in "+-"):
                if t == "(" and not operand:
                    return None
                waiting.append(t if t == "(" else "sign" if t == "-" else "plus")
            elif operand:
                return None
            elif t == ")":
                while waiting and waiting[-1] != "(":
                    _apply(waiting.pop(), numbers)
                if not waiting:
                    return None
                waiting.pop()
            else:
                while waiting and waiting[-1] != "(" and (_BINDS.get(waiting[-1], 3) > _BINDS[t] or (_BINDS.get(waiting[-1], 3) == _BINDS[t] and t != "**")):
                    _apply(waiting.pop(), numbers)
                waiting.append(t)
                operand = True
        if operand or "(" in waiting:
            return None
        while waiting:
            _apply(waiting.pop(), numbers)
    except (ZeroDivisionError, OverflowError):
        return None
    return str(numbers[0])


def _small(x: int | Fraction) -> int | Fraction:
    if max(x.numerator.bit_length(), x.denominator.bit_length()) > MOST_BITS:
        raise OverflowError
    return x


def _apply(operator: str, numbers: list[int | Fraction]) -> None:
    b = numbers.pop()
    if operator in ("sign", "plus"):
        numbers.append(-b if operator == "sign" else b)
        return
    a = numbers.pop()
    if operator == "**":
        most = max(a.numerator.bit_length(), a.denominator.bit_length())
        if b.denominator != 1 or abs(b) > MOST_POWER or abs(b) * most > MOST_BITS:
            raise OverflowError
        numbers.append((a if b >= 0 else Fraction(a)) ** int(b))
    else:
        numbers.append(_small(a + b if operator == "+" else a - b if operator == "-" else a * b if operator == "*" else _ratio(a, b)))


def _ratio(a: int | Fraction, b: int | Fraction) -> int | Fraction:
    return a // b if isinstance(a, int) and isinstance(b, int) and a % b == 0 else Fraction(a) / b
