"""Checking answers to mathematics questions.

Spellings are brought together by rules that are data: literal pairs and patterns,
in order.  The same rules make a Column expression, which stays in the JVM, or are
applied to a Python string inside the Arrow kernels that need more than patterns
(balanced braces, values of expressions).  Expressions are compared by their
values at fixed points; nothing is ever evaluated as code.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.kernels import balanced_end, last_boxed, udf

Rule = tuple[str, str, bool]  # old, new (groups as \1), whether old is a pattern

#: Fixed value: what Python's ``str.isspace`` holds for.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def literal(*pairs: tuple[str, str]) -> tuple[Rule, ...]:
    return tuple((old, new, False) for old, new in pairs)


def pattern(old: str, new: str) -> tuple[Rule, ...]:
    return ((old, new, True),)


def applied(text: str, rules: Iterable[Rule]) -> str:
    for old, new, is_pattern in rules:
        text = re.sub(old, new, text) if is_pattern else text.replace(old, new)
    return text


def expressed(text: Column, rules: Iterable[Rule]) -> Column:
    for old, new, is_pattern in rules:
        # groups are $1 in Java, and a backslash stands for itself only if doubled, as in Python
        text = F.regexp_replace(text, F.lit(old), F.lit(re.sub(r"(?<!\\)\\(\d)", r"$\1", new))) if is_pattern else F.replace(text, F.lit(old), F.lit(new))
    return text


# Final answers after a mark

#: Pairs that are replaced in a final answer, in this order.
FINAL_PAIRS = (
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
)
#: What does not count in a final answer, in this order.
FINAL_REMOVED = (
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
)
FINAL: tuple[Rule, ...] = (
    *literal(*FINAL_PAIRS),
    *literal(*((x, "") for x in FINAL_REMOVED)),
    *pattern(r"[^\n$]*\$([^\n$]*)\$[^\n]*", r"\1"),  # of a line with two dollars what is between the first two
    *(r for kind in ("text", "textbf", "overline") for r in pattern(r"\\%s\{([^\n}]*)\}" % kind, r"\1")),
    *pattern(r"\\boxed\{([^\n]*)\}", r"\1"),
    *pattern(r"frac([^{])([^\n])", r"frac{\1}{\2}"),
    *pattern(r"sqrt([^{])", r"sqrt{\1}"),
    *literal(("$", "")),
)


def final_answer(text: Column) -> Column:
    """What is right of the last equals sign, in one spelling: without articles,
    units, spaces and markup; numbers without commas."""
    plain = expressed(F.element_at(F.split(text, "="), -1), FINAL)
    digits = F.replace(plain, F.lit(","))
    return F.when(digits.rlike(r"^\p{Nd}+\z"), digits).otherwise(F.btrim(plain, F.lit(SPACES)))


def minerva(text: Column, gold: Column) -> Column:
    """1 if what the last ``Answer:`` of the last 300 characters gives is the gold
    answer, else -1."""
    found = F.regexp_extract_all(F.right(F.coalesce(text, F.lit("")), F.lit(300)), F.lit(rf"(?iu)answer[{SPACES}]*:[{SPACES}]*([^\n]+)"), 1)
    said = F.coalesce(F.get(F.reverse(found), 0), F.lit("[INVALID]"))
    return F.when(final_answer(said).eqNullSafe(final_answer(F.coalesce(gold, F.lit("")))), 1.0).otherwise(-1.0)


def strict_box(text: Column, gold: Column, tail: int = 100) -> Column:
    """1 if the last ``\\boxed{}`` of the last ``tail`` characters holds the gold
    answer as it stands, else -1."""
    said = udf(braced, "string")(F.right(F.coalesce(text, F.lit("")), F.lit(tail)))
    return F.when(said == gold, 1.0).otherwise(-1.0)


# Boxes


def braced(text: str | None) -> str | None:
    """What the last ``\\boxed{`` holds, if its braces are balanced."""
    at = (text or "").rfind("\\boxed{")
    end = balanced_end(text, at) if at >= 0 else -1
    return text[at + 7 : end] if end >= 0 else None


def boxed(text: str | None) -> str | None:
    """What follows the last ``\\boxed`` and a blank, up to a dollar sign, if there
    is one anywhere, else what the last ``\\boxed`` holds."""
    _, spaced, rest = (text or "").rpartition("\\boxed ")
    if spaced:
        return rest.split("$")[0]
    at = (text or "").rfind("\\boxed")
    return braced(text[at:]) if at >= 0 and text.startswith("{", at + 6) else None


# LaTeX spellings

#: Pairs that are replaced in LaTeX answers, in this order.
LATEX_PAIRS = (
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
)
#: Fixed value: units stand to the right of this mark.
UNIT_MARK = "\\text{ "
LATEX_DECIMALS: tuple[Rule, ...] = (*literal(("\\%", ""), (" .", " 0."), ("{.", "{0.")), *pattern(r"^\.", "0."), *pattern(r"^[^=]{0,2}=([^=]*)$", r"\1"))
LATEX_ROOTS: tuple[Rule, ...] = (*pattern(r"\\sqrt([^{])", r"\\sqrt{\1}"), *literal((" ", "")))
LATEX_FRACTIONS: tuple[Rule, ...] = (*pattern(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}"), *pattern(r"\\frac([^{])\{", r"\\frac{\1}{"))
LATEX_LAST: tuple[Rule, ...] = (*pattern(r"^0\.5$", r"\\frac{1}{2}"), *pattern(r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{\1}{\2}"))
#: A root or fraction of nothing cannot be read; one digit alone after a fraction leaves all of them as they are.
_NO_ROOT, _NO_FRACTION, _HALF = r"\\sqrt(?:\\sqrt|$)", r"\\frac(?:\\frac|$)", r"\\frac[^{](?:\\frac|$)"


def latex(text: str) -> str | None:
    """A LaTeX answer in one spelling; None if it cannot be read."""
    head, *units = applied(text, literal(*LATEX_PAIRS)).split(UNIT_MARK)
    s = applied(head, LATEX_DECIMALS)
    if len(units) > 1 or re.search(_NO_ROOT, s):
        return None
    s = applied(s, LATEX_ROOTS)
    if re.search(_NO_FRACTION, s):
        return None
    return applied(s if re.search(_HALF, s) else applied(s, LATEX_FRACTIONS), LATEX_LAST)


def latex_column(text: Column) -> Column:
    """The same as an expression."""
    parts = F.split(expressed(text, literal(*LATEX_PAIRS)), re.escape(UNIT_MARK), -1)
    s = expressed(F.get(parts, 0), LATEX_DECIMALS)
    rooted = expressed(s, LATEX_ROOTS)
    last = expressed(F.when(rooted.rlike(_HALF), rooted).otherwise(expressed(rooted, LATEX_FRACTIONS)), LATEX_LAST)
    return F.when((F.size(parts) <= 2) & ~s.rlike(_NO_ROOT) & ~rooted.rlike(_NO_FRACTION), last)


def latex_equal(a: Column, b: Column) -> Column:
    """Equal in spelling; as they stand if one of them cannot be read."""
    x, y = latex_column(a), latex_column(b)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b)), F.lit(False))


def boxed_score(text: Column, gold: Column) -> Column:
    """1 if what is boxed last equals the gold answer, else 0."""
    said = udf(boxed, "string")(text)
    return (said.isNotNull() & latex_equal(said, gold)).cast("double")


def box_bundle(said: Column, golds: Column) -> Column:
    """``score``, ``format_score``, ``acc`` of what is boxed (null if nothing is):
    right if it equals any gold answer, in form if there is a box."""
    right = (said.isNotNull() & F.coalesce(F.exists(golds, lambda g: latex_equal(said, g)), F.lit(False))).cast("double")
    return F.struct(right.alias("score"), said.isNotNull().cast("double").alias("format_score"), right.alias("acc"))


# Values of expressions

#: LaTeX names as words.
NAMES = (("\\sqrt", "sqrt"), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*"))
#: Fixed values.
FUNCTIONS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "abs": abs}
CONSTANTS = {"pi": math.pi}
_MARK = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(\*\*|[-+*/^(){}])|\\?([A-Za-z]+))")
#: Letters take these values; two expressions that agree at all of them count as equal.
POINTS = (0.7310585, 1.6180339, 2.7034512, 0.2718281)
LONGEST = 400


class Unreadable(ValueError):
    pass


def marks(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, applied(text, literal(*NAMES)).strip()
    if len(text) > LONGEST:
        raise Unreadable("too long")
    while at < len(text):
        m = _MARK.match(text, at)
        if not m:
            raise Unreadable(text[at:])
        at = m.end()
        number, sign, word = m.groups()
        if number or sign:
            out.append(("number", number) if number else ("sign", sign.replace("{", "(").replace("}", ")").replace("**", "^")))
            continue
        while word:  # a run of letters: names that are known, else single letters
            known = next((n for n in ("frac", *FUNCTIONS, *CONSTANTS) if word.startswith(n)), word[0])
            out.append(("name", known))
            word = word[len(known) :]
    return out


def value(text: str, letters: tuple[float, ...] = POINTS, pi: float = math.pi) -> complex:
    """Of an expression with letters at some values.  Factors may stand side by
    side; ``\\frac{a}{b}`` is a quotient."""
    found, at = marks(text), 0
    names = sorted({n for kind, n in found if kind == "name" and n not in FUNCTIONS and n not in CONSTANTS and n != "frac"})
    if len(names) > 2:
        raise Unreadable("more than two letters")
    env = {n: letters[i] * (1 + i) for i, n in enumerate(names)} | CONSTANTS | {"pi": pi}

    def here() -> str:
        return found[at][1] if at < len(found) else ""

    def step() -> tuple[str, str]:
        nonlocal at
        if at >= len(found):
            raise Unreadable("ends too early")
        at += 1
        return found[at - 1]

    def atom() -> complex:
        kind, x = step()
        if kind == "number":
            return float(x)
        if x == "(":
            out = total()
            if step()[1] != ")":
                raise Unreadable("no closing bracket")
            return out
        if x == "frac":
            a = atom()
            return a / atom()
        if x in FUNCTIONS:
            return FUNCTIONS[x](atom() if here() == "(" else power())
        if kind == "name":
            return env[x]
        raise Unreadable(x)

    def power() -> complex:
        out = atom()
        if here() == "^":
            step()
            out = complex(out) ** signed()
        return out

    def signed() -> complex:
        if here() in ("-", "+") and found[at][0] == "sign":
            return -signed() if step()[1] == "-" else signed()
        return power()

    def product() -> complex:
        out = signed()
        while at < len(found) and here() not in ("+", "-", ")"):
            if here() in ("*", "/"):
                out = out * signed() if step()[1] == "*" else out / signed()
            else:
                out = out * power()
        return out

    def total() -> complex:
        out = product()
        while here() in ("+", "-"):
            out = out + product() if step()[1] == "+" else out - product()
        return out

    try:
        out = total()
    except (ZeroDivisionError, OverflowError, RecursionError) as e:
        raise Unreadable(str(e)) from e
    if at < len(found):
        raise Unreadable("ends too late")
    return out


def same_value(a: str, b: str, tolerance: float = 1e-9, pi: float = math.pi) -> bool:
    """Whether two expressions agree at all points."""
    try:
        letters = {n for x in (a, b) for kind, n in marks(x) if kind == "name" and n not in FUNCTIONS and n not in CONSTANTS and n != "frac"}
        if len(letters) > 2 or ({n for k, n in marks(a) if k == "name" and n in letters} != {n for k, n in marks(b) if k == "name" and n in letters} and len(letters) > 1):
            return False
        for k in range(len(POINTS) if letters else 1):
            points = POINTS[k:] + POINTS[:k]
            if not cmath.isclose(value(a, points, pi), value(b, points, pi), rel_tol=tolerance, abs_tol=tolerance * 1e-3):
                return False
        return True
    except (Unreadable, ValueError, OverflowError):
        return False


# Answers in free text: what is said is found by rules, then compared by its shape


def _around(words: Iterable[str], side: str) -> tuple[Rule, ...]:
    """Rules that keep what is on one side of the last of each of some words."""
    kept = {"right": r"(?is)^.*%s(.*)$", "left": r"(?is)^(.*)%s.*$"}[side]
    return tuple(r for w in words for r in pattern(kept % re.escape(w), r"\1"))


#: Words before and after an answer, and words that lead to its last part.
BY_WORDS = (*_around(("answer:", "answer is", "answers are"), "right"), *_around(("is answer", "is the answer", "are answers", "are the answers"), "left"))
BY_LEAD = (*_around((". ",), "left"), *_around(("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"), "right"))


def marked(text: str) -> str:
    """The answer that a response marks by words or a box, else all of it."""
    said = applied(text, BY_WORDS)
    box = last_boxed(said)
    return applied(said if box is None else box, BY_LEAD).strip()


def marked_column(text: Column) -> Column:
    """The same as an expression."""
    said = expressed(text, BY_WORDS)
    return F.btrim(expressed(F.coalesce(udf(last_boxed, "string")(said), said), BY_LEAD), F.lit(SPACES))


#: Units that do not count, words for powers of ten, names of intervals and the brackets they stand for.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
POWERS = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
INTERVALS = (("Interval.open", "(", ")"), ("Interval.Lopen", "(", "]"), ("Interval.Ropen", "[", ")"), ("Interval", "[", "]"))
#: An answer in one spelling: brackets for what has parts, no money, percent, units or number bases, sums for mixed numbers.
PLAIN: tuple[Rule, ...] = (
    *literal(("\\begin{pmatrix}", "[["), ("\\end{pmatrix}", "]]"), ("\\\\", "],["), ("&", ",")),
    *(r for name, left, right in INTERVALS for r in pattern(rf"^{re.escape(name)}\((.*)\)$", rf"{left}\1{right}")),
    *pattern(r"^(?:Point\w*|Matrix)\((.*)\)$", r"(\1)"),
    *pattern(r"^\((\[.*\])\)$", r"\1"),
    *literal(("\\left", ""), ("\\right", ""), ("\\$", ""), ("\\%", ""), ("$", ""), ("%", "")),
    *pattern(r"\\(?:text|mbox)\{([^{}]*)\}", r"\1"),
    *pattern(r"\^ *(?:\\circ|\{\\circ\})", ""),
    *pattern(r"\b(?:%s)(?:es|s)?\b *(?:\^[0-9]+)?" % "|".join(UNITS), ""),
    *literal(*POWERS, ("dfrac", "frac"), ("tfrac", "frac"), (",\\!", ""), ("{,}", "")),
    *pattern(r"(?<=\d),(?=\d\d\d(?!\d))", ""),
    *pattern(r"(\d)_\{?\d+\}?$", r"\1"),
    *pattern(r"(\d) +(\d)", r"\1+\2"),
    *pattern(r"(\d) +[a-z]{3,}$", r"\1"),
)
_OPEN, _CLOSE = "([{", ")]}"


def shape(text: str) -> tuple[str, list] | str:
    """An answer as its outer brackets with the shapes of its parts, or, if it is one
    thing, as its text."""
    s = applied(text.strip(), PLAIN).strip()
    depth, ends, commas = 0, [], []
    for i, c in enumerate(s):
        depth += (c in _OPEN) - (c in _CLOSE)
        if not depth:
            ends.append(i)
        if c == "," and depth == 1:
            commas.append(i)
    if len(s) < 2 or s[0] not in "([" or s[-1] not in ")]" or ends != [len(s) - 1] or not (commas or s[1] == "["):
        return s
    cuts = [0, *commas, len(s) - 1]
    return s[0] + s[-1], [shape(s[a + 1 : b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _number(text: str, pi: float) -> float | None:
    """The value of what has no letters, or None."""
    try:
        if any(kind == "name" and x not in FUNCTIONS and x not in CONSTANTS and x != "frac" for kind, x in marks(text)):
            return None
        z = complex(value(text, pi=pi))
    except (Unreadable, ValueError, OverflowError):
        return None
    return z.real if math.isfinite(z.real) and abs(z.imag) < 1e-12 else None


def same(a, b, tolerance: float, pi: float) -> bool:
    """Two shapes: parts one by one, numbers within a tolerance, also as percentages
    either way, anything else by its value at all points."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and len(a[1]) == len(b[1]) and all(same(x, y, tolerance, pi) for x, y in zip(a[1], b[1], strict=True))
    if isinstance(a, tuple) or isinstance(b, tuple) or not a:
        return False
    if a.replace(" ", "").lower() == b.replace(" ", "").lower():
        return True
    x, y = _number(a, pi), _number(b, pi)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=tolerance) for z in (y, y / 100, y * 100))
    return x is None and y is None and same_value(a, b, 1e-9, pi)


def alike(given: str | None, gold: str | None, tolerance: float = 1e-4) -> bool:
    """Whether two answers are the same by shape; where pi occurs, 3.14 is as good."""
    given, gold = given or "", gold or ""
    pis = (math.pi, 3.14) if "\\pi" in given + gold else (math.pi,)
    a, b = shape(given[:1000]), shape(gold[:1000])
    return any(same(a, b, tolerance, pi) for pi in pis)


def right(text: Column, gold: Column) -> Column:
    """Whether a response's marked answer is the gold one: by spelling, else by shape
    and value."""
    said = marked_column(F.coalesce(text, F.lit("")))
    spelt = latex_equal(said, gold) & (said != "")
    return F.coalesce(spelt | udf(alike, "boolean")(said, gold), F.lit(False))


def verified(text: Column, gold: Column) -> Column:
    """1 if what a response boxes last, else its marked answer, is the gold answer by
    spelling, shape or value, else 0."""
    box = udf(boxed, "string")(text)
    alone = latex_equal(box, gold) | udf(alike, "boolean")(box, gold)
    return F.when(box.isNull(), right(text, gold)).otherwise(alone).cast("double")
