"""Answer checking: cases worked out by hand, and both forms of the rules against
each other."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import answers as x


def column(spark, f, rows, n=1):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(f(*(F.col(f"c{k}") for k in range(n)))).collect()]


FINAL = [
    ("$1$ and $2$", "1"),
    ("x = \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"),
    ("1,234 dollars", "1234"),
    ("1,2x", "1,2x"),
    ("\\ldots 5", "5"),
    ("sue 3", "3"),
    ("7 childrentickets", "7"),
    ("3 cm\\text{}^2", "3"),
    ("4\\text{}^3", "4"),
    ("5\\text{\ns}6\\text{\n}", "56"),
    ("an apple", "apple"),
    ("\\fracab", "\\frac{a}{b}"),
    ("\\sqrt3", "\\sqrt{3}"),
    ("\\textbf{a}\\overline{b}\\mbox{c}", "abc"),
    ("12^\\circ", "12"),
    ("12^{\\circ}", "12"),
    ("\\text{m}5", "5"),
    ("3,\\text{and}4", "34"),
    ("9\\mathrm{th}", "9"),
    ('"8"', "8"),
    ("5.$", "5"),
    ("\\$5", "5"),
    ("a = b = 6 ", "6"),
    ("\u2003 7\u00a0", "7"),
    ("", ""),
    ("{1,234}", "{1,234}"),
    ("1{,}234", "1234"),
    ("$x$ y $z$ w $u$", "x"),
    ("no $dollar", "nodollar"),
    ("\\;5\\;", "5"),
    ("10,\\!000", "10000"),
]


def test_final_answers(spark):
    assert column(spark, x.final_answer, [a for a, _ in FINAL]) == [b for _, b in FINAL]


def test_minerva(spark):
    rows = [
        ("Answer: 1\nanswer : $12$ inches", "12", 1.0),
        ("ANSWER:\n\n  3/4 ", "3/4", 1.0),
        ("Answer: 5 or so", "5", -1.0),
        ("nothing", "5", -1.0),
        ("nothing", "[INVALID]", 1.0),
        ("Answer: 5" + "x" * 300, "5", -1.0),
        ("x" * 300 + "Answer: 5", "5.0", -1.0),
        ("Answer: \\boxed{\\frac{1}{2}}", "\\frac{1}{2}", 1.0),
        (None, "1", -1.0),
        ("Answer: 1", None, -1.0),
    ]
    assert column(spark, x.minerva, [r[:2] for r in rows], 2) == [r[2] for r in rows]


def test_strict_box(spark):
    rows = [("so \\boxed{1{2}3}", "1{2}3", 1.0), ("\\boxed{5}" + " " * 95, "5", -1.0), ("\\boxed{5}" + " " * 91, "5", 1.0), ("\\boxed{ 5}", "5", -1.0), ("\\fbox{5}", "5", -1.0), ("\\boxed{5", "5", -1.0), (None, "5", -1.0)]
    assert column(spark, x.strict_box, [r[:2] for r in rows], 2) == [r[2] for r in rows]


def test_boxes():
    assert x.boxed("\\boxed 3$ then \\boxed{4}") == "3"
    assert x.boxed("\\boxed{1} and \\boxed{a{b}c} x") == "a{b}c"
    assert x.boxed("\\fbox{7}") is None and x.boxed("\\boxed{1} \\boxed{2") is None and x.boxed("\\boxedx{1}") is None
    assert x.boxed(None) is None and x.boxed("") is None


LATEX = [
    ("\\frac12", "\\frac{1}{2}"),
    ("\\frac1{72}", "\\frac{1}{72}"),
    ("\\frac{72}1", "\\frac{72}1"),
    ("\\frac1\\frac23", "\\frac1\\frac23"),
    ("\\frac", None),
    ("\\sqrt", None),
    ("\\sqrt3+\\sqrt{2}", "\\sqrt{3}+\\sqrt{2}"),
    ("\\sqrt 3", "\\sqrt{}3"),
    ("0.5", "\\frac{1}{2}"),
    (".5", "\\frac{1}{2}"),
    ("3/4", "\\frac{3}{4}"),
    ("-3/4", "\\frac{-3}{4}"),
    ("03/4", "03/4"),
    ("1/2/3", "1/2/3"),
    ("x = 3", "3"),
    ("xy = 3", "xy=3"),
    ("x=y=3", "x=y=3"),
    ("5\\text{ cm}", "5"),
    ("5\\text{ cm}\\text{ x}", None),
    ("5\\text{cm}", "5\\text{cm}"),
    ("\\left( 1 , 2 \\right)", "(1,2)"),
    ("50\\%", "50"),
    ("50%", "50%"),
    ("\\$5", "5"),
    ("$5", "$5"),
    ("90^\\circ", "90"),
    ("\\dfrac{.5}{2}", "\\frac{0.5}{2}"),
    ("a .5", "a0.5"),
    ("1\\\\2", "1\\2"),
    ("", ""),
]


def test_latex(spark):
    assert [x.latex(a) for a, _ in LATEX] == [b for _, b in LATEX]
    assert column(spark, x.latex_column, [a for a, _ in LATEX]) == [b for _, b in LATEX]


@pytest.mark.parametrize("seed", [1, 2])
def test_both_forms_of_the_rules_agree(spark, seed):
    rng = random.Random(seed)
    parts = ["\\frac", "\\sqrt", "{", "}", "1", "2", "x", "=", " ", ".", "\\text{ ", "\\%", "/", "-", "\\\\", "\\$", "\n", "0.5", "\\left", "tfrac", "^\\circ"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1500)]
    assert column(spark, x.latex_column, rows) == [x.latex(r) for r in rows]


def test_boxed_score(spark):
    rows = [("\\boxed{\\frac12}", "1/2", 1.0), ("\\boxed{0.5}", "\\dfrac{1}{2}", 1.0), ("\\boxed{3}", "4", 0.0), ("none", "none", 0.0), ("\\boxed{\\sqrt}", "\\sqrt", 1.0), ("\\fbox{3}", "3", 0.0), (None, None, 0.0), ("\\boxed{3}", None, 0.0)]
    assert column(spark, x.boxed_score, [r[:2] for r in rows], 2) == [r[2] for r in rows]


def test_values():
    for a, b in (("2(x+1)", "2x+2"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{1}{2}", "0.5"), ("sqrt(8)", "2sqrt(2)"), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}"), ("-x^2", "-(x^2)"), ("2pi", "6.283185307179586"), ("xy", "yx"), ("1/2x", "x/2"), ("2**3", "8"), ("sin(x)^2+cos(x)^2", "1"), ("\\frac{x}{2}+\\frac{x}{2}", "x"), ("--3", "3")):
        assert x.same_value(a, b), (a, b)
    for a, b in (("x", "y+1"), ("x^2", "2x"), ("1/0", "1/0"), ("(1", "1"), ("1)", "1"), ("a+b+c", "c+b+a"), ("", "1"), ("import os", "1"), ("9^9^9^9", "1")):
        assert not x.same_value(a, b), (a, b)


def test_marked_answers(spark):
    cases = (
        ("The answer is 42.", "42."),
        ("Answer: x = 7", "7"),
        ("42 is the answer", "42"),
        ("so \\boxed{\\frac{1}{2}} it is", "\\frac{1}{2}"),
        ("\\fbox{9}", "9"),
        ("we get 3", "3"),
        ("no digits is here", "here"),
        ("12", "12"),
        ("", ""),
    )
    assert [x.marked(text) for text, _ in cases] == [want for _, want in cases]
    assert column(spark, x.marked_column, [text for text, _ in cases]) == [want for _, want in cases]


def test_right_answers(spark):
    right = [
        ("The answer is \\frac{1}{2}", "0.5"),
        ("\\boxed{2x+2}", "2(x+1)"),
        ("Answer: 5 cm", "5"),
        ("\\boxed{1,234}", "1234"),
        ("\\boxed{(1, 2)}", "(1,2)"),
        ("\\boxed{50}", "0.5"),
        ("\\boxed{0.33333}", "0.333333"),
        ("\\boxed{2\\pi}", "6.2832"),
        ("\\boxed{6.28}", "2\\pi"),
        ("\\boxed{[1, 2]}", "[1.0, 2.0]"),
        ("\\boxed{Interval.open(1, 2)}", "(1, 2)"),
        ("\\boxed{[[1, 2], [3, 4]]}", "\\begin{pmatrix}1 & 2 \\\\ 3 & 4\\end{pmatrix}"),
        ("\\boxed{7 3/4}", "7+3/4"),
        ("\\boxed{3 \\text{ apples}}", "3"),
        ("\\boxed{2 million}", "2*10^6"),
        ("\\boxed{101_2}", "101"),
        ("\\boxed{5\\%}", "5"),
    ]
    wrong = [
        ("\\boxed{5}", "6"),
        ("\\boxed{(1, 2)}", "(2, 1)"),
        ("\\boxed{2/4}", "1/2x"),
        ("\\boxed{x}", "y"),
        ("\\boxed{1.01}", "1"),
        ("nothing", "3"),
        ("", ""),
        (None, "1"),
        ("\\boxed{__import__('os')}", "1"),
    ]
    assert column(spark, x.right, right, 2) == [True] * len(right)
    wrong = [w for w in wrong if w != ("", "")]
    assert column(spark, x.right, wrong, 2) == [False] * len(wrong)
    assert column(spark, x.verified, [("\\boxed{1/2}", "0.5"), ("the answer is 3", "3"), ("\\boxed{3} \\boxed{4}", "3"), (None, "1")], 2) == [1.0, 1.0, 0.0, 0.0]
