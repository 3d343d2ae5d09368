"""Rule-based scores of model outputs, as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "</think>"


def bound(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of values that are computed once.  Inside a lambda a column that is
    itself an expression may be computed anew for each element; a field of an
    element is not."""
    held = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(held, lambda s: f(*(s[f"v{i}"] for i in range(len(values))))), 0)


def _groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?d)\[(.*?)\]"), 1)


def _words(group: Column) -> Column:
    return F.filter(F.transform(F.split(group, ","), lambda w: F.btrim(w)), lambda w: w != "")


def after_last(text: Column, mark: str = END) -> Column:
    return F.element_at(F.split(text, mark), -1)


def items_sorted(text: Column) -> Column:
    """Items after the last closing think tag, their words sorted."""
    return F.transform(_groups(after_last(text)), lambda g: F.array_sort(_words(g)))


def items_ordered(text: Column) -> Column:
    """Items of the whole text, words in order and lower-cased."""
    return F.transform(_groups(F.lower(text)), _words)


def sid_triples(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"<s_a_\d+><s_b_\d+><s_c_\d+>"), 0)


def think_format(text: Column, least: int = 10) -> Column:
    """1 if there is a thought of more than ``least`` characters, white space not
    counted, between the tags; the first closing tag counts."""
    start, end = F.locate("<think>", text), F.locate(END, text)
    thought = F.translate(F.substring(text, start + 7, end - start - 7), " \n\r\t", "")
    return F.when((start > 0) & (end > start) & (F.length(thought) > least), 1.0).otherwise(0.0)


def _mean(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.size(c)), F.lit(0.0))


def partial_hit(pred: Column, gold: Column) -> Column:
    """Mean over predicted items of the best of 100 for an equal item and 50
    times the shared words over the larger word count."""
    one = lambda p, g: F.when(p == g, 100.0).otherwise(F.coalesce(F.try_divide(50.0 * F.size(F.array_intersect(p, g)), F.greatest(F.size(p), F.size(g))), F.lit(0.0)))
    return bound(lambda ps, gs: _mean(F.transform(ps, lambda p: F.coalesce(F.array_max(F.transform(gs, lambda g: one(p, g))), F.lit(0.0)))), pred, gold)


def partial_sid(pred: Column, gold: Column) -> Column:
    """Mean of 100, 10, 1 or 0 by how long a prefix of the triple is right."""
    head = lambda x, k: F.substring_index(x, ">", k)
    best = lambda gs: lambda p: F.when(F.array_contains(gs, p), 100.0).when(F.exists(gs, lambda g: head(g, 2) == head(p, 2)), 10.0).when(F.exists(gs, lambda g: head(g, 1) == head(p, 1)), 1.0).otherwise(0.0)
    return bound(lambda ps, gs: _mean(F.transform(ps, best(gs))), pred, gold)


def tagged_only(text: Column, score: Column) -> Column:
    return F.when(text.contains("<think>") & text.contains(END), score).otherwise(0.0)


def hit(pred: Column, gold: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(pred, gold)).cast("double"), F.size(pred)), F.lit(0.0))


def first_hit(pred: Column, gold: Column) -> Column:
    return F.when((F.size(pred) > 0) & F.array_contains(gold, F.get(pred, 0)), 1.0).otherwise(0.0)


def any_hit(pred: Column, gold: Column) -> Column:
    return F.coalesce(F.arrays_overlap(pred, gold), F.lit(False)).cast("double")


#: Reward by words of the first item that are right from the start.
PREFIX = (0.0, 0.6, 0.7, 0.8, 0.9, 1.0)


def hierarchical(pred: Column, gold: Column) -> Column:
    run = bound(lambda p, g: F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0), lambda a, i: F.when((a == i) & F.coalesce(F.get(p, i) == F.get(g, i), F.lit(False)), a + 1).otherwise(a)), F.get(pred, 0), F.get(gold, 0))
    return F.coalesce(F.get(F.array(*map(F.lit, PREFIX)), run), F.lit(0.0))


def jaccard_first(pred: Column, gold: Column) -> Column:
    p, g = F.coalesce(F.get(pred, 0), F.array().cast("array<string>")), F.coalesce(F.get(gold, 0), F.array().cast("array<string>"))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(p, g)).cast("double"), F.size(F.array_union(p, g))), F.lit(0.0))


def gsm8k_answer(text: Column, strict: bool = True) -> Column:
    """The last ``#### number`` of the last 300 characters, or flexibly the last
    number; commas and dollar signs go."""
    tail = F.right(text, F.lit(300))
    if strict:
        return F.translate(F.get(F.reverse(F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), 1)), 0), ",$", "")
    numbers = F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), 1), lambda x: ~x.isin("", "."))
    return F.get(F.reverse(numbers), 0)


def gsm8k_score(text: Column, gold: Column, strict: bool = True) -> Column:
    answer = gsm8k_answer(text, strict)
    return F.when(answer.isNull(), 0.0).when(answer == gold, 1.0).otherwise(0.0)


def normalise_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def answer_tag(text: Column) -> Column:
    """The last answer of two or more; a single one is the prompt's own."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(found) >= 2, F.trim(F.element_at(found, -1)))


def qa_em(text: Column, gold: Column, sub: bool = False) -> Column:
    """Exact match (or containment) with any gold answer; with more than ten
    closing or opening tags a quarter of it."""
    answer = normalise_answer(answer_tag(text))
    right = bound(lambda said, golds: F.exists(golds, lambda g: said.contains(normalise_answer(g)) if sub else normalise_answer(g) == said), answer, gold)
    tags = lambda t: F.size(F.split(text, t)) - 1
    full = F.when((tags("<answer>") > 10) | (tags("</answer>") > 10), 0.25).otherwise(1.0)
    return F.when(F.coalesce(right, F.lit(False)), full).otherwise(0.0)


def choice(text: Column, gold: Column) -> Column:
    letter = F.upper(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1))
    return (letter == gold).cast("double")


def tool_shape(score: Column, turns: Column) -> Column:
    """A negative score rises with tool turns, up to zero."""
    return F.when(score < 0, F.least(F.lit(0.0), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def truncated(text: Column, most: int, side: str) -> Column:
    """``left`` keeps the head, ``right`` the tail, ``middle`` both ends."""
    half = most // 2
    cut = {
        "left": F.concat(F.left(text, F.lit(most)), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(text, F.lit(most))),
        "middle": F.concat(F.left(text, F.lit(half)), F.lit("...(truncated)..."), F.right(text, F.lit(half))),
    }[side]
    return F.when(F.length(text) > most, cut).otherwise(text)


def tool_calls(text: Column) -> Column:
    """JSON blocks of tool calls that parse and have name and arguments."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    parsed = F.transform(blocks, lambda b: F.from_json(F.trim(b), "name string, arguments string"))
    return F.filter(parsed, lambda x: x["name"].isNotNull() & x["arguments"].isNotNull())


def passages(docs: Column) -> Column:
    """``Doc i (Title: first line)`` and the rest, one after the other."""
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.get(F.split(x, "\n"), 0), F.lit(")\n"), F.array_join(F.slice(F.split(x, "\n"), 2, 1 << 20), "\n"))
    return F.concat(F.array_join(F.transform(docs, one), "\n\n"), F.lit("\n\n"))


def clean_activity(text: Column) -> Column:
    text = F.regexp_replace(F.trim(text), r" \[title\]", ". ")
    return F.replace(F.regexp_replace(text, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))


def printed(code: Column, spaces: str) -> Column:
    """The first fenced block, or all of it, with its last line that is not empty
    printed, unless that line prints."""
    fenced = F.regexp_extract_all(code, F.lit(r"(?s)```python(.*?)```"), 1)
    lines = F.split(F.when(F.size(fenced) > 0, F.btrim(F.get(fenced, 0), F.lit(spaces))).otherwise(code), "\n", -1)

    def shown(ls: Column) -> Column:
        last = F.aggregate(F.transform(ls, lambda x, i: F.when(x != "", i)), F.lit(-1), lambda a, i: F.coalesce(i, a))
        return bound(lambda all_lines, at: F.array_join(F.transform(all_lines, lambda x, i: F.when((i == at) & ~x.startswith("print"), F.concat(F.lit("print("), x, F.lit(")"))).otherwise(x)), "\n"), ls, last)

    return shown(lines)


def sandbox_code(error: Column, api: Column, compiled: Column, run: Column, expected: Column) -> Column:
    """Result of one test case from a sandbox's answer: 1 right, 0 wrong, -1 no
    usable answer, -2 failed at run time, -3 out of time, -4 not compiled.
    ``compiled``, ``run``: structs of ``status``, ``return_code``, ``stdout``, or
    null."""

    def failed(x: Column) -> Column:
        return F.coalesce(x["status"].isin("Error", "TimeLimitExceeded") | ((x["status"] == "Finished") & ~x["return_code"].eqNullSafe(F.lit(0))), F.lit(False))

    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+\z", "")
    ran = F.when(F.coalesce(run["status"] == "Finished", F.lit(False)), (plain(run["stdout"]) == plain(expected)).cast("int")).otherwise(-1)
    stopped = F.when(failed(compiled), -4).when(F.coalesce(run["status"] == "TimeLimitExceeded", F.lit(False)), -3).when(failed(run), -2).otherwise(-1)
    return F.when(error.isNotNull(), -1).when(api == "Failed", stopped).when(api == "Success", ran).otherwise(-1)


SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "openai/gsm8k": gsm8k_score,
    "searchR1_nq": lambda t, g: qa_em(t, F.array(g)),
    "choice": choice,
}


def dispatch(source: Column, text: Column, gold: Column, scorers: dict[str, Callable] | None = None) -> Column:
    """The scorer of each row's source; an unknown source is an error."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double")
    for name, f in (scorers or SCORERS).items():
        fits = source.startswith(name[:-1]) if name.endswith("*") else source == name
        out = F.when(fits, f(text, gold)).otherwise(out)
    return out
