"""Procedural kernels as Arrow UDFs: what no expression can say."""

from __future__ import annotations

import base64
import heapq
import json
import pickle
import pickletools
import re
import zlib
from collections import OrderedDict

import pandas as pd
from pyspark.sql import functions as F


def balanced_end(text: str, start: int) -> int:
    """Index of the brace that closes the first one from ``start``, or -1."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i
    return -1


def last_boxed(text: str | None) -> str | None:
    """What the last ``\\boxed`` and a blank leads to, up to a dollar sign, if
    there is one; else what the last ``\\boxed`` (else ``\\fbox``) holds."""
    if text is None:
        return None
    if "\\boxed " in text:
        return text.split("\\boxed ")[-1].split("$")[0]
    at = text.rfind("\\boxed")
    at = text.rfind("\\fbox") if at < 0 else at
    start = text.find("{", at) if at >= 0 else -1
    end = balanced_end(text, start) if start >= 0 else -1
    return text[start + 1 : end] if end >= 0 else None


def repeatness(text: str | None) -> bool:
    """Whether adjacent sorted suffixes share more than a fifth of all there is
    to share.  Suffixes are ranked by doubling, prefixes by Kasai's rule."""
    s = text or ""
    n = len(s)
    if n <= 1:
        return False
    rank = [ord(c) for c in s]
    order, k = list(range(n)), 1
    while True:
        pair = lambda i, rank=rank, k=k: (rank[i], rank[i + k] if i + k < n else -1)
        order.sort(key=pair)
        new = [0] * n
        for a, b in zip(order, order[1:], strict=False):
            new[b] = new[a] + (pair(a) < pair(b))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1:
            break
    total = h = 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            total += h
            h = max(0, h - 1)
        else:
            h = 0
    return 2 * total / (n * (n + 1)) > 0.2


def evaluate(expression: str | None) -> float | None:
    """Infix arithmetic with ``a@b`` = 3a - 2b, which binds like a product."""
    if expression is None:
        return None
    marks = re.findall(r"\d+\.?\d*|[-+*/()@]", expression)
    at = 0

    def atom() -> float:
        nonlocal at
        t = marks[at]
        at += 1
        if t == "(":
            x = total()
            if marks[at] != ")":
                raise ValueError("no closing bracket")
            at += 1
            return x
        return -atom() if t == "-" else float(t)

    def product() -> float:
        nonlocal at
        x = atom()
        while at < len(marks) and marks[at] in "*/@":
            op = marks[at]
            at += 1
            y = atom()
            x = x * y if op == "*" else x / y if op == "/" else 3 * x - 2 * y
        return x

    def total() -> float:
        nonlocal at
        x = product()
        while at < len(marks) and marks[at] in "+-":
            op = marks[at]
            at += 1
            x = x + product() if op == "+" else x - product()
        return x

    try:
        x = total()
        return x if at == len(marks) else None
    except (IndexError, ValueError, ZeroDivisionError):
        return None


def greedy_partition(lengths: list[int], k: int) -> list[int]:
    """Part of each in the given order: the least loaded so far."""
    load = [(0, p) for p in range(k)]
    out = []
    for n in lengths:
        total, p = heapq.heappop(load)
        out.append(p)
        heapq.heappush(load, (total + n, p))
    return out


def karmarkar_karp(lengths: list[int], k: int, equal: bool = False) -> list[int]:
    """Part of each by largest differencing.  With ``equal`` all parts have as
    many; the count must divide."""
    n = len(lengths)
    if equal and n % k:
        raise ValueError(f"{n} rows do not divide into {k} parts")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    heap, serial = [], 0

    def push(sets: list[tuple[int, list[int]]]) -> None:
        nonlocal serial
        sets.sort(key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (-(sets[0][0] - sets[-1][0]), serial, sets))
        serial += 1

    if equal:
        for a in range(0, n, k):
            push([(lengths[i], [i]) for i in order[a : a + k]])
    else:
        for i in order:
            push([(lengths[i], [i])] + [(0, []) for _ in range(k - 1)])
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)])
    out = [0] * n
    for p, (_, members) in enumerate(sorted(heap[0][2], key=lambda s: min(s[1], default=n)) if heap else []):
        for i in members:
            out[i] = p
    return out


def micro_batches(lengths: list[int], most_tokens: int, least: int = 1, multiple: int = 1) -> list[int]:
    """Part of each, so that parts hold about ``most_tokens``; parts are numbered
    by the sum of squared lengths, largest first."""
    k = max(least, min(len(lengths), -(-sum(lengths) // most_tokens)))
    k = min(len(lengths), -(-k // multiple) * multiple) or 1
    part = karmarkar_karp(lengths, k)
    work: dict[int, int] = {}
    for p, n in zip(part, lengths, strict=True):
        work[p] = work.get(p, 0) + n * n
    rank = {p: r for r, p in enumerate(sorted(work, key=lambda p: (-work[p], p)))}
    return [rank[p] for p in part]


def chosen_servers(keys: list, servers: int, remembered: int = 10_000) -> list[int]:
    """Server of each request, in order: that of an earlier request with the same
    key, if the key is among the ``remembered`` last used ones, else the one with
    the fewest keys so far, the first on a tie."""
    load, last, out = [(0, s) for s in range(servers)], OrderedDict(), []
    for key in keys:
        if key not in last:
            n, s = load[0]
            heapq.heapreplace(load, (n + 1, s))
            last[key] = s
            if len(last) > remembered:
                last.popitem(last=False)
        last.move_to_end(key)
        out.append(last[key])
    return out


def packed_cases(text: str | None) -> str | None:
    """Test cases as they are handed round: pickled text, zipped, in base 64."""
    return None if text is None else base64.b64encode(zlib.compress(pickle.dumps(text))).decode()


def case_text(code: str | None) -> str | None:
    """Test cases as JSON text, whether packed or not; None if they are neither.
    A pickle is only read for its one text, never executed."""
    try:
        json.loads(code)
        return code
    except (TypeError, ValueError):
        pass
    try:
        found = [arg for op, arg, _ in pickletools.genops(zlib.decompress(base64.b64decode(code, validate=True))) if "UNICODE" in op.name]
        return found[0] if len(found) == 1 else None
    except (TypeError, ValueError, zlib.error, IndexError):
        return None


_ASKED = "*user question:*"
_TURNS = {kind: re.compile(rf"(.*?)<{kind}>(.*?)</{kind}>", re.S) for kind in ("code", "answer", "interpreter")}
_FENCED = re.compile(r"```python(.*?)```", re.S)


def trace_messages(prompt: str | None, trace: str | None) -> list[dict] | None:
    """A tool-use trace as messages: the question; then by turns what the assistant
    says with the code that it calls, or its answer, and what the interpreter gave.
    A trace in which a turn is missing is none."""

    def take(kind: str, rest: str):
        m = _TURNS[kind].match(rest)
        return (m[1], m[2], rest[m.end() :]) if m and f"</{kind}>" not in m[1] else None

    rest = trace or ""
    if prompt is None or _ASKED not in prompt:
        return None
    question = re.sub("</?answer>", "", prompt.split(_ASKED, 1)[1]).strip()
    out, tool = [{"role": "user", "content": question, "code": None}], False
    while rest:
        if tool:
            found = take("interpreter", rest)
            message = found and {"role": "tool", "content": found[1].strip(), "code": None}
        elif "<code>" in rest:
            found = take("code", rest)
            fenced = found and _FENCED.search(found[1])
            message = found and {"role": "assistant", "content": found[0].strip(), "code": fenced[1].strip() if fenced else found[1]}
        else:
            found = take("answer", rest)
            message = found and {"role": "assistant", "content": (found[0] + found[1]).strip(), "code": None}
        if not found:
            return None
        out.append(message)
        rest, tool = found[2], not tool
    return out


def python_format3(x: float | None) -> str | None:
    """Three decimals as Python rounds them: half to even of the exact value."""
    return None if x is None or pd.isna(x) else f"{x:.3f}"


def udf(f, kind: str):
    """A kernel over one or two columns as an Arrow-batched UDF."""

    def one(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(None if not isinstance(x, (str, list)) and pd.isna(x) else x))

    def two(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([f(a, b) for a, b in zip(s, t, strict=True)])

    many = f.__code__.co_argcount - len(f.__defaults__ or ()) > 1
    return F.pandas_udf(two if many else one, kind)


def partitioned(df, group: str, order: str, length: str, kernel, **options):
    """``part`` of each row of a group (one batch, which fits in a task)."""
    from quillon.session import ship

    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        pdf["part"] = kernel([int(x) for x in pdf[length]], **options)
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(group).applyInPandas(run, kinds + ", part long")
