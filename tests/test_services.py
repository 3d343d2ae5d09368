"""Server choice, codecs and copies."""

import pickle
import random

import pytest

from quillon.functions import kernels as k
from quillon import plans  # noqa: F401  registers the queries
from quillon.plans import proxies
from quillon.registry import QUERIES
from quillon.sources import files

D = "/root/testdata/sf0.001"


def plain_choice(keys, servers, remembered):
    """Least keys first, with a list as the memory, the last used at its end."""
    load, memory, out = [0] * servers, [], []
    for key in keys:
        hit = next((m for m in memory if m[0] == key), None)
        if hit is None:
            s = min(range(servers), key=lambda i: (load[i], i))
            load[s] += 1
            hit = (key, s)
        else:
            memory.remove(hit)
        memory = [*memory, hit][-remembered:]
        out.append(hit[1])
    return out


def test_servers():
    rng = random.Random(1)
    for remembered in (1, 3, 100):
        keys = [rng.randrange(12) for _ in range(300)]
        assert k.chosen_servers(keys, 4, remembered) == plain_choice(keys, 4, remembered)
    assert k.chosen_servers([], 3) == []


def test_server_query(spark):
    rows = {}
    for r in spark.read.parquet(f"{D}/events.parquet").select("event_type", "event_id", "user_id").collect():
        rows.setdefault(r.event_type, []).append((r.event_id, r.user_id))
    got = {(r.event_type, r.event_id): r.part for r in QUERIES["server_choice"](spark, D).collect()}
    for kind, own in rows.items():
        own.sort()
        want = plain_choice([u for _, u in own], 4, 50)
        assert [got[kind, e] for e, _ in own] == want


class Evil:
    def __reduce__(self):
        return (print, ("run",))


def test_cases():
    text = '{"inputs": ["é"], "outputs": [1]}'
    assert k.case_text(k.packed_cases(text)) == text == k.case_text(text)
    import base64
    import zlib

    for bad in (Evil(), ["a", "b"], 5):
        k.case_text(base64.b64encode(zlib.compress(pickle.dumps(bad))).decode())  # nothing is run
    assert k.case_text(None) is None and k.case_text("x{") is None and k.case_text("") is None and k.packed_cases(None) is None


def test_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    path, cache = f"file://{tmp_path}/in", f"file://{tmp_path}/cache"
    to = files.cached_copy(spark, path, cache)
    assert files.exists(spark, f"{to}/a.txt") and spark.read.text(to).first().value == "one"
    (tmp_path / "in" / "a.txt").write_text("two")
    assert files.cached_copy(spark, path, cache) == to and spark.read.text(to).first().value == "one"
    files.cached_copy(spark, path, cache, always=True)
    assert open(f"{to.removeprefix('file://')}/a.txt").read() == "two"
    with pytest.raises(FileNotFoundError):
        files.cached_copy(spark, f"{path}/none", cache)
    files.make_folder(spark, f"{cache}/x/y")
    assert files.exists(spark, f"{cache}/x/y") and not files.exists(spark, f"{cache}/z")


def plain_greedy(lengths, k):
    load, out = [0] * k, []
    for n in lengths:
        i = min(range(k), key=lambda j: (load[j], j))
        load[i] += n
        out.append(i)
    return out


def plain_differencing(lengths, k):
    """The two states of the widest spread become one, largest sums with smallest."""
    states = [[(lengths[i], [i])] + [(0, []) for _ in range(k - 1)] for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i))]
    while len(states) > 1:
        spread = lambda s: s[0][0] - s[-1][0]
        a = max(states, key=spread)
        states.remove(a)
        b = max(states, key=spread)
        states.remove(b)
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        states.append(sorted(both, key=lambda s: (-s[0], s[1])))
    return sorted((n, len(m)) for n, m in states[0])


def test_balancing_over_the_table(spark):
    rows = {}
    for r in sorted(proxies.responses(spark, D).select("uid", "sample", "len").collect()):
        rows.setdefault(r.uid // 1024, []).append(r.len)
    for name, f in (("balance_greedy", lambda x: plain_greedy(x, 4)), ("balance_kk", None)):
        got = {}
        for r in QUERIES[name](spark, D).collect():
            got.setdefault(r.batch, []).append((r.tokens, r.n))
        assert set(got) == set(rows)
        for batch, x in rows.items():
            if f:
                part = f(x)
                want = sorted((sum(n for n, p in zip(x, part, strict=True) if p == i), part.count(i)) for i in set(part))
            elif len(x) > 1500:
                continue  # the plain form takes too long
            else:
                want = [w for w in plain_differencing(x, 4) if w[1]]
            assert sorted(got[batch]) == want
    for lengths in ([5, 5, 4, 3, 3], [1], [7] * 9, list(range(1, 40))):
        for k_parts in (2, 3):
            part = k.karmarkar_karp(lengths, k_parts)
            assert sorted((sum(n for n, q in zip(lengths, part, strict=True) if q == i), part.count(i)) for i in range(k_parts)) == plain_differencing(lengths, k_parts)


def test_micro_batches_over_the_table(spark):
    rows = {}
    for r in proxies.responses(spark, D).select("uid", "len").collect():
        rows.setdefault(r.uid // 1024, []).append(r.len)
    got = {}
    for r in QUERIES["microbatch"](spark, D).collect():
        got.setdefault(r.batch, []).append(r)
    for batch, x in rows.items():
        parts = got[batch]
        assert len(parts) == min(len(x), -(-sum(x) // 2000)) and sum(r.n for r in parts) == len(x)
        assert sum(r.tokens for r in parts) == sum(x) and max(r.tokens for r in parts) - min(r.tokens for r in parts) <= max(x)


def test_registries():
    from quillon.functions import plugins
    from quillon.operators import advantages

    assert set(advantages.POLICY_LOSSES) >= {"vanilla", "gpg", "gspo"}
    with pytest.raises(ValueError):
        advantages.policy_loss("gpg")(lambda *_: None)
    with pytest.raises(ValueError):
        advantages.policy_loss_of("GPG")
    with pytest.raises(ValueError):
        plugins.TOOLS.get("unknown")
    with pytest.raises(ValueError):
        plugins.INTERACTIONS.add("until_short")(lambda m: None)
