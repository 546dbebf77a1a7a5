"""Policies, principals, identity: expressions against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from gatehouse import principals
from gatehouse.errors import AuthError, InvalidPrincipalError
from gatehouse.functions import policy
from gatehouse.principals import Groups, Principal, check_id, effective_principals, group_closure
from gatehouse.service.identity import header_groups, identity, redact, request_scope
from gatehouse.streaming.acl_cache import EpochCache


def admits(grants, denies, held):
    return bool(held) and not set(denies) & set(held) and bool(set(grants) & set(held))


def test_admits_and_explain_equal_the_model(spark):
    rng = random.Random(0)
    ids = ["a", "b", "c", "d", "e", "everyone"]
    some = lambda most: rng.sample(ids, rng.randint(0, most))
    rows = [(i, some(5), some(3), some(4)) for i in range(3000)]
    rows += [(5000, ["a", None, "a"], None, ["a", None]), (5001, None, None, ["a"]), (5002, ["a"], [None], [None])]
    frame = spark.createDataFrame(rows, "i int, g array<string>, d array<string>, p array<string>")
    got = frame.select("i", policy.admits("g", "d", F.col("p")).alias("ok"), policy.explain("g", "d", F.col("p")).alias("e")).collect()
    for (i, g, d, p), r in zip(rows, sorted(got, key=lambda r: r["i"]), strict=True):
        g, d, p = ([x for x in v or [] if x is not None] for v in (g, d, p))
        want = admits(g, d, p)
        assert r["i"] == i and r["ok"] == want == r["e"]["admitted"]
        hit, bar = sorted(set(g) & set(p)), sorted(set(d) & set(p))
        reason = "empty permission set" if not p else f"denied via {', '.join(bar)}" if bar else "no grants" if not g else f"granted via {', '.join(hit)}" if hit else "no matching grant"
        assert (r["e"]["reason"], r["e"]["matched_grants"], r["e"]["matched_denies"]) == (reason, hit, bar)


def test_keys_of_different_policies_differ(spark):
    pairs = [(["a", "b"], []), (["a+b"], []), (["a"], ["b"]), (["b", "a", "a"], []), (["a-b"], []), ([], ["a", "b"]), (["eng-contractors"], []), (["eng"], ["contractors"])]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, g array<string>, d array<string>")
    keys = [r[0] for r in frame.orderBy("i").select(policy.policy_key("g", "d")).collect()]
    assert keys[0] == keys[3]
    assert len(set(keys)) == len(pairs) - 1


def test_ids(spark):
    good, bad = ["a", "x" * 256, "u@example.com", "a+b"], ["", " a", "a b", "a\tb", "x" * 257, "everyone", "a b", "a\x01"]
    for raw in good:
        assert check_id(raw) == raw
    for raw in bad:
        with pytest.raises(InvalidPrincipalError):
            check_id(raw)
    frame = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
    assert {r["x"] for r in frame.where(policy.valid_id("x")).collect()} == set(good)


def test_closure_with_cycles(spark):
    groups = Groups({"a": ["b"], "b": ["c"], "c": ["a", "d"]})
    assert groups.resolve(Principal.of("u", "a")) == {"u", "everyone", "a", "b", "c", "d"}
    assert groups.resolve(Principal.of("u")) == {"u", "everyone"}
    pairs = {tuple(r) for r in group_closure(groups.frame(spark)).collect()}
    assert pairs == {(x, y) for x in "abc" for y in "abcd"}
    callers = spark.createDataFrame([("u", ["b"]), ("v", []), ("w", None)], "id string, groups array<string>")
    got = {(r["id"], r["principal"]) for r in effective_principals(callers, groups.frame(spark)).collect()}
    assert got == {("u", p) for p in ("u", "everyone", "a", "b", "c", "d")} | {(x, p) for x in "vw" for p in (x, "everyone")}
    assert effective_principals(callers, groups.frame(spark).where("false")).count() == 7


def test_identity_and_tokens():
    who = identity({"X-Gatehouse-Principal": " carol ", "x-gatehouse-groups": "sre, ,contractors"})
    assert who == Principal("carol", frozenset({"sre", "contractors"}))
    for headers in (None, {}, {"X-Gatehouse-Principal": "  "}, {"X-Gatehouse-Principal": "a b"}, {"X-Gatehouse-Principal": "a", "X-Gatehouse-Groups": "ok,everyone"}):
        with pytest.raises(AuthError):
            identity(headers)
    with request_scope({"X-Gatehouse-Token-Drive": "s3cr3t-value"}) as tokens:
        token = tokens["drive"]
        assert "s3cr3t" not in repr(token) and "s3cr3t" not in f"{token}"
        assert redact("sent s3cr3t-value; Bearer abc.def token=xyz") == "sent [REDACTED]; Bearer [REDACTED] token=[REDACTED]"
        assert token() == "s3cr3t-value"
        for dumps in (__import__("pickle").dumps, __import__("pyspark").cloudpickle.dumps):
            with pytest.raises((AttributeError, TypeError, __import__("pickle").PicklingError)):
                dumps(token)
    with pytest.raises(AuthError):
        token()
    for wrong in ({"X-Gatehouse-Token-": "x"}, {"X-Gatehouse-Token-Drive": " "}):
        with pytest.raises(AuthError), request_scope(wrong):
            pass


def test_header_groups(spark):
    frame = spark.createDataFrame([(" b, a ,,a",), ("a b",), (None,), ("everyone",)], "h string")
    got = [tuple(r[0]) for r in frame.select(header_groups("h")).collect()]
    assert got == [(["a", "b"], True), (["a b"], False), ([], True), (["everyone"], False)]


def test_cache_never_outlives_its_ttl_or_a_signal():
    now, truth, broken = [0.0], {"u": {"g"}}, [False]

    def resolve(who):
        if broken[0]:
            from gatehouse.errors import AclResolutionError

            raise AclResolutionError("down")
        return frozenset(truth[who.id])

    cache = EpochCache(resolve, clock=lambda: now[0], ttl=60, most=2)
    u = Principal.of("u")
    assert cache(u) == {"g"}
    truth["u"] = {"g", "h"}
    now[0] = 59
    assert cache(u) == {"g"}
    now[0] = 60
    assert cache(u) == {"g", "h"}
    truth["u"] = set()
    cache.signal("group", "other")
    assert cache(u) == {"g", "h"}
    cache.signal("group", "h")
    assert cache(u) == set()
    truth["u"] = {"g", "k"}
    cache.signal("principal", "u")
    assert cache(u) == {"g", "k"}
    cache.narrow("u", "g")
    assert cache(u) == {"k"}
    cache.signal()
    cache.narrow("u", "k")
    broken[0] = True
    assert cache(u) == set() and cache.outcomes["error"] == 1
    broken[0] = False
    assert cache(u) == {"g", "k"}
    truth |= {"v": {"x"}, "w": {"y"}}
    for who in ("u", "v", "w"):
        cache(Principal.of(who))
    assert len(cache.held) == 2
    assert EpochCache(resolve, ttl=0)(u) == {"g", "k"}


def test_a_signal_during_a_fetch_counts():
    rights = {"u": ["eng"]}

    def resolve(who):
        found = frozenset(rights[who.id])
        if hook:
            hook.pop()()
        return found

    def revoke():
        rights["u"] = []
        cache.signal("principal", "u")

    hook = [revoke]
    cache = EpochCache(resolve, clock=lambda: 0.0, ttl=60)
    u = Principal.of("u")
    assert cache(u) == {"eng"} and cache(u) == set() and cache(u) == set()
    assert cache.outcomes["hit"] == 1 and cache.outcomes["miss"] == 2
    none = EpochCache(resolve, ttl=0)
    assert none(u) == set() and not none.held


def test_closure_is_kept_up_to_date(spark, monkeypatch):
    rng = random.Random(12)
    nodes = [f"g{i}" for i in range(14)]
    edges = {tuple(rng.sample(nodes, 2)) for _ in range(22)} | {("g0", "g0")}

    def frame(some):
        return spark.createDataFrame(sorted(some), "child string, parent string")

    def brute(some):
        reach = set(some)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        return reach

    rounds = []
    write = principals.written
    monkeypatch.setattr(principals, "written", lambda df, name: (rounds.append(out := write(df, name)), out)[1])
    closure = principals.group_closure(frame(edges))
    assert {tuple(r) for r in closure.collect()} == brute(edges)
    # No round writes a pair again.
    assert sum(r.count() for r in rounds) == len(brute(edges))
    for _ in range(3):
        removed = set(rng.sample(sorted(edges), 4))
        added = {tuple(rng.sample(nodes, 2)) for _ in range(3)}
        closure = write(principals.update_closure(closure, frame(edges), frame(added), frame(removed | {("g1", "nobody")})), "closure")
        edges = (edges - removed) | added
        assert {tuple(r) for r in closure.collect()} == brute(edges)
    chain = {(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)}
    rounds.clear()
    assert principals.group_closure(frame(chain)).count() == 5050 and len(rounds) <= 9
