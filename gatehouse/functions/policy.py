"""Access policies as Column expressions.

A policy is two array<string> columns, grants and denies. A caller's
permissions are an array<string> column or a collection of ids. A null array
counts as empty, and null ids in an array are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERYONE = "everyone"


def ids(of: Column | str | Iterable[str]) -> Column:
    """A sorted, distinct, non-null array of ids. A string names a column; other collections are literals."""
    if isinstance(of, Column):
        return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(of, no_ids()))))
    if isinstance(of, str):
        return ids(F.col(of))
    known = sorted({x for x in of if x is not None})
    return F.array(*[F.lit(x) for x in known]) if known else no_ids()


def no_ids() -> Column:
    return F.array().cast("array<string>")


def _plain(of: Column | str | Iterable[str]) -> Column:
    """Like `ids`, without sorting: enough for overlap tests."""
    return F.array_compact(F.coalesce(F.col(of) if isinstance(of, str) else of, no_ids())) if isinstance(of, (str, Column)) else ids(of)


def admits(grants: Column | str, denies: Column | str, permissions: Column | str | Iterable[str]) -> Column:
    """Some grant and no deny is among the permissions; so nothing admits an empty set."""
    p = _plain(permissions)
    return F.arrays_overlap(_plain(grants), p) & ~F.arrays_overlap(_plain(denies), p)


def explain(grants: Column | str, denies: Column | str, permissions: Column | str | Iterable[str]) -> Column:
    """struct(admitted, matched_grants, matched_denies, reason); the reason names what decided."""
    p, g, d = ids(permissions), ids(grants), ids(denies)
    by_grant, by_deny = F.array_intersect(g, p), F.array_intersect(d, p)
    listed = lambda a: F.array_join(a, ", ")
    reason = (
        F.when(F.size(p) == 0, "empty permission set")
        .when(F.size(by_deny) > 0, F.concat(F.lit("denied via "), listed(by_deny)))
        .when(F.size(g) == 0, "no grants")
        .when(F.size(by_grant) > 0, F.concat(F.lit("granted via "), listed(by_grant)))
        .otherwise("no matching grant")
    )
    return F.struct(admits(grants, denies, permissions).alias("admitted"), by_grant.alias("matched_grants"), by_deny.alias("matched_denies"), reason.alias("reason"))


def revoke(grants: Column | str, principal: Column | str) -> Column:
    """The grants without one principal."""
    return F.array_remove(ids(grants), principal if isinstance(principal, Column) else F.lit(principal))


def with_rule(rules: Column | str, principal: Column | str) -> Column:
    """The grants (or denies) with one principal more."""
    return F.array_sort(F.array_union(ids(rules), F.array(principal if isinstance(principal, Column) else F.lit(principal))))


def without(permissions: Column | str, *gone: str) -> Column:
    """A permission set without some ids."""
    return F.array_except(ids(permissions), ids(gone))


def is_subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(ids(a), ids(b))) == 0


def policy_key(grants: Column | str, denies: Column | str) -> Column:
    """SHA-256 of the policy's ids, each preceded by its length, so that different policies differ."""
    part = lambda a, kind: F.array_join(F.transform(ids(a), lambda x: F.concat(F.lit(kind), F.length(x).cast("string"), F.lit(":"), x)), "")
    return F.sha2(F.concat(part(grants, "+"), part(denies, "-")), 256)


def fingerprint(content_hash: Column | str, grants: Column | str, denies: Column | str) -> Column:
    """Changes with the content or the policy of a document."""
    content = F.col(content_hash) if isinstance(content_hash, str) else content_hash
    return F.sha2(F.concat(content, policy_key(grants, denies)), 256)


def valid_id(column: Column | str) -> Column:
    """Non-empty, at most 256 characters, no white space or control characters, not the reserved id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 256) & ~c.rlike(r"(?U)[\s\x00-\x1f]") & (c != EVERYONE), F.lit(False))
