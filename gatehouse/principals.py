"""Callers and nested groups: validation, closure of memberships."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AclResolutionError, InvalidPrincipalError
from .functions.policy import EVERYONE
from .plans.tables import written
from .schemas import EDGES

LONGEST_ID = 256


#: What an id looks like; `functions.policy.valid_id` is the same rule for columns.
ID = re.compile(r"[^\s\x00-\x1f]{1,%d}" % LONGEST_ID)


def check_id(raw: str, kind: str = "principal") -> str:
    """The id, if it is well formed and not the reserved one."""
    if raw == EVERYONE or not ID.fullmatch(raw):
        raise InvalidPrincipalError(f"{kind} id is reserved, or isn't 1 to {LONGEST_ID} characters without white space or control characters")
    return raw


@dataclass(frozen=True)
class Principal:
    """A caller: an id and the groups that were forwarded with it."""

    id: str
    groups: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, id: str, *groups: str) -> Principal:
        return cls(check_id(id), frozenset(check_id(g, "group") for g in groups))


class Groups:
    """Which groups each group is directly a member of; cycles are allowed."""

    def __init__(self, edges: Mapping[str, Iterable[str]] | None = None):
        self.parents = {check_id(c, "group"): frozenset(check_id(p, "group") for p in ps) for c, ps in (edges or {}).items()}

    @classmethod
    def from_file(cls, path: str) -> Groups:
        """From a JSON object: group -> list of groups."""
        try:
            with open(path, encoding="utf-8") as f:
                edges = json.load(f)
        except (OSError, ValueError) as e:
            raise AclResolutionError(f"groups file unreadable ({type(e).__name__})") from None
        if not isinstance(edges, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in edges.values()):
            raise AclResolutionError("groups file must map groups to lists of groups")
        return cls(edges)

    def with_edge(self, child: str, parent: str) -> Groups:
        return Groups({**self.parents, child: {*self.parents.get(child, ()), parent}})

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, p) for c, ps in sorted(self.parents.items()) for p in sorted(ps)], EDGES)

    def resolve(self, who: Principal) -> frozenset[str]:
        """All that a caller is: the own id, everyone, and every group reached."""
        reached, fresh = set(), set(who.groups)
        while fresh:
            reached |= fresh
            fresh = {p for g in fresh for p in self.parents.get(g, ())} - reached
        return frozenset(reached | {who.id, EVERYONE})


def _pairs(edges: DataFrame) -> DataFrame:
    """Edges as pairs (child, ancestor), once each, without null ends."""
    return edges.select("child", F.col("parent").alias("ancestor")).where("child IS NOT NULL AND ancestor IS NOT NULL").distinct()


def _composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(child, ancestor) of each pair of ``first`` that ends where one of ``second`` starts."""
    return first.join(second.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("end")), "ancestor").select("child", F.col("end").alias("ancestor"))


def _grown(known: DataFrame, fresh: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``known``, which is closed, with ``fresh`` pairs (none of them known) and all that follows from both.

    Each round composes what the last one found with all that is known, on
    either side, so the length of paths doubles and the rounds are the logarithm
    of the depth. Only new pairs are written. within: the only pairs that may be new.
    """
    fresh = written(fresh, "closure")
    while not fresh.isEmpty():
        known = known.unionByName(fresh)
        found = _composed(fresh, known).unionByName(_composed(known, fresh)).distinct()
        if within is not None:
            found = found.join(within, ["child", "ancestor"], "left_semi")
        fresh = written(found.join(known, ["child", "ancestor"], "left_anti"), "closure")
    return known


def group_closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor): every group that a group reaches, itself not included unless on a cycle.

    edges: child, parent; cycles are allowed, null ends are dropped.
    """
    pairs = _pairs(edges)
    return _grown(pairs.limit(0), pairs)


def update_closure(closure: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure of ``edges`` without ``removed`` and with ``added``, from the closure of ``edges`` (each: child, parent).

    Deleting and deriving again: a pair that a removed edge may have led to is
    in doubt; all others stay as they are. Of those in doubt, the ones that are
    edges still, or that an edge and a pair that stays lead to, and what follows
    from them, come back. Then what the added edges lead to is found. The work
    is in proportion to the pairs in doubt and the new ones.
    """
    left = _pairs(edges).join(_pairs(removed), ["child", "ancestor"], "left_anti")
    gone = written(_pairs(edges).join(_pairs(removed), ["child", "ancestor"], "left_semi"), "closure")
    if not gone.isEmpty():
        starts = gone.unionByName(_composed(closure, gone))
        doubt = written(starts.unionByName(_composed(starts, closure)).distinct(), "closure")
        kept = written(closure.join(doubt, ["child", "ancestor"], "left_anti"), "closure")
        again = left.unionByName(_composed(left, kept)).distinct().join(doubt, ["child", "ancestor"], "left_semi")
        closure = _grown(kept, again, doubt)
    return _grown(closure, _pairs(added).join(closure, ["child", "ancestor"], "left_anti"))


def effective_principals(callers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, principal): what every caller is. callers: id, groups array<string>.

    The closure runs over the groups alone and is joined with the memberships
    once, so callers don't multiply its rounds.
    """
    direct = callers.select("id", F.explode(F.coalesce("groups", F.array().cast("array<string>"))).alias("principal")).where("principal IS NOT NULL")
    reached = direct.join(group_closure(edges).withColumnRenamed("child", "principal"), "principal").select("id", F.col("ancestor").alias("principal"))
    own = callers.select("id", F.col("id").alias("principal")).unionByName(callers.select("id", F.lit(EVERYONE).alias("principal")))
    return own.unionByName(direct).unionByName(reached).distinct()


def whoami(callers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, principals): the effective principals of every caller, sorted."""
    return effective_principals(callers, edges).groupBy("id").agg(F.array_sort(F.collect_set("principal")).alias("principals"))
