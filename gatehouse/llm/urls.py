"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import boxed, name

#: The rule list travels to every task, so its size is bounded.
MAX_RULES = 1_000_000


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    #: Rules that end inside a segment: rest of the path to (verdict, rule text), and the lengths of these rests, longest first.
    partial: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    rule: tuple[str, str] | None = None


class UrlTrie:
    """Longest-match lookup of (host, path) prefixes.

    The walk goes down the host's labels from the right, and from every host
    node that is reached down the path's segments. The deepest host wins, then
    the longest path. Of equal (host, path) rules with both verdicts, block wins.
    A path rule is a plain string prefix: ``/en/1`` also fits ``/en/10``.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError("a rule's verdict is allow or block")
            self._add(verdict, host.translate(_LOWER), path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, _Node())
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, _Node())
        name = f"{host}{path}"
        if rest:
            if node.partial.get(rest, ("allow",))[0] != "block":
                node.partial[rest] = (verdict, name)
            if len(rest) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(rest)], reverse=True)
        elif node.rule is None or node.rule[0] != "block":
            node.rule = (verdict, name)

    @staticmethod
    def _path(node: _Node, path: str) -> tuple[str, str] | None:
        best, segments, at = None, path.split("/"), 0
        for segment in segments:
            if hit := next((node.partial[p] for n in node.lengths if n <= len(segment) and (p := segment[:n]) in node.partial), None):
                best = hit
            elif node.rule:
                best = node.rule
            at += len(segment) + 1
            if at > len(path) or segment not in node.segments:
                return best
            node = node.segments[segment]
        return best

    def lookup(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._path(node, path) or best
        return best


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``rules``: (verdict, host, path) triples, verdict ``allow`` or ``block``.
    A url without a match gets a null rule and the verdict ``default``. A null
    url, or one without ``://``, has an empty host and path and so no match.
    Repeated rows stay; columns of these four names in the input are replaced.
    The empty table gives the empty table.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [trie.value.lookup(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r for _, r in found], "verdict": [v for v, _ in found]}, dtype=object)

    link = name(url)
    address = F.when(F.instr(link, "://") > 0, link.substr(F.instr(link, "://") + 3, F.length(link))).otherwise("")
    host = F.translate(F.regexp_extract(address, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(address, r"^[^/?#]*(/[^?#]*)?", 1)
    out = boxed(pages.drop("host", "path", "rule", "verdict"), host=host, path=path).withColumn("found", match("host", "path"))
    return out.select("row.*", "host", "path", "found.rule", "found.verdict")
