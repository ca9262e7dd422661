"""URL filters: rules filed under their rarest literal token.

A rule is found through one token that every url it fits must hold. Of a rule's
tokens the one is taken that the fewest urls hold, counted over all urls, so that
a url's tokens fetch few rules, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits a host, its subdomains and the paths that begin as given; the longest text wins."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class PatternRule:
    """Fits a url, A-Z lower-cased, in which the expression is found; its classes and borders of words are those of ASCII."""

    verdict: str
    pattern: str

    @property
    def literals(self) -> tuple[str, ...]:
        """Whole tokens (runs of a-z and 0-9) of which every url that fits holds all."""
        return literal_tokens(self.pattern)


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that stand in every match of an expression, with something else on both sides of each.

    Read off the expression's outermost sequence: runs of literal characters between
    literals of other kinds, borders of words, or the ends. What groups, repeats and
    classes need isn't looked into, so a rule may have fewer tokens than it could.
    """
    out, run, left, border = [], "", False, False
    for op, value in _parser.parse(pattern, re.ASCII):
        name = str(op)
        if name == "LITERAL" and re.match(_TOKEN, chr(value)):
            left = left if run else border
            run, border = run + chr(value), False
            continue
        closed = name == "LITERAL" or name == "AT" and str(value) != "AT_NON_BOUNDARY"  # no token goes on over such a place
        if run and left and closed:
            out.append(run)
        run, border = "", closed
    return tuple(dict.fromkeys(out))


#: The rules of the registered query.
HOST_RULES = (HostRule("block", "net/"), HostRule("allow", "example.net/en/"), HostRule("block", "example.com/de/"), HostRule("allow", "org/fr/"))
#: The patterns of the registered query: gambling, pills, adult and tracking hosts; the first that fits decides.
PATTERN_RULES = (
    PatternRule("allow", r"^[^/?#]*://[^/?#]*\b(?:help|support)\.[^/?#]*\bcasino\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bcasino\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bfree-bets?\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bbets\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bpoker\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bcheap-pills?\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bpills\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\badult-x\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bxxx\b"),
    PatternRule("block", r"^[^/?#]*://[^/?#]*\bviagra\b"),
    PatternRule("block", r"/ads?/[^?#]*\bbanner\b"),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null or a url without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_TO_LOWER), slash + path


def host_tokens(rule: HostRule) -> list[str]:
    return re.findall(_TOKEN, rule.host)


class RuleIndex:
    """Rules by their rarest token. seen: how many urls hold a token."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[PatternRule], seen: dict[str, int]):
        rarest = lambda tokens: min(tokens, key=lambda t: (seen.get(t, 0), t), default="")
        self.hosts, self.patterns = defaultdict(list), defaultdict(list)
        for h in hosts:
            self.hosts[rarest(host_tokens(h))].append(h)
        for k, p in enumerate(patterns):
            self.patterns[rarest(p.literals)].append((k, p.pattern, p.verdict))
        self.compiled: dict[str, re.Pattern] = {}  # those that have run

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """Host, path, host rule, verdict, and how many patterns ran."""
        host, path = parts(url)
        best = None
        for token in {*re.findall(_TOKEN, host), ""}:
            for r in self.hosts.get(token, ()):
                if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
                    best = r
        if best is not None:
            return host, path, best.text, best.verdict, 0
        low = (url or "").translate(_TO_LOWER)
        found = sorted((x for t in {*re.findall(_TOKEN, low), ""} for x in self.patterns.get(t, ())), key=lambda x: x[0])
        for ran, (_, pattern, verdict) in enumerate(found, 1):
            known = self.compiled.get(pattern)
            if known is None:
                known = self.compiled[pattern] = re.compile(pattern, re.ASCII)
            if known.search(low):
                return host, path, None, verdict, ran
        return host, path, None, "allow", len(found)


def rules_of(rules: DataFrame) -> tuple[list[HostRule], list[PatternRule]]:
    """Rules from a table (place, kind, verdict, text) of kinds host and pattern, in the order of place; rows of other kinds are an error."""
    hosts, patterns = [], []
    for r in rules.select("place", "kind", "verdict", "text").orderBy("place").toLocalIterator():
        if r.kind not in ("host", "pattern") or r.verdict not in ("allow", "block"):
            raise ValueError(f"no such rule: {r}")
        hosts.append(HostRule(r.verdict, r.text)) if r.kind == "host" else patterns.append(PatternRule(r.verdict, r.text))
    return hosts, patterns


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many of all urls each token of the rules stands; as many rows as rules have tokens."""
    low = F.translate(F.col("url"), _UPPER, _LOWER)
    held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({_TOKEN})"), 1))).alias("token"))
    wanted = pages.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")  # as large as the rules
    return {r.token: r["count"] for r in held.join(F.broadcast(wanted), "token").groupBy("token").count().collect()}


def filter_urls(pages: DataFrame, hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and patterns_run for each row of pages.

    A null url has an empty host and path, no rule, and the verdict allow, as has
    any url that nothing fits. Repeated rows give repeated rows; columns besides
    page_id and url aren't read. The rules are the operator's own parameters, or come
    from a table by rules_of(); every worker holds their index, as large as they are,
    and compiles the expressions that run. A narrow map after one small count; an empty
    table gives no rows, and a very long url costs its own length.
    """
    tokens = {t for h in hosts for t in host_tokens(h)} | {t for p in patterns for t in p.literals}
    seen = token_counts(pages, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(hosts, patterns, seen)
        for b in batches:
            host, path, rule, verdict, ran = zip(*map(index.judge, b.column(1).to_pylist())) if b.num_rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), pa.array(ran, pa.int32())],
                ["page_id", "host", "path", "rule", "verdict", "patterns_run"],
            )

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, patterns_run int")
