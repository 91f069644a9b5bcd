"""URL filters: rules indexed by their rarest literal token; only the rules that a url's tokens fetch run a pattern.

A rule is a host with an optional path (``net/``, ``example.net/en/``; it fits the host and its subdomains) or a regular
expression over the url in lower case. Its literal tokens are the runs of a-z0-9 that any fitting url must contain as
whole tokens; they are read off the rule. How often each of them occurs is counted over
all urls; the rarest one is the rule's key. Urls are exploded into their distinct tokens, joined to the keys, and the
fetched rules' patterns run in the JVM. Rules without a literal token are tried on every url in the row's own pass.

Verdict: the action of the longest fitting host rule; else ``block`` if a pattern rule fits; else ``allow``.

Edge cases: null urls and urls without ``://`` have empty host and path, and are allowed unless a pattern fits. Rows are
kept apart by a row number, so repeated rows, null ids and ties stay. An empty table gives an empty result. Very long urls
are read whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, cut



@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    kind: str


def host_rule(text: str, action: str) -> Rule:
    """A rule of a host and the path that follows it."""
    host, slash, path = text.partition("/")
    path = slash + path
    tokens = re.findall(r"[a-z0-9]+", host)
    # The last token of a path that ends inside a token may go on in the url.
    tokens += re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower()) if path.isascii() else []
    return Rule(text, action, rf"^(?:[^/]*\.)?{re.escape(host)}\x00{re.escape(path)}", tuple(tokens), "host")


#: What stands for a part of a pattern: its kind ("sign": one character outside a-z0-9, "literal": the character a-z0-9
#: in ``value``, "border": an end of the text or of a word, "other": any other character or place, "group": the
#: alternatives in ``value``), and whether it may be left out or repeated.
@dataclass(frozen=True)
class Part:
    kind: str
    value: object = None
    optional: bool = False
    repeated: bool = False


class _Reader:
    """Reads the patterns that Python and Java understand alike: literals, escaped signs, ``\\b \\d \\w \\s`` and their
    opposites, ``. ^ $``, classes of characters and ranges, groups without names or flags, alternatives, quantifiers.
    Everything else is refused."""

    ESCAPES = "dDwWsS"

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def fail(self) -> None:
        raise ValueError(f"pattern outside the common part of Python's and Java's grammars, at {self.at}: {self.text!r}")

    def take(self) -> str:
        if self.at >= len(self.text):
            self.fail()
        self.at += 1
        return self.text[self.at - 1]

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def alternatives(self, depth: int = 0) -> list[list[Part]]:
        out: list[list[Part]] = [[]]
        while self.at < len(self.text) and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                out.append([])
            else:
                out[-1].append(self.quantified(self.part(depth)))
        if self.at < len(self.text) and not depth:
            self.fail()
        return out

    def part(self, depth: int) -> Part:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.at += 1
                if self.take() != ":":
                    self.fail()
            held = self.alternatives(depth + 1)
            if self.take() != ")":
                self.fail()
            return Part("group", held)
        if c == "[":
            return Part("sign" if self.signs_only() else "other")
        if c in "^$":
            return Part("border")
        if c == ".":
            return Part("other")
        if c == "\\":
            c = self.take()
            if c == "b":
                return Part("border")
            if c == "B" or c in self.ESCAPES:
                return Part("other")
            if c.isalnum() or not c.isascii():
                self.fail()
            return Part("sign")
        if c in "*+?{}]" or c.isspace():
            self.fail()
        return Part("literal", c) if re.fullmatch("[a-z0-9]", c) else Part("sign")

    def signs_only(self) -> bool:
        """Reads a class; whether it holds single signs and nothing else."""
        if self.peek() in ("^", "]"):
            plain = self.peek() != "^"
            if plain:
                self.fail()
            self.at += 1
            if self.peek() == "]":
                self.fail()
        else:
            plain = True
        while (c := self.take()) != "]":
            if c == "[" or c == "&" and self.peek() == "&":
                self.fail()
            if c == "\\":
                c = self.take()
                if c in self.ESCAPES:
                    plain = False
                    continue
                if c.isalnum() or not c.isascii():
                    self.fail()
            elif re.fullmatch("[a-z0-9]", c):
                plain = False
            if self.peek() == "-" and self.peek(2)[1:] != "]":
                plain = False
        return plain

    def quantified(self, part: Part) -> Part:
        c, least, most = self.peek(), 1, 1
        if c and c in "*+?":
            self.at += 1
            least, most = {"*": (0, 2), "+": (1, 2), "?": (0, 1)}[c]
        elif c == "{":
            found = re.compile(r"\{(\d+)(,(\d*))?\}").match(self.text, self.at)
            if not found:
                self.fail()
            self.at = found.end()
            least = int(found[1])
            most = least if not found[2] else int(found[3]) if found[3] else 2
        else:
            return part
        if self.peek() == "?":
            self.at += 1
        if self.peek() and self.peek() in "*+?{" or part.kind == "border":
            self.fail()
        return Part(part.kind, part.value, least == 0, most > 1)


def _edge(parts: list[Part], first: bool) -> bool | None:
    """Whether all that a sequence fits starts (``first``) or ends outside a-z0-9, or at a border; None if it may fit the
    empty text only. Parts that may be left out count only if they agree with what lies beyond."""
    for part in parts if first else reversed(parts):
        if part.kind == "group":
            found = [_edge(x, first) for x in part.value]
            one = None if all(f is None for f in found) else all(f is True for f in found)
            if one is not None and None in found and one:
                one = None
        else:
            one = part.kind in ("sign", "border")
        if one is False:
            return False
        if one is True and not part.optional:
            return True
    return None


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Runs of a-z0-9 that every fitting text has as whole tokens: literals of the pattern's outermost sequence with a
    sign, a border of a word or an end of the text on both sides."""
    reader = _Reader(pattern)
    sequences = reader.alternatives()
    if len(sequences) > 1:
        return ()
    parts, out, at = sequences[0], [], 0
    plain = [p.kind == "literal" and not p.optional and not p.repeated for p in parts]
    while at < len(parts):
        stop = at
        while stop < len(parts) and plain[stop]:
            stop += 1
        if stop > at and _edge(parts[:at], False) and _edge(parts[stop:], True):
            out.append("".join(p.value for p in parts[at:stop]))
        at = max(stop, at + 1)
    return tuple(out)


def pattern_rule(pattern: str) -> Rule:
    """A regular expression that blocks: what ``_Reader`` takes; others are refused."""
    return Rule(pattern, "block", pattern, literal_tokens(pattern), "pattern")


def parse_rules(text: str) -> list[Rule]:
    """Rules of a text, one a line: ``block`` or ``allow`` and a host with its path, or ``block`` and ``/pattern/``.
    Blank lines and lines that start with # are skipped."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("#"):
            continue
        action, _, rule = line.partition(" ")
        rule = rule.strip()
        if action not in ("block", "allow") or not rule:
            raise ValueError(f"not a rule: {line!r}")
        if rule.startswith("/") and rule.endswith("/") and len(rule) > 1:
            if action != "block":
                raise ValueError(f"patterns can only block: {line!r}")
            out.append(pattern_rule(rule[1:-1]))
        else:
            out.append(host_rule(rule, action))
    return out


#: The default pattern rules, for farms of links, pills and casinos.
PATTERNS = (
    pattern_rule(r"://([^/?#]*\.)?spam-farm\."),
    pattern_rule(r"://([^/?#]*\.)?cheap-pills\."),
    pattern_rule(r"://([^/?#]*[.-])?(?:online-)?casino[.-]"),
    pattern_rule(r"[?&]utm_source=spam(?:&|#|$)"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def filter_urls(
    pages: DataFrame,
    host_rules: list[Rule],
    patterns: list[Rule] = PATTERNS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule (text of the host rule that decided, or null), verdict, fitting pattern or null."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    number, page = F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id")
    rows = pages.select(number, page, url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut(rows, "urls").withColumn("tokens", _tokens(F.coalesce("url", F.lit(""))))
    rules = list(enumerate([*host_rules, *patterns]))
    schema = "number int, text string, action string, pattern string, kind string, tokens array<string>"
    listed = [(i, r.text, r.action, r.pattern, r.kind, list(r.tokens)) for i, r in rules if r.tokens]
    table = spark.createDataFrame(listed, schema)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    # Above this size the joins with the urls' tokens are shuffled.
    size = sum(len(r.text) + len(r.pattern) + sum(map(len, r.tokens)) + 200 for _, r in rules)
    bound = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    counts = rows.select(F.explode("tokens").alias("token")).join(bound(wanted), "token")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    keyed = table.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = keyed.groupBy("number").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("key"))
    index = cut(table.drop("tokens").join(rarest, "number"), "rules")
    over = F.when(F.col("kind") == "host", F.concat("host", F.lit("\0"), "path")).otherwise(F.lower("url"))
    kept = ("row", "number", "text", "action", "kind")
    fetched = rows.withColumn("key", F.explode("tokens")).join(bound(index), "key")
    fits = fetched.where(F.regexp_like(over, "pattern")).select(*kept)
    spare = [(i, r) for i, r in rules if not r.tokens]
    if spare:
        # One condition a rule, in the row's own pass: no url is sent anywhere for them.
        tried = F.array(
            *(
                F.when(
                    F.regexp_like(F.concat("host", F.lit("\0"), "path") if r.kind == "host" else F.lower("url"), F.lit(r.pattern)),
                    F.struct(*(F.lit(v).alias(c) for v, c in zip((i, r.text, r.action, r.kind), kept[1:], strict=True))),
                )
                for i, r in spare
            )
        )
        fits = fits.unionByName(rows.select("row", F.inline(F.array_compact(tried))))
    best = fits.groupBy("row").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("text").alias("n"), "number", "text", "action"))).alias("host_rule"),
        F.min(F.when(F.col("kind") == "pattern", F.col("text"))).alias("pattern"),
    )
    verdict = F.coalesce("host_rule.action", F.when(F.col("pattern").isNotNull(), "block"), F.lit("allow"))
    rule = F.col("host_rule.text").alias("rule")
    return rows.join(best, "row", "left").select("page_id", "host", "path", rule, verdict.alias("verdict"), "pattern")
