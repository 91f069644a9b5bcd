import random
import re

import pytest

from foldspark.llm.urlfilter import PATTERNS, Rule, filter_urls, host_rule, literal_tokens, parse_rules, pattern_rule

RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
CASES = [
    ("https://a.b.NET/x", "a.b.net", "/x", "net/", "block"), ("http://net/", "net", "/", "net/", "block"), ("http://mynet/", "mynet", "/", None, "allow"), ("http://net", "net", "", None, "allow"),
    ("http://www.example.net/en/1?q=/de/#x", "www.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/en", "example.net", "/en", "net/", "block"), ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("http://example.com/DE/", "example.com", "/DE/", None, "allow"), ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://spam-farm.example.com/fr/", "spam-farm.example.com", "/fr/", None, "block"), ("http://spam-farm.example.org/fr/x", "spam-farm.example.org", "/fr/x", "org/fr/", "allow"), ("http://my-cheap-pills.shop/", "my-cheap-pills.shop", "/", None, "allow"),
    ("http://www.cheap-pills.shop/", "www.cheap-pills.shop", "/", None, "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("ftp://x://net/", "x:", "//net/", None, "allow"), ("http://x.net\\n?a", "x.net\\n", "", None, "allow"),
]


def test_verdicts(spark):
    rows = [(u, i, "r") for i, (u, *_) in enumerate(CASES)] + [(CASES[0][0], 0, "r"), (None, None, "r")]
    out = filter_urls(spark.createDataFrame(rows, "url string, page_id bigint, rule string").repartition(3), RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == (CASES[r.page_id][1:] if r.page_id is not None else ("", "", None, "allow")), r


def test_rules_without_tokens_and_unfinished_tokens(spark):
    pages = spark.createDataFrame([(1, "http://a.de/deutsch"), (2, "http://a.de/zzz"), (3, "http://b.de/x")], "page_id bigint, url string")
    rules = [host_rule("a.de/de", "block")]
    got = {r.page_id: (r.rule, r.pattern, r.verdict) for r in filter_urls(pages, rules, [pattern_rule("z{3}"), Rule("q", "block", "qqq", ("qqq",), "pattern")]).collect()}
    assert got == {1: ("a.de/de", None, "block"), 2: (None, "z{3}", "block"), 3: (None, None, "allow")}
    assert filter_urls(pages.limit(0), rules).collect() == []


@pytest.mark.parametrize(
    "pattern, tokens",
    [
        (r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
        (r"://([^/?#]*[.-])?(?:online-)?casino[.-]", ("casino",)),
        (r"[?&]utm_source=spam(?:&|#|$)", ("utm", "source", "spam")),
        ("farm", ()),
        ("-farm", ()),
        ("[a-]farm-", ()),
        ("-fa*rm-", ()),
        ("-(?:x)?farm-", ()),
        ("-farm(?:-x|y)", ()),
        ("^https?://bad/", ("bad",)),
        ("(?:/|^)ads/x", ("ads",)),
        ("-a|-b-", ()),
        (".farm.", ()),
        (r"\Bcasino\B", ()),
        (r"\bcasino\b", ("casino",)),
        (r"-casino\B", ()),
        (r"-(?:|x)farm-", ()),
        (r"(?:-|)farm-", ()),
        (r"[/-]{2}farms?-", ()),
        (r"/a+b/c/", ("c",)),
        (r"/(?:a|b-)/x1/", ("x1",)),
    ],
)
def test_tokens_of_patterns(pattern, tokens):
    assert literal_tokens(pattern) == tokens


@pytest.mark.parametrize("pattern", ["(?i)x", "[a&&b]", r"\h", r"a\1", "(?<n>a)", "(?=a)", "[[:alpha:]]", "a**", "x{,3}", "a b", "[]a]", "(a", "a)", "^*", r"\pL", "a++"])
def test_patterns_outside_the_common_grammar_are_refused(pattern):
    with pytest.raises(ValueError):
        pattern_rule(pattern)


def random_pattern(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 5)):
        piece = rng.choice(["a", "b", "ab", "c1", "-", "/", r"\.", r"\b", r"\B", "[-/]", "[a-]", "[^a]", ".", r"\w", "group", "group"])
        if piece == "group":
            piece = "(?:" + "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 3))) + ")" if depth < 2 else "a"
        if not piece.startswith(("\\b", "\\B")):
            piece += rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}"])
        out += piece
        if rng.random() < 0.3:
            border = ["/", "-", r"\b", "[-/]", r"(?:-|\.)", "(?:/|$)", r"\B"]
            out += rng.choice(border) + rng.choice(["a", "b", "ab", "c1"]) + rng.choice(border)
    return ("^" if rng.random() < 0.1 else "") + out + ("$" if rng.random() < 0.1 else "")


def test_every_pattern_against_every_url(spark):
    """Random patterns over random urls: what the index fetches is what trying all patterns on all urls finds."""
    rng = random.Random(4)
    urls = ["http://" + "".join(rng.choice(["a", "b", "ab", "c1", "-", "/", ".", "x", "aa"]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    patterns = sorted({p for p in (random_pattern(rng) for _ in range(150))})
    rules = [pattern_rule(p) for p in patterns]
    assert sum(bool(r.tokens) for r in rules) > 20
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    got = {r.page_id: r.pattern for r in filter_urls(pages, [], rules).collect()}
    want = {i: min((p for p in patterns if re.search(p, u)), default=None) for i, u in enumerate(urls)}
    assert got == want
    # Tokens alone, pattern by pattern: each must be a whole token of every url that fits.
    for r in rules:
        for u in urls:
            if re.search(r.pattern, u):
                assert set(r.tokens) <= set(re.findall("[a-z0-9]+", u)), (r, u)


def test_rules_of_a_text():
    rules = parse_rules("# farms\n\nblock net/\n allow example.net/en/ \nblock /[?&]ad=1&/\n")
    assert rules == [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), pattern_rule("[?&]ad=1&")]
    with pytest.raises(ValueError):
        parse_rules("deny net/")
    assert all(r.tokens for r in PATTERNS)


def test_very_long_urls(spark):
    url = "http://a.net/" + "x-" * 100_000
    rows = filter_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string"), RULES).collect()
    assert [(r.rule, r.verdict, len(r.path)) for r in rows] == [("net/", "block", 200_001)]
