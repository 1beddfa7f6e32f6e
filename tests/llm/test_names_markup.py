"""Names against brute force and made identities; markup on constructs and look-alikes."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from repolith.llm import link, markup, names, sitetree


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_segment_join(spark):
    r = random.Random(8)
    words = set()
    for _ in range(250):
        w = "".join(r.choices("abcd", k=r.randint(1, 11)))
        words |= {w, w[: r.randint(0, len(w))] + r.choice("abcd") + w[r.randint(0, len(w)) :]}
    words = sorted(words)
    df = spark.createDataFrame([("x", w, 0) for w in words + words[:9]] + [(None, "abc", 0), ("x", None, 0), ("x", "", 0), ("y", words[0], 0)], "block string, w string, name int")
    got = {(x["a"], x["b"]): x["distance"] for x in names.name_pairs(df, "block", "w").collect()}
    want = {(a, b): d for a, b in combinations([w for w in words if w], 2) if (d := distance(a, b)) <= names.edits_allowed(min(len(a), len(b)))}
    assert got == want


@pytest.mark.parametrize(
    "typed, want",
    [
        ("Okwembe, Jennifer", ("jennifer", "okwembe", None, "", False)),
        ("Dr. Jen Okwembe (Acme)", ("jennifer", "okwembe", None, "", False)),
        ("JenniferOkwembe", ("jennifer", "okwembe", None, "", False)),
        ("jennifer.okwembe", ("jennifer", "okwembe", None, "", False)),
        ("Théodore X. Kobragíl", ("theodore", "kobragil", None, "x", False)),
        ("Zaserak, R. M.", (None, None, "zaserak", "rm", False)),
        ("Gudrehin Systems, Ltd", ("gudrehin", "systems", None, "", True)),
        ("The Gudrehin Systems team", ("gudrehin", "systems", None, "", True)),
        ("", (None, None, None, "", False)),
        (None, (None, None, None, "", False)),
    ],
)
def test_parse_name(typed, want):
    assert names.parse_name(typed) == want


def test_parse_address():
    assert names.parse_address("12+Rebecca.Z@users.example") == "rebeccaz"
    assert names.parse_address("a.b+git@x.example") == "ab"
    assert names.parse_address("team7@box.example") == "@box" and names.parse_address("hello@acme-labs.example") == "@acme"
    assert names.parse_address(None) is None and names.parse_address("nobody") is None


PEOPLE = [
    (1, "Jennifer Vedruhunz", "jennifer-vedruhunz@acme.example"),
    (2, "Jen Vsdruhunz", "vedruhunzj@post.example"),
    (3, "J Vedruhunz", "31+jennifer-vedruhunz@noreply.example"),
    (4, "Vedruhunz Jennifer", None),
    (5, "Jennifer Vedruhunz", "team2@box.example"),
    (6, "Andrea Vedruhunz", "andrea.vedruhunz@acme.example"),
    (7, "Robert Stesibrinz", "team2@box.example"),
    (10, "Theodore Marvesh", "thplegitras23@acme.example"),
    (11, "Theo Marvesh", "thplegitras23@localhost"),
    (12, "Theodore Marvesh", "thstazewek87@other.example"),
    (13, "Theodore Marvesh", None),
    (20, "Gudrehin Systems", "oss@gudrehin.example"),
    (21, "The Gudrehin Systems Inc.", "hello@gudrehin-systems.example"),
    (22, "Gudrehin Labs", "hello@gudrehin.example"),
    (30, None, None),
    (31, "", "jvedruhunz@x.example"),
    (None, "Jennifer Vedruhunz", "x@y.example"),
]


def test_linking(spark):
    df = spark.createDataFrame(PEOPLE, "node long, entity string, email string")
    got = {(r["node_a"], r["node_b"]) for r in link.pairs(link.link(df, "node", "entity", "email"), "node").collect()}
    groups = [[1, 2, 3, 4, 5], [10, 11], [20, 21]]
    assert got == {p for g in groups for p in combinations(g, 2)}
    assert link.link(df, "node", "entity", "email").select("node").distinct().count() == len(PEOPLE) - 1
    assert link.link(df.limit(0), "node", "entity", "email").count() == 0


def test_learned_short_forms(spark):
    """A short form seen in three families is learned, and then links names of other mailboxes; family names of couples are not."""
    rows, n = [], 0
    for family in ("Okasul", "Brandivel", "Chermodin"):
        for name in ("Wilhelmina", "Minke"):
            n += 1
            rows.append((n, f"{name} {family}", f"wilhelmina.{family.lower()}@acme.example"))
    for i in range(8):  # further bearers of the long form
        rows.append((20 + i, f"Wilhelmina Dra{chr(97 + i)}vo{chr(97 + i)}n", None))
    rows += [(40, "Minke Tarvosil", "tarvosilw@post.example"), (41, "Wilhelmina Tarvosil", "wtarvosil@acme.example"), (42, "Minka Other", None)]
    for i, (x, y) in enumerate([("Anders", "Birgit"), ("Carla", "Dmitri"), ("Erik", "Farah")]):
        rows += [(50 + 2 * i, f"{x} Fam{i}ilo", f"box{i}x@home.example"), (51 + 2 * i, f"{y} Fam{i}ilo", f"box{i}x@home.example")]
    df = spark.createDataFrame(rows, "node long, entity string, email string")
    typed = names.parsed(df, "node", "entity", "email")
    assert {(r["word"], r["long"]) for r in link.learned(typed).collect()} == {("minke", "wilhelmina")}
    got = {(r["node_a"], r["node_b"]) for r in link.pairs(link.link(df, "node", "entity", "email"), "node").collect()}
    assert {(1, 2), (3, 4), (5, 6), (40, 41)} <= got and not any(a >= 50 for a, _ in got)


def test_slips_in_both_words(spark):
    people = [
        (1, "Olumide Hosejal", "ohosejal@acme.example"),
        (2, "Hostejal, Olmide", "ohosejal@post.example"),
        (3, "Bert Quandirel", "ohosejal@acme.example"),
        (4, "Hostejal Olmide", "other77@x.example"),
        (5, "Vermida Okasul", None),
        (6, "Vermidar Okazul", None),
    ]
    df = spark.createDataFrame(people, "node long, entity string, email string")
    got = {(r["node_a"], r["node_b"]) for r in link.pairs(link.link(df, "node", "entity", "email"), "node").collect()}
    assert (1, 2) in got and not got & {(1, 3), (2, 3), (5, 6)}


KINDS = {
    "heading": ["# A", "## b ##", "Title\n=====", "== W ==", "<h2>x</h2>", "<H3 class='a'>x</H3>", "\\section{x}", "\\subsection*{x y}"],
    "list": ["- a\n- b", "* a\n** b", "1. a\n1. b", "<ul><li>a</li></ul>", "\\begin{itemize}\n\\item a\n\\end{itemize}", "- [x] done", "+ a"],
    "code": ["```py\n# no *head*\n```", "~~~\n- x\n~~~", "a `b` c", "<pre><code>x < y</code></pre>", "{{{\nx\n}}}", "\\verb|x|", "\\begin{verbatim}\n$x$\n\\end{verbatim}", "<source>\nx\n</source>", "```\nopen"],
    "formula": ["$e^{-x}$", "$$\nx^2\n$$", "\\(a \\leq b\\)", "\\[ x \\]", "<math>a</math>", "\\begin{equation}\nx\n\\end{equation}"],
    "other": ["**b**", "_i_ now", "[a](http://x)", "![a](b.png)", "[[A|b]]", "{{Note|x}}", "a &amp; b", "<b>x", "<!-- c -->", "> q", "| a | b |\n|---|---|\n| c | d |", "~~s~~", "a<ref>b</ref>", "x~\\cite{n}", "\\textbf{x}", "<https://x.y>", "''i'' again", "a<br/>b"],
}
PLAIN = [
    "when a < b and c > d", "List<Table> and Map<Key,Value>", "costs $5 to $10", "a 4 * 16 * 2 b", "[breaking] change", "x[0] out of range", "see #12 and PR #3", "C# client",
    "C:\\temp\\section", "a_b_c and max_x_size", "Dictionary<string,b>", "a => b", "R & D", "~15%", "2 * 3 * 4 is wrong", "修复（x）", "", "   ",
]


def test_kinds():
    for kind, texts in KINDS.items():
        for t in texts:
            assert set().union(*(b.kinds for b in markup.parse(t))) == {kind}, t
    for t in PLAIN:
        assert not set().union(set(), *(b.kinds for b in markup.parse(t))), t
    assert markup.parse(None) == []


WITHIN = [
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", ["- a", "  - b"], {"list"}),
    ("<ul><li>a</li><ul><li>b</li></ul><li>c</li></ul>", ["- a", "  - b", "- c"], {"list"}),
    ("<ol><li>a<OL><li>b</li><li>`c`</li></OL>d</li><li>e</li></ol>", ["1. a", "  1. b", "  2. `c`", "  d", "2. e"], {"list", "code"}),
    ("<ul>" + "<li>x<ul>" * 9 + "<li>y</li>" + "</ul></li>" * 9 + "</ul>", ["  " * i + "- x" for i in range(9)] + ["  " * 9 + "- y"], {"list"}),
    ("<ul>say<li>a</li></ul>", ["- say", "- a"], {"list"}),
    ("<ul><!-- c --><li>a</li></ul>", ["- a"], {"list", "other"}),
    ("<ul><li>a\\begin{itemize}\n\\item b\n\\end{itemize}</li></ul>", ["- a", "  - b"], {"list"}),
    ("<table><tr><td>x</td><td><ul><li>a</li><li>b</li></ul></td></tr></table>", ["x | - a - b"], {"other", "list"}),
    ("<table><tr><td><h2>t</h2></td><td>y</td></tr></table>", ["## t | y"], {"other", "heading"}),
    ("{|\n| x\n| <ul><li>a</li></ul>\n|}", ["x\n- a"], {"other", "list"}),
    ("<h2>t <ul><li>a</li></ul></h2>", ["## t - a"], {"heading", "list"}),
    ("<ul><li>a", ["a"], {"list"}),
]


@pytest.mark.parametrize("text, want, kinds", WITHIN)
def test_blocks_within_blocks(text, want, kinds):
    blocks = markup.parse(text)
    assert [t for b in blocks for _, t in markup.leaves(b)] == want
    assert set().union(*(b.kinds for b in blocks)) == kinds


DEEP = [
    ("3. c\n4. d", ["3. c", "4. d"]),
    ("1. one\n  - sub\n  - more\n2. two", ["1. one", "  - sub", "  - more", "2. two"]),
    ("1. one\n- sub\n2. two", ["1. one", "- sub", "2. two"]),
    ("<ol start='7'><li>x</li><li>y</li></ol>", ["7. x", "8. y"]),
    ("> ## t\n> - a\n>\n> 2. b", ["## t", "- a", "2. b"]),
    (">>> x\n>> y", ["x\ny"]),
    ("".join("  " * i + f"- x{i}\n" for i in range(10)), ["  " * i + f"- x{i}" for i in range(10)]),
    ("<div>a<section><h2>b</h2><ul><li>c</li></ul></section></div>", ["a", "## b", "- c"]),
    ("<div>a<div>b", ["a\nb"]),
    ("\\begin{itemize}\\item a\\begin{enumerate}\\item b\\end{enumerate}\\item c\\end{itemize}", ["- a", "  1. b", "- c"]),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", ["a | b\nc"]),
]


@pytest.mark.parametrize("text, want", DEEP)
def test_depth_and_numbers(text, want):
    assert [t for b in markup.parse(text) for _, t in markup.leaves(b)] == want


def test_never_fails():
    r = random.Random(9)
    bits = ["```", "$", "$$", "\\(", "<b", "<li>", "</ul>", "{{", "}}", "[[", "\n", "\n\n", "# ", "- ", "|", "---", "a", " ", "&", "&lt;", "'''", "\x00", "\x001\x00", "\\begin{itemize}", "\\item", "=", "*"]
    for _ in range(3000):
        for b in markup.parse("".join(r.choices(bits, k=r.randint(0, 25)))):
            assert markup.leaves(b) is not None
    markup.parse("[" * 50_000 + "a" * 50_000)
    for text in ("<div>" * 20_000 + "x" + "</div>" * 20_000, ">" * 20_000 + " x", "<ul><li>" * 5_000 + "x" + "</li></ul>" * 5_000):
        assert "x" in sitetree.page_leaves(text)[0][2]


def test_clean_text(spark):
    text = "# Title\r\n\r\nSome **bold** &amp; `x<y`\r\n\r\n1. one\r\n2. [two](http://x)\r\n\r\n$$\nx^2\n$$"
    rows = [("h", "r1", text), ("h", "r1", text), ("h", "r2", None), ("h", "r3", ""), ("h", None, "x"), (None, "r4", "plain")]
    rows += [("big", f"p{i}", f"Welcome to our releases\n\n# Release {i}\n\nchanged {chr(97 + i) * 5}") for i in range(8)]
    df = spark.createDataFrame(rows, "host string, record string, page string")
    got = {r["record"]: r for r in sitetree.clean(df, F.col("host"), F.col("record"), F.col("page")).collect()}
    assert got["r1"]["text"] == "# Title\n\nSome bold & `x<y`\n\n1. one\n2. two\n\n$$x^2$$"
    assert got["r1"]["structure"] == ["code", "formula", "heading", "list", "other"]
    assert (got["r2"]["text"], got["r3"]["text"], got["r4"]["text"]) == ("", "", "plain") and len(got) == 12
    assert got["p3"]["text"] == "# Release 3\n\nchanged ddddd" and got["p3"]["removed"] == 1
    assert sitetree.clean(df.limit(0), F.col("host"), F.col("record"), F.col("page")).count() == 0
    assert sitetree.host_importance(sitetree.read_pages(df, F.coalesce("host", F.lit("")), F.col("record"), F.col("page"))).filter("host = 'big'").first()["pages"] == 8


def test_removed_branches(spark):
    """Pages of three hosts with branches known to be boilerplate or content: at least 0.9 of each is told apart."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    rows, keep, drop = [], {}, {}
    for h in range(3):
        menu = "<nav><ul>" + "".join(f"<li>menu {word()}</li>" for _ in range(4)) + "</ul></nav>"
        foot = f"<footer><div>foot {phrase(5)}<ul><li>foot {word()}</li></ul></div></footer>"
        for i in range(25):
            body = [f"body{i} {phrase(6)}" for _ in range(3)]
            items = [f"body{i} {phrase(3)}" for _ in range(r.randint(1, 3))]
            rows.append((f"h{h}", f"h{h}p{i}", f"{menu}<div><h2>{body[0]}</h2>\n\n{body[1]}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{body[2]}</div>{foot}"))
            keep[f"h{h}p{i}"] = [*body, *items]
            drop[f"h{h}p{i}"] = 4 + 2
    df = spark.createDataFrame(rows, "host string, record string, page string")
    got = {x["record"]: x for x in sitetree.clean(df, F.col("host"), F.col("record"), F.col("page")).collect()}
    kept = sum(t in got[k]["text"] for k, ts in keep.items() for t in ts)
    left = sum(got[k]["text"].count("menu ") + got[k]["text"].count("foot ") for k in drop)
    assert kept >= 0.9 * sum(map(len, keep.values()))
    assert left <= 0.1 * sum(drop.values())


def test_hosts_have_titles(spark, tmp_path):
    spark.createDataFrame([("a", "r1", "# Notes")], "repo_id string, id string, notes string").write.parquet(str(tmp_path / "releases.parquet"))
    spark.createDataFrame([("a", "i1", "fix x"), ("b", "i2", "fix y")], "repo_id string, id string, title string").write.parquet(str(tmp_path / "issues.parquet"))
    assert {(r["host"], r["pages"]) for r in entry.queries()["p3_hosts"](spark, str(tmp_path)).collect()} == {("a", 2), ("b", 1)}
