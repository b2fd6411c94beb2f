"""Operators on pages and conversations against small brute-force versions."""

from __future__ import annotations

import hashlib
from itertools import combinations

import public_tokenizers
import pytest
from hearken.llm import chat_tree, html_text, queries, url_rules

JSON = public_tokenizers.path("byte_bpe_50k.json")


def text_of(page):
    return " ".join(html_text.Page(page).kept())


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b> c<br>d<p>e", "ab c d e"),
        ("<nav>menu</nav><article><header><h1>T</h1></header><p>x &lt;i&gt; &#233;&nbsp;y</p></article><footer>f</footer>", "T x <i> é y"),
        ('<div class="ad">buy</div><div id=sidebar>s</div><main>m</main><div class="comments"><p>c</p></div><form>q<input></form>', "m"),
        ("<script>if (a<b) {'</p>'}</script><style>p{}</style><p>t</p><!-- c > d --><noscript>n</noscript>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"), ("</div></p>stray<div><p>open", "stray open"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()), ('<a title="x > y">link</a> a < b', "link a < b"), ("<div class='pad'>kept</div>", "kept"),
        ("<header>site</header><p hidden>h</p><p>x\n\t y</p>", "x y"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div style="overflow:hidden"><p>story</p></div>', "story"), ('<div data-id="share" title="a hidden role=menu">story</div>', "story"), ("<div data-hidden=1>story</div>", "story"),
        ("<div title = 'x' HIDDEN>gone</div><p>story</p>", "story"), ("<div x=y/ class='a nav'>gone</div><p>story</p>", "story"), ('<div style="a" role=menu><article>gone</article></div>story', "story"),
        ('<div id="content-with-sidebar"><article>story</article><div class="ad">buy</div></div>', "story"),
        ('<div class="share"><div class="nav"><main>story</main></div></div><p>more</p>', "story more"),
        ('<div class="with-sidebar"><p>a long story without an article</p></div><p>more</p>', "a long story without an article more"),
        ('<article>s</article><div class="comments"><article>a very long comment</article></div>', "s"), ('<div class="ad">buy</div><p>story</p>', "story"),
    ],
)
def test_attributes_and_layout_wrappers(page, want):
    assert text_of(page) == want


def test_templates_of_a_host_go_and_articles_stay(spark):
    pages = [(k, f"http://h.example/{k}", f"<div><p>Welcome to the site</p></div><div><p>story {k} with words</p></div><div><span>All rights</span></div>") for k in range(30)]
    copies = [(100 + k, f"http://h.example/c{k}", "<div><p>one much copied story</p></div>") for k in range(200)]
    few = [(300 + k, f"http://few.example/{k}", "<p>Hello</p>" + f"<p>n {k}</p>") for k in range(3)]
    odd = [(400, None, None), (None, "x", "<p>y</p>"), (401, "http://h.example/401", "")]
    schema = "page_id long, url string, html string, host string, salt string, texts string"
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in pages + copies + few + odd + odd[:1]], schema)
    out = html_text.extract(frame).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(pages + copies + few + odd) + 1
    assert all(got[k] == f"story {k} with words" for k in range(30))
    assert all(got[100 + k] == "one much copied story" for k in range(200))
    assert got[300] == "Hello n 0" and got[400] == "" and got[None] == "y" and got[401] == ""
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p class="share price">a</p><p class="social-history">b</p><p id="menu-prices">c</p><h2 class="legal">d</h2></article>', "a b c d"),
        ('<p class="share price">a</p><p id="menu-prices">c</p><li class="related">d</li>', "a c d"),
        ('<article><p>a</p><div class="share-price">b</div><div class="ad">buy</div><section class="comments x">no</section></article>', "a b"),
        ('<p>a <span class="ad">buy</span> b</p><p>and more text than that</p>', "a b and more text than that"), ("<a href='x>y</a> z", "y z"), ('<p class=foo">a</p>', "a"),
        ("<b><p>a<b><p>c</b>d", "a c d"), ("<p>x</p><a ", "x"), ("<title>t</title><iframe>i</iframe><p>x", "x"),
    ],
)
def test_class_words_of_containers_only(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page", ["<a " * 340_000 + '"', "<div>x" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000 + "</i>" * 50_000, "<div class=ad>" * 50_000 + "y", "<ul><li>a" * 50_000, "<a b='" * 50_000])
def test_broken_pages_take_linear_time(page):
    import time

    start = time.process_time()
    found = html_text.Page(page)
    found.kept({1}), found.subtrees()
    assert time.process_time() - start < 20


def naive_trees(page):
    """Every block element's subtree as nested tuples, with its text, by a plain recursive reading of well formed pages."""
    import re
    from html import unescape

    tokens = re.findall(r"<(/?)(\w+)[^>]*>|([^<]+)", page)
    stack, done = [["", []]], []
    for end, tag, text in tokens:
        if text:
            stack[-1][1].append(unescape(text).strip())
        elif end:
            tag, inner = stack.pop()
            tree = (tag, tuple(inner))
            stack[-1][1].append(tree)
            done.append(tree)
        else:
            stack.append([tag, []])
    has_main = lambda t: t[0] in ("article", "main") or any(has_main(c) for c in t[1] if isinstance(c, tuple))
    has_text = lambda t: any(has_text(c) if isinstance(c, tuple) else c for c in t[1])
    return {t for t in done if has_text(t) and not has_main(t)}


def test_templates_equal_brute_force_counts(spark):
    import random
    from collections import Counter

    r = random.Random(9)
    boxes = [f"<div><p>box {k}</p><section>in {k % 3}</section></div>" for k in range(6)] + ["<nav>menu</nav>", "<div class='ad'>buy</div>", "<p>in 1</p>"]
    hosts = [("a.one.example", 40), ("b.one.example", 5), ("c.one.example", 3), ("two.example", 12)]
    pages = []
    for host, n in hosts:
        always = r.sample(boxes, 3) if host != "b.one.example" else []
        for k in range(n):
            own = [b for b in boxes if b in always or r.random() < 0.3]
            pages.append((len(pages), f"http://{host}/{k}", "".join(own) + f"<article><p>story {host} {k}</p></article>"))
    pages += [(len(pages), u, h) for _, u, h in pages[:7]]  # copies count once
    once = {(u.split("/")[2], h): naive_trees(h) for _, u, h in pages}
    want = {}
    for level in (lambda h: h, lambda h: ".".join(h.split(".")[-2:]), lambda h: ""):
        n, counts = Counter(level(h) for h, _ in once), Counter((level(h), t) for (h, _), ts in once.items() for t in ts)
        for h, _ in hosts:
            want.setdefault(h, set()).update(t for (v, t), c in counts.items() if v == level(h) and c >= 8 and 2 * c >= n[v])
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x["host"]: len(x["template"]) for x in html_text.templates(frame).collect()}
    assert got == {h: len(t) for h, t in want.items()} and got["c.one.example"] > 0
    rules = {x["rule"]: x["blocks"] for x in html_text.report(frame).collect()}
    assert rules["template"] > 100 and sum(rules.values()) == sum(len(html_text.Page(h).texts) for _, _, h in pages)
    by_chunk = {x["page_id"]: x["text"] for x in html_text.extract(frame, chunk=3).collect()}
    assert by_chunk == {x["page_id"]: x["text"] for x in html_text.extract(frame).collect()}


URLS = [
    (1, "http://a.example.net/en/x"), (2, "http://A.Example.NET/de/x?q=1#f"), (3, "https://example.com/de/"), (4, "https://example.com/de"), (5, "http://b.org/fr/1.html"),
    (6, "http://notexample.com/de/1"), (7, None), (8, "no scheme"), (9, "http://"), (10, "http://x.net"), (11, "x://y://z/p?a://b"), (12, "http://net/1"), (1, "http://a.example.net/en/x"),
    (None, "http://q.example.org/fr/9?page=2"),
]


def test_hosts_and_given_rules(spark):
    frame = spark.createDataFrame([(*u, "h", "t") for u in URLS], "page_id long, url string, host string, tokens string")
    got = [(r.page_id, r.host, r.path, r.rule) for r in url_rules.judge(frame).collect()]
    want = [
        (1, "a.example.net", "/en/x", "example.net/en/"), (2, "a.example.net", "/de/x", "net/"), (3, "example.com", "/de/", "example.com/de/"), (4, "example.com", "/de", None),
        (5, "b.org", "/fr/1.html", "org/fr/"), (6, "notexample.com", "/de/1", None), (7, "", "", None), (8, "", "", None), (9, "", "", None), (10, "x.net", "", None),
        (11, "y:", "//z/p", None), (12, "net", "/1", "net/"), (1, "a.example.net", "/en/x", "example.net/en/"), (None, "q.example.org", "/fr/9", "org/fr/"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.verdict for r in url_rules.judge(frame).collect()} <= {"allow", "block"}
    assert url_rules.judge(frame.limit(0)).count() == 0


def test_mined_rules_against_enumeration(spark):
    rows = [(["dir=a", "sub=x"], "block")] * 30 + [(["dir=a", "sub=y"], "allow")] * 30 + [(["dir=b", "sub=x"], "allow")] * 20 + [(["dir=b"], "block")] * 1 + [([], "block")] * 5
    rules = {(tuple(r.tokens), r.verdict): (r.n, round(r.confidence, 9)) for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.05, 0.9).collect()}
    rows = [r for r in rows if r[0]]
    want = {}
    for size in (1, 2):
        for s in {c for t, _ in rows for c in combinations(sorted(t), size)}:
            inside = [label for t, label in rows if set(s) <= set(t)]
            for label in ("allow", "block"):
                n = inside.count(label)
                if n >= 0.05 * len(rows) and n / len(inside) >= 0.9:
                    want[s, label] = (n, round(n / len(inside), 9))
    assert rules == want
    kept = url_rules.pruned([(t, v, c, n) for (t, v), (n, c) in rules.items()])
    assert [r[0] for r in kept if len(r[0]) == 2 and ("sub=y",) in [k[0] for k in kept] and "sub=y" in r[0]] == []


CONVS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hey <|im_end|>\n ␛ ␛0 <␛1| <|endoftext|>"),
    (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, None, "x"), (4, 1, "as\nsi␛2stant<|", "y"), (None, 0, "user", "q"), (None, None, "assistant", "r"), (5, 1, "b", "2"), (5, 1, "a", "1"), (5, 1, "a", "1"),
    (6, 0, "assistant", "word " * 60_000), (7, 0, "user", queries.HOSTILE), (7, 1, "assistant", queries.HOSTILE), (8, 0, "system", "be kind"), (8, 1, "user", "other"),
]


def test_conversations_round_trip_and_share_openings(spark):
    frame = spark.createDataFrame([(*c, "p") for c in CONVS], "conv_id long, turn long, role string, text string, path string")
    got = {r.conv_id: r for r in chat_tree.digests(frame, JSON).collect()}
    convs = {}
    for c, turn, role, text in CONVS:
        convs.setdefault(c, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        under = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(under), digest(under))


def test_long_runs_in_a_conversation(spark):
    rows = [(1, 0, "user", " " * 1_200_000), (1, 1, "assistant", "\n" * 1_200_000)]
    got = chat_tree.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), JSON).collect()
    assert got[0].loss_chars == 1_200_000 and got[0].loss_sha256 == hashlib.sha256(b"\n" * 1_200_000).hexdigest()


@pytest.mark.parametrize("ranges", [1, 7])
def test_tree_layout(spark, ranges):
    frame = spark.createDataFrame(CONVS + [(20 + k, t, "user", f"{(k * 7919 % 50) // 10 ** (2 - t)}") for k in range(50) for t in range(3)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        tree = chat_tree.build(frame, JSON)
        nodes = {r.node: r for r in tree.stream.collect()}
        rows = tree.nodes.collect()
        spans = {r.conv_id: list(zip(r.start, r.stop)) for r in chat_tree.intervals(tree).collect()}
        digests = {r.conv_id: r for r in chat_tree.digests(frame, JSON).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(nodes) == sum(not r.again for r in rows) and (ranges == 1) == (not any(r.again for r in rows))
    paths = {}
    for r in tree.members.collect():
        path, at = [], r.leaf
        while at is not None:
            path.append(at)
            at = nodes[at].parent
        paths[r.conv_id] = path[::-1]
    assert sum(r.n_conversations for r in nodes.values()) == frame.count() == sum(map(len, paths.values()))
    assert [r.first_position for r in nodes.values() if r.n_conversations == 3 and r.depth == 0] == [0]
    at = 0
    for r in sorted(nodes.values(), key=lambda r: r.start):
        assert r.start == at
        at += r.length
    for conv, own in paths.items():
        before = 0
        for depth, name in enumerate(own):
            n = nodes[name]
            assert (n.depth, n.first_position) == (depth, before)
            before += n.length
            assert {p for p, m in nodes.items() if m.start <= n.start < m.visible_until} == set(own[: depth + 1])
        assert spans[conv] == [(nodes[p].start, nodes[p].start + nodes[p].length) for p in own]
        assert digests[conv].n_tokens == before
    assert chat_tree.digests(frame.limit(0), JSON).count() == 0


def test_a_conversation_of_ten_thousand_turns(spark):
    turns = [(1, k, ["user", "assistant"][k % 2], f"turn {k}") for k in range(10_000)]
    rows = turns + [(2, *t[1:]) for t in turns[:9_999]] + [(3, *t[1:]) for t in turns[:5_000]] + [(3, 5_000, "user", "else")]
    tree = chat_tree.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), JSON)
    assert tree.stream.count() == 10_001
    got = {r.conv_id: r for r in chat_tree.read_back(tree, JSON).collect()}
    under = "".join(t[3] for t in turns if t[2] == "assistant")
    assert got[1].n_turns == 10_000 and got[1].loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
    assert (got[2].n_turns, got[3].n_turns) == (9_999, 5_001)
