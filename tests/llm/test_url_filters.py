import html
import html.parser
import random
from urllib.parse import urljoin, urlsplit

import pytest

from terradrift.llm import url_filters as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judged(spark, rows, rules=RULES, redirects=None):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, rule string")
    return {r["page_id"]: r for r in U.judge_urls(pages, rules, redirects).collect()}


@pytest.mark.parametrize("as_table", [False, True])
def test_longest_rule_and_odd_urls(spark, as_table):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if as_table else RULES
    got = judged(spark, [(1, "http://EXAMPLE.com/en/a?q#f", ""), (2, "https://www.example.com/en/", None), (3, "http://a.b.net/es/x", ""), (4, "http://notnet/es/", ""), (5, None, None), (6, "no scheme.com/en/", ""), (7, "http://x.com", ""), (8, "http://x.com?q=/", ""), (9, "", ""), (10, "http://example.com/EN/", "")], rules)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [
        ("example.com", "/en/a", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.b.net", "/es/x", "net/es/", "block"),
        ("notnet", "/es/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.com", "", None, "allow"),
        ("x.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("example.com", "/EN/", "com/", "allow"),
    ]


def test_blocks_reach_aliases_unless_allowed(spark):
    canonical = '<html><head><LINK href="http://z.net/es/1" rel=canonical></head>'
    refresh = "<meta http-equiv='Refresh' content='3; URL=//z.net/es/1'>"
    chain = '<link rel="canonical" href="/start">'
    got = judged(
        spark,
        [
            (1, "http://mirror.org/a", canonical),
            (2, "http://other.org/b", refresh),
            (3, "http://other.org/c", '<link rel="canonical" href="b">'),
            (4, "http://ok.com/d", canonical),
            (5, "http://free.org/e", chain),
            (6, "http://free.org/start", "<link rel=stylesheet href=x.css>"),
            (7, "http://free.org/x", '<link rel="canonical" href="mailto:a@b.net">'),
        ],
    )
    # the explicit allow holds for its own url alone
    assert {k: v["verdict"] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    got = judged(spark, [(1, "http://mirror.org/a", canonical), (2, "http://other.org/b", refresh), (3, "http://other.org/c", '<link rel="canonical" href="b">'), (5, "http://free.org/e", chain)])
    assert {k: (v["verdict"], v["alias_of_blocked"]) for k, v in got.items()} == {1: ("block", True), 2: ("block", True), 3: ("block", True), 5: ("allow", False)}


def test_redirect_chain_and_hub(spark):
    chain = [(f"http://h{i}.org/", f"http://h{i + 1}.org/") for i in range(40)] + [(f"http://s{i}.org/", "http://h40.org/") for i in range(60)] + [("http://h40.org/", "http://a.net/es/"), ("http://loop.org/", "http://loop.org/"), ("http://q.org/", None)]
    redirects = spark.createDataFrame(chain, "src string, dst string")
    got = judged(spark, [(0, "http://h0.org/", ""), (1, "https://s59.org/#x", ""), (2, "http://loop.org/", ""), (3, "http://q.org/", "")], redirects=redirects)
    assert [got[i]["verdict"] for i in range(4)] == ["block", "block", "allow", "allow"]


def test_empty(spark):
    assert judged(spark, []) == {}


class Links(html.parser.HTMLParser):
    """Targets of canonical and refresh tags, and the base, by the standard library's parser."""

    def __init__(self, text):
        super().__init__()
        self.base, self.targets = None, []
        self.feed(text or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"]
        if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.targets.append((a.get("href") or "").strip())
        if tag == "meta" and (a.get("http-equiv") or "").strip().lower() == "refresh" and "url=" in (a.get("content") or "").lower():
            value = a["content"][a["content"].lower().index("url=") + 4 :]
            self.targets.append(value.strip().strip("'\""))

    handle_startendtag = handle_starttag


def node(url):
    if not url or "://" not in url:
        return None
    parts = urlsplit(url)
    path = urlsplit(urljoin("http://h" + (parts.path or "/"), "")).path or "/"
    path = urlsplit(urljoin("http://h/", path)).path
    return (parts.netloc.lower(), path, parts.query) if parts.netloc else None


def brute(rows, rules):
    """Verdicts by components of links, one page after another."""
    def rule(n):
        fits = [(len(h + p), v) for h, p, v in rules if n and (n[0] == h or n[0].endswith("." + h)) and n[1].startswith(p)]
        return max(fits)[1] if fits else None

    near, own = {}, {i: node(u) for i, u, _ in rows}
    for _, url, text in rows:
        links = Links(text)
        base = urljoin(url, links.base) if links.base else url
        for t in links.targets:
            a, b = node(url), node(urljoin(base, t)) if t and not t.startswith("mailto:") else None
            if a and b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    out = {}
    for i, n in own.items():
        seen, todo = {n}, [n]
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        alias = rule(n) is None and len(seen) > 1 and any(rule(x) == "block" for x in seen)
        out[i] = (rule(n) or ("block" if alias else "allow"), alias)
    return out


def test_alias_step_against_brute_force(spark):
    """Pages with links of many notations: dot segments, bases, comments, references, several tags, loops and hubs."""
    rng = random.Random(13)
    hosts = ["a.org", "B.org", "x.example.com", "m.net", "free.de", "www.example.com"]
    paths = ["/", "/p/1", "/p/2", "/q/r/3", "/es/1", "/en/1", "/p/1?x=1&y=2", "/p/1?x=2"]

    def page(k):
        url = f"http://{rng.choice(hosts)}{rng.choice(paths)}" + ("" if k % 3 else f"?page={k}")
        out = []
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            host, path = rng.choice(hosts), rng.choice(paths)
            href = rng.choice([f"http://{host}{path}", f"//{host}{path}", path, "../p/2", "./1", "r/../../p/1", "/./es/../es/1", "?x=1&y=2", "#top", "3", "mailto:a@b.net", "", "/q/.."])
            written = rng.choice([html.escape(href), href.replace("&", "&#38;"), href.replace("/", "&#x2F;"), html.escape(href)])
            out.append(rng.choice([
                f'<link rel="canonical" href="{written}">',
                f"<LINK href='{written}' REL=canonical />",
                f'<link data-href="/wrong" rel="nofollow canonical" href=" {written} ">',
                f'<meta http-equiv="refresh" content="0; url={written}">',
                f"<META content=\"5;URL='{written}'\" http-equiv=Refresh>",
                f'<!-- <link rel="canonical" href="http://m.net/es/1"> -->',
                f'<link rel="stylesheet" href="{written}">',
                "<meta http-equiv='refresh' content='30'>",
            ]))
        if rng.random() < 0.2:
            out.insert(0, f'<base href="{rng.choice(["/q/r/", "http://free.de/p/", "sub/"])}">')
        return k, url, "<html><head>" + "\n".join(out) + "</head></html>"

    rules = [("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/", "block"), ("free.de", "/q/", "allow")]
    decided = 0
    for _ in range(4):
        rows = [page(k) for k in range(45)]
        got = {k: (v["verdict"], v["alias_of_blocked"]) for k, v in judged(spark, rows, rules).items()}
        assert got == brute(rows, rules)
        decided += sum(a for _, a in got.values())
    assert decided > 10
