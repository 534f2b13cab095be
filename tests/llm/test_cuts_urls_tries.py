"""Fill-in-the-middle, URL filters and prefix tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from corpusmill.llm import fim
from corpusmill.llm.fim import EliasFano, fill_in_middle, line_ends, restored
from corpusmill.llm.queries import URL_RULES
from corpusmill.llm.sql import ORACLE_SQL
from corpusmill.llm.trie import prefix_trie
from corpusmill.llm.urls import judge_urls


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano_selects_every_value(seed):
    r = np.random.default_rng(seed)
    universe = int(r.choice([5, 64, 1000, 10**6, 10**12]))
    values = np.unique(r.integers(1, universe + 1, int(r.integers(1, 400))))
    known = EliasFano.read(bytes(EliasFano.of(values, universe)))
    assert [known.select(i) for i in range(len(values))] == values.tolist()
    assert EliasFano.read(bytes(EliasFano.of(np.zeros(0, dtype=np.int64), 0))).count == 0


def test_line_ends_over_blocks(monkeypatch):
    monkeypatch.setattr(fim, "SCAN_CHARS", 7)
    for text in ("", "\n", "a\n\nb", "日本\n語 \U0001f600\n", "no end", "x\r\ny\n" * 20):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert line_ends(text).tolist() == np.cumsum([len(x) for x in lines]).astype(int).tolist()


def fim_by_hand(doc_id, text, rate=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h4 % 100 < 50
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_odd_texts(make_docs, mixed_rows):
    rows = mixed_rows + [(200 + i, t) for i, t in enumerate(["<P>", "a <M>\nb", "\n", "\n\n\n", "a<\nS>b\n<", "P>x\n<S", "é\n日本\n\U0001f600", "x\r\ny\rz\n"] * 5)]
    rows += [(500 + i, "one\ntwo\nthree\nfour\n") for i in range(60)] + [(900, "long line\n" * 200_000)]
    for digest_bytes in (32, 1):  # one byte: nearly all digests collide
        made = fill_in_middle(make_docs(rows), digest_bytes=digest_bytes)
        got = made.select("*", restored(made.output, made.form).alias("back")).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((fim_by_hand(*r) for r in rows), key=repr)
        texts = defaultdict(set)
        for i, t in rows:
            texts[i].add(t or "")
        assert all(r.back in texts[r.doc_id] for r in got)


def test_fill_in_middle_of_a_hot_text_in_small_chunks(make_docs, monkeypatch):
    """A third of all rows hold one text; its ids are joined in chunks of 16 over several tasks, and some documents stay plain."""
    monkeypatch.setattr(fim, "CHUNK_ROWS", 16)
    rows = [(i, "hot\ntext\n\nof lines" if i % 3 == 0 else f"text\n{i // 2}") for i in range(900)]
    got = fill_in_middle(make_docs(rows).repartition(5), rate=80).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((fim_by_hand(*r, rate=80) for r in rows), key=repr)
    assert fill_in_middle(make_docs(rows).limit(0)).count() == 0


RULES = [("allow", "org", "/"), ("block", "bad.org", "/x/"), ("block", "evil.com", "/"), ("allow", "evil.com", "/good")]


def judged_by_hand(pages, rules, links):
    """links: (address, address) pairs of pages and targets."""

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0], host.lower() + re.match(r"[^#]*", rest[len(host) :])[0]

    def rule(url):
        host, path, _ = split(url)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: (len(r[1] + r[2]), r[0] == "allow"), default=None)

    near, verdict = defaultdict(set), {}
    for a, b in links:
        x, y = split(a)[2], split(b)[2]
        if x and y:
            near[x].add(y)
            near[y].add(x)
            verdict |= {x: (rule(a) or ("",))[0], y: (rule(b) or ("",))[0]}
    bad, todo = set(), [x for x, v in verdict.items() if v == "block"]
    while todo:
        x = todo.pop()
        if x not in bad:
            bad.add(x)
            todo += near[x]
    out = []
    for page_id, url in pages:
        host, path, address = split(url)
        r = rule(url)
        alias = r is None and address in bad and address != ""
        out.append((page_id, host, path, r and r[1] + r[2], r[0] if r else "block" if alias else "allow", alias))
    return sorted(out, key=repr)


def test_url_filter_over_redirects_and_canonical_links(spark):
    canonical = '<html><head><link rel="canonical" href="{}"></head>'.format
    rows = [
        (1, "http://a.net/1", canonical("http://b.net/2?q=1&amp;r=2")),
        (2, "https://B.net/2?q=1&r=2#top", '<meta http-equiv="refresh" content="0; url=http://evil.com/z">'),
        (3, "http://www.evil.com/good/1", canonical("http://a.net/1")),
        (4, "http://c.net/dir/page?x", "<link href='other' rel=canonical>"),
        (5, "http://c.net/dir/other", "<LINK REL='alternate canonical' HREF='//d.net/q'>"),
        (6, "http://d.net/q", canonical("/x/y")),
        (7, "http://bad.org/x/1", canonical("http://d.net/x/y")),
        (8, "http://e.net/", '<!-- <link rel="canonical" href="http://evil.com/"> --><script>var a=\'<link rel="canonical" href="http://evil.com/">\';</script><link rel="stylesheet" href="http://evil.com/c">'),
        (9, "http://notbad.org/x/1", None),
        (10, None, canonical("http://evil.com/")),
        (11, "no address", canonical("http://evil.com/")),
        (12, "", ""),
        (13, "http://f.net", canonical("?page=2") + "<link rel=canonical href=mailto:x@evil.com><link rel=canonical href=''><link rel=canonical href='#a'>"),
        (14, "http://f.net?page=2", canonical("http://evil.com/")),
        (15, "http://evil.com", None),
        (1, "http://a.net/1", canonical("http://b.net/2?q=1&amp;r=2")),
        (None, "ftp://sub.evil.com/goods?u=http://x", "<link " * 2000),
        (16, "HTTP://EVIL.COM/GOOD", "<" * 50_000),
        (17, "http://evil.com\n/a", None),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, URL string, node int")
    links = [("http://a.net/1", "http://b.net/2?q=1&r=2"), ("http://b.net/2?q=1&r=2", "http://evil.com/z"), ("http://evil.com/good/1", "http://a.net/1")]
    links += [("http://c.net/dir/page?x", "http://c.net/dir/other"), ("http://c.net/dir/other", "http://d.net/q"), ("http://d.net/q", "http://d.net/x/y"), ("http://bad.org/x/1", "http://d.net/x/y")]
    links += [("http://f.net", "http://f.net?page=2"), ("http://f.net?page=2", "http://evil.com/")]
    got = judge_urls(pages, RULES).collect()
    want = judged_by_hand([r[:2] for r in rows], RULES, links)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.page_id for r in got if r.alias} == {1, 2, 4, 5, 6, 13, 14}
    assert judge_urls(pages.limit(0), RULES).count() == 0
    found = {r.page_id: r.verdict for r in judge_urls(pages, [], spark.createDataFrame([("http://e.net/", "http://g.net/")], "url string, target string")).collect()}
    assert set(found.values()) == {"allow"}


def test_url_filter_sql_on_linked_pages(spark):
    """The contract's rules over random pages that redirect to each other, one of them a hub; SQL and operator agree, and so does a walk by hand."""
    r = random.Random(3)
    urls = [f"http{'s' * (i % 2)}://{r.choice(['a', 'm.b', 'c'])}.{r.choice(['example.com', 'example.org', 'net'])}/{r.choice(['fr', 'de', 'es', 'en'])}/{r.choice(['1', '2'])}{i}{r.choice(['', '?p=1', '#t'])}" for i in range(300)]
    goals = [urls[7] if i % 3 == 0 else r.choice(urls) if i % 5 < 2 else None for i in range(300)]
    rows = [(i, u, g and (f'<link rel="canonical" href="{g}">' if i % 2 else f"<meta content='3;URL={g}' http-equiv=refresh>")) for i, (u, g) in enumerate(zip(urls, goals, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(x)[:5] for x in judge_urls(pages, URL_RULES).collect())
    db = duckdb.connect()
    db.sql("create table pages (page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", rows)
    assert got == sorted(db.sql(ORACLE_SQL["op12_url_filter"]).fetchall())
    assert got == sorted(x[:5] for x in judged_by_hand([x[:2] for x in rows], URL_RULES, [(u, g) for u, g in zip(urls, goals, strict=True) if g]))
    assert {x[4] for x in got if x[3] is None} == {"allow", "block"}


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            sig = hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, sig, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100 * (1 if c > 0 else -1)
        full = tuple(own.get(c - rest, [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            nodes[full[:d]].append((c, len(full) == d))
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
    low = {k: min(c for c, _ in v) for k, v in nodes.items()}
    ends = {k: hashlib.sha256(",".join(str(c) for c, e in sorted(v) if e).encode()).hexdigest() for k, v in nodes.items()}
    return sorted((low[k], len(k), low[k[:-1]] if k else -1, len(v), len(kids[k]), leaves[k], saved[k], ends[k]) for k, v in nodes.items())


def trie_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string, Text string, depth int"


@pytest.mark.parametrize("kind", ["shared", "equal", "single", "turnless"])
def test_prefix_trie_is_brute_force(spark, kind):
    r = random.Random(kind)
    rows = []
    if kind == "shared":
        for c in [*range(0, 60), *range(300, 330), *range(-40, 0, 3), 100, 777]:
            rows += [(c, t, r.choice(["user", None]), r.choice(["yes", "no", "é\n", None])) for t in range(r.randint(1, 9))]
        rows += [(5, None, "user", "first"), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (None, 0, "user", "lost"), (6, 4, None, None)]
        rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(12)]  # equal ones beside the others
    elif kind == "equal":
        rows = [(c, t, "a", f"w{t}") for c in range(50) for t in range(9)]
    elif kind == "single":
        rows = [(12, t, "a", "b" * t) for t in range(40)]
    else:
        rows = [(c, 0, "a", "b") for c in range(101, 140)]
    table = spark.createDataFrame([(*x, "z", 1) for x in rows], CONVERSATIONS).repartition(3)
    assert trie_of(prefix_trie(table)) == trie_by_hand(rows)


def test_prefix_trie_of_one_long_conversation_and_an_empty_table(spark):
    """A third of all turns are one conversation's."""
    rows = [(7, t, "a", f"{t}") for t in range(1500)] + [(1000 + c, t, "u", f"{c % 7} {t}") for c in range(600) for t in range(5)]
    table = spark.createDataFrame([(*x, "z", 1) for x in rows], CONVERSATIONS).repartition(5)
    assert trie_of(prefix_trie(table)) == trie_by_hand(rows)
    empty = prefix_trie(table.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
