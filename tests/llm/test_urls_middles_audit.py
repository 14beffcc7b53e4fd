"""Link-graph URL filter, fill-in-the-middle forms and filter audit against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from satspan.llm import fill_in_middle, filter_audit, link_graph

from .helpers import WORD, documents, empty, prose, texts

# --- link graph ---------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, trust string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(rows)], PAGES)


def link(*targets):
    return "<p>text</p>" + "".join(f"<a href='{t}'>x</a>" for t in targets)


def by_rules(host, path):
    best = None
    for r in link_graph.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.host + r.path) > len(best.host + best.path):
                best = r
    return best


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/x": ("a.example.net", "/x", "net/", "block"),
        "https://example.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://myexample.net/en/": ("myexample.net", "/en/", "net/", "block"),
        "https://w.example.com/de/": ("w.example.com", "/de/", "example.com/de/", "block"),
        "https://w.example.com/DE/": ("w.example.com", "/DE/", None, "allow"),
        "https://x.org/fr/?a": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://x.org/fr": ("x.org", "/fr", None, "allow"),
        "//example.net/": ("", "", None, "allow"),
        "net://": ("", "", None, "allow"),
        "x://net": ("net", "", None, "allow"),
        "x://net?y/": ("net", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "https://h.net:80/x": ("h.net:80", "/x", None, "allow"),
        "https://ÉX.NET/\n/": ("Éx.net", "/\n/", "net/", "block"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = link_graph.judge(pages(spark, [(u, None) for u in cases])).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    for i, (u, want) in enumerate(cases.items()):
        if want[0] == "h.net:80":
            continue  # the host keeps its port, which no rule has
        assert got[i] == want, u
    assert got[12][0] == "h.net:80" and got[12][2] is None
    assert len(rows) == len(cases)


def spread(edges, start, rounds=400, follow=link_graph.FOLLOW):
    """Personalised PageRank of one kind in plain floats; in seeds."""
    out = defaultdict(float)
    for (a, _), n in edges.items():
        out[a] += n
    total = sum(start.values())
    home = {h: w / total for h, w in start.items()} if total else {}
    mass = dict(home)
    for _ in range(rounds):
        came = defaultdict(float)
        for (a, b), n in edges.items():
            came[b] += mass.get(a, 0) * follow * n / out[a]
        rest = 1 - sum(came.values())
        mass = {h: came.get(h, 0) + rest * home.get(h, 0) for h in set(came) | set(home)}
    return {h: m * total for h, m in mass.items()}


def test_propagation_matches_brute_force(spark):
    r = random.Random(3)
    hosts = [f"h{i}.test" for i in range(30)]
    edges = Counter()
    for _ in range(120):
        a, b = r.sample(hosts, 2)
        edges[(a, b)] += 1
    for h in hosts[1:]:
        edges[(h, hosts[0])] += 5  # a hub
    trusted = {h: 1.0 for h in hosts[:4]}
    blocked = {h: 0.75 for h in hosts[25:]}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n_links long")
    start = spark.createDataFrame([(h, trusted.get(h, 0.0), blocked.get(h, 0.0)) for h in hosts], "host string, trusted double, blocked double")
    got = {x["host"]: x for x in link_graph.propagate(links, start, rounds=60).collect()}
    want_t = spread(edges, trusted)
    want_d = spread(Counter({(b, a): n for (a, b), n in edges.items()}), blocked)
    for h in hosts:
        assert got[h]["trust"] == pytest.approx(want_t.get(h, 0), abs=1e-4)
        assert got[h]["distrust"] == pytest.approx(want_d.get(h, 0), abs=1e-4)


def test_links_condemn_hosts_and_trust_saves_them(spark):
    bad, good = [f"http://bad{i}.net/" for i in range(3)], [f"http://good{i}.org/fr/" for i in range(3)]
    rows = [(u, link()) for u in bad] + [(u, link("http://saved.test/", "/own")) for u in good]
    rows += [("http://farm.test/1", link(*bad, "relative.html", "#x"))] * 2
    rows += [("http://saved.test/", link(*bad))]
    rows += [("http://clean.test/", '<img src="//cdn.test/i.png"><a HREF = http://Other.TEST:8080/x?y>x</a>')]
    rows += [("http://mixed.example.com/de/1", None), ("http://mixed.example.com/en/1", None), ("http://mixed.example.com/en/2", None)]
    table = pages(spark, rows)
    found = {tuple(x) for x in link_graph.edges(table).collect()}
    assert ("farm.test", "bad0.net", 2) in found and ("good0.org", "saved.test", 1) in found
    assert ("clean.test", "cdn.test", 1) in found and ("clean.test", "other.test:8080", 1) in found
    assert not any(a == b for a, b, _ in found) and len(found) == 3 + 3 + 3 + 2
    got = {r["page_id"]: r for r in link_graph.judge(table).collect()}
    at = {rows[i][0]: r for i, r in got.items()}
    assert at["http://farm.test/1"]["verdict"] == "block" and at["http://farm.test/1"]["rule"] is None
    assert at["http://saved.test/"]["verdict"] == "allow" and at["http://saved.test/"]["trust"] > 0.25
    assert at["http://clean.test/"]["verdict"] == "allow"
    # one page in three blocked by its path does not condemn the host
    assert at["http://mixed.example.com/de/1"]["verdict"] == "block" and at["http://mixed.example.com/en/1"]["verdict"] == "allow"
    again = {r["page_id"]: r for r in link_graph.judge(table.repartition(7)).collect()}
    assert again == got


def test_hot_host_and_empty_tables(spark):
    hub = [("http://hub.test/%d" % i, link(*[f"http://t{i}.test/"] * 3)) for i in range(300)]
    rows = link_graph.judge(pages(spark, hub + [("http://one.net/", link("http://hub.test/"))])).collect()
    assert len(rows) == 301 and {r["verdict"] for r in rows if r["host"] == "hub.test"} == {"allow"}
    none = link_graph.judge(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and none.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


# --- fill in the middle -------------------------------------------------------


def draws(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def whole_form(doc_id, text):
    text = text or ""
    h, n = draws(doc_id), len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, m, s = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", len(a), len(m), f"<S>{s}<P>{a}<M>{m}"
    return n, "psm", len(a), len(m), f"<P>{a}<S>{s}<M>{m}"


HARD = [
    "\U0001f600a\U0001f600\U0001f601b\n\r\n\u2028\x85 \x00", "<S", "<P><", "a<S>b", "<<P<S<M", "e\u0301\u200d" * 40, "\U00010348" * 30, "\n\n\n", " ", "x",
    prose(9, 150_000),
]


def test_forms_match_brute_force(spark):
    from satspan.llm.queries import op12_lookaround_splitting

    rows = [(i, t, "n", "form") for i, t in enumerate(texts() + HARD * 6)] + [(None, "null id", "", ""), (None, None, "", "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n string, form string")
    made = fill_in_middle.transform(table).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    forms = Counter()
    for r in made.collect():
        n, form, a, m, output = whole_form(r["doc_id"], r["text"])
        forms[form] += 1
        assert (r["n"], r["form"], r["output"]) == (n, form, output)
        assert (None if r["prefix"] is None else len(r["prefix"]), None if r["middle"] is None else len(r["middle"])) == (a, m)
        assert r["back"] == r["text"]
    assert sum(forms.values()) == len(rows) and min(forms.values()) > 3
    assert fill_in_middle.transform(empty(spark)).count() == 0
    assert op12_lookaround_splitting.__name__ == "op12_lookaround_splitting"


def units(text, grammar):
    """The units by a plain scan over neighbouring characters."""
    import re

    pairs = [(re.compile(a, re.S | re.A), re.compile(b, re.S | re.A)) for a, b in fill_in_middle.GRAMMARS[grammar]]
    found, last = [], 0
    for i in range(1, len(text)):
        if any(a.fullmatch(text[i - 1]) and b.fullmatch(text[i]) for a, b in pairs):
            found.append(text[last:i])
            last = i
    return found + [text[last:]] if text else []


@pytest.mark.parametrize("grammar", list(fill_in_middle.GRAMMARS))
def test_every_grammar_keeps_all_characters(spark, grammar):
    given = [t or "" for t in texts()] + HARD[:-1] + ["getUserName42 = x_1.y();\n  return HTTPError2  ", "One. Two!  Three?\nFour", "é1É2\U0001f600b2"]
    table = spark.createDataFrame([(t,) for t in given], "text string")
    for t, u in table.select("text", fill_in_middle.pieces(F.col("text"), grammar)).collect():
        assert u == units(t, grammar) and "".join(u) == t


# --- filter audit -------------------------------------------------------------


def mask_of(text):
    words = WORD.findall(text)
    return "".join(
        x for x, fails in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)), ("D", any(c in "#$%&*|" for c in text)),
        ) if fails
    )


def by_hand(rows, said):
    """rows (doc_id, text, lang); said doc_id: (good, toxic). Every order document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = [mask_of(t or "") + ("E" if i is not None and i > least[t or ""] else "") for i, t, _ in rows]
    found = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {lang or "" for _, _, lang in rows}:
            for k in range(1, 6):
                found[part, order, k] = Counter()
        for (i, _, lang), f in zip(rows, fails):
            good, toxic = said.get(i, (0, 0)) if i is not None else (0, 0)
            gone = False
            for k, letter in enumerate(order, 1):
                x = found[lang or "", order, k]
                if letter in f:
                    x["redundant" if gone else "removed"] += 1
                    x["unique_fails"] += f == letter
                    if not gone:
                        x["good_lost"] += good
                        x["toxic_lost"] += toxic
                        x["by", letter] += 1
                    gone = True
                x["kept"] += not gone
    for part in {lang or "" for _, _, lang in rows}:
        sums = Counter()
        for (p, order, k), x in found.items():
            if p == part:
                sums[order[k - 1]] += x["removed"]
        for (p, order, k), x in found.items():
            if p == part:
                x["shapley"] = sums[order[k - 1]]
    return found


def test_audit_matches_brute_force(spark):
    r = random.Random(5)
    pool = [t for t in texts()] + ["SHOUTING " * 5, prose(7, 130) + " #", " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}" for i in range(120))]
    rows = [(r.choice([None, *range(60)]), r.choice(pool), r.choice([None, "", "en", "de"])) for _ in range(200)]
    rows += [(1000 + i, pool[-2], "en") for i in range(400)]  # a large group of copies
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    said = defaultdict(lambda: (0, 0))
    for i, q, t in labels:
        said[i] = (max(said[i][0], int(q == 1)), max(said[i][1], int(t == 1)))
    docs = spark.createDataFrame([(*x, "m", "w", 1) for x in rows], "doc_id long, text string, lang string, mask string, words string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    want = by_hand(rows, said)
    assert len(got) == len(want) == 3 * 600
    for x in got:
        w = want[x["part"], x["filter_order"], x["step"]]
        assert [x[c] for c in filter_audit.COUNTS] == [w[c] for c in filter_audit.COUNTS]
    assert filter_audit.audit(empty(spark), marks).count() == 0
    assert filter_audit.audit(docs, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_incidence_is_32_by_600():
    found = filter_audit.incidence()
    assert {m.shape for m in found.values()} == {(32, 600)}
    assert (found["kept"][0] == 1).all() and found["kept"][1:, 4::5].sum() == 0
    # a mask of k filters is removed by each of them in 120 / k orders
    assert set(found["shapley"][31]) == {24} and set(found["shapley"][3]) == {0, 60}
