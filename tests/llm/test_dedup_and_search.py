import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from satspan.llm import components, latent_decontamination, lcs, license_index, secret_crf, setsketch_dedup

from .helpers import LOWER, WORD, documents, empty, prose, texts


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def classes(rows):
    sets = {i: shingles(t) for i, t in enumerate(rows)}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def family(seed, n, words, edits):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_match_brute_force(spark):
    shared = prose(77, 60)
    rows = texts() + family(1, 40, 150, 3) + family(2, 30, 90, 6) + [shared + " " + prose(100 + i, 5 + i) for i in range(40)]
    want, sizes = classes(rows)
    found = setsketch_dedup.score(documents(spark, rows)).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    kept = setsketch_dedup.keep(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i in want if want[i] == i)
    assert setsketch_dedup.score(empty(spark)).count() == 0


def test_near_duplicates_of_repeated_and_string_ids(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = a.replace(a.split()[40], "changed", 1)
    rows = [("1", a), ("1", b), ("2", c), ("2", c), ("3", a), ("1", a.upper()), ("4", near), (None, a), (None, a), ("5", None), ("5", "  "), ("5", None), ("0", b + " more")]
    docs = spark.createDataFrame([(t, k, i) for i, (k, t) in enumerate(rows)], "text string, doc_id string, id int")
    want, sizes = classes([t for _, t in rows])
    sets = [shingles(t) for _, t in rows]
    named = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i]:
            named[want[i]] = min(k, named.get(want[i], k))
    found = setsketch_dedup.score(docs).collect()
    expect = sorted((k or "", sizes[i], named[want[i]] if k is not None and sets[i] else k or "") for i, (k, _) in enumerate(rows))
    assert sorted((r["doc_id"] or "", r["n_shingles"], r["component_id"] or "") for r in found) == expect
    kept = setsketch_dedup.keep(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r["doc_id"] or "" for r in got) == ["", "", "0", "1", "2", "5", "5", "5"]
    assert {t for _, t in rows if t is None or not t.strip()} <= {r["text"] for r in got}
    assert all(any(shingles(r["text"]) and want[i] == want[r["id"]] for r in got) for i, s in enumerate(sets) if s)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64)), np.unique(r.integers(0, 2**63, 100, dtype=np.uint64))
    both = np.union1d(a, b)
    x, y, z = setsketch_dedup.registers([a, b, both])
    assert (np.maximum(x, y) == z).mean() > 0.98  # truncation differs with the size
    j = setsketch_dedup.estimate(x[None], z[None], np.array([900.0]), np.array([1000.0]))[0]
    assert abs(j - 0.9) < 0.06


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + k] == 100 for k in range(50))


def test_lcs_matches_the_table_method():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = lcs.lcs_pairs(a, b)
        assert len(pairs) == table[-1][-1] == lcs.lcs_length(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_decontamination_finds_copies_and_paraphrases(spark):
    r = random.Random(5)
    items = [" ".join(f"q{r.randrange(4000)}" for _ in range(30 + i)) for i in range(12)]
    items[3] = None
    para = items[1].split()
    for k in (4, 11, 17):
        para[k] = "other"
    rows = [prose(i, 80) for i in range(30)]
    rows[2] = prose(2, 50) + " " + items[0] + " " + prose(9, 50)
    rows[5] = prose(5, 33) + " " + " ".join(para) + " " + prose(8, 20)
    rows[7] = items[2].upper() + "!!"
    rows[9] = " ".join(items[4].split()[:8]) + " " + prose(11, 40)
    rows[11], rows[12] = None, prose(13, 3000) + " " + items[5]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, rows)
    found = {r["doc_id"]: list(r["item_ids"]) for r in latent_decontamination.find(docs, bench).collect()}
    assert found == {2: [0], 5: [1], 7: [2], 12: [5]}
    kept = latent_decontamination.keep(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([0, *(i for i in range(30) if i not in found)])
    assert latent_decontamination.find(docs, bench.limit(0)).count() == 0
    assert latent_decontamination.find(empty(spark), bench).count() == 0


def test_decontamination_of_copies_frequent_words_and_small_tables(spark):
    r = random.Random(6)
    items = [" ".join(f"q{r.randrange(4000)}" for _ in range(34)) for _ in range(3)] + [prose(50, 40)]
    rows = [f"{prose(i, 60)} " + " ".join(f"r{r.randrange(10**6)}" for _ in range(40)) for i in range(36)]
    copied = prose(70, 40) + " " + items[0] + " " + prose(71, 40)
    want = {i: [0] for i in range(0, 36, 3)}
    for i in want:
        rows[i] = copied
    for i in range(1, 36, 3):  # a passage in a third of different texts
        rows[i] = " ".join(rows[i].split()[:70]) + " " + items[1] + " " + rows[i][-60:]
        want[i] = [1]
    rows[5] = rows[5] + " " + items[3] + " " + rows[8][-80:]  # an item of frequent words
    want[5] = [3]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def found(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {x["doc_id"]: list(x["item_ids"]) for x in latent_decontamination.find(docs, bench).collect()}

    assert found(rows) == want
    assert found([rows[2], prose(9, 40) + " " + items[2] + " " + prose(10, 30), rows[0]]) == {1: [2], 2: [0]}
    assert found([items[2]]) == {0: [2]}


def test_search_finds_what_brute_force_finds():
    """Every window of every text against every item, by subsequence alone."""
    m = latent_decontamination
    r = random.Random(8)
    items = [prose(300 + i, 8) + " " + " ".join(f"q{r.randrange(900)}" for _ in range(24 + i % 9)) + " " + prose(400 + i, 6) for i in range(25)]
    items[7] = "the the the of of lor " * 7
    rows = []
    for i in range(120):
        own = items[i % 25].split()
        for _ in range(r.randrange(0, len(own) // 2)):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice(([], ["new"], [own[k], "more"]))
        rows.append(prose(i, r.randrange(0, 90)) + " " + " ".join(own) + " " + prose(i + 500, r.randrange(0, 90)))
    words, first = m.words_of(pa.array(rows))
    item_words, item_first = m.words_of(pa.array(items))
    own = [item_words[a:b].tolist() for a, b in zip(item_first[:-1], item_first[1:])]
    want = set()
    starts, doc = m._segments(first, m.BLOCK)
    for at, d in zip(starts.tolist(), doc.tolist()):
        for k, item in enumerate(own):
            region = words[max(first[d], at - len(item)) : min(first[d + 1], at + m.PASSAGE + m.BLOCK + len(item))].tolist()
            if m.confirm(item, region):
                want.add((d, k))
    term = (words & m.U(m.TERMS - 1)).astype(np.int64)
    df = np.zeros(m.TERMS)
    for d in range(len(rows)):
        df[np.unique(term[first[d] : first[d + 1]])] += 1
    weight = np.maximum(np.log((len(rows) + 1) / (df + 1)), m.LEAST_IDF) ** m.POWER
    start = np.random.default_rng(1).standard_normal((m.TERMS, m.DIRECTIONS)).astype(np.float32)
    gram = np.zeros_like(start)
    m._gram_times(words, first, m.PASSAGE, weight, start, gram)
    m._gram_times(item_words, item_first, m.PIECE, weight, start, gram, m.BOOST)
    vectors, _ = np.linalg.qr(gram.astype(np.float64))
    place = np.full(m.TERMS, -1)
    place[np.argsort(-df, kind="stable")[: m.FREQUENT]] = np.arange(m.FREQUENT)
    basis = m.Basis(weight, (vectors * weight[:, None]).astype(np.float32), place, float((df * weight**2).sum() / df.sum()))
    got = {(d, k) for d, k, _ in m.search(words, first, basis, m.item_vectors(list(range(25)), pa.array(items), basis))}
    assert got <= want and len(want) > 60 and len(got) >= 0.9 * len(want)


def test_gram_in_blocks_equals_the_product(monkeypatch):
    m = latent_decontamination
    monkeypatch.setattr(m, "WORDS_AT_ONCE", 100)
    words, first = m.words_of(pa.array([prose(1, 333), "", prose(2, 20), None, prose(3, 70)]))
    r = np.random.default_rng(2)
    weight, block = r.random(m.TERMS), r.standard_normal((m.TERMS, 3)).astype(np.float32)
    out = np.zeros_like(block)
    m._gram_times(words, first, m.PASSAGE, weight, block, out)
    starts, _ = m._segments(first, m.PASSAGE)
    a = np.zeros((len(starts), m.TERMS))
    row = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    term = (words & m.U(m.TERMS - 1)).astype(np.int64)
    np.add.at(a, (row, term), weight[term] / np.sqrt(np.bincount(row, weight[term] ** 2))[row])
    assert np.allclose(out, a.T @ (a @ block), atol=1e-3)


def test_decontamination_of_rows_that_share_an_id(spark):
    r = random.Random(9)
    item = " ".join(f"q{r.randrange(4000)}" for _ in range(40))
    rows = [("a", prose(1, 60)), ("a", prose(2, 30) + " " + item), (None, item), (None, prose(3, 60)), ("b", prose(4, 50)), ("b", prose(4, 50)), ("c", None), ("d", "")]
    docs = spark.createDataFrame([(t, k, "x") for k, t in rows], "text string, doc_id string, item_ids string")
    bench = spark.createDataFrame([("i", item), ("i", prose(9, 40)), (None, rows[0][1])], "item_id string, text string")
    found = latent_decontamination.find(docs, bench).collect()
    assert sorted((x["doc_id"] or "", list(x["item_ids"])) for x in found) == [("", ["i"]), ("a", ["i"])]
    kept = latent_decontamination.keep(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or "", x["text"] or "") for x in kept.collect()) == sorted((k or "", t or "") for k, t in rows if item not in (t or ""))


def test_sample_is_bounded_by_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(latent_decontamination, "FIT_DOCS", 40)
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(prose(1, 30))).otherwise(F.concat_ws(" ", F.lit(prose(2, 20)), "id")).alias("text"))
    seen = {}
    monkeypatch.setattr(latent_decontamination, "randomised_svd", lambda sample, items, weight: seen.update(n=sample.count()) or np.zeros((latent_decontamination.TERMS, latent_decontamination.DIRECTIONS)))
    list(latent_decontamination.searches(docs, spark.createDataFrame([(0, prose(3, 40))], "item_id long, text string")))
    assert 10 < seen["n"] < 100


def test_license_places_match_brute_force(spark):
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    rows = texts() + [
        "Released under the MIT License.", "MIT\n license, MIT-License apache LICENSE", "mit the license", "general public license version 3",
        "Licensed under the Apache License, Version 2.0. " + prose(1, 300), license_index.TEMPLATES[1].text.upper(),
    ]
    found = {r["doc_id"]: r for r in license_index.scan(documents(spark, rows)).collect()}
    for i, t in enumerate(rows):
        words = word.findall((t or "").translate(LOWER))
        places = [(k, label) for p, label in license_index.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(texts())
    assert "mit-notice" in found[n]["labels"] and "apache-2.0-notice" in found[n + 4]["labels"] and "mit-text" in found[n + 5]["labels"]
    assert found[n + 2]["labels"] == "" and license_index.scan(empty(spark)).count() == 0


def test_license_templates_match_brute_force(spark):
    """Every template at every shift of every text."""
    m, r = license_index, random.Random(11)
    rows = [prose(i, 40) for i in range(10)]
    for i in range(110):
        own = r.choice(m.TEMPLATES).text.split()
        for _ in range(r.randrange(0, max(1, len(own) // 3))):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice(([], ["other"], [own[k], "and"]))
        rows.append(" ".join([prose(i, r.randrange(1, 30)), *own, r.choice(m.TEMPLATES).text if i % 5 == 0 else "", prose(i + 90, r.randrange(1, 30))]))
    rows.append(" ".join(["the software the license"] * 40))
    found = {x["doc_id"]: x for x in m.scan(documents(spark, rows)).collect()}
    some = 0
    for i, text in enumerate(rows):
        words, want = text.lower().split(), {}
        for t in m.TEMPLATES:
            own = t.text.split()
            for shift in range(-len(own), len(words)):
                score = m.in_place(own, words, shift) / len(own)
                stretch = " " + " ".join(words[max(0, shift - m.SLACK) : max(0, shift + len(own) + m.SLACK)]) + " "
                if score >= m.LEAST_SCORE and all(f" {k} " in stretch for k in t.keys):
                    want[t.label] = max(score, want.get(t.label, 0))
        some += len(want)
        assert set(found[i]["labels"].split(",")) - {"mit", "apache", "gpl", ""} == set(want)
        assert found[i]["score"] == pytest.approx(max(want.values(), default=0.0))
    assert some > 60


@pytest.fixture(scope="module")
def field(spark):
    return secret_crf.fit(documents(spark, texts() + [prose(i, 200) for i in range(60)]))


def spans_by_brute_force(text):
    """Base spans by the contract, and their digest."""
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), 0, m.end())] if len(m.group(2)) >= 8 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return found, joined


def test_secrets(spark, field):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = texts() + [
        f'token = "{"0f" * 20}" and {key}', "password: short", "é api_key='abcd1234efgh' tokEN:zzzzzzzzz", "AKIA12", "secret = token: abcdefghijk",
        "deploy with ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8" + " today", "SECRET=" + "x" * 60_000 + " " + prose(4, 9000), "apİkey: abcdefghij toKen=12345678",
    ]
    found = {r["doc_id"]: r for r in secret_crf.scan(documents(spark, rows), field).collect()}
    for i, t in enumerate(rows):
        spans, joined = spans_by_brute_force(t)
        assert [found[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in found[i]["spans"].split(",") if x and not x.startswith("crf")] == [x for x in joined.split(",") if x]
    n = len(texts())
    assert found[n + 5]["spans"] == "crf:12:52" and all(found[i]["spans"] == "" for i in range(n))
    assert secret_crf.scan(empty(spark), field).count() == 0
    named = secret_crf.scan(spark.createDataFrame([("a", rows[n], 1), ("a", None, 2), (None, rows[n + 3], 3)], "doc_id string, text string, spans int"), field)
    assert sorted((r["doc_id"] or "", r["n_hex"]) for r in named.collect()) == [("", 0), ("a", 0), ("a", 1)]


def test_field_on_held_out_lines(field):
    """Lines of another seed, and formats that the training has not seen."""
    found = wanted = right = wrong = 0
    lines = list(secret_crf._made_up(3000, seed=99))
    r = random.Random(4)
    some = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    lines += [(f"use {p}{some(k)} here", [(4, 4 + len(p) + k)]) for p, k in (("AIza", 35), ("SG.", 40), ("npm_", 36), ("", 44)) for _ in range(50)]
    for line, spans in lines:
        data = np.frombuffer(line.encode(), np.uint8)
        got = secret_crf.field_spans(field, data, np.array([0, len(data)])).get(0, [])
        wanted += len(spans)
        found += len(got)
        right += sum(any(a < y and b > x and min(b, y) - max(a, x) >= 0.8 * (y - x) for a, b in got) for x, y in spans)
        wrong += sum(not any(a < y and b > x for x, y in spans) for a, b in got)
    assert right >= 0.9 * wanted and wrong <= 0.05 * found
    data, at = secret_crf.text_bytes(pa.array([prose(i, 300) for i in range(200, 230)]))
    assert secret_crf.field_spans(field, data, at) == {}


def test_decoding_equals_the_full_chain(field):
    lines = [x for x, _ in secret_crf._made_up(60, seed=5)] + ["é key=" + "Zz9Q" * 9 + " " + "9fQ2kLm0" * 4 + "\n\n" + prose(1, 30), "", "a"]
    data, at = secret_crf.text_bytes(pa.array([" ".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]))
    t = secret_crf.tokens_of(data, at)
    got = set(field.decode(t))
    s = field.scores(t.features, t.begins, t.goes_on)
    want = set()
    for d in range(len(at) - 1):
        mine = np.flatnonzero(t.doc == d)
        tags = field.viterbi(s[mine]) if len(mine) else []
        for i, tag in enumerate(tags):
            if tag == 1:
                k = i
                while k + 1 < len(tags) and tags[k + 1] == 2:
                    k += 1
                want.add((int(mine[i]), int(mine[k])))
    assert got == want and len(want) > 20


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(1)
    field = secret_crf.Field(transition=r.normal(size=(3, 3)))
    for n in range(1, 6):
        s = r.normal(size=(n, 3))
        value = lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(field.transition[a, b] for a, b in zip((0, *p), (*p, 0)))  # noqa: E731,B023
        assert tuple(field.viterbi(s)) == max(product(range(3), repeat=n), key=value)


def test_pieces_cover_a_batch():
    from satspan.llm.textbytes import pieces

    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": ["x" * (i * 10) if i % 4 else None for i in range(9)]})
    assert [r for p in pieces(batch, "text", 50) for r in p.column(0).to_pylist()] == list(range(9))


def test_license_texts_that_name_no_license(spark):
    """Texts with licences whose names do not occur, in the middle of prose, whole and
    with words changed: the method labels what the base phrases miss."""
    r = random.Random(12)
    given, want = [], []
    for t in license_index.TEMPLATES:
        if any(p in t.text for p, _ in license_index.BASE) or len(t.text.split()) < 12:
            continue
        for k in range(6):
            words = t.text.split()
            keys = [w for key in t.keys for w in key.split()]
            for i in range(len(words)):
                if k and words[i] not in keys and r.random() < 0.08:
                    words[i] = r.choice(["work", "code", "programme", "owner", "item"])
            given.append(prose(100 + len(given), 150) + " /* " + " ".join(words).upper() + " */ " + prose(900 + len(given), 60))
            want.append(t.label)
    clean = [prose(3000 + i, 300) + " permission to use the software is a condition of the license and copyright notice" for i in range(40)]
    found = {x["doc_id"]: x for x in license_index.scan(documents(spark, given + clean)).collect()}
    hits = sum(label in found[i]["labels"].split(",") for i, label in enumerate(want))
    assert len(want) >= 90 and hits >= 0.9 * len(want)
    assert all(found[i]["base_labels"] == "" for i in range(len(want)))
    assert all(found[len(want) + i]["labels"] == "" for i in range(len(clean)))
    assert 30 <= len(license_index.TEMPLATES) <= 200


def test_license_words_are_looked_up_by_falling_idf(spark):
    """The early end changes no candidate, and a text of common words looks up few."""
    from collections import Counter

    t = license_index.TEMPLATES
    idf = {w: 1.0 / (1 + sum(w in x.text.split() for x in t)) for x in t for w in x.text.split()}
    index = license_index.Index(t, idf)
    r = random.Random(13)
    common = sorted(idf, key=idf.get)[:25]

    def everything(places):
        votes = Counter()
        for w in places:
            for k, at in index.postings.get(w, ()):
                votes.update({(k, p - at + d) for p in places[w] for d in range(-license_index.SLACK, license_index.SLACK + 1)})
        return sorted(x for x, n in votes.items() if n >= index.least[x[0]])

    for trial in range(60):
        words = [r.choice(common) for _ in range(r.randrange(80))] + r.choice(t).text.split()[r.randrange(4) :] + [r.choice(common) for _ in range(20)]
        if trial % 3 == 0:
            words = [r.choice(common) for _ in range(300)]
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        assert index.candidates(places) == everything(places)
