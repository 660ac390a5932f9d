"""Operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framelark.llm import bpe_counts, decontaminate, main_text, mixing, near_dedup, page_tree, pitman_yor, quality_rules, repeats, site_bayes, textscan, textstats, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Äö", "#*", "x!"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 30, 120]))) for _ in range(40)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts += [passage + " tail " + t for t in texts[:6]] + texts[3:8]
    for t in texts[20:26]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "One", "a b " * 30, "long " + "z" * 5000, " ".join(["same"] * 45), "line one\nline one\n\nline two"]
    return [(i, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", 0, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_and_hashes():
    texts = ["a bb  a", "", None, "x" * 3000 + " y", "É a"]
    for _, _, buf, offs in textscan.slices(pa.array(texts), 10):
        w = textscan.Words(buf, offs, textscan.NON_SPACE)
        got = [bytes(buf[s:e]).decode() for s, e in zip(w.start, w.end)]
        h = w.hashes()
        assert len(got) == len(h)
        same = {}
        for word, x in zip(got, h.tolist()):
            assert same.setdefault(word, x) == x
    w = textscan.Words(*textscan.buffer_of(pa.array(["a b", "a", "b a"])), textscan.NON_SPACE)
    h = w.hashes().tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and w.first.tolist() == [0, 2, 3, 5]


def test_near_duplicates(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()} == {i for i in sets if find(i) == i}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_family_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 12)
    monkeypatch.setattr(near_dedup, "INDEX", 5)
    monkeypatch.setattr(near_dedup, "PARTNERS", 4)
    rnd = random.Random(1)
    texts = []
    for f in range(2):
        base = [f"{f}w{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(30):
            w = list(base)
            for _ in range(rnd.randrange(12)):
                w[rnd.randrange(120)] = f"e{rnd.random()}"
            texts.append(" ".join(w))
    rows = [(i, t, None, None, 0, "") for i, t in enumerate(texts)]
    test_near_duplicates(spark.createDataFrame(rows, DOCS), rows)


def test_quality_statistics_and_rules(spark, docs, rows):
    from collections import Counter

    def brute(t):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c, rep = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                rep.update(range(i, i + 5))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)

    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 40)] + [(None, 0, 0), (3, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, labels).collect():
        n = brute(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_rules_are_found():
    rnd = np.random.default_rng(0)
    x = {f: rnd.random(3000) for f in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.7) & (x["repeat_share"] < 0.3))
    rules = quality_rules.learn(x, bad, rnd.integers(0, 3, 3000))
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality_rules.cover_of(r, x)
    assert (hit == bad).mean() > 0.97


def test_language_model(docs, rows):
    words = {i: WORD.findall(lower(t)) + [None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = {}
    for i, w in words.items():
        if not held[i]:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    got = pitman_yor.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        base = sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words[r.doc_id]), sum(x in count for x in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0


def stirling(c, d):
    """Weights of the ways to seat c customers at 1..c tables (index: tables)."""
    row = [1.0]
    for n in range(c):
        row = [(row[k] * (n - d * k) if k < len(row) else 0.0) + (row[k - 1] if k else 0.0) for k in range(len(row) + 1)]
    return row


def test_seating_has_the_posterior_of_enumeration():
    d, theta, counts, chance = 0.6, 1.5, (5, 3, 1), np.array([0.3, 0.05, 0.1])
    weights = {}
    for t in itertools.product(*(range(1, c + 1) for c in counts)):
        rising = math.prod(theta + d * k for k in range(1, sum(t)))
        weights[t] = rising * math.prod(stirling(c, d)[k] * p**k for c, k, p in zip(counts, t, chance))
    total = sum(weights.values())
    want = np.array([sum(t[i] * w for t, w in weights.items()) / total for i in range(3)])
    many = 4000  # alike restaurants
    s = pitman_yor.Seating(np.tile(counts, many), np.repeat(np.arange(many), 3), many, d, theta, np.random.default_rng(0))
    kept = []
    for k in range(30):
        s.sweep(np.tile(chance, many))
        assert (s.tables == s.t.reshape(many, 3).sum(axis=1)).all() and (s.size >= 0).all()
        if k >= 10:
            kept.append(s.t.reshape(many, 3).mean(axis=0))
    assert np.mean(kept, axis=0) == pytest.approx(want, rel=0.02)  # dishes move at the same time, which small restaurants feel most


def test_large_dishes_have_the_expected_tables():
    rng, d, weight, n = np.random.default_rng(2), 0.7, 3.0, 3000
    seen = []
    for _ in range(200):
        t = 1
        for j, u in enumerate(rng.random(n - 1), 1):
            t += u < weight / (weight + j - d * t)
        seen.append(t)
    assert pitman_yor.expected_tables(np.array([float(n)]), np.array([weight]), d)[0] == pytest.approx(np.mean(seen), rel=0.05)


def test_discount_and_strength_are_found():
    rng, true_d, true_s = np.random.default_rng(5), 0.6, 4.0
    n, at = [], []
    for r in range(300):  # restaurants drawn from the process itself; each table serves a dish of its own
        sizes = []
        for j in range(400):
            if rng.random() * (true_s + j) < true_s + true_d * len(sizes):
                sizes.append(1)
            else:
                x = np.array(sizes) - true_d
                sizes[rng.choice(len(sizes), p=x / x.sum())] += 1
        n += sizes
        at += [r] * len(sizes)
    d, s = 0.3, 20.0
    for k in range(60):
        seats = pitman_yor.Seating(np.array(n), np.array(at), 300, 1e-9, s, np.random.default_rng(k))  # at this discount a dish begins at one table
        seats.discount = d
        d, s = pitman_yor.drawn(seats.evidence(), k)
    assert d == pytest.approx(true_d, abs=0.05) and s == pytest.approx(true_s, rel=0.3)


def brute_model(train, texts, sweeps, seed):
    """Log10 probabilities of texts under the same model: each customer of each restaurant seated anew, one by one, with lists of tables."""
    rnd, h = random.Random(seed), None
    parts = {}
    for words in train:
        for u, w in zip([0, *words], words):
            parts.setdefault(u, {}).setdefault(w, []).append(1)
    vocabulary = {w for r in parts.values() for w in r}
    root = {w: [1] * sum(len(r.get(w, ())) for r in parts.values()) for w in vocabulary}
    d, s, d0, s0 = h or (0.8, 5.0, 0.6, 10.0)
    base = 1 / (len(vocabulary) + 1)
    tables = {u: sum(map(len, r.values())) for u, r in parts.items()}
    root_tables, root_customers = sum(map(len, root.values())), sum(map(sum, root.values()))

    def p_root(w):
        x = root.get(w, [])
        return (sum(x) - d0 * len(x) + (s0 + d0 * root_tables) * base) / (s0 + root_customers)

    def up(w, by):
        nonlocal root_tables, root_customers
        x = root[w]
        if by < 0:
            k = rnd.choices(range(len(x)), x)[0]
            x[k] -= 1
            root_customers -= 1
            if not x[k]:
                del x[k]
                root_tables -= 1
            return
        k = rnd.choices(range(len(x) + 1), [*(c - d0 for c in x), (s0 + d0 * root_tables) * base])[0]
        root_customers += 1
        if k == len(x):
            x.append(1)
            root_tables += 1
        else:
            x[k] += 1

    for sweep in range(sweeps):
        for u, r in parts.items():
            for w, x in r.items():
                for _ in range(sum(x)):
                    k = rnd.choices(range(len(x)), x)[0]
                    x[k] -= 1
                    if not x[k]:
                        del x[k]
                        tables[u] -= 1
                        up(w, -1)
                    k = rnd.choices(range(len(x) + 1), [*(c - d for c in x), (s + d * tables[u]) * p_root(w)])[0]
                    if k == len(x):
                        x.append(1)
                        tables[u] += 1
                        up(w, 1)
                    else:
                        x[k] += 1
    out = []
    for words in texts:
        total = 0.0
        for u, w in zip([0, *words], words):
            r = parts.get(u, {})
            x, c, t = r.get(w, []), sum(map(sum, r.values())), tables.get(u, 0)
            total += math.log10((sum(x) - d * len(x) + (s + d * t) * p_root(w)) / (s + c))
        out.append(total)
    return out


@pytest.mark.parametrize("hot", [1000, 12])
def test_scores_agree_with_a_sampler_in_memory(spark, monkeypatch, hot):
    py = pitman_yor
    monkeypatch.setattr(py, "HOT", hot)
    monkeypatch.setattr(py, "SHARD", 2_000)
    monkeypatch.setattr(py, "TOP", 40)
    monkeypatch.setattr(py, "drawn", lambda evidence, seed: (0.8, 5.0) if seed == 1 else (0.6, 10.0))
    rnd = random.Random(8)
    follows = {i: [rnd.randrange(1, 150) for _ in range(6)] for i in range(151)}
    texts = []
    for _ in range(400):
        words = [0]
        while len(words) < 25:
            words.append(rnd.choice(follows[words[-1]]) if rnd.random() < 0.8 else rnd.randrange(1, 150))
        texts.append(words[1:])
    docs = spark.createDataFrame([(str(i), " ".join(f"w{w}" for w in t), "en", "s", 0, "") for i, t in enumerate(texts)], DOCS.replace("doc_id long", "doc_id string")).repartition(3)
    got = {int(r.doc_id): r for r in py.score_documents(docs).collect()}
    ends = [[*t, -1] for t in texts]
    train = [t for i, t in enumerate(ends) if zlib.crc32(str(i).encode()) % 10]
    want = brute_model(train, ends, 12, 1)
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].n_tokens == 25 for i in got)
    for ids in (held, list(got)):
        assert sum(got[i].score for i in ids) == pytest.approx(sum(want[i] for i in ids), rel=0.01)
    assert all(got[i].score == pytest.approx(want[i], rel=0.12) for i in got)


def test_suffix_automaton_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        v, width = rnd.choice([2, 3, 6]), rnd.choice([2, 3, 4])
        items = [[rnd.randrange(v) for _ in range(rnd.randint(1, 9))] for _ in range(rnd.randint(1, 5))]
        doc = [rnd.randrange(v) for _ in range(rnd.randint(0, 20))]
        want, found = [False] * len(doc), set()
        for k, it in enumerate(items):
            n = min(width, len(it))
            wins = {tuple(it[i : i + n]) for i in range(len(it) - n + 1)}
            for i in range(len(doc) - n + 1):
                if tuple(doc[i : i + n]) in wins:
                    found.add(k)
                    want[i : i + n] = [True] * n
        hit, got = decontaminate.SuffixAutomaton([*enumerate(items)], width).hits(np.array(doc, np.uint64), np.array([0, len(doc)]))
        assert hit.tolist() == want and got.get(0, set()) == found


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(WORD.findall(rows[0][1])[:40]).upper()), (22, "one"), (3, None), (4, "!!"), (5, rows[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in decontaminate.report(docs, bench).collect()}
    blocks = {tuple(r) for r in decontaminate.report(docs, bench, block_words=10).collect()}
    assert one == blocks and any(r[2] for r in one)
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    untouched = {r[0] for r in one if not r[2]}
    assert all(clean[i] == rows[i][1] for i in untouched)
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats(docs, rows, hot):
    seen, want = set(), {}
    for i, t, *_ in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.report(docs, hot=hot).collect()}
    assert got == want
    left = {r.doc_id: r.text for r in repeats.without_repeats(docs, hot=hot).collect()}
    assert all(left[i] == rows[i][1] for i in want if not want[i][1])
    assert all(len(WORD.findall(left[i])) == want[i][0] - want[i][1] for i in left if left[i] and want[i][1])


PAGES = [
    (1, "http://a.x/1", "p" * 1200),
    (2, "http://a.x/2", "p" * 1200),
    (3, None, None),
    (4, "http://a.x/ \r\n", "é\r\n\r\n" * 700000),
    (5, "u", "small"),
    (6, "u", "small"),
    (None, "u", "p" * 1200),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_warc(pages)
    chunks = warc.read_warc(spark, manifest)
    got = {r.page_id: r for r in warc.records(chunks).collect()}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if i == 1 else ("response", None))
    big = chunks.where("page_id = 4").orderBy("chunk_no").collect()
    assert len(big) > 3 and b"".join(bytes(r.data) for r in big).decode() == PAGES[3][2]
    assert warc.records(warc.read_warc(spark, warc.write_warc(pages.limit(0)))).count() == 0


def test_token_counts_match_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    path = names.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe_counts.PieceCounter(path)
    rnd = random.Random(4)
    letters = [*"abcXYZ '\t\n\r\x0b\x1c\x85  éÉßİΣς０²½日語글ȩ́🙂#$%*<|>", "<|endoftext|>", "'s", "I'll", "ﬁ", "thinking"]
    for _ in range(2000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        assert own(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_of_documents(docs, rows):
    names = pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r for r in bpe_counts.count_documents(docs, names.path("word_bpe_49k.json"), limit=50).collect()}
    for i, t, *_ in rows:
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 50)


def test_mixing_meets_targets(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 3 else None, 10, "") for i in range(6000)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, {"big": 1.0}, size=2.5).groupBy("source").count().collect()
    assert [r.source for r in mixed] == ["big"] and mixed[0]["count"] == pytest.approx(15000, rel=0.03)
    again = mixing.mix(docs, {"big": 1.0}, size=2.5).select("doc_id", "copy", "order_key")
    assert again.exceptAll(mixing.mix(docs, {"big": 1.0}, size=2.5).select("doc_id", "copy", "order_key")).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs).groupBy().count().first()[0] == pytest.approx(6000, rel=0.05)


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>m<li>n</ul></nav><div class=ad>buy</div><article><h1>T &amp; t</h1><p>a  b<br>c<p><b>d{}</b></article><footer>f</footer><script>x</script>"
    rows = [(i, "http://h.x/%d" % i, page.format(i)) for i in range(5)]
    rows += [(6, None, "<div class=sidebar>s</div><div id=main><p>only text here</div><div class=comments><p>no</div>"), (7, "http://e.x", None), (8, "http://e.x", "")]
    got = {r.page_id: r for r in main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(5):
        assert got[i].text == f"T & t\na b c\nd{i}" and got[i].n_chars == len(got[i].text)
    assert got[6].text == "only text here" and got[7].text == got[8].text == ""


def test_wrapper_groups():
    one = page_tree.wrapper_of(page_tree.parse("<div><p>a<p>b</div>"))
    two = page_tree.wrapper_of(page_tree.parse("<div><h2>x</h2><p>c</div>"))
    assert page_tree.as_expression(page_tree.merge(one, two)) == "<#><div>(<h2>x</h2>)?(<p>#TEXT</p>)+</div></#>"


def test_site_classifier(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        words = [rnd.choice("the of and to in was is on".split()) + rnd.choice("abcdefgh") for _ in range(80)]
        if kind == 0:
            words = [w + "***" for w in words]
        if kind == 1:
            words[10] = "vileword"
        rows.append((i, " ".join(words) + ".", "en", "s0" if i % 2 else None, 0, "clash"))
        if i % 2 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    labels += [(i, 1, 1) for i in range(1, 600, 12)]
    for i in range(1, 600, 12):
        rows[i] = (i, rows[i][1].replace(" ", " vileword ", 1), "en", "s0", 0, "clash")
    rows += [(1000, None, None, None, 0, ""), (1001, "", None, None, 0, "")]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in site_bayes.classify(docs, table).collect()}
    assert len(got) == 602 and not got[1000] and not got[1001]
    clean = [got[i] for i in range(600) if i % 6 > 1 and "vileword" not in rows[i][1]]
    bad = [got[i] for i in range(600) if i % 6 == 0 or "vileword" in rows[i][1]]
    assert sum(clean) > 0.97 * len(clean) and sum(bad) < 0.1 * len(bad)
    assert all(r.kept == (r.n_words > 0) for r in site_bayes.classify(docs, table.limit(0)).collect())


def test_statistics_of_nothing():
    assert [len(x) for x in textstats.stats_of(np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0] * len(textstats.FIELDS)


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) - {"kept"} <= set(out.columns) and out.count() > 0


def test_mixture_query_returns_whole_documents(spark, docs, rows, tmp_path):
    from framelark.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = queries.QUERIES["op8_mixing"](spark, str(tmp_path)).collect()
    text = {i: t for i, t, *_ in rows}
    assert mixed and all(r.text == text[r.doc_id] for r in mixed)
    assert len({(r.doc_id, r.copy, r.order_key) for r in mixed}) == len(mixed)


CLASHES = "rid key own hot cold cuts _cuts _key _s _p site path e rate copy order_key _copies _cdf _source cdf id of n place _hits hits kept llr _verdict digest component c s text_".split()


def test_stages_keep_columns_of_any_name(spark, rows):
    import corpus_pipeline

    wide = [(*r[:5], *(f"{c}{r[0]}" for c in CLASHES)) for r in rows] + [(None, "no id here " * 30, None, None, None, *CLASHES)] * 2
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(WORD.findall(rows[0][1])[:40])), (None, rows[2][1])], "item_id long, text string")
    first = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    for name, made in {
        "quality": site_bayes.without_bad(docs, labels),
        "near": near_dedup.without_near_duplicates(docs),
        "repeats": repeats.without_repeats(docs),
        "clean": decontaminate.decontaminate(docs, bench, block_words=20),
        "mix": mixing.mix(docs),
    }.items():
        got = made.collect()
        assert made.columns[: len(docs.columns)] == docs.columns and got, name
        for r in got:
            if r.doc_id is not None:
                assert all(r[c] == first[r.doc_id][c] for c in CLASHES), name
    assert [c for c in mixing.mix(docs).columns if c not in docs.columns] == ["rate_", "copy_", "order_key_"]
    for _, stage in (corpus_pipeline.STAGES[1], corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[4]):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_poisson_inversion_by_halving(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 900.0)], "source string, rate double")
    for r in mixing.poisson_tables(rates).collect():
        assert r.cdf == sorted(r.cdf) and r.cdf[-1] == pytest.approx(1)
        us = [0.0, 0.2, 0.5, 0.97, 0.9999999]
        from pyspark.sql import functions as F

        one = spark.createDataFrame([(r.cdf, u) for u in us], "cdf array<double>, u double")
        assert [x.n for x in one.select(mixing.below(F.col("cdf"), F.col("u")).alias("n")).collect()] == [sum(c <= u for c in r.cdf) for u in us]


def test_names_alone_drop_no_text():
    body = "<h1>Head</h1><p>Body text number one.</p><p>Second paragraph.</p>"
    for name in "legal-analysis related notice social-history banner-story article-header comments ad".split():
        page = page_tree.parse(f'<html><body><article><div class="{name}">{body}</div></article></body></html>')
        assert page_tree.extract(page, page_tree.judge(page_tree.wrapper_of(page))) == ["Head", "Body text number one.", "Second paragraph."]
    deep = "<article>" + "<div>" * 300 + "<p>a</p><div><p>b</p></div><p>c</p><div><p>d</p></div><p>e</p>" + "</div>" * 300 + "</article>"
    page = page_tree.parse(deep)
    assert page_tree.extract(page, page_tree.judge(page_tree.wrapper_of(page))) == list("abcde")


def test_wrapper_stays_bounded_and_decides():
    import json

    def infer(pages):
        trees, w = [page_tree.parse(p) for p in pages], None
        for t in trees:
            one = page_tree.wrapper_of(t, page_tree.print_of(t))
            w = one if w is None else page_tree.merge(w, one)
        return trees, w

    odd = [f'<body><div id="post{i}" class="c{chr(97 + i % 26)}{chr(97 + i // 26)}"><p>text {i}</p></div></body>' for i in range(600)]
    trees, w = infer(odd)
    assert len(json.dumps(w)) < 20_000
    verdicts = page_tree.judge(w)
    assert all(page_tree.extract(t, verdicts) == [f"text {i}"] for i, t in enumerate(trees))
    page = "<body><div class=x1a><div>Site name</div><div class=content><h2>T{0}</h2><p>Para {0} long text here.</p><div class=ad>Buy {0}</div><p>Tail {0}.</div><ul><li><a>link {0}</a><li><a>link b</a></ul><div id=comments><div><p>bla {0}</div><div><p>bla bla</div></div><div>copyright</div></div></body>"
    trees, w = infer([page.format(i * 7) for i in range(6)])
    verdicts = page_tree.judge(w)
    assert [page_tree.extract(t, verdicts) for t in trees] == [[f"T{i * 7}", f"Para {i * 7} long text here.", f"Tail {i * 7}."] for i in range(6)]


def test_alignment_against_brute_force():
    import re as regex

    rnd = random.Random(3)

    def pattern(w):
        body = f"<{w[0]}>" + "".join(map(pattern, w[page_tree.WITHIN])) + f"</{w[0]}>"
        return f"(?:{body})" + ("*" if w[1] and w[2] else "+" if w[1] else "?" if w[2] else "")

    def shape(t):
        return f"<{t[0]}>" + "".join(map(shape, t[2])) + f"</{t[0]}>"

    for _ in range(60):  # every page of a small host matches the wrapper as a regular expression
        pages = [["r", [], [[rnd.choice("abc"), [], [[rnd.choice("xy"), [], []] for _ in range(rnd.randrange(2))]] for _ in range(rnd.randrange(1, 4))]] for _ in range(3)]
        w = None
        for p in pages:
            one = page_tree.wrapper_of(p)
            w = one if w is None else page_tree.merge(w, one)
        if any(k[1] for k in w[page_tree.WITHIN]):
            continue  # repeats fold pairs, whose groups pattern() doesn't write
        assert all(regex.fullmatch(pattern(w), shape(p)) for p in pages), (pages, w)


def test_hot_windows_are_confirmed_before_they_are_dealt(spark, monkeypatch):
    rnd = random.Random(6)

    def gram(line):
        raw = np.frombuffer(line.encode(), np.uint8)
        return int(textscan.windows(textscan.Words(raw, np.array([0, len(raw)]), textscan.NON_SPACE).hashes(), repeats.GRAM)[0])

    line = min((f"one line of six words{i}" + " here" for i in range(500)), key=gram)  # small, so it is a minimizer
    texts = [" ".join(f"x{rnd.randrange(10**6)}" for _ in range(25)) + f" {line} " + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(25)) for _ in range(120)]
    texts += texts[:12] + [" ".join(t.split()[8:44]) for t in texts[20:26]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "") for i, t in enumerate(texts)], DOCS).repartition(3)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        words, gone = t.split(), set()
        for k in range(len(words) - 19):
            phrase = tuple(words[k : k + 20])
            if phrase in seen:
                gone.update(range(k, k + 20))
            seen.add(phrase)
        want[i] = len(gone)
    monkeypatch.setattr(repeats, "AUTOMATON_PHRASES", 20)
    for hot in (5, 10**6):
        assert {r.doc_id: r.n_removed for r in repeats.report(docs, hot=hot).collect()} == want
    rows, deal = [], repeats.dealt
    monkeypatch.setattr(repeats, "dealt", lambda *a: rows.append(deal(*a)) or rows[0])  # the last argument is `hot`
    repeats.report(docs, hot=5)
    sums = rows[0].where("kind = 0").collect()
    assert sums and all(r.n > 1 for r in sums)
    held = {}
    for r in sums:
        held[r.shard] = held.get(r.shard, 0) + 1
    assert len(held) > 16 and max(held.values()) <= 60


def test_region_is_chosen_for_each_page(spark):
    other = "<div><h1>Head</h1><p>plain block {} of some length</div>"
    deep = "<div>" * 250 + "<div class=comments><p>menu</div><p>deep text" + "</div>" * 250
    rows = [(0, "http://h.x/0", "<article><p>article text</article>"), (1, "http://h.x/1", "<main><p>main text</main>")]
    rows += [(2 + i, f"http://h.x/{i}", other.format(i)) for i in range(2)]
    rows += [(10 + i, "http://c.x/1", other.format("same")) for i in range(4)] + [(20, "http://d.x", deep)]
    got = {r.page_id: r.text for r in main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[0] == "article text" and got[1] == "main text"
    assert all(got[2 + i] == f"Head\nplain block {i} of some length" for i in range(2))
    assert all(got[10 + i] == "Head\nplain block same of some length" for i in range(4))
    assert got[20] == "deep text"


def test_empty_tables(spark, docs):
    names = pytest.importorskip("public_tokenizers")
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        near_dedup.near_duplicates(none),
        repeats.report(none),
        bpe_counts.count_documents(none, names.path("word_bpe_49k.json")),
        main_text.extract_main_text(pages),
        site_bayes.classify(none, labels),
        site_bayes.without_bad(none, labels),
        mixing.mix(none),
    ):
        assert made.columns and made.count() == 0


def test_repeated_rows_and_null_ids(spark, docs, rows):
    from pyspark.sql import functions as F

    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, rows[0][1], None, None, 0, ""), (None, rows[0][1], None, None, 0, "")], DOCS))
    once = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    got = near_dedup.near_duplicates(twice).collect()
    assert len(got) == 2 * len(rows) + 2
    for r in got:
        assert r.component_id is None and r.kept if r.doc_id is None else r == once[r.doc_id]
    once = {r.doc_id: r for r in repeats.report(docs).collect()}
    for r in repeats.report(twice).collect():
        n = len(WORD.findall(rows[0][1]))
        assert (r.n_words, r.n_removed) == (n, n if n >= 20 else 0) if r.doc_id is None else r == once[r.doc_id]
    scored = pitman_yor.score_documents(twice).collect()
    assert len(scored) == len(got) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in scored)
    assert [r.held_out for r in scored if r.doc_id is None] == [True, True]
    count = {}
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for x in WORD.findall(lower(t)) + [None]:
                count[x] = count.get(x, 0) + 2
    n, v = sum(count.values()), len(count)
    base = {i: sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in WORD.findall(lower(t)) + [None]) for i, t, *_ in rows}
    assert all(r.base_score == pytest.approx(base[0 if r.doc_id is None else r.doc_id]) for r in scored)
    mixed = mixing.mix(twice).groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("doc_id is not null").collect()
    assert mixed and all(r.n == 2 for r in mixed)
    bench = spark.createDataFrame([(None, rows[2][1])], "item_id long, text string")
    hit = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}[2]
    assert hit.contaminated and hit.n_items == 0 and hit.n_hit == hit.n_words


def test_verdict_of_quality_rules_is_the_first_rule_that_fires(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(45)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(docs, labels) or [[quality_rules.Test("chars_per_word", True, 3.2)]]
    rules.append([quality_rules.Test("words", False, 31.0), quality_rules.Test("repeat_share", True, 0.0)])
    for r in quality_rules.judge(docs, labels, rules=rules).collect():
        x = {f: np.array([r[a] / max(r[b], 1) if b else float(r[a])]) for f, (a, b) in quality_rules.FEATURES.items()}
        assert r.kept == (not r.base_failed and not any(quality_rules.cover_of(rule, x)[0] for rule in rules))


def test_every_customer_of_a_frequent_pair_is_seated():
    d, theta, tables, weight, many = 0.7, 1.5, 1000.0, 1000.0, 20
    counts = (2000, 600)  # one dish a restaurant, whose tables are held; it begins with about n ** d tables
    want = []
    for c in counts:
        k, row = np.arange(1, c + 1), np.full(c, -np.inf)  # log weights of the ways to seat the first customers at k tables
        row[0] = 0.0
        for n in range(1, c):
            row = np.logaddexp(row + np.log(np.maximum(n - d * k, 1e-300)), np.concatenate([[-np.inf], row[:-1]]))
        p = np.exp(row + k * math.log(weight) - (row + k * math.log(weight)).max())
        want.append((p * k).sum() / p.sum())
    n = np.repeat(counts, many)
    r = len(n)
    s = pitman_yor.Seating(n, np.arange(r), r, d, theta, np.random.default_rng(0), np.ones(r, bool), np.full(r, tables))
    kept = []
    for k in range(8):
        s.sweep(np.full(r, weight / (theta + d * tables)))
        if k >= 3:
            kept.append(s.t.reshape(2, many).mean(axis=1))
    assert np.mean(kept, axis=0) == pytest.approx(want, rel=0.02) and (s.tables == tables).all()


def test_a_pair_beyond_a_million_tokens_has_whole_tables():
    n = (1 << 20) + 7
    s = pitman_yor.Seating(np.array([n, 3]), np.array([0, 0]), 1, 0.8, 5.0, np.random.default_rng(1), chance=np.array([0.01, 0.01]))
    s.sweep(np.array([0.01, 0.01]))
    assert (s.t == np.round(s.t)).all() and s.tables[0] == s.t.sum()
    (dish,) = s.long_dishes
    assert sum(dish.size) == n and (np.bincount(dish.table, minlength=len(dish.size)) == dish.size).all() and sum(x > 0 for x in dish.size) == s.t[0]


class CountedDraws:
    """A generator that counts the uniform random numbers drawn from it."""

    def __init__(self, seed):
        self.rng, self.drawn = np.random.default_rng(seed), 0

    def random(self, size):
        self.drawn += size
        return self.rng.random(size)

    def __getattr__(self, name):
        return getattr(self.rng, name)


def test_a_customer_with_no_choice_among_tables_takes_one_random_number():
    d, theta, tables, weight, many = 0.8, 5.0, 100.0, 0.5, 20_000
    s = pitman_yor.Seating(np.full(many, 2), np.arange(many), many, d, theta, CountedDraws(3), np.ones(many, bool), np.full(many, tables))
    for _ in range(3):
        s.rng.drawn = 0
        s.sweep(np.full(many, weight / (theta + d * tables)))
        assert s.rng.drawn == 2 * many  # both customers of each dish
        assert np.mean(s.t == 2) == pytest.approx(weight / (weight + 1 - d), abs=0.02)


def test_shards_merge_the_pairs_of_all_chunks(monkeypatch):
    import pyarrow as pa

    py, rnd = pitman_yor, random.Random(4)
    monkeypatch.setattr(py, "CHUNK", 300)
    monkeypatch.setattr(py, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    texts = [" ".join(f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(40))) for _ in range(100)]
    held = [i % 10 == 0 for i in range(100)]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(range(i, i + 10)), "held_out": held[i : i + 10], "text": texts[i : i + 10]}) for i in range(0, 100, 10)]
    name = lambda w: int(py.END) if w is None else int(py.BEGIN) if w == "" else int(py.tokens_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    want, there = {}, {}
    for i, t in enumerate(texts):
        words = ["", *t.split(), None]
        for u, w in zip(words, words[1:]):
            k = name(u), name(w)
            want[k] = want.get(k, 0) + (not held[i])
            there.setdefault(k, {})[i] = there.get(k, {}).get(i, 0) + 1
    top = np.sort(np.array([name(w) for w in [None, *(f"w{i}" for i in range(25))]], np.uint64))
    hot, nothing = top[np.isin(top, [name("w0"), name("w1")])], np.zeros(2)
    known = py.Known(top, np.ones(len(top)), np.zeros(len(top)), hot, nothing, nothing, 1.0, 3)
    rows = [(b, k) for b in py._deal(known, py.deal_schema(pa.int64()), True)(batches) for k in range(len(b)) if b["kind"][k].as_py() == py.PAIRS]
    chunk_of = {number: k for k, number in enumerate(sorted({b["chunk"][k].as_py() for b, k in rows}))}
    first = np.cumsum([0] + [len(ids) for ids, *_ in py.chunks(batches)])
    assert len(chunk_of) > 2
    got, documents = {}, {}
    for number in range(3):
        s = py.Shard(known, number)
        for b, k in rows:
            if b["shard"][k].as_py() == number:
                s.add(b, k)
        s.ready()
        assert (s.words[1:] > s.words[:-1]).all() and (s.contexts[1:] > s.contexts[:-1]).all()
        pairs = [(int(u), int(w)) for u, w in zip(s.contexts[s.context], s.words[s.word])]
        assert len(set(pairs)) == len(pairs) and not set(pairs) & set(got)
        got |= dict(zip(pairs, s.n.tolist()))
        seen = 0
        for chunk, docs, doc, times in s.parts:
            of = np.repeat(s.pair[seen : seen + len(docs)], docs)
            seen += len(docs)
            for p, i, n in zip(of, doc, times):
                at = documents.setdefault(pairs[p], {})
                at[int(first[chunk_of[chunk]] + i)] = at.get(int(first[chunk_of[chunk]] + i), 0) + int(n)
        lookups = []
        s.replies = [(s.words[k : k + 1], np.array([k]), np.array([k, 0], np.float32)) for k in range(len(s.words)) if s.words[k] not in top]
        with monkeypatch.context() as m:
            m.setattr(py, "lookup", lambda table, x, f=py.lookup: lookups.append(len(x)) or f(table, x))
            count, x = s.known_words()
        rare = ~np.isin(s.words, top)
        assert (count[rare] == np.flatnonzero(rare)).all() and (x[rare] == count[rare]).all() and len(s.replies) > 3 and len(lookups) == 2  # all replies at once
    assert got == want and documents == there


def test_numbers_are_put_in_order_where_leading_bits_are_the_same():
    x = np.array([(i * 7919) % 5 << 60 | (i * 31) % 9 for i in range(400)], np.uint64)  # the last four bits give way to places
    order = pitman_yor.by_leading_bits(x)
    assert sorted(order.tolist()) == list(range(400)) and (np.diff((x[order] >> np.uint64(60)).astype(int)) >= 0).all()
    different, at = pitman_yor.numbered(x)
    assert different.tolist() == sorted(set(x.tolist())) and (different[at] == x).all()
    different, at = pitman_yor.numbered(x[:0])
    assert len(different) == len(at) == 0


def test_pairs_of_one_very_long_text_stand_once(monkeypatch):
    import pyarrow as pa

    py, n = pitman_yor, (1 << 21) + 9
    monkeypatch.setattr(py, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    words = np.random.default_rng(1).integers(0, 100, n)
    text = " ".join(np.array([f"w{i}" for i in range(100)])[words].tolist())
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1]), "held_out": [False], "text": [text]})
    nothing = np.zeros(0)
    known = py.Known(np.array([py.END]), np.ones(1), np.zeros(1), nothing.astype(np.uint64), nothing, nothing, 1.0, 3)
    found = [b["n"][k].values.to_pylist() for b in py._deal(known, py.deal_schema(pa.int64()), False)([batch]) for k in range(len(b))]
    assert sorted(sum(found, [])) == sorted([1, 1, *np.unique(words[:-1] * 100 + words[1:], return_counts=True)[1].tolist()])
