"""The ten operators against brute force on small tables, and their defined results for odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, embeddings, html_text, language, mixing, repeats, secret_scan, simhash, tokens, urls
from sparkloom.llm.arrays import unite

SIZE = f"{DATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SIZE}/documents.parquet")


def frame(spark, texts, extra=True):
    """Documents with nulls, empty and repeated rows, and columns whose names clash with those inside the operators."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("row_key", "key", "fp", "component", "node", "who", "topic", "copies", "start", "found", "hash", "n", "id")
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


# ---- 3: repeated strings ----


def removed_by_force(rows, n):
    seen = {}
    raws = [(t or "").encode() for t in rows]
    for i, b in enumerate(raws):
        for s in range(len(b) - n + 1):
            seen.setdefault(b[s : s + n], []).append((i, s))
    cover = [bytearray(len(b)) for b in raws]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                cover[i][s : s + n] = b"\1" * n
    return [bytes(x for x, c in zip(b, k) if not c) for b, k in zip(raws, cover)]


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_repeats_by_force(spark, group_rows):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", "short", base, base, "x" * 400, "ab" * 150, base[:150] + "!" + base[151:], "y" * 50 + base[100:400] + "z" * 50]
    for _ in range(25):
        a = rng.randrange(len(base) - 60)
        texts.append(" ".join(rng.choice(words) for _ in range(20)) + base[a : a + rng.randrange(10, 250)] + rng.choice(words))
    for n in (20, 50):
        got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(frame(spark, texts), length=n, group_rows=group_rows).collect()}
        want = removed_by_force(texts, n)
        assert [got[i] for i in range(len(texts))] == want


def test_repeats_whole_table(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs).collect()}
    assert [got[r.doc_id] for r in rows] == removed_by_force([r.text for r in rows], 200)


def test_repeats_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(empty).count() == 0
    long = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(700))
    twice = spark.createDataFrame([(None, long), (1, long), (1, long), (1, "other")], "doc_id long, text string")
    assert sorted((r.n_removed, len(r.spans)) for r in repeats.remove_repeats(twice).collect()) == [(0, 0), (700, 1), (700, 1), (700, 1)]


def test_anchor_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    for n in (0, 199, 200, 201, 5000):
        start, count, anchor, _ = repeats.runs_of_anchors(rng.integers(97, 99, n).astype(np.uint8), 200)
        assert np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)] + [np.empty(0, int)]).tolist() == list(range(max(0, n - 199)))
        assert ((anchor >= start + count - 1) & (anchor <= start + 100)).all()


def test_slices_change_nothing(monkeypatch):
    text = np.frombuffer(bytes(random.Random(2).choice(b"ab ") for _ in range(3000)), np.uint8)
    whole = [set(zip(np.repeat(a, c).tolist(), itertools.chain.from_iterable(range(s, s + k) for s, k in zip(st, c)))) for st, c, a, _ in [repeats.runs_of_anchors(text, 200)]]
    monkeypatch.setattr(repeats, "SLICE", 256)
    repeats._powers.clear()
    cut = [set(zip(np.repeat(a, c).tolist(), itertools.chain.from_iterable(range(s, s + k) for s, k in zip(st, c)))) for st, c, a, _ in [repeats.runs_of_anchors(text, 200)]]
    repeats._powers.clear()
    assert whole == cut


# ---- 4: SimHash ----


def fingerprint_by_force(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_xxh64():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(2000))
    at = [(s, s + rng.randrange(150)) for s in range(0, 1800, 3)]
    got = simhash.xxh64_slices(np.frombuffer(raw, np.uint8), np.array([a for a, _ in at]), np.array([b for _, b in at]))
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in at]


def test_simhash(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefÉ") for _ in range(5)) for _ in range(400)]
    texts = [None, "", " \n\t", "One two", "one TWO", "É é", "a\x1cb c d e"]
    for _ in range(25):
        w = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(w))
        texts.append(" ".join(w[:-1] + ["changed"]))
    f = [fingerprint_by_force(t) for t in texts]
    want = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 4])
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(f))] == f
    assert [got[i].component for i in range(len(f))] == want
    assert sum(r.kept for r in got.values()) == len(set(want))


def test_simhash_odd_tables(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "quite different words are in here"), (None, "nobody else has this text at all")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component) for r in simhash.simhash_groups(rows).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (2, 2), (None, None)], key=str)


@pytest.mark.parametrize("keep, bucket", [(1, 4096), (2, 3), (3, 2)])
def test_buckets_lose_no_link(spark, keep, bucket):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.near_fingerprints(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long"), 4, keep, bucket)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, x) for x in range(501, 560)] + [(7000, 7000)] + [(rng.randrange(800, 900), rng.randrange(800, 900)) for _ in range(60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(7001, edges)
    assert all(got.get(i, i) == want[i] for i in range(7001))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unite():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    parent = np.arange(200)
    unite(parent, i, j)
    assert parent.tolist() == roots(200, zip(i.tolist(), j.tolist()))


# ---- 1: embeddings ----


@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "fit_rows": 64}])
def test_embeddings(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    x = [(c + rng.normal(size=8) * s).tolist() for c in centres for s in (0, 0, 0.1, 0.2)]
    rows = [(i, v) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [float("inf")] * 8), (904, [None] + [1.0] * 7), (905, []), (906, x[0][:4]), (907, (np.array(x[0]) * 1e-30).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("label", "node", "times", "block", "hash", "row_key")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(df, **options).collect()}
    good = [(i, np.array(v)) for i, v in rows if i < 900 or i == 907]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    root = roots(len(good), zip(*np.nonzero(near)))
    for k, (i, _) in enumerate(good):
        assert got[i] == (int(near[k].sum()), good[root[k]][0], root[k] == k)
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert got[i] == (0, i, True)


def test_embeddings_empty(spark):
    assert embeddings.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embeddings.embedding_groups(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1


# ---- 2: decontamination ----


def test_masks_lose_no_overlap():
    for n in range(5, 17):
        for bad in itertools.combinations(range(n), int(n * 0.2 + 1e-9)):
            assert any(all(s + p not in bad for p in m) for m in decontaminate.MASKS for s in range(n - m[-1]))


def test_best_overlap_by_force():
    rng = random.Random(6)
    for _ in range(300):
        doc, item = np.array([rng.randrange(3) for _ in range(30)]), np.array([rng.randrange(3) for _ in range(rng.randrange(1, 15))])
        shift = rng.randrange(-10, 30)
        want = 0
        for a in range(len(item)):
            for b in range(a, len(item)):
                if 0 <= a + shift and b + shift < len(doc) and doc[a + shift] == item[a] and doc[b + shift] == item[b]:
                    if (doc[a + shift : b + shift + 1] == item[a : b + 1]).mean() >= 0.8 - 1e-9:
                        want = max(want, b - a + 1)
        assert decontaminate.best_overlap(doc, item, shift, 0.8)[0] == want


@pytest.mark.parametrize("broadcast", [16 << 20, -1])
def test_contamination(spark, docs, broadcast):
    rng = random.Random(2)
    bench = spark.read.parquet(f"{SIZE}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None), (98, ""), (99, "too short item")], "item_id long, text string"))
    items = [r for r in bench.collect() if r.item_id is not None and r.item_id < 90]
    clean = [f"zq{i} " + " ".join(f"w{rng.randrange(5000)}x" for _ in range(60)) for i in range(20)]
    texts, want = [None, "", "too short item"], set()
    for k in range(20):
        item = rng.choice(items)
        w = item.text.split()
        for j in rng.sample(range(len(w)), int(0.15 * len(w))):
            w[j] = "changed"
        want.add((len(texts), item.item_id))
        texts.append(clean[k][:200] + " " + " ".join(w).upper() + " " + clean[k][200:])
    texts += clean
    got = decontaminate.find_contamination(frame(spark, texts), bench, broadcast_bytes=broadcast).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_matches >= 0.8 * r.n_tokens for r in got)
    assert decontaminate.find_contamination(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


# ---- 5: URLs ----


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda t: len(t) % 2)  # every key collides
    urls.write_digest_array([("a", "/", "x"), ("bb", "/", "y"), ("ccc", "/", "x")], str(tmp_path / "d"))
    d = urls.DigestArray(str(tmp_path / "d"))
    found = d.find([b"a\n/", b"bb\n/", b"ccc\n/", b"z\n/", b"zz\n/"])
    assert [d.verdict_names[d.verdicts[i]] if i >= 0 else None for i in found] == ["x", "y", "x", None, None]
    urls.write_digest_array([], str(tmp_path / "e"))
    assert urls.DigestArray(str(tmp_path / "e")).find([b"a"]).tolist() == [-1]


def test_urls(spark):
    from sparkloom.llm.queries import URL_RULES

    cases = {
        "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "HTTP://WWW.Example.COM/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.b.www.example.com/en/": ("a.b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/de/": ("x.net", "/de/", None, "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?a=/en/": ("example.com", "", None, "allow"),
        "x://y://z/en": ("y:", "//z/en", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "id": F.lit(3)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(rows, URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge_urls(rows.limit(0), URL_RULES).count() == 0


# ---- 6: tokens ----

ODD = ["", "  ", "a  b   c\n\n  d\t e", "x\x1cy !\x1c z", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "é\u00a0\u3000日本語  中文 ", "a" * 3000, " " * 5000, "don't  we'll 's", " \x85 x"]


def test_token_counts(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = [r.text for r in docs.collect()] + ODD + ["".join(rng.choice(" \n\t  ab'sé1.!\x1c\u00a0日<|endoftext|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter.count_short(texts) == want
    assert [counter.count_huge(t, 200, 16) for t in texts] == want
    assert [counter.count_huge(t, 64, 4) for t in texts[-300:]] == want[-300:]


def test_token_table(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, [None, "", "one two", "é" * 700, "word " * 9000]), path, huge=1000, chunk=500, overlap=50).collect()}
    assert [(got[i].n_bytes, got[i].over_limit) for i in range(5)] == [(0, False), (0, False), (7, False), (1400, got[3].n_tokens > 512), (45000, True)]
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[4].n_tokens == len(tokens.Counter(path).encode("word " * 9000).ids)


# ---- 7: language ----


def test_language_held_out_accuracy(spark, docs):
    marked = docs.withColumn("held_out", language.held_out("doc_id"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in marked.select("doc_id", "held_out").collect())
    model = language.fit_languages(marked.where("not held_out"))
    rows = language.predict_languages(marked, model, ["doc_id", "held_out", "lang"]).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, docs):
    model = language.fit_languages(docs)
    odd = frame(spark, [None, "", "123 !!", "é", "The and of thering " * 40_000])
    got = {r.doc_id: r for r in language.predict_languages(odd, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[3].lang_pred in model.languages and got[4].lang_pred in model.languages
    assert language.fit_languages(odd.where("lang is null")) is None
    assert {r.lang_pred for r in language.predict_languages(odd, None, ["doc_id"]).collect()} == {"und"}
    one = language.fit_languages(docs.where("lang = 'en'"))
    assert language.predict_languages(docs.limit(5), one, ["doc_id"]).where("lang_pred = 'en'").count() == 5


def test_codewords():
    for n in (1, 2, 4, 7, 30):
        code = language.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


# ---- 8: secrets ----


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.fit_forest(secret_scan.labelled_findings(spark, 60), trees=20)


def test_secrets(spark, forest):
    h = hashlib.sha256(b"1").hexdigest()
    texts = [None, "", "nothing here", f'my token = "{h[:40]}" ok', f"fixed in commit {h[:40]} today", "password=your_password_here", f"x AKIA{'Q7' * 8} y password={h[:18]} z", "é\ue000 " + f'secret: "{h[:32]}"', "a" * 100_000 + f" token={h[:40]}"]
    got = secret_scan.scan_secrets(frame(spark, texts), forest, ["doc_id"]).orderBy("doc_id", "start").collect()
    assert all(texts[r.doc_id][r.start : r.start + r.n_chars] == r.secret for r in got)
    assert [(r.doc_id, r.secret) for r in got] == [(3, h[:40]), (6, "AKIA" + "Q7" * 8), (6, h[:18]), (7, h[:32]), (8, h[:40])]
    for broadcast in (16 << 20, -1):
        df = frame(spark, texts)
        cut = secret_scan.redact_secrets(df, forest, broadcast_bytes=broadcast)
        assert cut.columns == df.columns
        want = list(texts)
        for r in reversed(got):
            want[r.doc_id] = want[r.doc_id][: r.start] + "[SECRET]" + want[r.doc_id][r.start + r.n_chars :]
        assert [r.text for r in cut.orderBy("doc_id").collect()] == want
    assert secret_scan.scan_secrets(spark.createDataFrame([], DOCS), forest, ["doc_id"]).count() == 0


def test_forest_removes_false_positives(spark, forest):
    fresh = secret_scan.labelled_findings(spark, 130).withColumn("n", F.xxhash64("secret"))
    judged = forest.judged(fresh).agg(F.avg(((F.col("probability") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert judged >= 0.95


def test_secret_scan_is_native(spark, forest, docs):
    plan = secret_scan.scan_secrets(docs, forest, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- 9: HTML ----


def test_html_marked_article():
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two&nbsp;&lt;x&gt;<br>three &am</p><div class='comments'><p>me too</p></div><form>f</form></article><aside>side</aside><footer>&copy; f</footer>"
    assert html_text.main_text(page) == "A & B\n\none two <x>\n\nthree &am"


def test_html_names_of_frames():
    for names in ("ad", "top-nav", "siteFooter", "cookie_notice", "post comments", "related-posts"):
        assert html_text.names_frame(names), names
    for names in ("article-header", "with-sidebar", "content", "reading", "commentary", "entry-content has-footer"):
        assert not html_text.names_frame(names), names
    body = "<p>" + "Many words that belong to the article stand here. " * 5 + "</p>"
    page = f"<div class='page with-sidebar'><article class='post sidebar-left'><div class='entry-header'><h1>Head</h1></div>{body}</article></div><div id='sidebar'>{body}</div>"
    assert html_text.main_text(page).split("\n\n")[0] == "Head" and html_text.main_text(page).count("Many words") == 5


def test_html_by_density():
    para = "A long sentence of the article that goes on for a while, with words enough to be dense. " * 4
    page = "<body>" + "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(12)) + f"<h2>Title</h2><p>{para}</p><p>{para}</p><p>Short end of it, between long ones.</p><p>{para}</p>" + "".join(f"<span><a href='/{i}'>more {i}</a></span><br>" for i in range(12))
    got = html_text.main_text(page).split("\n\n")
    assert got == ["Title", para.strip(), para.strip(), "Short end of it, between long ones.", para.strip()]


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 30_000), (3, "u", "</p></div>&#x41;<b>b<i>"), (None, "u", "<script>x")], "page_id long, url string, html string").withColumns({"text": F.lit(1), "id": F.lit(2)})
    got = html_text.extract_text(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 2, 149_999]
    assert html_text.extract_text(rows.limit(0)).count() == 0


# ---- 10: mixing ----


def test_rake_meets_marginals():
    rng = random.Random(1)
    cells = [(s, t) for s in "abcd" for t in "xyz"]
    mass = np.array([rng.randrange(1, 1000) for _ in cells], float)
    w, error = mixing.rake(cells, mass, {"s": {"a": 0.4, "b": 0.1}, "t": 0.0})
    share = lambda d, c: sum(x for x, cell in zip(w, cells) if cell[d] == c) / w.sum()
    assert error < 1e-8 and share(0, "a") == pytest.approx(0.4) and share(0, "b") == pytest.approx(0.1) and share(1, "z") == pytest.approx(1 / 3)
    assert w.sum() == pytest.approx(mass.sum())


def test_rake_in_spark_is_the_same(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.choice("xy"), rng.randrange(50)) for i in range(400)]
    placed = spark.createDataFrame(rows, "k long, s string, t string, n_tokens long")
    targets = {"s": {"a": 0.5}, "t": 0.5}
    a, b = ({r.k: (round(r.weight, 4), r.copies) for r in mixing.mix(placed, targets, "k", driver_cells=n).collect()} for n in (1000, 0))
    assert a == b


def test_mixing(spark, docs):
    mixed = mixing.mix_documents(docs).collect()
    assert len(mixed) == docs.count()
    total = sum(r.n_tokens for r in mixed)
    assert sum(r.weight * r.n_tokens for r in mixed) == pytest.approx(total, rel=1e-6)
    assert all(r.copies in (int(r.weight), int(r.weight) + 1) for r in mixed)
    want = mixing.target_shares({c: float(sum(r.n_tokens for r in mixed if r.lang == c)) for c in {r.lang for r in mixed}}, 0.7)
    for c, share in want.items():
        assert sum(r.weight * r.n_tokens for r in mixed if r.lang == c) / total == pytest.approx(share, rel=1e-5)
    odd = mixing.mix_documents(frame(spark, [None, "", "a b c", "a b c d"])).collect()
    assert len(odd) == 4 and {r.n_tokens for r in odd} == {0, 3, 4}
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0
