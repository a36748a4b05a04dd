"""Approximate and learnt operators against brute force on small tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.llm import ann, html_extract, quality, queries, simhash, toxicity
from linkwell.llm.boosting import boost

SF = "/root/testdata/sf0.01"


def near_texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice((1, 2, 3, 60, 200)))]
        for _ in range(r.randint(1, 6)):
            w = base[:]
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice(("  ", " ", "\n")).join(w).title())
    return [*texts, "", None, " \t", "É é", "é É", "a\x0bb c d"]


def brute_fingerprint(text):
    import xxhash

    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_keys_meet_for_every_close_pair():
    golay = simhash.Golay()
    assert {int((row >= 0).sum()) for row in golay.errors} == {1, 6}
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << r.integers(0, 64, len(y)).astype(np.uint64)
    sides = []
    for fps, left in ((x, True), (y, False)):
        keys = defaultdict(set)
        for f, k in zip(*(a.tolist() for a in simhash._keys(fps.view(np.int64), golay, left))):
            keys[f].add(k)
        sides.append(keys)
    assert all(sides[0][a] & sides[1][b] for a, b in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist()))


def test_simhash(spark):
    texts = near_texts()
    df = spark.createDataFrame([(100 + i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, sha string")
    fps = [brute_fingerprint(t) for t in texts]
    expected = [(100 + i, f"{f:016x}", 100 + c) for i, (f, c) in enumerate(zip(fps, brute_components(fps)))]
    assert sorted(tuple(x) for x in simhash.simhash_components(df).collect()) == expected
    kept = {c for *_, c in expected}
    assert sorted(x.doc_id for x in simhash.keep_one(df).collect()) == sorted(kept)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    twice = df.union(df.where("doc_id = 100")).union(spark.createDataFrame([(None, "q r s t", 1, "x"), (None, texts[0], 1, "x")], df.schema))
    got = simhash.simhash_components(twice)
    assert got.count() == len(texts) + 3 and got.where("doc_id IS NULL AND component_id = 100").count() == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 3000), (5, 1000)]
    random.Random(2).shuffle(edges)
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.root for x in got} == {0} and {x.node for x in got} == set(range(1, 301)) | {1000, 2000, 3000}


def test_toxicity_finds_sentences():
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioubcdlmnr") for _ in range(r.randint(3, 7)))
    bad = ["blarg", "frobnik"]

    def text(toxic):
        s = [" ".join(word() for _ in range(8)) + "." for _ in range(r.randint(1, 12))]
        if toxic:
            w = s[k := r.randrange(len(s))].split()
            w.insert(3, r.choice(bad))
            s[k] = " ".join(w)
        return " ".join(s)

    labels = [int(r.random() < 0.3) for _ in range(600)]
    model = toxicity.fit([text(y) for y in labels], labels)
    for y in labels[:200]:
        t = text(y)
        score, spans = model.score(t)
        assert (score >= 0.7) == bool(y)
        assert not y or any(b in t[i:j] for i, j, _ in spans for b in bad)
        assert score == pytest.approx(1 - np.prod([1 - s for _, _, s in model.sentences(t)]), abs=1e-9)
        # the score by hand: the sentences' words and prefixes
        clean = 1.0
        for sentence in t.split(". "):
            z = model.settings.prior + sum(model.weights.get(f, 0) for w in {x.strip(".") for x in sentence.split()} for f in [w, *(w[:n] + "*" for n in range(3, min(9, len(w))))])
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert score == pytest.approx(1 - clean, abs=1e-9)
    assert model.score("") == (0.0, []) and model.score(" \n ") == (0.0, [])
    assert toxicity.fit(["a"], [1]).score("a b.")[0] < 0.7


def test_toxicity_gradient():
    r = np.random.default_rng(6)
    rows = [(int(r.random() < 0.5), int(r.integers(0, 5)), toxicity.Counter({tuple(sorted(r.integers(0, 6, r.integers(1, 4)).tolist())): int(r.integers(1, 4)) for _ in range(r.integers(0, 5))})) for _ in range(30)]
    s, bags, w = toxicity.Settings(prior=-2.0), toxicity.Bags.of(rows, 6), r.normal(size=6)
    gradient = toxicity.objective(w, bags, s)[1]
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        assert (toxicity.objective(w + step, bags, s)[0] - toxicity.objective(w - step, bags, s)[0]) / 2e-6 == pytest.approx(gradient[i], rel=1e-4, abs=1e-5)


def test_training_on_executors_equals_training_here(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for module, label, best in ((toxicity, "toxic", max), (quality, "quality", min)):
        y = defaultdict(list)
        for r in labels.collect():
            if r[label] is not None:
                y[r.doc_id].append(r[label])
        rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in y]
        rows.sort(key=lambda x: (x[0], __import__("hashlib").sha256(x[1].encode()).hexdigest()))
        here, there = module.fit([t for _, t in rows], [best(y[i]) for i, _ in rows]), module.train(docs, labels, F.lit(True))
        if module is toxicity:
            assert here.weights == pytest.approx(there.weights)
        else:
            assert here.terms == there.terms and np.allclose(here.vectors, there.vectors)


def test_training_sample_is_bounded(spark):
    from linkwell.llm.labelled import sample_rows

    rows = [(1, f"text {i}") for i in range(50)] + [(2, "same")] * 20 + [(3, "z" * 300_000), (None, "x"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (5, 1), (None, 1)], "doc_id long, y int")
    got = sample_rows(df, labels, F.lit(True), 1000, F.max, "doc_id", "text", "y").collect()
    assert len(got) == 53 and {(r.doc_id, r.y) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 0)} and max(len(r.text) for r in got) == 300_000
    assert sample_rows(df, labels, F.lit(True), 7, F.max, "doc_id", "text", "y").count() <= 7


# the rarer label of each: precision and recall of calling it, on a table that holds 18 toxic and 11 bad documents
@pytest.mark.parametrize("name, label, rare, precision, recall", [("op1_toxicity", "toxic", 1, 0.85, 0.7), ("op2_quality", "quality", 0, 0.85, 0.85)])
def test_learnt_queries_on_held_out_rows(spark, name, label, rare, precision, recall):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES[name](spark, SF)
    rows = got.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", F.col(label).alias("y")).collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows) and all(zlib.crc32(str(r.doc_id).encode()) % (3 if label == "toxic" else 5) == (1 if label == "toxic" else 0) for r in rows)
    called, true = [r for r in rows if r.predicted == rare], [r for r in rows if r.y == rare]
    both = sum(r.y == rare for r in called)
    print(name, len(rows), both / len(called), both / len(true))
    assert both >= precision * len(called) and both >= recall * len(true)


def test_voters_are_chosen_by_leaving_one_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = (x[:, 0] + rng.normal(scale=0.3, size=60) > 0.4).astype(float)
    s = quality.Settings(neighbours=(1, 4, 11))
    model = quality.Model({}, np.zeros(0), np.zeros((0, 4)), x, y, s)
    error = {}
    for m in s.neighbours:
        error[m] = 0
        for i in range(60):
            cos = np.round(x @ x[i], s.digits)
            cos[i] = -1
            near = cos >= np.sort(cos)[-m]
            w = np.where(near, np.maximum(cos, 0), 0) ** s.sharpness
            p = (w @ y) / w.sum() if w.sum() > 1e-9 else y.mean()
            error[m] += (p - y[i]) ** 2 / (y == y[i]).sum()
    assert model.choose_voters() == min(error, key=error.get)
    assert quality.Model({}, np.zeros(0), np.zeros((0, 4)), x, np.ones(60), s).choose_voters() == 11


def test_learnt_operators_edge_cases(spark):
    schema = "doc_id long, text string, score string, predicted int"
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "bad word. " * 40000, "x", 1), (3, "fine", "x", 1), (None, "bad", "x", 1)], schema)
    labels = spark.createDataFrame([(1, None, None), (3, 1, 0), (2, 0, 1), (2, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(df, labels, F.lit(True))
    assert toxicity.score(df, model).count() == 5 and toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.score(df, toxicity.train(df, labels.limit(0), F.lit(True))).where("score BETWEEN 0 AND 1").count() == 5
    for some in (labels, labels.limit(0)):
        m = quality.train(df, some, F.lit(True))
        assert quality.score(df, m).where("score BETWEEN 0 AND 1").count() == 5
    assert quality.score(df.limit(0), m).count() == 0


def test_quality_votes_are_exact():
    r = random.Random(9)
    texts = [" ".join(r.choice(("alpha", "beta", "gamma", "delta", "###", "ODD")) for _ in range(r.randint(1, 30))) for _ in range(120)]
    labels = [int("###" not in t) for t in texts]
    s = quality.Settings(neighbours=(7,), size=5, block=32, seen=1)
    m = quality.fit(texts, labels, s)
    v, y = m.vectorise(texts), np.array(labels, float)
    for i, got in enumerate(m.score(texts)):
        cos = np.round([sum(a * b for a, b in zip(v[i], u)) for u in m.vectors], 9)
        near = cos >= np.sort(cos)[-7]
        w = np.maximum(cos, 0) ** s.sharpness * near
        assert got == pytest.approx((w * y).sum() / w.sum() if w.sum() > 1e-9 else y.mean(), abs=1e-6)
    assert quality.token_terms("!!!!x##") == ("x", "\0!!##") and quality.token_terms("#" * 99) == ("\0##",)


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = boost(x, y, trees=30, depth=3)
    assert ((t.logits(x) > 0) == (y == 1)).mean() > 0.97 and len(t.logits(x[:0])) == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy this now. It is cheap.</div>
<article><h1>A  title &amp; more</h1><p>First&nbsp;paragraph with <b>bold</b> text, a comma.<p>Second &lt;one&gt;
goes on<br>here.</p><ul><li>item one<li>item two</ul><div class="share"><a href=/x>Tweet</a></div></article>
<div id="comments"><div class=comment><p>I liked it a lot, really.</p></div></div><footer>&copy; nobody</footer></body></html>"""


def test_html(spark):
    expected = "A title & more\nFirst paragraph with bold text, a comma.\nSecond <one> goes on here.\nitem one\nitem two"
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<<<>< a 'b \"c <div class='x"), (6, "u", "<!-- open <p>x</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == expected and got[1].n_chars == len(expected)
    assert got[2].text == got[3].text == "" and len(got) == 6 and html_extract.extract(df.limit(0)).count() == 0


def test_html_keeps_article_text_in_any_element():
    page = PAGE.replace("<ul><li>item one", "<p>The formula is <math><mi>E</mi> = <mn>m</mn></math> and &am<b>p;lt;</b> stays.<p>Seen <noscript>without scripts too, I say.</noscript></p><xmp>a <b> &amp; c</xmp><p>An icon <svg><title>no</title><text>ok</text></svg> here.<ul><li>item one")
    got = html_extract.fit().extract([page])[0].split("\n")
    assert got[3:7] == ["The formula is E = m and &amp;lt; stays.", "Seen without scripts too, I say.", "a <b> &amp; c", "An icon ok here."]
    hidden = html_extract.fit().extract([PAGE.replace("<article>", "<noscript>Please turn on scripts to use this site.</noscript><article><script>x</script><style>y</style><template>z</template><!-- c -->")])[0]
    assert hidden.startswith("A title") and not {"x", "y", "z", "c"} & set(hidden.split("\n"))


def test_html_on_the_tables(spark):
    """The pages' article element is the whole truth there."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inside = whole[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(filter(None, blocks))


def test_html_on_other_layouts():
    model, missed, extra, size = html_extract.fit(), 0, 0, 0
    for page in html_extract.training_pages(150, seed=77):
        got = set(model.extract([page.replace(html_extract.MARK, "")])[0].split("\n"))
        lines, marked, last = defaultdict(list), False, None
        for _, block, run, _ in html_extract.parse(page).runs:
            marked = html_extract.MARK in run or marked and block == last
            last = block if marked else last
            if marked:
                lines[block].append(run.replace(html_extract.MARK, ""))
        truth = {" ".join("".join(v).split()) for v in lines.values()} - {""}
        missed, extra, size = missed + len(truth - got), extra + len(got - truth - {""}), size + len(truth)
    assert missed / size < 0.03 and extra / size < 0.03


def test_decoding_is_consistent():
    page = html_extract.parse("<div><p>a</p><div><p>b</p></div></div>")
    r = np.random.default_rng(2)
    for _ in range(200):
        keep = html_extract.decode(page, r.normal(size=len(page.tag)))
        assert all(not keep[i] or keep[page.parent[i]] for i in range(1, len(keep)))


def brute_nearest(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = {}
    for q, a in ok:
        if q % step == 0:
            c = [(-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i) for i, b in ok if i != q]
            out[q] = sorted(c, key=lambda x: (round(x[0], 12), x[1]))[:k]
    return out


def test_ann_small_and_odd(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [1.0, None] * 4), (2200, [1.0]), (None, rows[1][1]), (5, rows[5][1]), (2250, [1e200] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = defaultdict(dict)
    for g in ann.nearest(df, F.col("id") % 50 == 0, 5).collect():
        got[g.query_id][g["rank"]] = (g.vec_id, g.score)
    expected = brute_nearest([(i, [x / 1e200 for x in v] if i == 2250 else v) for i, v in rows], 5, 50)
    assert set(got) == set(expected)
    hit = sum(len({v for v, _ in got[q].values()} & {i for _, i in expected[q]}) for q in expected)
    assert hit >= 0.98 * sum(map(len, expected.values()))
    assert [v for v, _ in (got[0][k] for k in range(1, 6))] == [1000, 1001, 1002, 1003, 1004]
    for q, ranks in got.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5] and all(v != q for v, _ in ranks.values())
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id IN (3, 4)"), F.lit(True)).count() == 2


def test_ann_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = defaultdict(set)
    for g in ann.nearest(df, F.col("id") % 50 == 0, 5).collect():
        got[g.query_id].add(g.vec_id)
    ids, v = zip(*[(r.vec_id, r.embedding) for r in df.collect()])
    u = np.array(v, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    for i, q in enumerate(ids):
        if q % 50 == 0:
            c = u @ u[i]
            c[i] = -2
            hits += len({ids[j] for j in np.argsort(-c)[:5]} & got[q])
            total += 5
    assert hits / total >= 0.9


def test_ann_search_ends_when_all_is_expanded(spark):
    # a chain: every list holds the next node and the one before, so node 12 is twelve steps away
    angle = np.arange(20) * 0.05
    v = np.stack([np.cos(angle), np.sin(angle)], 1)
    codes, rows = ann._codes(v), []
    for i in range(20):
        near = np.zeros((0 < i) + (i < 19), ann.entry(2))
        near["id"] = [j for j in (i - 1, i + 1) if 0 <= j < 20]
        near["code"] = codes[near["id"]]
        near["sim"] = ann.similarity(codes[i : i + 1], near["code"])[0]
        rows.append((i, codes[i].tobytes(), near.tobytes()))
    graph = spark.createDataFrame(rows, "id long, code binary, lists binary")
    found = {r.found for r in ann.search(graph, graph.where("id = 0"), 2).collect()}
    assert found >= set(range(13))


def ann_recall(spark, v, step=50, k=5, equal=False):
    """Share of the true neighbours found at the registered settings; every query must have all its ranks."""
    df = spark.createDataFrame([*enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for g in ann.nearest(df, F.col("id") % step == 0, k).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.vec_id, g.score))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(v), step):
        c = u @ u[q]
        c[q] = -2
        least = np.sort(c)[-k]
        assert len({i for i, _ in got[q]} - {q}) == k and all(abs(x - c[i]) < 1e-9 for i, x in got[q])
        hits += sum(c[i] >= least - 1e-12 for i, _ in got[q])
    return hits / (k * len(range(0, len(v), step)))


def test_ann_tight_cluster_and_isolated_query(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=16)
    assert ann_recall(spark, np.concatenate([[-base], base + r.normal(size=(2999, 16)) * 0.02])) >= 0.95


def brute_by_id(rows, queries, k):
    """Of ids with several vectors the nearest pair counts; an id is not its own neighbour."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in queries:
        best = {}
        for i in np.flatnonzero(ids == q):
            for j, c in enumerate(u @ u[i]):
                if ids[j] != q:
                    best[int(ids[j])] = max(best.get(int(ids[j]), -2), c)
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_ann_ids_with_several_vectors(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=8)
    rows = [(0, base + r.normal(size=8) * 1e-3) for _ in range(7)] + [(i, r.normal(size=8)) for i in range(1, 61)] + [(7, base + r.normal(size=8) * 0.1) for _ in range(9)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows] + [(0, rows[0][1].tolist()), (50, None)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for g in ann.nearest(df, F.col("id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.rank, g.vec_id, round(g.score, 9)))
    expected = brute_by_id(rows, (0, 50), 5)
    assert dict(got) == {q: [(k + 1, i, round(float(c), 9)) for k, (i, c) in enumerate(x)] for q, x in expected.items()}


def test_ann_crowd_of_one_code(spark, monkeypatch):
    """Vectors of one code are met in blocks, with the same answers; equal vectors among them."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    r = np.random.default_rng(9)
    v = np.concatenate([r.normal(size=16)[None] * (1 + r.random((700, 1))) + r.normal(size=(700, 16)) * 1e-5, r.normal(size=(300, 16))])
    v[100:140] = v[100]
    assert len(np.unique(ann._codes(v[:700]), axis=0)) < 20
    assert ann_recall(spark, v, step=10) >= 0.99


def test_ann_very_common_vector(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 16))
    v[1000:2000] = v[1000]
    assert ann_recall(spark, v) >= 0.95


def test_ann_many_vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 16))[r.integers(0, 300, 50_000)] * (r.random((50_000, 1)) < 0.5) + r.normal(size=(50_000, 16)) * 0.4
    assert ann_recall(spark, v, step=250) >= 0.9


def test_ann_messages_to_a_hub_are_read_in_part():
    rows = ann.Rows({"dst": np.array([1] * 6 + [2] * 3), "kind": np.array([-1, 0, 0, 0, 1, 1, -1, 1, 1]), "src": np.arange(9)}, [b"", b""])
    assert rows.read_part(2).parts["src"].tolist() == [0, 1, 2, 4, 5, 6, 7, 8]
    assert ann._thinned(np.array([7, 7, 8, 7]), np.array([3, 1, 2, 2]), 2).tolist() == [1, 3, 2]


def test_ann_many_near_copies(spark):
    # closer than a step of the codes: only the original vectors tell them apart
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=8) + r.normal(size=(600, 8)) * 3e-4, r.normal(size=(100, 8))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = defaultdict(dict)
    for g in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, 5).collect():
        got[g.query_id][g["rank"]] = g.vec_id
    assert len(got) == 14
    for i, ranks in got.items():
        c = (v @ v[i]) / np.linalg.norm(v, axis=1) / np.linalg.norm(v[i])
        c[i] = -2
        assert [ranks[n] for n in range(1, 6)] == np.argsort(-c)[:5].tolist()
