"""Merkle manifest, MinHash near copies and divergence audit against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwell.llm import divergence, merkle, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return sha(*map(written, (row[0], row[3], row[2], row[4], text)))


def tree(leaves):
    """Root, and for each leaf its siblings level by level."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for at in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            first = at - at % 3
            proof.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
            at //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        altered = r[1]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and altered is not None:
            altered = altered.replace("\n", "")
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, altered), r[0]))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in order}
    root, crown = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, crown, strict=True):
        for x, proof in zip(sorted(by_source[s]), trees[s][1], strict=True):
            whole, at = proof + above, x[3]
            for left, right in whole:
                at = sha(left, at, right)
            out.append((x[4], x[2], trees[s][0], root, sha(*(p + q for p, q in whole)), at, at == root))
    return sorted(out, key=repr)


def manifest(df):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": altered})
    out = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("altered_leaf"), F.col("proof")).alias("folded"))
    return sorted(map(tuple, out.withColumn("ok", F.col("folded") == F.col("root")).collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    texts = ["a\nb", None, "", "ü\n", "word\n" * 40000, "plain", "a\nb"]
    rows = [(i, texts[i % 7], ("en", None)[i % 2], (None, "", "s", "ß", "only once" if i == 4 else "s")[i % 5], None if i % 4 == 0 else i) for i in range(40)]
    rows += [rows[3], rows[3], (None, "x\n", None, "s", 1), (None, "y", None, "s", 1), (7, "another text\n", "en", "s", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert manifest(df) == brute_manifest(rows)
    clashing = df.withColumns({c: F.lit("x") for c in ("grp", "pos", "hash", "level", "block", "leaf", "_row", "n")})
    assert manifest(clashing) == brute_manifest(rows)
    assert manifest(df.limit(0)) == []
    assert manifest(df.where("source = 'only once'").limit(1)) == brute_manifest([r for r in rows if r[3] == "only once"][:1])


def test_manifest_of_several_passes(spark):
    """A group of more leaves than two passes of small blocks hold, beside groups that end at every height."""
    rows = [(i, f"t{i}\n", "en", "hot", i) for i in range(4400)] + [(10_000 + i, "t", "en", f"s{i % 40:02}", i) for i in range(3 * 40 - 17)] + [(20_000 + i, "t", "en", "block", i) for i in range(2187)]
    random.Random(5).shuffle(rows)
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows)


def test_manifest_survives_small_blocks(spark, monkeypatch):
    """Blocks of nine leaves: many passes."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    for n in (1, 3, 10, 82, 250):
        rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else None, i) for i in range(n)]
        assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute_manifest(rows), n


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append({" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def brute_near(rows):
    sets = word_sets([t for _, t in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = defaultdict(list)
    for (i, _), x in zip(rows, label, strict=True):
        least[x].append(i)
    smallest = {x: min((i for i in ids if i is not None), default=None) for x, ids in least.items()}
    return sorted(((i, len(s), smallest[x], i == smallest[x]) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=repr)


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, minhash.minhash_components(df).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice(("new", "other")) + str(rng.random()) if rng.random() < share else w for w in words]


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \t", "one", "One", "one two three", "ONE two three", "a b c d e f g h i j k", "a b c d e f g h i j x", "É a b c d", "é a b c d", long, long + " end", "a b c d " * 50, "a b c d a"]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "another text of five words"), (None, "one"), (None, "only null ids"), (None, "only null ids"), (None, None)]
    assert near(spark, rows) == brute_near(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "sig", "pool", "n", "key", "digest")})
    assert sorted(map(tuple, minhash.minhash_components(df).collect()), key=repr) == brute_near(rows)
    assert minhash.minhash_components(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        minhash.minhash_components(df, percent=50)


def test_near_copies_around_the_threshold(spark):
    """Families of many distances from their origin: links that only members share, not the origin."""
    rng, rows = random.Random(3), []
    for family in range(25):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.choice((12, 40, 150)))]
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.05, 0.08):
            once = edited(rng, base, share)
            rows += [(len(rows), " ".join(once)), (len(rows) + 1, " ".join(edited(rng, once, 0.02)))]
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(1000 + i, common + " " + " ".join(f"{i}x{j}" for j in range(rng.choice((5, 20, 60))))) for i in range(60)]
    rng.shuffle(rows)
    assert near(spark, rows) == brute_near(rows)


def test_near_copies_of_a_crowd(spark, monkeypatch):
    """One crowd in many tiles: blocks of 16 nodes."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((0.01, 0.03, 0.05, 0.07))))) for i in range(260)]
    assert near(spark, rows) == brute_near(rows)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (400, minhash.MINIMA)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.MINIMA, minhash.MOST_ERRORS, replace=False)
        row[at] = row[at] ^ np.uint16(1)
    assert (minhash.keys(a) == minhash.keys(b)).any(1).all()


def brute_audit(rows, least, top=10):
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for text, lang, source in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for la, s in counts if la == lang]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            d = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // d for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


@pytest.mark.parametrize("chunk, block, segment", [(4096, 16, 64), (3, 2, 1), (5, 3, 2)])
def test_audit(spark, monkeypatch, chunk, block, segment):
    for name, v in (("CHUNK", chunk), ("BLOCK", block), ("SEGMENT", segment), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(6)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x-ray", "d'or", "naïve", "日本", "B2B", "ǅ", "i̇", *"abcdefgh"]
    rows = [(" ".join(rng.choices(words, weights=[rng.random() ** 3 + 0.01 for _ in words], k=rng.randrange(30))), rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "ß", "Z", None, "", "s3"))) for _ in range(150)]
    rows += [(None, "en", "silent"), ("1 2 3 ___", "lone", "x"), ("few words", "rare", "a"), ("few words", "rare", "b"), ("long " * 50000, "en", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "n", "block", "chunk", "total")})
    assert sorted(map(tuple, divergence.audit(df, least_docs=4).collect())) == brute_audit(rows, 4)
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_beyond_64_bits(spark):
    n, total = 5 * 10**12, 9 * 10**12 + 7
    assert divergence._shares(np.array([n, 3]), total).tolist() == [1 + 10**9 * (n + 2) // total, 1 + 10**9 * 5 // total]
    row = spark.sql(f"SELECT CAST({n} AS BIGINT) AS n, CAST({total} AS BIGINT) AS total").select(F.expr(divergence._share("n", "total"))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // total
