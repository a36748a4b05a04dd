"""Exact operators against brute force on small tables: exact copies, mixing, SentencePiece, sharding, chat."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkwell.llm import chat, exact_copies, mixing, queries, sentencepiece_codec, sharding
from linkwell.storage import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["a b c", "a b c", "a b c ", "", None, "x", "ü", "a\nb", "word " * 30000, "x", "a b c"]


def docs(spark, texts=TEXTS, sources=("s1", "s2", None)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(t)) for i in ids]
    return sorted(out, key=repr)


def test_exact_copies(spark):
    rows = [*enumerate(TEXTS), (None, "x"), (None, "lone"), (3, "other"), (5, "x")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, salt int")
    for digest in (exact_copies._sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)):  # the second collides
        got = exact_copies.exact_copies(df, salts=3, digest=digest).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_copies(rows)
    assert exact_copies.exact_copies(df.limit(0)).count() == 0


def test_drop_copies(spark):
    rows = [*enumerate(TEXTS), (3, "other"), (9, "x")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _id int, _sha int")
    got = exact_copies.drop_copies(df).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted({(i, t or "") for i, t in rows if i == max(j for j, u in rows if (u or "") == (t or ""))})


def test_drop_copies_of_rows_that_repeat(spark):
    """Null and empty texts are one text; of rows that repeat id and text the first by its other columns stays, whatever the order."""
    rows = [(1, None, "b"), (1, "", "a"), (1, "", None), (2, "x", "b"), (2, "x", "a"), (None, "n", "a"), (None, "n", "b"), (3, "y", "z")]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string, lang string").repartition(4)
        got = {(r.doc_id, r.text, r.lang) for r in exact_copies.drop_copies(df).collect()}
        assert got == {(1, "", "a"), (2, "x", "a"), (None, "n", "a"), (3, "y", "z")}
    assert exact_copies.drop_copies(df.limit(0)).count() == 0


def brute_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        lift = (total - sum(target.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * lift > most * sizes[s]]
        if not over:
            target |= {s: w[s] * lift for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice((0, 1, 3, 20, 90)))), r.choice(("b", "a", "é", None, "z", "z", "z"))) for i in range(3000)] + [(None, "one two", "z"), (7, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("digit", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        assert g._size == len(re.findall(r"[^\x20\x09-\x0D]+", g.text or "")) and 0 <= g._copies <= 2
        sizes[g.source] += g._size
        taken[g.source] += g._size * g._copies
        target[g.source] = g._target
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 90
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((g.doc_id or -1, g._copies) for g in again) == sorted((g.doc_id or -1, g._copies) for g in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_takes_repeated_rows_one_by_one(spark):
    texts = ["a b c d e f g h i j", "k l m n o"]
    rows = [(i % 2, texts[i % 2 if i < 60 else 0] + (f" {i}" if i >= 80 else ""), "s", 5) for i in range(100)] + [(None, "w w w", "t", 1)] * 30 + [(None, None, "t", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        sizes[g.source], taken[g.source], target[g.source] = sizes[g.source] + g._size, taken[g.source] + g._size * g._copies, g._target
    assert len(got) == len(rows) and {g.target for g in got} <= {1, 5}
    for s, expected in brute_targets(sizes).items():
        assert target[s] == pytest.approx(expected) and abs(taken[s] - target[s]) <= (5.5 if s == "s" else 1.5)


ODD = ["", " ", "  ", "a", " a  b ", "\n", "a\n\n b", "▁x ▁", "\x00\x01", "<s></s><unk>", "梦😀é", "\r\n\t;", "            deep", "x" * 5000, "日本語 text", "​", "a\u2028b"]


def test_codec_equals_the_library():
    codec = sentencepiece_codec.Codec(queries.tokenizer_model(), cached=50)
    r = random.Random(5)
    for text in [*ODD, *("".join(r.choice(["a", "the", " ", "  ", "\n", "▁", "É", "\x00", "</s>", "梦", "😀", "\t", "\r\n", "ing", "é", "0"]) for _ in range(r.randint(0, 15))) for _ in range(4000))]:
        ids = codec.encode(text)
        assert ids == " ".join(map(str, codec.library.encode(text)))
        assert codec.decode(f"{ids} 2".strip()) == codec.library.decode([*codec.library.encode(text), 2])
    codec.check()
    for _ in range(1000):
        ids = [r.choice([r.randrange(32000), r.randrange(259)]) for _ in range(r.randint(1, 6))]
        if 0 not in ids:
            assert codec.decode(" ".join(map(str, ids))).replace(" ", "") == codec.library.decode(ids).replace(" ", "")


def test_codec_notices_a_difference():
    codec = sentencepiece_codec.Codec(queries.tokenizer_model())
    codec.fresh.append(("▁the", "1 2 3"))
    with pytest.raises(RuntimeError, match="differ"):
        codec.check()


def test_codec_refuses_other_settings():
    model = queries.tokenizer_model()
    sentencepiece_codec.check_settings(model)
    for message, field, value in ((2, 3, b"\x01"), (3, 2, b"\x01x"), (3, 4, b"\x01")):  # unigram, a normaliser, white space removed
        tail = bytes([field << 3 | (2 if field == 2 else 0)]) + value
        with pytest.raises(ValueError, match="settings"):
            sentencepiece_codec.Codec(model + bytes([message << 3 | 2, len(tail)]) + tail)


def test_encode_decode(spark):
    df = docs(spark, [*TEXTS, *ODD]).withColumn("ids", F.lit(0))
    library = sentencepiece_codec.Codec(queries.tokenizer_model()).library
    for r in sentencepiece_codec.encode_decode(df, queries.tokenizer_model(), keep_ids=True, keep_text=True).collect():
        text = [*TEXTS, *ODD][r.doc_id] or ""
        ids = [*library.encode(text), 2]
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, sha(" ".join(map(str, ids)))) and r.decoded_sha256 == sha(r.decoded) and r.decoded == library.decode(ids)
    assert sentencepiece_codec.encode_decode(df.limit(0), queries.tokenizer_model()).count() == 0


def test_sharding(spark):
    df = docs(spark, [*TEXTS, *(f"text {i}" for i in range(500))]).withColumn("_arrival", F.lit("x"))
    store = sharding.ShardStore(spark, scratch_path(spark, "t"), df.schema, target_bytes=40_000, fanout=3, smallest=4_000)
    assert store.read().count() == 0 and store.version() == 0
    store.append(df.limit(0))
    assert store.version() == 0
    assert store.append(df, F.col("doc_id") % 6) == 6
    assert store.append(df.where("doc_id < 5")) == 7
    before = store.shards()
    store.compact()
    after = store.shards()
    assert len(after) < len(before) and not store.plan(after)
    assert sum(len(t) for t in [store.shards(7)]) == len(before)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(store.read()) == key(df.union(df.where("doc_id < 5")))
    with pytest.raises(FileExistsError):  # another writer took the version
        store.commit(after, [], store.version() - 1)
    assert store.shards() == after
    assert store.vacuum() == 0 and store.vacuum(keep=1, least_age=0) > 0 and key(store.read()) == key(df.union(df.where("doc_id < 5")))


def test_shard_sizes_and_other_writers(spark, monkeypatch):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    target = 1 << 20
    new = lambda: sharding.ShardStore(spark, root, df.schema, target_bytes=target, fanout=4, smallest=1 << 15)
    root = scratch_path(spark, "t")
    store, other = new(), new()
    store.append(df, F.pmod("doc_id", F.lit(40)))
    assert store.version() == 40
    # while one compacts, another appends: both changes stand
    merge = sharding.ShardStore._merge
    added = []

    def late(self, run):
        out = merge(self, run)
        if not added:
            added.append(other.append(df.limit(10)))
        return out

    monkeypatch.setattr(sharding.ShardStore, "_merge", late)
    store.compact()
    monkeypatch.undo()
    store.compact()
    sizes = sorted(s.bytes for s in store.shards())
    assert store.read().count() == 60_010 and not store.plan(store.shards())
    whole = sum(sizes)
    assert max(sizes) <= 2 * target and sum(s for s in sizes if s >= target // 2) > 0.8 * whole
    # a shard that is gone cannot be removed again, and the loser's files go
    gone = store.shards(40)[0]
    assert store._change([], [gone]) is None
    assert store.read(17).count() < store.read(40).count() == 60_000


CHAT = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]", "", None, "a\nb \\", "[/INST", "<s", "[OUT][ROLE]x[/ROLE]", "é😀" * 700]


def test_escaping():
    r = random.Random(6)
    for _ in range(5000):
        s = "".join(r.choice(["\\", " ", "x", *chat.CONTROLS, "<s", "INST]"]) for _ in range(r.randint(0, 8)))
        assert chat.unescape(chat.escape(s)) == s
        for role in ("user", "assistant", s):
            chunk, start, size = chat.render(role, s)
            assert chat.read_chunk(chunk) == (role, s)
            assert (chat.unescape(chunk[start : start + size]) == s) if role == "assistant" else size == 0


def test_chat(spark):
    r = random.Random(7)
    rows = [(c, t, r.choice(("user", "assistant", "system", None, "tool [INST]")), r.choice(CHAT)) for c in range(6) for t in range(r.choice((1, 5, 150)))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, "user", "n"), (1, None, "assistant", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {g.conv_id: g for g in chat.read_back(chat.format_events(chat.events_of(df, piece=7))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        mine = got[c]
        assert mine.n_turns == len(turns)
        assert mine.turns_sha256 == sha("".join(f"{x[3]}\n{x[5]}\n" for x in turns))
        loss = "".join(x[5] for x in turns if x[3] == "assistant")
        assert (mine.loss_chars, mine.loss_sha256) == (len(loss), sha(loss))
        assert mine.formatted_chars == sum(len(chat.render(x[3], x[5])[0]) for x in turns)
    assert chat.read_back(chat.format_events(chat.events_of(df.limit(0)))).count() == 0


def test_chat_ids_of_other_types(spark):
    rows = [(1, 0, "user", "a" * 70_000 + "[INST]"), (1, 1, "assistant", "b</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.events_of(df)
    assert {e.kind for e in chat.events_of(spark.range(99).selectExpr("id conv_id", "id turn", "'user' role", "repeat(id, 9) text"), piece=4).collect()} == {"start", "delta", "regenerate", "edit"}
    expected = [tuple(r)[1:] for r in chat.read_back(chat.format_events(events)).collect()]
    assert expected[0][1] == sha(f"user\n{rows[0][3]}\nassistant\nb</s>\n")
    for kind in ("short", "string", "decimal(9,2)", "date", "binary"):
        value = F.lit("2020-01-02").cast(kind) if kind in ("date", "binary") else F.col("conv_id").cast(kind)
        assert [tuple(r)[1:] for r in chat.read_back(chat.format_events(events.withColumn("conv_id", value))).collect()] == expected


def test_events_are_folded(spark):
    log = [(1, 0, 1, "start", "user", None), (1, 0, 2, "delta", None, "he"), (1, 0, 3, "delta", None, "llo"), (1, 1, 4, "start", "assistant", "bad"), (1, 1, 5, "regenerate", None, None),
           (1, 1, 6, "delta", None, "good"), (1, 0, 7, "edit", None, "hi"), (1, 2, 8, "delta", "user", "late")]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = chat.format_events(df).orderBy("place").collect()
    assert [chat.read_chunk(g.chunk) for g in got] == [("user", "hi"), ("assistant", "good"), ("user", "late")]
    with pytest.raises(Exception, match="unknown event"):
        chat.format_events(df.withColumn("kind", F.lit("shout"))).collect()
