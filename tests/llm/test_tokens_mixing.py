import random

import pytest

from loomline.llm import mixing
from loomline.llm.batches import slices
from loomline.llm.lexicon import Lexicon, compile_lexicon
from loomline.llm.tokens import Merger, default_vocabulary, encode


def test_lexicon(tmp_path):
    r = random.Random(1)
    words = {bytes(r.choice(b"abc\xff") for _ in range(r.randrange(1, 7))): [r.randrange(50000) for _ in range(r.randrange(1, 4))] for _ in range(500)}
    path = tmp_path / "lex"
    path.write_bytes(compile_lexicon(words))
    lex = Lexicon(str(path))
    probe = [*words, b"", b"zzz", b"abcabcabc", *[w + b"a" for w in words]]
    for w, i in zip(probe, lex.find(probe).tolist()):
        assert (lex.ids_of(i) if i >= 0 else None) == words.get(w)
    assert len(lex.final) < sum(len(w) for w in words) / 2  # suffixes are shared
    # minimal: no two states have the same continuations
    arcs = {}
    for key, t in zip(lex.keys.tolist(), lex.target.tolist()):
        arcs.setdefault(key // 256, []).append((key % 256, t))
    signs = [(f, tuple(arcs.get(s, ()))) for s, f in enumerate(lex.final.tolist())]
    assert len(set(signs)) == len(signs)
    path.write_bytes(compile_lexicon({}))
    assert Lexicon(str(path)).find([b"a", b""]).tolist() == [-1, -1]


TEXTS = [
    None, "", " ", "  \n\t x ", "Hello world's 'll I'LL", "<|endoftext|> a<|endoftext|>", "naïve café été 漢字テスト 🚀👩🏽‍💻", "tab\there\r\nnew\x1cline\x85 end\u3000wide", "a" * 5000, "don't 123abc ４５６ Ⅷ x²", "\u200b\ufeff ﬁne", "foo  bar   baz\n\n\n", "    indented\n\treturn x", "²³", "\x1c\x1d",
]


def test_encode_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("aeB 1_.-\n\té漢'\r") for _ in range(r.randrange(60))) for _ in range(300)] + ["frequent word " * 30] * 3
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "id int, text string, ids string")
    got = {x.id: x.ids for x in encode(df, "text", ["id"]).collect()}
    lengths = {x.id: x.n_tokens for x in encode(df, "text", ["id"], lengths_only=True).collect()}
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == want and lengths[i] == len(want), repr(x)
    assert encode(df.limit(0), "text", ["id"]).count() == 0


def test_slices():
    import pyarrow as pa

    texts = ["é" * 3, None, "", "x" * 50, "a", "b" * 9, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    got = [b.column(1).to_pylist() for b in slices(iter([batch, batch.slice(0, 0)]), 1, 10)]
    assert got == [["é" * 3, None, ""], ["x" * 50], ["a", "b" * 9], ["c"]]


def test_merger_keeps_bytes():
    m = Merger.of(default_vocabulary())
    by_id = {i: b for b, i in m.ranks.items()}
    for text in filter(None, TEXTS):
        assert b"".join(by_id[i] for w in m.words(text) for i in m.ids(w.encode())) == text.encode()


def test_pfair_deviation():
    for weights in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05], [1.0], [0.41, 0.33, 0.13, 0.08, 0.05]):
        n = 400
        sources = [mixing.Source(f"s{i}", w, round(w * n)) for i, w in enumerate(weights)]
        got = dict.fromkeys((s.name for s in sources), 0)
        for slot, name, block in mixing.pfair(sources):
            assert block == got[name]
            got[name] += 1
            for s in sources:
                assert abs(got[s.name] - s.weight * (slot + 1)) < 1 + 1e-6
        assert got == {s.name: s.blocks for s in sources}


def test_pfair_ends():
    """At the first block that is missing; or, with a total, at the total, sources that are used up having left."""
    a, b, c = mixing.Source("a", 0.5, 1000), mixing.Source("b", 0.3, 30), mixing.Source("c", 0.2, 1000)
    count = lambda order: {s: sum(x[1] == s for x in order) for s in "abc"}
    got = count(mixing.pfair([a, b, c]))
    assert got["b"] == 30 and abs(got["a"] - 50) <= 1 and abs(got["c"] - 20) <= 1
    order = mixing.pfair([a, b, c], 700)
    got = count(order)
    assert len(order) == 700 and got["b"] == 30 and abs(got["a"] - (50 + 600 * 5 / 7)) <= 2
    assert [x[2] for x in order if x[1] == "a"] == list(range(got["a"]))
    assert count(mixing.pfair([a, b, c], 10**6)) == {"a": 1000, "b": 30, "c": 1000}
    assert mixing.pfair([], 5) == [] and mixing.pfair([mixing.Source("a", 1.0, 0)]) == []


def test_live_sources():
    q = mixing.live_sources({"a": 1000, "b": 10}, [("a", 0.5, 1), ("b", 0.3, 2), ("gone", 0.1, 3), ("zero", 0.0, 1), (None, 0.1, 1)])
    assert {s: (round(w, 9), c) for s, (w, c) in q.items()} == {"a": (0.625, 1000), "b": (0.375, 20)} and mixing.live_sources({}, [("a", 1.0, 1)]) == {}


def test_the_schedule_decides(spark, monkeypatch):
    """Another order of the same blocks gives another mixture: what is scheduled goes out, nothing else."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(400)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    mix = lambda: {r.doc_id for r in mixing.mixture(mixing.copies(docs, targets)).collect()}
    fair = mix()
    assert sum(i % 2 == 0 for i in fair) == 200 and abs(sum(i % 2 for i in fair) - 50) <= 1
    monkeypatch.setattr(mixing, "pfair", lambda sources, slots=None: [(k, s.name, k) for s in reversed(sources) for k in range(s.blocks)][:250])
    assert mix() != fair


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 6 + ["b", "b", "c", None, "other"]), r.choice([0, None, *range(1, 60)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.2, 4), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    placed = mixing.copies(docs, targets).persist()
    mix = mixing.mixture(placed).collect()
    most = {"a": 1, "b": 3, "c": 4}
    assert all(1 <= m.repeats <= most[m.source] and m.n_tokens > 0 for m in mix) and len({m.doc_id for m in mix}) == len(mix)
    total = sum(m.repeats * m.n_tokens for m in mix)
    share = {x.source: x.actual_share for x in mixing.shares(placed, targets).collect()}
    for s, want in (("a", 0.4 / 0.95), ("b", 0.35 / 0.95), ("c", 0.2 / 0.95)):
        assert abs(sum(m.repeats * m.n_tokens for m in mix if m.source == s) / total - want) < 120 / total and abs(share[s] - want) < 120 / total
    assert share["none"] == 0
    left = [most[s] * sum(n for _, x, n in rows if x == s and n) - sum(m.repeats * m.n_tokens for m in mix if m.source == s) for s in most]
    assert min(left) < 60  # one source is used up
    # what has gone out at any slot is close to the shares
    out = {}
    for x in sorted(placed.collect(), key=lambda x: x.slot):
        out[x.source] = out.get(x.source, 0) + x.n_tokens
        gone = sum(out.values())
        assert all(abs(out.get(s, 0) - w / 0.95 * gone) < 3 * 60 for s, w in (("a", 0.4), ("b", 0.35), ("c", 0.2)))
    assert mixing.mixture(mixing.copies(docs.limit(0), targets)).count() == 0
