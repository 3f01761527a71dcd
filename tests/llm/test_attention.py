"""The attention model against plain computations, and its counts against brute force."""

import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import attention_lm as lm
from lodestone.llm.byte_bpe import ByteBPE
from lodestone.llm.text import lower_ascii

BPE = public_tokenizers.path("byte_bpe_50k.json")


def small():
    vocab = lm.Vocabulary({i: 50 - i for i in range(50)}, 64)
    r = np.random.default_rng(0)
    pairs = np.zeros((lm.SLOTS + 1, lm.SLOTS))
    pairs[:51, :51] = r.integers(0, 9, (51, 51))
    p = lm.init()
    p["pair"] += (0.1 * r.standard_normal(p["pair"].shape)).astype(np.float32)
    group, within = lm.neighbour_bias(pairs, vocab)
    return vocab, p, (group, within.astype(np.float32)), r


def plain(p, bias, slots):
    """Natural log of each token's probability, one token at a time in float64."""
    p = {n: a.astype(np.float64) for n, a in p.items()}
    out = []
    for t, goal in enumerate(slots):
        begin = t // lm.STRIDE * lm.STRIDE - lm.CONTEXT  # of the window that scores the token
        e = []
        for place, at in enumerate(range(begin, t + 1)):
            own = lm.START if at == 0 else slots[at - 1] if at > 0 else None
            if own is None:
                continue
            last = lm.START if at <= 1 or place == 0 else slots[at - 2]
            e.append(p["emb"][own] + p["pair"][(last * 1_000_003 + own * 7919) % lm.PAIRS] + p["pos"][place])
        e = np.array(e)
        s = (e[-1] @ p["q"]) @ (e @ p["k"]).T / np.sqrt(lm.DIM)
        a = np.exp(s - s.max())
        c = (a / a.sum()) @ (e @ p["v"])
        h = np.maximum(np.concatenate([e[-1], c @ p["o"]]) @ p["f1"] + p["b1"], 0) @ p["f2"] + e[-1]
        before = lm.START if t == 0 else slots[t - 1]
        g, w = divmod(int(goal), lm.WIDE)
        first, second = h @ p["g"] + bias[0][before], h @ p["w"][g] + bias[1][before, g]
        out.append(first[g] - np.log(np.exp(first).sum()) + second[w] - np.log(np.exp(second).sum()))
    return np.array(out)


def test_bpe_equals_the_tokenizer(rows):
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(BPE), ByteBPE(BPE)
    more = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " " * 20_000 + "x", "\n " * 9000, "é" * 5000, "12 345's ’s  x"]
    for text in [r[1] or "" for r in rows] + more:
        assert np.frombuffer(mine.encode_bytes(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_by_words_equals_the_tokenizer(rows):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestone.llm.word_bpe import WordBPE

    r, t, words = random.Random(5), Tokenizer.from_file(BPE), WordBPE(ByteBPE(BPE))
    atoms = ["a", "the", "'s", "'ll", "é", "日", "12", " ", " ", "  ", "\n", "\r\n", "\u3000", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endof", "!?", "\u200b", "😀", "\x00", " " * 9]
    texts = [x[1] or "" for x in rows] + ["".join(r.choices(atoms, k=r.randint(0, 12))) for _ in range(5000)]
    texts += ["a" + " " * 20_000 + "x b", "\n " * 9000, "x" * 30_000, "é" * 5000 + " y", "", "a " * 9000]
    for i in range(0, len(texts), 700):
        part = texts[i : i + 700]
        ids, where, numbers, places = words.encode(pa.array(["z", *part]).slice(1))
        known = words.words.to_pylist()
        for j, text in enumerate(part):
            assert ids[where[j] : where[j + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text[:50]
            assert [known[n][1:] for n in numbers[places[j] : places[j + 1]]] == text.encode().split()


def test_words_are_encoded_once():
    import pyarrow as pa

    from lodestone.llm.word_bpe import WordBPE

    bpe, seen = ByteBPE(BPE), []
    words = WordBPE(bpe)
    ordinary = bpe.ordinary
    bpe.ordinary = lambda text: seen.append(text) or ordinary(text)
    for _ in range(3):
        words.encode(pa.array(["one two three\nfour two"] * 50))
    assert sum("two" in text for text in seen) == 1


def test_steps_and_scores_reuse_their_pages():
    import resource

    _, p, bias, r = small()
    lm.keep_pages()
    windows = lm.Windows([r.integers(0, 50, 20_000).astype(np.int32)])
    trainer, bias = lm.Trainer(p, bias), (bias[0], bias[1].astype(np.float32))
    batches = [windows.take(np.arange(at, at + lm.STEP)) for at in range(0, 1000, lm.STEP)]

    def faults(work):
        for b in batches:
            work(b)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for b in batches:
            work(b)
        return (resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / len(batches)

    assert faults(lambda b: trainer.step(b, 0.6)) < 100  # 740 before
    assert faults(lambda b: lm.score_windows(p, bias, *b[:4])) < 100


def test_windows_score_each_token_once():
    texts = [np.arange(n).astype(np.int32) for n in (1, 16, 0, 17, 24, 300)]
    x, pad, target, use, text = lm.Windows(texts).take(np.arange(len(lm.Windows(texts))))
    got = Counter((int(o), int(t)) for o, row, u in zip(text, target, use) for t in row[u])
    assert got == Counter((i, int(t)) for i, a in enumerate(texts) for t in a)
    assert not (pad & use).any() and (x[use & (target == 0)] == lm.START).all()


def test_scores_equal_a_pass_token_by_token(monkeypatch):
    vocab, p, bias, r = small()
    ids = [r.integers(0, 60, n) for n in (1, 5, 300, 40, 1, 90)]
    want = [plain(p, bias, vocab.slot[i]).sum() / np.log(10) + vocab.extra[i].sum() for i in ids]
    scorer = lm.Scorer(p, bias, vocab)
    np.testing.assert_allclose(scorer.score(ids), want, rtol=1e-4)
    monkeypatch.setattr(lm, "BATCH", 3)  # a long text in pieces
    np.testing.assert_allclose(scorer.score(ids), want, rtol=1e-4)


def test_gradients():
    _, p, bias, r = small()
    p = {k: a.astype(np.float64) for k, a in p.items()}
    windows = lm.Windows([r.integers(0, 50, 60).astype(np.int32)])
    batch = windows.take(np.arange(len(windows)))[:4]
    _, grads = lm.gradients(p, bias, *batch)
    for name, g in grads.items():
        if name in lm.SPARSE:
            dense = np.zeros_like(p[name])
            dense[g[0]] = g[1]
            g = dense
        at = np.unravel_index(np.abs(g).argmax(), p[name].shape)
        p[name][at] += 1e-5
        up = lm.gradients(p, bias, *batch)[0]
        p[name][at] -= 2e-5
        down = lm.gradients(p, bias, *batch)[0]
        p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=2e-2, abs=1e-5), name


def test_gradients_are_the_same_in_place_and_copied_together(monkeypatch):
    _, p, bias, r = small()
    windows = lm.Windows([r.integers(0, 50, n).astype(np.int32) for n in (300, 5, 90, 1)])
    batch = windows.take(np.arange(len(windows)))[:4]
    use = batch[3][:, lm.CONTEXT :].ravel()
    got = []
    for own in ((slice(None), np.flatnonzero(~use)), (np.flatnonzero(use), np.zeros(0, int))):
        monkeypatch.setattr(lm, "_places", lambda use, own=own: own)
        got.append(lm.gradients(p, bias, *batch))
        got[-1] = [got[-1][0], lm.score_windows(p, bias, *batch), *(g[1] if n in lm.SPARSE else g for n, g in got[-1][1].items())]
    for a, b in zip(*got):
        np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-6)


def test_one_pass_in_chunks(monkeypatch):
    _, p, bias, r = small()
    monkeypatch.setattr(lm, "TOKENS", 100)
    texts = [np.arange(n).astype(np.int32) % 50 for n in r.integers(1, 200, 600)]
    windows = lm.Windows(texts[:50])
    batch = windows.take(np.arange(len(windows)))[:4]
    before, taught = lm.gradients(p, bias, *batch)[0], lm.Pass(p, bias, 2)
    for t in texts:
        taught.add(t)
        assert taught.held < 100
    taught.flush()
    every = sum(-(-len(t) // lm.STRIDE) for t in texts)
    assert taught.windows == every and taught.trainer.seen == -(-every // lm.SHARE)
    assert lm.gradients(p, bias, *batch)[0] < before


def test_a_pass_learns_from_every_position():
    _, p, bias, r = small()
    texts = [r.integers(0, 50, n).astype(np.int32) for n in (1, 16, 0, 17, 300, 5)]
    taught = lm.Pass(p, bias, 2)
    for t in texts:
        taught.add(t)
    taught.flush()
    assert taught.trainer.seen == sum(-(-len(t) // lm.STRIDE) for t in texts)
    windows = lm.Windows(texts)
    assert taught.trainer.touched.sum() == windows.take(np.arange(len(windows)))[0].size


def test_models_are_averaged_by_weight(spark):
    r, n = np.random.default_rng(1), 2 * lm.FAN + 5  # two rounds
    vec, weight = r.random((n, 6)).astype(np.float32), r.random((n, 3)).astype(np.float32)
    parts = spark.createDataFrame([(i, 0, bytearray(v.tobytes()), bytearray(w.tobytes())) for i, (v, w) in enumerate(zip(vec, weight))], "part long, chunk int, vec binary, weight binary")
    (got,) = lm.averaged(parts, spark).collect()
    np.testing.assert_allclose(np.frombuffer(got["vec"], np.float32), (vec * (wide := weight.repeat(2, axis=1))).sum(0) / wide.sum(0), rtol=1e-5)


@pytest.mark.parametrize("piece", [lm.PIECE, 40])  # also with words spread over many pieces
def test_counts(spark, docs, rows, empty, piece, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", piece)
    monkeypatch.setattr(lm, "WARM_PASSES", 1)
    tokens = lm.tokenized(docs, BPE)
    assert tokens.filter("ids IS NOT NULL").count() == len(rows)
    got, total = lm.base_scores(tokens, tokens.filter("learn").count())
    named = tokens.filter("ids IS NOT NULL").select("piece", "at", "doc_id").join(got, ["piece", "at"]).collect()
    counts = Counter()
    for i, t, *_ in rows:
        if i is not None and not lm.held_out(i):
            counts.update([*lower_ascii(t).split(), None])
    n, kinds = sum(counts.values()), len(counts)
    text = {i: t for i, t, *_ in rows}
    assert len(named) == len(rows) and total == n
    for r in named:
        w = [*lower_ascii(text[r["doc_id"]]).split(), None]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (n + kinds + 1)) for x in w))


def test_words_travel_packed(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "BUCKETS", 8, raising=False)
    tokens = lm.tokenized(docs, BPE)
    words = tokens.filter("ids IS NULL AND id IS NULL").collect()
    assert len(words) <= 8 * docs.rdd.getNumPartitions()  # one row per word before
    assert len({r["hashes"][i : i + 16] for r in words for i in range(0, len(r["hashes"]), 16)}) == len({w for _, t, *_ in rows for w in lower_ascii(t).split()})
    learn = [i is not None and not lm.held_out(i) for i, *_ in rows]
    assert sum(np.frombuffer(r["times"], np.int64).sum() for r in words) == sum(len(lower_ascii(t).split()) for (_, t, *_), l in zip(rows, learn) if l)


def test_score(docs, rows, empty):
    got = lm.score(docs, BPE).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r["score"] < 0 and r["held_out"] == (r["doc_id"] is not None and lm.held_out(r["doc_id"])) for r in got)
    twice = [r["score"] for r in got if r["doc_id"] in (0, 170)]
    assert max(twice) - min(twice) < 1e-3  # equal texts
    assert lm.score(empty, BPE).isEmpty()


def test_neighbours_against_brute_force(spark, docs, rows):
    tokens, bpe = lm.tokenized(docs, BPE), ByteBPE(BPE)
    vocab = lm.Vocabulary({i: 300 - i for i in range(300)}, 65537)
    got = lm.neighbours(tokens.filter("learn"), spark.sparkContext.broadcast(vocab), 65537)
    want = Counter()
    for i, t, *_ in rows:
        if i is not None and not lm.held_out(i):
            slots = [vocab.slot[x] for x in [*bpe.ids(lower_ascii(t).decode()), 65536]]
            want.update(zip([lm.START, *slots[:-1]], slots))
    assert got.sum() == sum(want.values()) and all(got[a, b] == c for (a, b), c in want.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_model_beats_the_base_where_all_words_are_known(spark):
    got = lm.query(spark, "/root/testdata/sf0.01").filter("n_known = n_tokens").groupBy("held_out").sum("score", "base_score").collect()
    assert len(got) == 2 and all(r["sum(score)"] > r["sum(base_score)"] for r in got)
