"""Operators of the llm subpackage against brute force, on texts with nulls, blanks, copies and long rows."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, packing, quality, rollup, sentencepiece_bpe, sharding, simhash, topk, warc
from lodestone.llm.byte_bpe import ByteBPE
from lodestone.llm.scratch import folder, path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("targets", [None, {"s0": 1, "s1": 3, "": 1}, packing.tempered])
def test_packing(docs, rows, targets):
    got = packing.pack(docs, BPE, 64, targets).toPandas()
    got = got.sort_values(["sequence_id", "offset"])
    for _, s in got.groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
    sums = got.groupby("sequence_id")["length"].sum()
    assert (sums[:-1] == 64).all() and sums.index.tolist() == list(range(len(sums)))
    mine = ByteBPE(BPE)
    ids = {r[0]: np.append(np.frombuffer(mine.encode_bytes(r[1] or ""), "<u2"), 0).astype("<u4") for r in rows if r[0] is not None}
    for r in got[got.doc_id.notna()].itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    twice = len(ids[170])
    assert got["length"].sum() == sum(len(x) for x in ids.values()) + twice + len(ids[1])


def test_plan_keeps_the_mixture():
    plan = packing.Plan({"a": 6000, "b": 3000, "c": 1000}, 100)
    got = Counter()
    for q, n in (("a", 6000), ("b", 3000), ("c", 1000)):
        for run, seq, _ in plan.pieces(q, 0, n):
            got[seq, q] += run
    assert all(abs(got[s, "a"] - 60) <= 1 and abs(got[s, "b"] - 30) <= 1 for s in range(100))


def test_rollup(spark, docs):
    counts = rollup.counted(docs, {"v1": BPE})
    store = rollup.Rollup(spark, path(spark, "test-rollup"))
    assert store.totals().isEmpty()
    assert store.commit("1", rollup.signed(None, counts)) and not store.commit("1", rollup.signed(None, counts))
    full = {tuple(r) for r in store.totals().collect()}
    assert store.commit("2", rollup.signed(counts.filter("lang = 'fr'"), None))
    assert store.totals().filter("lang = 'fr'").isEmpty()
    store.compact()
    assert not store.commit("2", rollup.signed(counts, None)) and store.commit("3", rollup.signed(None, counts.filter("lang = 'fr'")))
    assert {tuple(r) for r in store.totals().collect()} == full


def test_simhash_against_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 6))) for b in base for _ in range(5)]
    near = simhash.forest(fps, 4)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for limit in (4096, 3):  # also with every shard split again
        simhash.HOT, kept = limit, simhash.HOT
        comps = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
        simhash.HOT = kept
        got = {}
        for row in comps:
            got.setdefault(row["root"], {row["root"] & (2**64 - 1)}).add(row["node"] & (2**64 - 1))
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert len(list(near)) == len(set(fps)) - len(want)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(-60, -1)] + [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(900, i) for i in range(901, 930)] + [(2**62, -(2**62)), (5, 5)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: m for x, m in root.items() if x != m}
    edges, context = spark.createDataFrame(pairs, "a long, b long"), spark.sparkContext
    context.setJobGroup("components", "")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == want
    assert len(context.statusTracker().getJobIdsForGroup("components")) <= 8  # not several a round
    context.setJobGroup("rest", "")
    assert simhash.components(edges.filter("a = b")).isEmpty()
    monkeypatch.setattr(simhash, "FEW", 0)
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == want


def test_simhash_rows(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["fingerprint"] for r in got if r["doc_id"] in (120, 121, 129)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (120, 121, 129)} == {120}
    assert simhash.near_duplicates(empty).isEmpty()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 170").isEmpty()


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 8).toPandas()
    assert len(got) == len(rows) and sorted(got["place"]) == list(range(len(rows)))
    sizes = got.groupby("shard")["slot"].agg(["count", "max"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] == sizes["count"] - 1).all()
    assert sharding.shard(empty).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_feistel_is_a_permutation(spark, n):
    a, b = sharding.grid(n)
    assert a * b >= n
    got = [r[0] for r in sharding.permute(spark.range(a * b), "id", n, 5).collect()]
    assert sorted(got) == list(range(a * b))


def test_sentencepiece(docs, rows):
    import sentencepiece

    sp, mine = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_bpe.Encoder(PIECE)
    for text in [r[1] or "" for r in rows]:
        ids = sp.encode(text)
        assert mine.ids(text) == ids and mine.encode(text)[2] == sp.decode(ids)
    assert sentencepiece_bpe.encode(docs, PIECE).count() == len(rows)


def test_sentencepiece_short_units():
    import os

    import sentencepiece

    made = os.stat(PIECE).st_mtime_ns
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_bpe._encoder(PIECE, made)
    assert sentencepiece_bpe._encoder(PIECE, made) is mine  # a worker's next task finds its cache
    r = random.Random(7)
    pieces = r.sample(sorted(mine.model.id_of), 4000) + ["\n", ".", "😀", "\x00", "▁", " "] * 60
    for _ in range(1500):
        text = "".join(r.choices(pieces, k=r.randint(1, 12)))
        ids = sp.encode(text)
        assert mine.ids(text) == ids and mine.encode(text)[1:] == (len(ids), sp.decode(ids))
        unit = text[: sentencepiece_bpe.SHORT]
        assert mine.search_short(unit) == mine.search(unit)


def test_warc(spark):
    big = "<p>" + "b" * 100_000
    pages = [(1, "u", "same", "x"), (2, "u", "same", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "v\nw", big, "x"), (6, "u", "é", "x"), (None, "u", "same", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string")
    got = {r["page_id"]: r for r in warc.pages(warc.reassemble(warc.read(warc.write(df), folder(spark)))).collect()}
    assert len(got) == len(pages)
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and got[2]["record_type"] == "response"
    assert got[3]["refers_to"] == 4 and got[5]["payload_bytes"] == len(big)
    for p, _, html, _ in pages:
        assert got[p]["payload_digest"] == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_repeated_rows(spark):
    big = "<p>" + "b" * 100_000
    pages = [(5, "u", big), (5, "u", big), (5, "v", "c" * 70_000), (4, "u", big), (None, "u", big), (None, "u", big)]
    got = warc.pages(warc.reassemble(warc.read(warc.write(spark.createDataFrame(pages, "page_id long, url string, html string")), folder(spark)))).collect()
    want = [(5, len(big), "response", None)] * 2 + [(5, 70_000, "response", None), (4, len(big), "revisit", 5)] + [(None, len(big), "response", None)] * 2
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.pages(warc.reassemble(warc.read(warc.write(empty), folder(spark)))).isEmpty()


def test_warc_broken_archives_are_refused(spark):
    good = [("a", "response", "u", 1, None, None, "D", 3, None, b"abc"), ("a:2", "continuation", "u", 2, "a", 5, "D", 3, None, b"de")]
    frame = lambda rows: spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], warc.RECORDS)
    assert bytes(warc.reassemble(frame(good)).first()["block"]) == b"abcde"
    for bad in (good[:1], good[1:], [good[0], good[1][:5] + (6,) + good[1][6:]]):
        with pytest.raises(Exception, match="segments missing"):
            warc.reassemble(frame(bad)).collect()
    with pytest.raises(Exception, match="no response"):
        warc.pages(frame([("urn:lodestone:page:1", "revisit", "u", None, None, None, "D", 3, "urn:lodestone:page:2", b"")]).drop("segment", "origin", "total")).collect()


def test_warc_framing_errors():
    assert warc.unchunked(warc.chunked(b"x" * 20000)) == b"x" * 20000
    with pytest.raises(warc.WarcError):
        warc.unchunked(b"5\r\nabc")


def test_topk_ties(spark):
    rows = [(i, [0.5, float(i % 3) / 64]) for i in range(200)] + [(7, [0.5, 1.0])]  # few distinct scores, a repeated id
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).collect()
    v = [(i, [int(64 * x) for x in e]) for i, e in rows]
    for q in range(0, 200, 20):
        best = sorted((-(e[0] * v[q][1][0] + e[1] * v[q][1][1]), i) for i, e in v if i != q)[:4]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best


def test_topk(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(0, 0.05, (500, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [None] + [0.0] * 7), (902, [float("nan")] * 8), (None, [1.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5).toPandas()
    v = np.floor(64 * vectors.astype(np.float64))
    for q in range(0, 500, 20):
        s = v @ v[q]
        want = sorted(((-s[i], i) for i in range(500) if i != q))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine["score"], mine["vec_id"])) == [(int(a), b) for a, b in want]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


def test_topk_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 150)  # 14 shards, in rounds of 1, 1, 2, 4 and 6
    monkeypatch.setattr(topk, "SPREAD", 2)
    monkeypatch.setattr(topk, "FIRST", 30)
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(0, 0.03, (2000, 6)), 1e7 * r.normal(0, 0.03, (60, 6))])  # the last need 64 bits
    got = topk.top_k(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>"), 7).toPandas()
    w = np.floor(64 * v).astype(np.int64)
    assert len(got) == 7 * 103
    for q, mine in got.groupby("query_id"):
        s = w @ w[q]
        want = sorted((-s[i], i) for i in range(len(v)) if i != q)[:7]
        mine = mine.sort_values("rank")
        assert list(zip(-mine["score"], mine["vec_id"])) == want


def test_topk_costs_about_a_matrix_product():
    r = np.random.default_rng(5)
    v = np.floor(64 * r.normal(0, 0.125, (20_000, 64)))
    names = np.arange(0, 20_000, 20)
    tree, none = topk.KDTree(v, np.arange(20_000)), np.full(len(names), -np.inf)
    began = time.process_time()
    found = list(topk._search(tree, names, v[names], none, 20))
    took, began = time.process_time() - began, time.process_time()
    scores = v @ v[names].T
    scores[names, np.arange(len(names))] = -np.inf
    want = -np.sort(-np.partition(scores, len(v) - 20, axis=0)[len(v) - 20 :], axis=0)
    assert took < 3 * (time.process_time() - began)
    got = np.zeros((20, len(names)))
    for which, _, score in found:
        got[:, which[::20]] = score.reshape(-1, 20).T
    assert (got == want).all()


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    clash = docs.withColumns({c: F.lit("mine") for c in ("n_words", "kept", "_stratum", "last", "step", "_last", "stats")})
    out = quality.judge(clash, labels, "own")
    assert out.columns == [*clash.columns, "own"]
    got = {r["doc_id"]: r["own"] for r in out.collect()}
    for i, text, *_ in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {p for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for p in (j, j + 1, j + 2)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(hit))
        assert got[i]["kept"] == (len(w) >= 50 and 2 * len(hit) <= len(w))  # too few labels for a certificate
    assert quality.judge(empty, labels, "own").isEmpty()


def test_cutoffs_are_certified_and_control_the_risk(spark, tmp_path):
    """Thousands of labels: cutoffs bite, equal those of a plain computation, and hold on documents never seen."""
    from math import comb

    r = random.Random(8)

    def text(good):
        symbols = min(40, int(r.expovariate(1.2))) if good else r.randint(0, 60)
        return " ".join([f"w{r.randrange(10**6)}" for _ in range(r.randint(20 if r.random() < 0.01 else 60, 90))] + ["#|#"] * symbols)

    rows = [(i, text(i % 3 != 0), "xx" if i % 5 else "yy", i % 3 != 0) for i in range(9000)]
    rows += [(10_000 + i, rows[1][1], "yy", True) for i in range(500)]  # copies are one trial
    df = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(good), 0) for i, _, _, good in rows if i % 2 or i >= 10_000], "doc_id long, quality int, toxic int")
    for base, alpha in ((True, 0.03), (False, 0.05)):
        got = {x["doc_id"]: x["own"] for x in quality.judge(df, labels, "own", alpha=alpha, base=base).collect()}
        for lang in ("xx", "yy"):
            trials = {t: got[i]["step"] for i, t, g, good in rows if g == lang and good and (i % 2 or i >= 10_000) and not (base and got[i]["base_failed"])}
            n, last = len(trials), -1
            for step in range(len(quality.STEPS)):
                k = sum(s <= step for s in trials.values())
                if k >= n * alpha or sum(comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > quality.DELTA / 2:
                    break
                last = step
            assert 0 <= last < len(quality.STEPS)
            own = [(got[i], good, i) for i, _, g, good in rows if g == lang]
            assert all(q["kept"] == (q["step"] > last and not (base and q["base_failed"])) for q, _, _ in own)
            unseen = [q for q, good, i in own if good and i % 2 == 0 and i < 10_000 and not (base and q["base_failed"])]
            assert sum(q["step"] <= last for q in unseen) < 1.5 * alpha * len(unseen)
        assert sum(not got[i]["kept"] for i, _, _, good in rows if not good) > 500


def test_quality_stage_keeps_good_documents_and_columns(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)) + (" #|$%" * 60 if i % 4 == 0 else ""), "en", "mine") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.stage(spark, df, str(tmp_path))
    assert got.columns == df.columns and {x["doc_id"] for x in got.collect()} == {i for i in range(4000) if i % 4}


def test_binomial_tail(spark):
    from math import comb

    df = spark.createDataFrame([(0, 300), (2, 500), (9, 1500)], "k long, n long")
    for r in df.select("k", "n", quality._binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)))


def test_automaton_finds_longest_matches():
    word = [2, 3, 2, 2, 3, 4]
    table = language.automaton(word, 6)
    subs = {tuple(word[i:j]) for i in range(6) for j in range(i + 1, 7)}
    for a in range(2, 5):
        for b in range(2, 5):
            for c in range(2, 5):
                s = 0
                for x in (a, b, c):
                    s = table[s, x] if s >= 0 else -1
                assert (s >= 0) == ((a, b, c) in subs)


def test_language(docs, rows, empty):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    right = [got[i]["lang_pred"] == lang for i, t, lang, *_ in rows if lang and i is not None and len(t) > 80]
    assert sum(right) > 0.95 * len(right)
    assert got[120]["lang_pred"] == got[129]["lang_pred"] == "und"
    assert language.identify(empty).isEmpty()





def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    long = [(i, " ".join(f"{t} word{j}" for j in range(60)) if t and (i or 0) % 3 else t, lang, s, 1) for i, t, lang, s, _ in rows]
    spark.createDataFrame(long, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and not set(got["doc_id"].dropna()) & {120, 121, 129} and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"



def test_keep_one_takes_all_pairs_from_080(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(60, 400))]
        texts.append(base)
        for changes in (1, 2, 3, 5, 8, 12):  # similarities on both sides of 0.8
            copy = list(base)
            for at in r.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = word()
            texts.append(copy)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root, near = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if 5 * both >= 4 * (len(grams[a]) + len(grams[b]) - both):
                near += 1
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    want = {root.index(x) for x in root}
    got = simhash.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert near > 150 and {x["doc_id"] for x in got.collect()} == want


def test_parse_in_blocks_equals_a_parse_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 8)
    monkeypatch.setattr(language, "SYNC", 3)
    monkeypatch.setattr(language, "LANES", 5)
    r = random.Random(4)
    line = lambda n, k: np.array([r.randint(0, k) for _ in range(n)], np.uint8)
    tables = [language.automaton(line(400, 4).tolist(), 6), language.automaton([2, 3] * 60 + [4, 1, 5], 6)]
    parser = language.CrossParser(["x", "y"], list("abcd"), tables, [1.0, 1.0])
    arrays = [line(n, 5) for n in (0, 1, 7, 8, 9, 100, 333)] + [np.array([2, 3] * 90, np.uint8), line(50, 3)]
    rates, _ = parser.rate_of(arrays)
    for a, got in zip(arrays, rates):
        for j, t in enumerate(tables):
            state, count = 0, int(len(a) > 0)
            for c in a.tolist():
                if t[state, c] < 0:
                    count, state = count + 1, max(0, t[0, c])
                else:
                    state = t[state, c]
            assert got[j] * max(len(a), 1) == pytest.approx(count)


def _words(seed, n, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("texts,words", [(3, 120), (4, 5500)])  # few texts; texts of about 30,000 characters
def test_language_with_few_or_long_texts(spark, texts, words):
    letters = {"xx": "aaabdeegilmnoo", "yy": "aehkkoprstuuvw"}
    ids = [i for i in range(100) if not language.held_out(i)]
    learned = {lang: [_words(f"{lang}{i}", words, letters[lang]) for i in range(40 if lang == "yy" and texts == 3 else texts)] for lang in letters}
    rows = [(i, t, lang) for i, (lang, t) in zip(ids, ((lang, t) for lang in letters for t in learned[lang]))]
    unseen = [(1000 + 10 * j + k, _words(f"new{lang}{j}", 200, letters[lang]), lang) for k, lang in enumerate(letters) for j in range(5)]
    held = [(i, t, lang) for i, (_, t, lang) in zip((i for i in range(5000, 9000) if language.held_out(i)), unseen)]
    parser, reducer = language.fit(spark.createDataFrame(rows + held, "doc_id long, text string, lang string"))
    langs, scores = parser.predict([t for _, t, _ in held], reducer)
    assert langs == [lang for *_, lang in held] and min(scores) > 0.5


def test_plan_with_a_rare_queue():
    totals = {"a": 314_159, "b": 150, "c": 571_828}
    plan, filled = packing.Plan(totals, 1024), {}
    for q, n in totals.items():
        r, at = random.Random(q), 0
        while at < n:
            size, done = min(n - at, r.randint(1, 3000)), 0
            for length, seq, offset in plan.pieces(q, at, size):
                filled.setdefault(seq, []).append((offset, length))
                done += length
            assert done == size
            at += size
    assert sorted(filled) == list(range(-(-plan.total // 1024)))
    for seq, pieces in filled.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == min(1024, plan.total - seq * 1024)
    for x in range(0, plan.total, 1024):
        for k, n in enumerate(totals.values()):
            assert abs(plan.phases[0].of(k, x) - x * n / plan.total) < 2




def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    got = simhash.keep_one(spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (3, c)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, a), (1, b), (3, c)]


def test_rollup_revision_and_two_versions(spark, docs, rows):
    counts = rollup.counted(docs, {"v1": BPE, "v2": BPE})
    after = rollup.counted(docs.filter("lang = 'fr'").withColumn("text", docs["text"].substr(1, 20)), {"v1": BPE, "v2": BPE})
    store = rollup.Rollup(spark, path(spark, "test-revision"))
    for _ in range(2):
        store.commit("1", rollup.signed(None, counts))
        store.commit("2", rollup.signed(counts.filter("lang = 'fr'"), after))
    encoder, want = ByteBPE(BPE), Counter()
    for _, t, lang, source, _ in rows:
        t = (t or "")[:20] if lang == "fr" else t or ""
        for v in ("v1", "v2"):
            want[source or "", lang or "", v, "docs"] += 1
            want[source or "", lang or "", v, "tokens"] += len(encoder.encode_bytes(t)) // 2
            want[source or "", lang or "", v, "chars"] += len(t)
    got = {(r["source"], r["lang"], r["tokenizer"], m): r[m] for r in store.totals().collect() for m in rollup.MEASURES}
    assert got == dict(want)


def test_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline

    assert packing.pack(empty, BPE).isEmpty() and sentencepiece_bpe.encode(empty, PIECE).isEmpty()
    assert rollup.counted(empty, {"v": BPE}).isEmpty() and simhash.keep_one(empty).isEmpty()
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_rollup_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    versions = {v: ByteBPE(public_tokenizers.path(f)) for v, f in (("byte_bpe_50k", "byte_bpe_50k.json"), ("byte_bpe_multi_50k", "byte_bpe_multi_50k.tiktoken"))}
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r["text"] or ""
        if r["source"] == rollup.REVISED:
            text = __import__("re").sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
        for v, b in versions.items():
            key = (r["source"] or "", r["lang"] or "", v)
            for m, x in (("docs", 1), ("tokens", len(b.ids(text))), ("chars", len(text))):
                want[(*key, m)] += x
    got = {(r["source"], r["lang"], r["tokenizer"], m): r[m] for r in rollup.query(spark, sf).collect() for m in rollup.MEASURES}
    assert got == dict(want)
