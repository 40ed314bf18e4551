"""The dealt operators: against plain versions, libraries or round trips, and on awkward rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.llm import bpe_count, chat, components, decontaminate, fingerprint, html, jaccard_join, langid, packing, queries, resampling, runtime, textvec, toxicity

SP, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = "alpha beta gamma " * 6000
AWKWARD = [None, "", " ", "a", "\n\n", "one two", "one two", "tab\tand\x0bmore", "日本語 テスト", "x" * 9000, LONG, "é́ ß İ Σ", "<s> </s> <|endoftext|>", "\x00 nul", "a▁b  c   d", "👍🏽 ok", "UPPER lower 123 !!"]
ODD = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, host string"


def rows(spark, texts, first=1):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)], ODD)


def awkward(spark):
    """Awkward texts, a repeated row, a null id, and columns whose names the outputs use."""
    d = rows(spark, AWKWARD)
    return d.unionAll(d.where("doc_id = 4")).unionAll(spark.createDataFrame([(None, "null id here", None, None, None, None, None, None)], ODD))


def nothing(spark):
    return spark.createDataFrame([], ODD)


# ---- shared hashing ---------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé日", max_size=20), max_size=6))
def test_words_split_as_the_pattern_does(texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    h, s, e, begin = textvec.words(np.frombuffer(b"".join(raw), np.uint8), off)
    data = b"".join(raw)
    seen: dict = {}
    for i, t in enumerate(texts):
        want = [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        got = [data[s[k] : e[k]].decode().translate({c: c + 32 for c in range(65, 91)}) for k in range(begin[i], begin[i + 1])]
        assert got == want
        for k, w in zip(range(begin[i], begin[i + 1]), want, strict=True):
            assert seen.setdefault(w, h[k]) == h[k]
    assert len({*seen.values()}) == len(seen)


# ---- 1 toxicity ----------------------------------------------------------------------------------------------------------
def _toxic_rows(n=240):
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]
    out = []
    for i in range(n):
        w = list(r.choice(words, int(r.integers(5, 150))))
        if i % 3 == 0:
            for _ in range(1 + len(w) // 40):
                w.insert(int(r.integers(0, len(w) + 1)), "zzq" + "".join(r.choice(list("xyz"), 3)))
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_toxicity_learns_characters_and_scores_all(spark):
    data = _toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, net).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.9
    kept = {r["doc_id"] for r in toxicity.clean(docs, net).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 0}
    out = toxicity.score(awkward(spark), net).collect()
    assert len(out) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(nothing(spark), net).count() == 0
    assert toxicity.score(rows(spark, ["a b", None]), toxicity.fit(docs.limit(0), labels)).count() == 2


def test_toxicity_gradient_is_the_slope():
    net = toxicity.Network.fresh(np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(3)
    gates, on = r.standard_normal((2, 3, 7, 3 * toxicity.HIDDEN)), np.arange(7) < np.array([7, 4, 1])[:, None]
    out, kept = net.run(gates, on, keep=True)
    g, _ = net.backward(kept, on, np.ones(3))
    for name, place in (("U", (0, 2, 5)), ("A", (3, 1)), ("v", (2,)), ("o", (4,))):
        net.p[name][place] += 1e-3
        up = net.run(gates, on)[0].sum()
        net.p[name][place] -= 2e-3
        down = net.run(gates, on)[0].sum()
        net.p[name][place] += 1e-3
        assert g[name][place] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4)


def test_windows_cover_every_word():
    net = toxicity.Network.fresh(np.zeros(toxicity.BUCKETS, np.float32), np.zeros(toxicity.BUCKETS, np.float32))
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        place, on, of, _ = net.windows([["w"] * n])
        assert {*place[on].tolist()} == {*range(n)} and len(of) == (0 if not n else 1 + max(0, -(-(n - 64) // 48)))


# ---- 2 quality -------------------------------------------------------------------------------------------------------------
def test_importance_draw(spark):
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(400)]
    texts = [" ".join(r.choice(words, 80)) if i % 5 else " ".join("##%%" + w.upper() for w in r.choice(words, 80)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    model = resampling.fit(docs, labels)
    got = {x["doc_id"]: x for x in resampling.resample(docs, model).collect()}
    assert np.mean([got[i]["selected"] == (i % 5 > 0) for i in range(300)]) > 0.97
    assert {x["doc_id"] for x in resampling.selected(docs, model).collect()} == {i for i, x in got.items() if x["selected"]}
    top = resampling.resample(docs, model, k=17).where("selected").collect()
    keys = sorted((x["gumbel_key"] for x in got.values()), reverse=True)
    assert len(top) == 17 and min(x["gumbel_key"] for x in top) == keys[16]
    assert resampling.resample(awkward(spark), model).count() == len(AWKWARD) + 2
    assert resampling.resample(nothing(spark), model).count() == 0
    assert resampling.resample(docs, resampling.fit(docs, labels.limit(0))).where("selected").count() == 300


def test_kth_largest_is_exact(spark):
    v = [float(x) for x in np.random.default_rng(5).integers(0, 50, 400)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 7, 200, 400):
        assert resampling.kth_largest(df, "v", k, few=20, cells=8) == sorted(v, reverse=True)[k - 1]


# ---- 3 fingerprints ---------------------------------------------------------------------------------------------------------
def _plain_sketch_likeness(a, b):
    used = {x[:2] for x in a.split()} | {x[:2] for x in b.split()}
    return len({*a.split()} & {*b.split()}) / len(used) if used else 1.0


def test_fingerprints(spark, sf, tmp_path):
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(200)) for i in range(5)] + ["", "a", LONG, "a b a b a b a b", None]
    docs = spark.createDataFrame([(3 * i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_order_minhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    ids = sorted(got, reverse=True)
    by = {3 * i: t or "" for i, t in enumerate(texts)}
    for k, i in enumerate(ids):
        nxt, t = by[ids[(k + 1) % len(ids)]], by[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(_plain_sketch_likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]))
        assert got[i]["near_next"] == pytest.approx(_plain_sketch_likeness(got[i]["fingerprint"], got[ids[(k + 1) % len(ids)]]["fingerprint"]))


def test_fingerprint_sees_order_and_edits(spark):
    base = [f"w{k * k % 997}" for k in range(400)]
    few, swapped = [*base], base[200:] + base[:200]
    few[50] = few[300] = "changed"
    df = spark.createDataFrame([(" ".join(base), " ".join(few), " ".join(swapped), " ".join(f"v{k}" for k in range(400)))], "a string, b string, c string, d string")
    s = {c: fingerprint.sketches(F.col(c)) for c in "abcd"}
    r = df.select(*[fingerprint.likeness(s["a"], s[c]).alias(c) for c in "abcd"]).first()
    assert r["a"] == 1 and 0.85 < r["b"] < 1 and r["c"] < 0.85 and r["d"] < 0.05


def test_next_is_right_over_many_ranges(spark):
    ids = [int(x) for x in np.random.default_rng(0).choice(10**9, 900, replace=False)] + [7]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(d, rows_per_range=20, inner=4).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert fingerprint.with_next(awkward(spark)).count() == len(AWKWARD) + 2
    assert fingerprint.with_next(nothing(spark)).count() == 0


# ---- 4 decontamination --------------------------------------------------------------------------------------------------------
def _distance(p, t):
    d = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        e = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            e[j] = min(d[j] + 1, e[j - 1] + 1, d[j - 1] + (p[i - 1] != t[j - 1]))
        d = e
    return min(d)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_bit_parallel_distance(p, t):
    assert decontaminate.Pattern(p).best(t)[0] == _distance(p, t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcd ", min_size=3, max_size=25), min_size=1, max_size=4), st.text("abcd ", max_size=60))
def test_matches_are_all_within_budget(items, text):
    items = [(k, decontaminate.normal(x)) for k, x in enumerate(items)]
    text = decontaminate.normal(text)
    got = {(i, d) for i, d, _, _ in decontaminate.Matcher(items, 0.2).find(text)}
    want = {(k, d) for k, x in items if x and (d := _distance(x, text)) <= int(len(x) * 0.2) and text}
    assert got == want


def test_decontaminate_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and then sleeps all day long"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "another item of some length here")], "item_id long, text string")
    texts = [f"before {item} after", "before " + item.upper().replace(" ", "\n") + "!", item.replace("quick", "qvick"), "nothing of it", None, "x another item of some length here y"]
    d = rows(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(d, bench).collect()}
    assert got == {(1, 1): 0, (2, 1): 0, (3, 1): 1, (6, None): 0}
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, bench).collect()) == [4, 5]
    assert decontaminate.clean(d, bench).columns == d.columns
    assert decontaminate.matches(nothing(spark), bench).count() == 0 and decontaminate.matches(d, bench.limit(0)).count() == 0
    assert decontaminate.clean(awkward(spark), bench).count() == len(AWKWARD) + 2


# ---- 5 language -------------------------------------------------------------------------------------------------------------------
def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = langid.learn(docs)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.predict(docs, p).collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    out = langid.predict(awkward(spark), p).collect()
    assert len(out) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 5)} == {"und"}
    assert langid.predict(nothing(spark), p).count() == 0
    assert [r["lang_pred"] for r in langid.predict(rows(spark, ["abc"]), langid.learn(docs.limit(0))).collect()] == ["und"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ .1\n", max_size=60))
def test_grams_count_plainly(text):
    folded = re.sub(r"[^a-zé]+", " ", f" {text.lower()} ")
    want: dict = {}
    if any(c != " " for c in folded):
        for n in (1, 2, 3):
            for i in range(len(folded) - n + 1):
                g = folded[i : i + n]
                if g != " ":
                    want[g] = want.get(g, 0) + 1
    x, n = langid.grams(text)
    name = lambda v: "".join(chr(c) for c in (v >> 42, v >> 21 & 0x1FFFFF, v & 0x1FFFFF) if c)
    assert {name(int(a)): int(b) for a, b in zip(x, n, strict=True)} == want


# ---- 6 near copies ------------------------------------------------------------------------------------------------------------------
def brute_classes(texts: dict, num=3, den=4, width=5):
    """doc_id -> (size, class) by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def made_texts(seed, n=260):
    """Copies, edited copies at every likeness, one large group, and a passage that many texts share."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choice(words, 60))
    big = list(r.choice(words, 150))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(out) < 6:
            t = " ".join(r.choice(words, int(r.choice([1, 3, 5, 8, 20, 60, 200]))))
        elif kind == 1:
            t = out[int(r.integers(0, len(out)))]
        elif kind in (2, 3):
            w = out[int(r.integers(0, len(out)))].split(" ")
            for _ in range(int(r.integers(0, 1 + len(w) // 12))):
                w[int(r.integers(0, len(w)))] = str(r.choice(words))
            t = " ".join(w)
        elif kind == 4:
            w = [*big]
            for _ in range(int(r.integers(0, 4))):
                w[int(r.integers(0, len(w)))] = str(r.choice(words))
            t = " ".join(w)
        else:
            t = " ".join([*r.choice(words, int(r.integers(5, 90))), passage, *r.choice(words, int(r.integers(0, 40)))])
        out.append(t)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    texts = made_texts(seed)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()}
    assert got == brute_classes(texts)


def test_join_is_exact_when_signatures_are_scarce(spark, monkeypatch):
    """Segments so few that sets run out of allowances: the join takes more of them and still loses nothing."""
    monkeypatch.setattr(jaccard_join.Bands, "segments", lambda self, band: max(1, (1 << band) // 8) * self.factor)
    monkeypatch.setattr(jaccard_join.Bands, "table", lambda self: np.array([self.segments(b) for b in range(40)], np.int64))
    texts = made_texts(3, 120)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d).collect()}
    assert got == brute_classes(texts)


def test_join_on_awkward_rows(spark):
    out = jaccard_join.join(awkward(spark)).collect()
    assert len(out) == len(AWKWARD) + 2
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert by[1] == by[1][:0] + (0, 1) and by[2] == (0, 2) and by[6] == (1, 6) and by[7] == (1, 6)
    assert jaccard_join.join(nothing(spark)).count() == 0
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(awkward(spark)).collect()]
    assert 7 not in kept and kept.count(4) == 1 and None in kept and 1 in kept


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


# ---- 7 chat ---------------------------------------------------------------------------------------------------------------------------
NASTY = [r"\### Assistant: </turn> ok", "<|end|>\n", "\\", "\\<|", "<<||>", "<|turn:user|>x<|end|>", "", None, "a\n<|", "日本<|end|>", "|>", "\\\\<"]


def test_chat_round_trip(spark):
    data = [(c, k, ("system", "user", "assistant")[k % 3] if k else None, t) for c in range(3) for k, t in enumerate(NASTY)] + [(9, 0, "assi|st<|ant\\", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.formatted(chat.canonical_turns(chat.gathered(df, "conv_id", "turn", "role", "text")))).collect()
    assert len(out) == 4
    for r in out:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in data if x[0] == r["id"]), key=lambda x: x[1])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        learn = "".join(b for a, b in turns if a == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learn), hashlib.sha256(learn.encode()).hexdigest())


def test_chat_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":7}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"instruction":"a","input":"","output":"b"}',
        '{"prompt":"a","response":"b","extra":{"role":"x"}}',
        '{"system":"s","prompt":"a","response":"b"}',
        '{"unknown":1}', "not json", None,
    ]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "id long, record string, turns string")
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.canonical_turns(df).collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert got[0] == ("messages", pair) and got[1] == ("sharegpt", pair) and got[2] == ("alpaca", pair) and got[3] == ("prompt_response", pair)
    assert got[4] == ("system_prompt_response", [("system", "s"), *pair]) and got[5] == got[6] == got[7] == (None, [])


def test_chat_query_holds_no_python(spark, sf):
    df = queries.op7_schema_chat(spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert df.where("conv_id = -7").first()["n_turns"] == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.canonical_turns(chat.gathered(empty, "conv_id", "turn", "role", "text"))).count() == 0


# ---- 8 token counts ---------------------------------------------------------------------------------------------------------------------
def test_counts_equal_the_library(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = bpe_count.token_counts(awkward(spark), SP, 4096).collect()
    texts = {i + 1: t or "" for i, t in enumerate(AWKWARD)} | {None: "null id here"}
    assert len(got) == len(AWKWARD) + 2
    for r in got:
        n = len(sp.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)
    assert bpe_count.token_counts(nothing(spark), SP, 1).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab nthe.,\n▁é日<s>\x00", max_size=40))
def test_counts_equal_the_library_on_any_text(text):
    import sentencepiece

    sp = test_counts_equal_the_library_on_any_text.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=SP))
    assert bpe_count.merger(SP).tokens(text) == len(sp.encode(text))


# ---- 9 packing ----------------------------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ABab thé.,'s1!\n\tΣİ日\x1c", max_size=40))
def test_encoder_equals_the_library(text):
    e = packing.encoder(WORD)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ABab é#$*-<|'_1\u0301 Σİ", max_size=40))
def test_encoder_equals_the_library_on_marks(text):
    e = packing.encoder(WORD)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_that_come_again_are_learned_once(monkeypatch):
    """What is dropped when too many words are remembered are those that did not come again; marks at a word's end make no new word."""
    monkeypatch.setattr(packing, "REMEMBER", 100)
    e, learned = packing.Encoder(WORD), []
    monkeypatch.setattr(packing.Encoder, "learn", lambda self, words, learn=packing.Encoder.learn: (learned.extend(words), learn(self, words)))
    letters = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05d}")
    for batch in range(20):
        text = " ".join(["common", "words###", "éà,", *(letters(100 * batch + k) + "$$$" for k in range(30))])
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(e) <= 100 + 33  # and the letters before the marks of one batch
    assert sorted(w for w in learned if w in ("common", "words", "éà")) == ["common", "words", "éà"]
    assert not any("#" in w or "$" in w for w in learned)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(1, 40))
def test_fullest_is_the_best_subset(counts, room):
    best = {0}
    for length, n in counts.items():
        best |= {b + k * length for b in best for k in range(1, n + 1) if b + k * length <= room}
    got = packing.fullest(counts, room)
    assert sum(k * v for k, v in got.items()) == max(best) and all(v <= counts[k] for k, v in got.items())


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    d = awkward(spark)
    got = packing.pack(d, WORD, 64, 0).collect()
    spans: dict = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    texts = {i + 1: t or "" for i, t in enumerate(AWKWARD)} | {None: "null id here"}
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i})
        want = [(k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert own == want
    assert len(spans) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack(nothing(spark), WORD).count() == 0


# ---- 10 pages -------------------------------------------------------------------------------------------------------------------------------
def page(n, body, wrap="article"):
    return f"""<!DOCTYPE html><html><head><title>T{n}</title><script>var a="<p>";</script></head><body><nav><ul>{"".join(f"<li><a href=/{k}>m{k}</a></li>" for k in range(n + 2))}</ul></nav>
    <div class="ad">Buy {n}</div><{wrap}>{body}</{wrap}><aside>side</aside><section class="comments"><p>first!</p></section><footer>&copy; {n}</footer></body></html>"""


def test_pages(spark):
    a = [page(k, f"<h1>Head {k}</h1><p>One &amp;  two{' <b>bold' if k % 2 else ''}</p><p>Three<br>four</p>") for k in range(6)]
    b = [page(k, f"<h2>Div {k}</h2><p>Text &lt;{k}&gt; of some length, longer than all that stands around it, so it is the main part.</p><ul><li>x</li><li>y</li></ul>", "div") for k in range(4)]
    data = [(k, f"http://a.example/{k}", t) for k, t in enumerate(a)] + [(10 + k, f"https://B.example/{k}?q", t) for k, t in enumerate(b)]
    data += [(20, None, None), (21, "not a url", ""), (22, "http://a.example/odd", "<p>only <i>this"), (None, "http://a.example/", a[0]), (0, "http://a.example/0", a[0])]
    df = spark.createDataFrame([(*x, "clash") for x in data], "page_id long, url string, html string, text string")
    got = html.main_text(df, 4).collect()
    assert len(got) == len(data)
    by = {(r["page_id"]): r for r in got}
    for k in range(6):
        assert by[k]["text"] == f"Head {k}\nOne & two{' bold' if k % 2 else ''}\nThree four" and by[k]["n_chars"] == len(by[k]["text"])
    for k in range(4):
        assert by[10 + k]["text"].split("\n")[:1] == [f"Div {k}"] and by[10 + k]["text"].endswith("\nx\ny") and f"<{k}>" in by[10 + k]["text"]
    assert by[20]["text"] == by[21]["text"] == "" and by[22]["text"] == "only this" and by[None]["text"] == by[0]["text"]
    assert html.main_text(df.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    w = html.infer(["<div><p>a</p><p>b</p><i>same</i></div>", "<div><p>c</p><em>x</em><i>same</i></div>"])
    assert html.regular_expression(w) == "<#> <div> (<p> #PCDATA </>)+ (<em> x </>)? <i> same </> </> </>"
    assert html.regular_expression(html.infer(["<dl><dt>a<dd>b<dt>c<dd>d</dl>"])) == "<#> <dl> (<dt> #PCDATA </> <dd> #PCDATA </>)+ </> </>"


def test_constant_text_of_a_host_is_template(spark):
    body = lambda k: f"<div class=x7><p>Our shop is <b>open</b>.</p><i>Write to us</i></div><p>Story {k} about <b>{k * k}</b> things.</p><p>So <b>it</b> goes on {k}.</p>"
    copy = "<p>The same story on every page.</p><h3>Only this story has a heading.</h3><p>And its end.</p>"
    data = [(k, f"http://t.example/{k}", page(k, body(k))) for k in range(10)] + [(20 + k, f"http://c.example/{k}", page(k, copy)) for k in range(10)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in html.main_text(df, 64).collect()}
    for k in range(10):
        assert by[k] == f"Story {k} about {k * k} things.\nSo it goes on {k}."
        assert by[20 + k] == "The same story on every page.\nOnly this story has a heading.\nAnd its end."


def test_a_rare_template_is_read_at_its_own_place(spark, monkeypatch):
    long = lambda k: f"<p>The text of page {k}, which is long enough to be what its page is about, and so it is read.</p>"
    usual = [f"<body><div class=content>{long(k)}</div></body>" for k in range(60)]
    rare = [f"<body><div class=content><p>Teaser {k}</p></div><article>{long(k)}</article></body>" for k in (60, 61)]
    data = [(k, f"http://t.example/{k}", t) for k, t in enumerate(usual + rare)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    want = {k: f"The text of page {k}, which is long enough to be what its page is about, and so it is read." for k in range(62)}
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want
    monkeypatch.setattr(html, "SHARED_BYTES", 0)
    assert {r["page_id"]: r["text"] for r in html.main_text(df.repartition(5), 2).collect()} == want


def test_aligning_does_not_depend_on_order():
    pages = [page(k, f"<h1>Head {k}</h1>" + "<p>x</p>" * (k % 3) + "<h2>same</h2>" * (k % 2)) for k in range(12)]
    own = [html._generalised(r := html.parse(p), html._mark(r)) for p in pages]
    keyed = [(hash(repr(html.structure(w))), w) for w in own]
    assert html.aligned(keyed) == html.aligned(keyed[::-1]) == html.aligned([(k, html.aligned([(k, w)])) for k, w in sorted(keyed, key=lambda x: repr(x[1]))])


def test_deep_and_unclosed_markup_is_read():
    import time

    began = time.time()
    deep = "<article>" + "<div>" * 10_000 + "<p>At the bottom.</p>" + "</div>" * 10_000 + "<p>After.</p></article>"
    assert html.extract(deep, {}).split("\n") == ["At the bottom.", "After."]
    many = "<article><p>" + "a < b " * 50_000 + "</p></article>"
    assert html.extract(many, {}) == ("a < b " * 50_000).strip()
    assert html.extract("<article><p>" + "x <a " * 50_000, {}).count("x") == 50_000
    html._generalised(html.parse(deep))
    assert time.time() - began < 20


def test_many_near_copies_and_a_passage_in_every_text(spark):
    """Edited copies on both sides of the threshold, and one passage that makes up much of every text."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    passage, base = [word() for _ in range(40)], [word() for _ in range(60)]
    texts = []
    for k in range(700):
        w = list(base)
        for at in r.choice(60, k % 5, replace=False):
            w[at] = word()
        texts.append(" ".join(passage + w))
    texts += [" ".join(passage + [word() for _ in range(int(n))]) for n in r.integers(0, 30, 200)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(rows(spark, texts)).collect()}
    assert got == brute_classes({i + 1: t for i, t in enumerate(texts)})


def test_trim_driver_reaches_the_command(spark, monkeypatch):
    """The call goes through where Java has the command, and is passed over where it has not."""
    import contextlib

    from py4j.protocol import Py4JError

    from arcloom.llm import runtime

    runtime.trim_driver(spark)
    told = []

    @contextlib.contextmanager
    def heard(*kinds):
        assert kinds == (Py4JError,)
        try:
            yield
        except Py4JError as e:
            told.append("javax.management.ReflectionException" in str(e))  # of a Java without the command

    monkeypatch.setattr(runtime.contextlib, "suppress", heard)
    runtime.trim_driver(spark)
    assert all(told)


def test_a_pair_that_meets_in_many_runs_is_made_few_times(spark, monkeypatch):
    """Edited copies around the threshold share most of their costly signatures; each pair of them is made about once."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(200):
        w = list(base)
        for at in r.choice(150, 5, replace=False):
            w[at] = word()
        texts.append(" ".join(w))
    made = []
    met = jaccard_join._met
    monkeypatch.setattr(jaccard_join, "_met", lambda *a: made.append(met(*a)) or made[-1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(rows(spark, texts)).collect()}
    assert got == brute_classes({i + 1: t for i, t in enumerate(texts)})
    assert made
    for pairs in made:
        assert 0 < pairs.count() <= 1.5 * pairs.distinct().count()


def test_packed_signatures_are_small_and_read_back():
    """Whatever the widths of counts and sizes, and with more signatures than one part of a bucket has."""
    r = np.random.default_rng(3)
    for sets, per, largest, buckets in ((400, 300, 300, 64), (3, 900, 100_000, 2), (1, 1, 1, 8)):
        node, n = r.integers(1, 1 << 62, sets), r.integers(1, largest + 1, sets)
        sig = r.integers(0, 1 << 62, sets * per // 2 + 1).astype(np.uint64)[r.integers(0, sets * per // 2 + 1, sets * per)]
        owner, cost = r.permutation(np.repeat(np.arange(sets), per)), r.integers(0, 3, sets * per).astype(np.int8)
        batch = jaccard_join._packed(sig, owner, cost, node, n, buckets)
        if sets == 400:  # nearly five signatures of a set in a row; it was 10.5 bytes for each, now 7.6
            assert sum(batch.column(k).nbytes for k in range(1, 6)) < 8.5 * len(sig)
        low, got, want = sig & np.uint64((1 << 40) - 1), set(), {}
        bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
        for k in range(batch.num_rows):
            one = jaccard_join.pa.Table.from_batches([batch.slice(k, 1)])
            s, own, c, v, size = jaccard_join._unpacked(one)
            here = bucket == one["bucket"][0].as_py()
            assert sorted(zip(s, v[own], size[own], c)) == sorted(zip(low[here], node[owner[here]], n[owner[here]], cost[here]))
            v, size, c, s, width, place = jaccard_join._runs(one)
            got |= set(zip([k] * len(v), s.tolist(), v.tolist(), size.tolist(), c.tolist(), width.tolist()))
            for x, o, d in zip(low[here].tolist(), owner[here], cost[here].tolist()):
                run = want.setdefault((k, x), {})
                run[o] = max(run.get(o, 0), d)
        plain = set()
        for k in range(batch.num_rows):
            here = bucket == batch.column(0)[k].as_py()
            times = dict(zip(*np.unique(low[here], return_counts=True)))
            plain |= {(k, x, int(node[o]), int(n[o]), d, len(run)) for (row, x), run in want.items() if row == k and times[x] > 1 for o, d in run.items()}
        assert got == plain


def test_few_full_buckets_are_taken_before_many():
    """A set's node is sent for each bucket: from ENOUGH on, buckets are filled first."""
    assert [jaccard_join._buckets(n) for n in (0, 17e6, 40e6, 120e6, 1e9)] == [8, 34, 64, 64, 500]


def test_spent_shuffles_are_deleted(spark, monkeypatch):
    """Once the signatures are looked through, their shuffle's files go, without waiting for the driver's heap to fill."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known, freed = [], runtime.free_shuffles
    ids = lambda: {int(x) for x in tracker.shuffleStatuses().keySet().mkString(",").split(",") if x}

    def heard(session):
        newest = max(ids())
        freed(session)
        time.sleep(1)
        known.append(newest in ids())

    monkeypatch.setattr(runtime, "free_shuffles", heard)
    jaccard_join.join(rows(spark, ["one two three four five six seven", "one two three four five six"])).collect()
    assert known and not any(known)
