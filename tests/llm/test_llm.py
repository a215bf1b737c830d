"""The training-data operators against brute force, round trips and held-out
accuracy, and their defined edge cases, on small tables."""

import collections
import gc
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import caps, components, jaccard, langid, lm, mixing, packing, pii, quality, sketch, tokens
from larkspur.llm.common import durable, sweep
from larkspur.llm.grams import Words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = ("lorem ipsum dolor " * 4000).strip()
ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one", "en", None, 3),
    (5, "one", "en", None, 3),
    (5, "one", "en", None, 3),
    (6, LONG, "fr", "b", len(LONG)),
    (7, "x" * 50_000, "de", "b", 50_000),
    (8, "a  b   c\n\n d<|endoftext|>e 'S it's 你好 12", "xx", "c", 30),
    (None, "no id here at all", "en", "c", 17),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    # columns of clashing names must be ignored
    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("_text", F.lit("y")).withColumn("n", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_mix_words_come_near_their_targets(docs, odd, empty):
    d = mixing.mix(docs).toPandas()
    src = docs.select("doc_id", "source", "text").toPandas()
    d = d.merge(src, on="doc_id")
    assert (d["size"] == d["text"].fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    assert (d["taken"] <= 2 * d["size"]).all()
    by = d.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1).all()
    assert abs(by["target"].sum() - 1.5 * d["size"].sum()) < 1e-6 * d["size"].sum()
    assert mixing.mix(docs).toPandas().sort_values("doc_id").equals(mixing.mix(docs).toPandas().sort_values("doc_id"))
    o = mixing.mix(odd).toPandas()
    assert len(o) == len(ODD) and (o[o["size"] == 0]["taken"] == 0).all()
    assert mixing.mix(empty).count() == 0


def brute_base(text):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, r in kinds.items():
        for m in re.finditer(r, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or k == "card" and 13 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_are_exact(spark, docs, odd, empty):
    tricky = ["a@b.c_x@y.z.w q@@r.s", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111-1111 1111 4111111111111112", "+1 (555) 123-4567 +12 +1((((", "é ü@x.yy ÿ+49 30 1234567.", None, "", "a" * 3000 + "@b", "1" * 5000, "+1" + "(" * 3000, "a.a@" + "b." * 5000 + "c"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in pii.span_digest(rows).collect():
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in want) for k in ("email:", "ip:", "card:", "phone:")]
        assert set(want) <= set(r["spans"].split(",")) | set() if want else True
    assert pii.span_digest(odd).count() == len(ODD) and pii.span_digest(empty).count() == 0


def test_pii_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "mail x@y.io now", 5), (2, None, 6), (3, "clean", None)], "doc_id long, text string, n long")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", 5), (2, None, 6), (3, "clean", None)]


def luhn_card(rng):
    digits = [4, *rng.integers(0, 10, 14).tolist()]
    total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, [*digits, -total % 10]))


def test_pii_adds_wide_forms(spark):
    """Forms that no base pattern matches are found from base examples alone."""
    rng = np.random.default_rng(4)
    pick = lambda *x: x[rng.integers(len(x))]
    rows, planted = [], {}
    for i in range(120):
        token = rng.bytes(20).hex()
        rows.append((i, f"{pick('call', 'on', 'und')} +49 {rng.integers(20, 90)} {rng.integers(1000, 9999)} {rng.integers(1000, 9999)} {pick('mail', 'to')} a{i}@site{i}.org {pick('host', 'at')} 10.{i}.3.{rng.integers(255)} {pick('card', 'with')} {luhn_card(rng)} on 2024-01-{i % 28 + 1:02d} for $ 12.50 in version 3.4.5 token = \"{token}\" end"))
    for i in range(200, 240):
        card = luhn_card(rng)
        kind, value = pick(("email", f"bob{i} (at) site{i} (dot) com"), ("email", f"ann{i} [at] corp{i}.org"), ("phone", f"(0{rng.integers(20, 90)}) {rng.integers(1000, 9999)} {rng.integers(1000, 9999)}"), ("card", f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"), ("ip", f"10[.]{i}[.]0[.]{rng.integers(255)}"))
        rows.append((i, f"{pick('write', 'on', 'see')} {value} {pick('now', 'then')}"))
        planted[i] = f"{kind}:{rows[-1][1].index(value)}:{rows[-1][1].index(value) + len(value)}"
    clean = ["look (at) this", "on 12.05.2021 and 2021 05 12", "100.000.000 items for $ 1 200 300 400", "pages 12-14, 1999-2004", "version 10.2.300.4000", "x = 12345 67890", "token of thanks"]
    rows += [(300 + i, t) for i, t in enumerate(clean)]
    got = {r["doc_id"]: r for r in pii.span_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i]["spans"] == s for i, s in planted.items())
    assert found >= 0.9 * len(planted)
    assert all(not got[300 + i]["spans"] for i in range(len(clean)))
    assert all(got[i]["n_added"] == 1 and got[i]["spans"].endswith(f"secret:{rows[i][1].index('token = ') + 9}:{len(rows[i][1]) - 5}") for i in range(120))


def test_pii_long_texts_full_of_matches(spark):
    text = " ".join(f"é +49 30 {1000 + i % 9000} 5678 x{i}@y.io" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.span_digest(df).first()
    want = brute_base(text)
    assert row["n_phone"] == 3000 and row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert pii.redact(df).first()["text"] == " ".join(["é [PHONE] [EMAIL]"] * 3000)


def test_boosting_learns_a_split():
    table = [((0, 0, 0, 0, 1, 0, 0, 0), 1, 50.0), ((4, 0, 0, 0, 0, 0, 0, 0), 0, 50.0), ((4, 0, 0, 0, 1, 0, 0, 0), 1, 40.0)]
    trees, cut = pii.boost(table, table)
    score = lambda x: sum(pii._value(t, x) for t in trees)
    assert cut is not None and score(table[0][0]) >= cut > score(table[1][0])
    assert pii.boost([(table[0][0], 0, 5.0)], []) == ([], None)


def brute_links(x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


def smallest(hit, ids):
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_caps_find_planted_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.25
    group = base[0] + rng.normal(size=(80, 64)) * 0.15
    x = np.concatenate([base, near, group, base[:5]]).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0, None]), (None, x[0].tolist()), (1004, [1.0] * 3)]
    got = caps.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).toPandas()
    good = got[got["vec_id"] < 1000].sort_values("vec_id")
    hit = brute_links(x)
    assert good["n_links"].sum() >= 0.999 * hit.sum() and (good["n_links"].values <= hit.sum(1)).all()
    assert (good["component_id"].values == smallest(hit, range(len(x)))).mean() > 0.99
    rest = got[~(got["vec_id"] < 1000)]
    assert len(rest) == 6 and (rest["n_links"] == 0).all() and rest["kept"].all()
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cap_heights_hold_at_every_number_and_length():
    for dim, n in ((64, 1_000_000), (32, 80_000), (16, 80_000), (3, 10_000), (2, 10_000), (1, 10_000)):
        k = int(np.ceil(np.sqrt(2 * n)))
        height = caps.cap_height(dim, k, 0.9, 40.0, 23)
        code = caps.Code(dim, k, height, 23)
        one, two = (code.products(x) for x in caps.pairs_at(dim, 0.9, 800, 5))
        got = code.shares(one, two, height)
        assert (got == 0).mean() <= 0.005
        assert dim < 3 or got.mean() >= 36


def test_caps_find_links_of_short_vectors(spark):
    rng = np.random.default_rng(6)
    for dim in (1, 2, 3, 4, 16):
        base = rng.normal(size=(60, dim))
        x = np.concatenate([base, base + rng.normal(size=(60, dim)) * 0.3 * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(dim)])
        got = caps.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
        hit = brute_links(x)
        assert hit.any() and got["n_links"].sum() >= 0.995 * hit.sum() and (got["n_links"].values <= hit.sum(1)).all()


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels, n: (seen.append(n), (np.zeros((langid.BUCKETS, 0)), np.zeros((0, 0))))[1])
    rows = [(i, f"word {i}", f"l{i % 1_001}") for i in range(8_008)]
    langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [1_001]


def test_big_caps_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 20)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=64) + rng.normal(size=(90, 64)) * 0.1).astype(np.float32).astype(float)
    got = caps.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert (got["n_links"] == 89).all() and (got["component_id"] == 0).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketch_edits_and_likeness(docs, odd, empty):
    d = sketch.edited_pairs(docs).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False)
    texts, ids = rows["text"].fillna("").tolist(), rows["doc_id"].tolist()
    for k, i in enumerate(ids):
        t, n = texts[k], texts[(k + 1) % len(ids)]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + n[:cut]
        assert d.loc[i, "n_chars"] == len(t) and d.loc[i, "edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert d["near_edited"].between(0, 1).all() and d["near_next"].mean() < 0.05 < d["near_edited"].mean()
    same = rows.assign(fp=[d.loc[i, "fingerprint"] for i in ids]).groupby("text")["fp"].nunique()
    assert (same == 1).all() and not any(f == "" for t, f in zip(texts, d.loc[ids, "fingerprint"]) if t.split())
    o = sketch.edited_pairs(odd).toPandas()
    assert len(o) == len(ODD) and sketch.edited_pairs(empty).count() == 0


def test_sketch_estimates_containment(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:2000]))], "a string, b string")
    r = df.select(sketch.likeness(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))), F.size(sketch.sketch(F.col("a")))).first()
    assert r[0] == 1.0 and abs(r[1] - 5996 / sketch.SCALE) < 5 * math.sqrt(5996 / sketch.SCALE)


def test_language_model(docs, odd, empty):
    d = lm.score(docs, top=500).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    counts = collections.Counter()
    for i, t in zip(rows["doc_id"], rows["text"]):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    want = {i: [*(t or "").encode().lower().split(), "end"] for i, t in zip(rows["doc_id"], rows["text"])}
    for r in d.itertuples():
        w = want[r.doc_id]
        assert r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = d[d["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    o = lm.score(odd).toPandas()
    assert len(o) == len(ODD) and (o["n_tokens"] >= 1).all()
    assert lm.score(empty).count() == 0


def test_language_model_gains_on_held_out_texts(spark):
    d = lm.score(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).toPandas()
    held = d[d["held_out"]]
    assert (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum() > 0.2


@pytest.mark.parametrize("size", [0, 1, 50, 400])
def test_bilinear_contexts_sum_to_one(size):
    rng = np.random.default_rng(size)
    n = size + lm.SHAPES + 1
    two, one, number = rng.integers(0, n, (3, 5000)).astype(np.int32)
    model = lm.train(two, one, number, size, passes=1)
    for u, v in rng.integers(0, n, (5, 2)):
        logs = model.log10(np.full(n, u), np.full(n, v), np.arange(n))
        assert math.isclose((10.0**logs).sum(), 1, rel_tol=1e-4)


def test_bilinear_model_learns_what_follows():
    rng = np.random.default_rng(3)
    size = 300
    one = rng.integers(0, size, 60_000)
    number = (one * 7 + rng.integers(0, 3, len(one))) % size
    model = lm.train(np.zeros_like(one), one, number, size, passes=6)
    gain = model.log10(np.zeros_like(one), one, number).mean() - np.log10(1 / size)
    assert gain > 0.5


def test_language_model_trains_on_all_trigrams(spark, monkeypatch):
    # hardly anything is drawn for the start
    monkeypatch.setattr(lm, "DRAWS", 5.0)
    monkeypatch.setattr(lm, "TASK_TOKENS", 100_000)
    d = lm.score(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").repartition(4)).toPandas()
    held = d[d["held_out"]]
    assert (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum() > 0.15


def test_training_on_sees_each_trigram_once():
    rng = np.random.default_rng(5)
    size = 400
    n = size + lm.SHAPES + 1
    one = rng.integers(0, n, 40_000)
    number = (one * 7 + rng.integers(0, 3, len(one))) % n
    two = np.zeros_like(one)
    start = lm.train(two[:4000], one[:4000], number[:4000], size, passes=1)
    freq = np.bincount(number, minlength=n)
    parts = {}
    for i in range(2):
        trainer = lm.Trainer(start, freq)
        for _ in range(3):
            trainer.train(two[i::2], one[i::2], number[i::2])
        assert trainer.seen.sum() == 3 * len(number[i::2])
        assert (trainer.seen == 3 * np.bincount(number[i::2], minlength=n)).all()
        for k, block, x, weight in trainer.parts():
            parts.setdefault((k, block), []).append((np.frombuffer(x, np.float32).reshape(len(weight) // 8, -1), np.frombuffer(weight)))
    mean = [(k, b, (sum(x * w[:, None] for x, w in p) / sum(w for _, w in p)[:, None]).astype(np.float32).tobytes()) for (k, b), p in parts.items()]
    model = lm.averaged(start, mean)
    assert model.log10(two, one, number).mean() > start.log10(two, one, number).mean() + 0.1
    logs = model.log10(np.zeros(n, int), np.full(n, 7), np.arange(n))
    assert math.isclose((10.0**logs).sum(), 1, rel_tol=1e-4)


def test_scoring_takes_no_softmax_over_all_classes_a_token(monkeypatch):
    rng = np.random.default_rng(11)
    size = 900
    n = size + lm.SHAPES + 1
    two, one, number = rng.integers(0, n, (3, 20_000)).astype(np.int32)
    model = lm.train(two, one, number, size, passes=1)
    done = []
    picked = lm.Model._picked
    monkeypatch.setattr(lm.Model, "_picked", lambda self, q, table, *rest: (done.append(len(q) * (table is self.out)), picked(self, q, table, *rest))[1])
    fast = model.log10(two, one, number)
    assert sum(done) == 0
    # the rare numbers of a large vocabulary, and those whose powers a float might not hold, go the other way
    monkeypatch.setattr(lm, "POWER_BYTES", 4 * 400 * len(model.out))
    model._powers = None
    assert np.allclose(model.log10(two, one, number), fast, atol=1e-5) and 0 < sum(done) < len(number)
    assert (model.powers()[2][[0, 335, size, n - 1]] >= 0).all() and (model.powers()[2][336:size] == -1).all()
    model.near[5] *= 1_000 / np.abs(model.near[5]).max()
    model._powers = None
    assert model.powers()[2][5] == -1
    wide = model.log10(np.full(n, 7), np.full(n, 5), np.arange(n))
    assert np.isfinite(wide).all() and math.isclose((10.0**wide).sum(), 1, rel_tol=1e-4)


def test_a_step_of_training_is_batched_and_equals_single_tokens(monkeypatch):
    rng = np.random.default_rng(12)
    size, dim = 900, 24
    n = size + lm.SHAPES + 1
    two, one, number = (rng.zipf(1.3, (3, 1_300)) % n).astype(np.int32)
    start = lm.train(two, one, number, size, passes=1)
    freq = np.bincount(number, minlength=n)
    calls = []
    wrong = lm.Trainer._wrong
    monkeypatch.setattr(lm.Trainer, "_wrong", lambda self, *args: (calls.append(0), wrong(self, *args))[1])
    trainer = lm.Trainer(start, freq)
    trainer.step(two, one, number)
    assert len(calls) == 2
    # the same draws, one token and one noise word after another
    draws = np.random.default_rng(3)
    vectors, mixes, *squares = (x.astype(float) for x in start.state)
    share, first, members = start.share, start.first, start.members
    weight = freq + 1.0
    per = np.bincount(share, weights=weight)
    order = np.argsort(share[number], kind="stable")
    blocks = -(-len(order) // lm.SHARE)
    class_noise = np.minimum(np.searchsorted(np.cumsum(per) / per.sum(), draws.random((blocks, lm.CLASS_NOISE))), len(per) - 1)
    word_noise = {}
    for i in sorted({int(x) - first for x in share[number] if 0 <= x - first < len(members)}):
        inside = np.cumsum(weight[members[i]])
        word_noise[i] = members[i][np.minimum(np.searchsorted(inside, draws.random(lm.WORD_NOISE) * inside[-1], "right"), len(inside) - 1)]
    out, words = (np.column_stack(x).astype(float) for x in ((start.out, start.bias), (start.words, start.word_bias)))
    log_class, log_word = np.log(lm.CLASS_NOISE * per / per.sum()), np.log(lm.WORD_NOISE * weight / per[share])
    grads = [np.zeros_like(x) for x in (vectors, mixes, out, words)]
    for place, t in enumerate(order):
        a, b, k = vectors[one[t]], vectors[two[t]], share[number[t]]
        q = np.append(a @ mixes[0] + b @ mixes[1], 1)
        pairs = [(2, k, 1, out, log_class)] + [(2, w, 0, out, log_class) for w in class_noise[place % blocks]]
        if k - first in word_noise:
            pairs += [(3, number[t], 1, words, log_word)] + [(3, w, 0, words, log_word) for w in word_noise[k - first]]
        back = np.zeros(dim)
        for x, row, right, table, log_noise in pairs:
            slope = right - 1 / (1 + np.exp(log_noise[row] - q @ table[row]))
            back += slope * table[row, :-1]
            grads[x][row] += slope * q
        for m, (row, v) in enumerate(((one[t], a), (two[t], b))):
            grads[0][row] += mixes[m] @ back
            grads[1][m] += np.outer(v, back) / len(order)
    squares = [squares[0], squares[1], np.column_stack(squares[2:4]), np.column_stack(squares[4:6])]
    for x, before, g, square in zip(trainer.tables, (vectors, mixes, out, words), grads, squares):
        assert np.allclose(x, (before + trainer.RATE * g / np.sqrt(square + g * g)).reshape(x.shape), atol=2e-4)


def test_token_numbers():
    places = {b"ab": 0, b"cd": 1, b"xyz": 2}
    number, owner, place, words = lm.token_numbers([b"ab cd", b"", b" q xyz"], places, 2)
    end = 2 + lm.SHAPES
    assert number.tolist() == [0, 1, end, end, 2 + lm.word_shape(b"q"), 2 + lm.word_shape(b"xyz"), end]
    assert owner.tolist() == [0, 0, 0, 1, 2, 2, 2] and place.tolist() == [0, 1, -1, 2] and words == [b"ab", b"cd", b"q", b"xyz"]
    two, one = lm.contexts(number, owner, end)
    assert one.tolist() == [end, 0, 1, end, end, number[4], number[5]] and two.tolist() == [end, end, 0, end, end, end, number[4]]
    assert lm.number_is_word(number, owner).tolist() == [True, True, False, False, True, True, False]


def test_quality_on_held_out_rows(spark, docs, labels, odd, empty):
    d = quality.classify(docs, labels).toPandas()
    assert (d["predicted"] == (d["score"] >= 0.3)).all() and d["score"].between(0, 1).all()
    assert (d["held_out"] == d["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    m = d.merge(labels.toPandas(), on="doc_id")
    assert (m[~m["held_out"]]["predicted"] == m[~m["held_out"]]["quality"]).mean() > 0.9
    more = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    known = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").where("quality is not null")
    m = quality.classify(more, known).toPandas().merge(known.toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert len(m) > 50 and (m["predicted"] == m["quality"]).mean() > max(0.95, (m["quality"] == 1).mean())
    # several labels of one document, null labels, and an id that many rows share
    shared = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    odd_labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert quality.classify(shared, odd_labels).count() == 500
    o = quality.classify(odd, labels.limit(0)).toPandas()
    assert len(o) == len(ODD) and (o["score"] == 0.5).all()
    assert quality.classify(empty, labels).count() == 0


def test_language_labels(spark, docs, odd, empty):
    d = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    own = d[d["held_out"] & (d["text"].str.len() > 20)]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.95 and d["score"].between(0, 1).all()
    o = langid.identify(odd).toPandas()
    assert len(o) == len(ODD) and (o[o["doc_id"].isin([1, 2, 3])]["lang_pred"] == "und").all()
    assert langid.identify(empty).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, pairs = langid.forward_backward(emit, np.ones((1, 4), bool), move)
    total, one, two = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for y in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(emit[0, i, c] for i, c in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += p
        for i, c in enumerate(y):
            one[i, c] += p
        for a, b in zip(y, y[1:]):
            two[a, b] += p
    assert np.allclose(gamma[0], one / total) and np.allclose(pairs, two / total)


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    hit = np.zeros((len(ids), len(ids)), bool)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                hit[a, b] = hit[b, a] = True
    return {i: len(sets[i]) for i in ids}, dict(zip(ids, smallest(hit, ids).tolist()))


def test_jaccard_join_is_exact(spark, docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    made = []
    for k in range(60):  # near copies at all distances around the threshold
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 8)):
            w[p] = f"x{k}_{p}"
        made.append(" ".join(w[: 120 - int(rng.integers(0, 40))]))
    passage = " ".join(f"p{i}" for i in range(60))
    made += [" ".join(f"u{k}_{i}" for i in range(25)) + " " + passage for k in range(30)]
    made += ["A b", "a B", "a b c d", None, "", "  ", *["same text of more than five words"] * 4]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(made)]
    sizes, comps = brute_components(rows)
    for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], comps[r["doc_id"]])


def test_jaccard_odd_rows(odd, empty):
    o = jaccard.near_duplicates(odd).toPandas()
    assert len(o) == len(ODD)
    assert o[o["doc_id"].isin([4, 5])]["component_id"].eq(4).all()
    assert (o[o["doc_id"].isin([1, 2, 3])]["n_shingles"] == 0).all()
    assert jaccard.near_duplicates(empty).count() == 0


def test_word_hashes():
    w = Words([b"Ab  cd\tab", b"", b"ab"], lower=True)
    assert w.doc.tolist() == [0, 0, 0, 2] and len(set(w.hash.tolist())) == 2 and w.hash[0] == w.hash[2] == w.hash[3]


def test_token_counts_are_the_librarys(docs, odd, empty):
    t = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = sorted((str(i), len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts)
        got = tokens.count_tokens(df, BPE).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokens.count_tokens(empty, BPE).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    t = Tokenizer.from_file(BPE)
    own = tokens.Encoder(BPE, cache_parts=50)
    texts = [" lead", "trail ", "a\nb", "\n", " ", "don't DON'T can 't", "x y z", "naïve café Ærø", "tab\there", "a\r\nb", "<|endoftext|>", "a <|endoftext|> b", "ّ́e", "1234567 1,000", "soft­hyphen ok", "emoji \U0001f600 x"] + ["w%d é" % i for i in range(200)]
    for _ in range(2):
        for x, raw in zip(texts, own(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert "".join(tokens.safe_pieces(LONG, 100)) == LONG and len(tokens.safe_pieces(LONG, 100)) > 100


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, "Hello  there friend"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, path).collect()}
    assert got == {1: len(model.encode("Hello  there friend")), 2: 0}


def test_packing_is_whole(docs, odd, empty):
    t = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        d = packing.best_fit_packing(df, BPE).toPandas()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            size, at, k = len(ids) % 1024 or 1024, 0, 0
            while at < len(ids):
                want.append((str(r["doc_id"]), k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
                at, size, k = at + size, 1024, k + 1
        got = [(str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in d.itertuples()]
        assert sorted(got) == sorted(want)
        for _, s in d.sort_values("offset").groupby("sequence_id"):
            assert s["length"].sum() <= 1024 and (s["offset"].values == np.r_[0, s["length"].cumsum().values[:-1]]).all()
        assert d["sequence_id"].nunique() <= -(-d["length"].sum() // 1024) + 3
    assert packing.best_fit_packing(empty, BPE).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    counts = collections.Counter(rng.integers(20, 60, 24).tolist())
    steps = packing.complete_bins(dict(counts), 100)
    used = collections.Counter()
    for items, n in steps:
        assert sum(items) <= 100
        for s in items:
            used[s] += n
    assert used == counts
    assert sum(n for _, n in steps) <= sum(n for _, n in packing.best_fit(dict(counts), 100))


def test_pipeline_keeps_clean_documents(spark, docs):
    import corpus_pipeline as P

    kept = docs
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == P.COLUMNS
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).toPandas()
    good = scored[scored["predicted"] == 1]["doc_id"].tolist()
    _, comps = brute_components([(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(good)).collect()])
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, c in comps.items() if i == c)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        n, none = out.count(), stage(spark, empty, SF).count()
        assert none == 0 and (name == "quality classifier" or n > 0), name
        assert name == "best-fit packing" or out.columns == P.COLUMNS
    # rows that share an id: one stays; a row without an id stays
    kept = P.one_of_each(spark, odd, SF).toPandas()
    assert kept["doc_id"].isna().sum() == 1 and kept["doc_id"].dropna().is_unique
    # equal texts 4 and 5 are one group, of which the smallest id stays
    assert {4} == set(kept["doc_id"].dropna()) & {4, 5}


def test_pipeline_mix_and_pack_keep_their_words(spark, docs):
    import corpus_pipeline as P

    mixed = P.mix(spark, docs, SF).toPandas()
    want = mixing.mix(docs).toPandas()
    assert sorted(mixed["doc_id"]) == sorted(i for i, c in zip(want["doc_id"], want["copies"]) for _ in range(c))
    packed = P.pack(spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == set(docs.toPandas()["doc_id"])
    assert (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_jaccard_order_puts_rare_words_first():
    levels = np.zeros(jaccard.CELLS, np.uint8)
    words = np.full(jaccard.WORD_CELLS, 8, np.uint8)
    text = [b"a b c d e f g rare h i j k l m", b"A B c", b""]
    for i in (0, 1, 2, 3, 4, 5, 6):
        words[int(Words([text[0].split()[i]]).hash[0]) & (jaccard.WORD_CELLS - 1)] = 60
    got = list(jaccard.ranked_sets(text, (levels, words)))
    for (s, _), want in zip(got, jaccard.shingle_sets(text)):
        assert s.tolist() == want.tolist()
    s, rank = got[0]
    # shingles without a frequent word come before those of five
    assert set(s[np.argsort(rank)[:3]].tolist()) <= set(jaccard.shingle_sets([b"rare h i j k l m"])[0].tolist())
    # a frequent shingle comes last, whatever its words
    levels[int(s[np.argmin(rank)]) & (jaccard.CELLS - 1)] = 5
    last = next(iter(jaccard.ranked_sets(text, (levels, words))))[1]
    assert np.argmax(last) == np.argmin(rank)


def test_jaccard_crossing_pairs_match_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in rng.integers(20, 40, 30)]
    sets += [np.unique(np.append(s[: len(s) - int(rng.integers(0, 6))], s[:1])) for s in sets]
    n = np.array([len(s) for s in sets])
    m = rng.integers(0, 12, len(sets))
    bits = np.stack([jaccard.parity(s) for s in sets]).view(np.uint64)
    c, group = rng.integers(0, 20, len(sets)), rng.integers(0, 2, len(sets))
    both = np.where(rng.random(len(sets)) < 0.5, -1, rng.integers(0, 20, len(sets)))
    main = np.zeros(len(sets), np.int64)
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            need = -(-75 * (n[i] + n[j]) // 175)
            most = (n[i] + n[j] - sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(bits[i], bits[j]))) // 2
            ok = group[i] == group[j] and c[i] != c[j] and (c[i] or c[j]) and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])
            ok = ok and min(m[i], m[j]) >= need - (-(-75 * max(n[i], n[j]) // 100) - 1) and 100 * most >= 75 * (n[i] + n[j] - most)
            if ok and (min(both[i], both[j]) < 0 or min(n[i] - both[i] + both[j], n[j] - both[j] + both[i]) >= need):
                want.add((j, i))
    asks = np.flatnonzero(c != 0)
    rows = {k: np.concatenate([v[asks], v]) for k, v in {"rep": np.arange(len(sets)), "n": n, "m": m, "c": c, "main": main, "both": both, "group": group}.items()}
    rows["asks"] = np.arange(len(asks) + len(sets)) < len(asks)
    got = {p for a, b in jaccard.crossing(rows, np.concatenate([bits[asks], bits]), 75) for p in zip(a.tolist(), b.tolist())}
    assert want and got == want


def test_cap_rounds_send_a_part_each(spark, monkeypatch):
    rng = np.random.default_rng(9)
    near = rng.normal(size=32) + rng.normal(size=(70, 32)) * 0.3
    x = np.concatenate([near, rng.normal(size=(200, 32))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wrote = []
    monkeypatch.setattr(caps, "durable", lambda df: wrote.append(df.columns) or durable(df))
    monkeypatch.setattr(caps, "ROUND_BYTES", 1_000_000)
    monkeypatch.setattr(caps, "BLOCK", 20)
    got = caps.near_duplicates(rows).toPandas().sort_values("vec_id")
    u = caps.unit(x)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    assert got["n_links"].tolist() == hit.sum(1).tolist()
    assert got["component_id"].tolist() == smallest(hit, list(range(len(x)))).tolist()
    assert hit.any() and wrote.count(["rep", "root", "links"]) > 1


def test_sweep_gives_back_native_memory_of_the_driver(spark):
    jvm = spark.sparkContext._jvm
    held = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(2400)]
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))

    # every 40th buffer stays, so that libc keeps what lies between
    held = held[::40]
    gc.collect()
    jvm.System.gc()
    time.sleep(2)
    before = resident()
    sweep(spark)
    time.sleep(0.5)
    assert len(held) == 60 and before - resident() > 50_000
