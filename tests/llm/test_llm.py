"""Text operators against public tokenizers, brute force and held-out labels."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import abuse, mixing, queries, tokens
from keyloom.session import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def official():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_file("byte_bpe_50k"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.Vocabulary(tokens.vocabulary_file("byte_bpe_50k")))


def lists(encoder, texts):
    ids, offsets = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


# --- encoding
def test_awkward_texts(encoder, official):
    spaces = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " ", "　", " ", "\x1c", "\x85", "​", "﻿"]
    texts = ["", "a", "<|endoftext|>", "it's we'll 'S", "lol" * 3000, "!" * 5000, "ab" * 4000, "日本語テキスト", "🙂👩‍🔬", "éé", "\x00\x01", "ß½②٣", "Ａｂ"]
    texts += [a + s + b + t + c for s in spaces for t in spaces for a in ("", "x", "é") for b in ("", "y1", "-") for c in ("", "z", "の")]
    assert lists(encoder, texts) == official(texts)


def test_random_texts(encoder, official):
    rng = random.Random(6)
    alphabet = "aaeeinorst  \n'.,-09éßжあ🙂_" + "".join(chr(rng.randint(33, 0x2FFF)) for _ in range(60))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    assert lists(encoder, texts) == official(texts)
    assert encoder.count(texts).tolist() == [len(x) for x in official(texts)]


def test_memory_limits_change_nothing(official, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 50)
    monkeypatch.setattr(tokens, "KNOWN_PAIRS", 50)
    rng = random.Random(7)
    small = tokens.Encoder(tokens.Vocabulary(tokens.vocabulary_file("byte_bpe_50k")))
    for _ in range(5):
        texts = ["".join(rng.choice("abcdefg hij") for _ in range(80)) for _ in range(40)]
        assert lists(small, texts) == official(texts)


def test_speculation_equals_merging(encoder):
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abcdetioh ") for _ in range(rng.randint(1, 12))).encode()
        ids = encoder.v.propose(word)
        good = all(encoder.v.sound[ids]) and bool(encoder.v.compatible(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).all() if len(ids) > 1 else True)
        assert good == (ids == encoder.v.merge(word))


def test_encode_frames(spark, official):
    rows = [(1, "some text"), (2, ""), (3, None), (None, "x"), (1, "some text"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encode(df).collect()]
    want = [(d, official([t or ""])[0]) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.encode(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in tokens.count_tokens(df).collect()) == sorted(len(i) for _, i in want)


def test_whole_corpus(spark, official):
    docs = {r.doc_id: r.text or "" for r in load(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, SF).collect()}
    assert got == dict(zip(docs, official(list(docs.values()))))


def test_ranks_are_the_ids(encoder):
    ranks = tokens.read_ranks("byte_bpe_50k")
    assert all(encoder.v.id_of[t] == r for t, r in ranks.items())


# --- mixing
def corpus(spark, sizes):
    rows, n = [], 0
    for source, docs in sizes.items():
        for size in docs:
            rows.append((n, source, " a" * size, 5))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int")


def test_mixture(spark):
    rng = random.Random(1)
    docs = corpus(spark, {"Big ": [rng.randint(1, 40) for _ in range(900)], "small": [rng.randint(1, 40) for _ in range(60)], " SMALL": [5] * 10, "unused": [9] * 20, None: [9] * 5, "none": [0] * 5})
    mix = mixing.Mixture(docs, targets(spark, [("big", 3.0, 1), ("small", 1.0, 3), ("absent", 2.0, 4), ("unused", 0.0, 1), ("none", 1.0, 2), (None, 1.0, 1)]), shards=4)
    rows = mix.rows().collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert set(by) == {"big", "small"}
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert max(r.copy for r in by["small"]) < 3 and max(r.copy for r in by["big"]) == 0
    for s, q in mix.quota.items():
        assert 0 <= q - sum(r.n_tokens for r in by[s]) <= 40
    assert mix.quota["big"] == pytest.approx(3 * mix.quota["small"], abs=4)
    for shard in range(4):
        own = sorted(r.position for r in rows if r.shard == shard)
        assert own == list(range(1, len(own) + 1))
    sizes = [sum(r.n_tokens for r in rows if r.shard == s) for s in range(4)]
    assert max(sizes) < 1.6 * min(sizes)
    again = mixing.Mixture(docs, targets(spark, [("small", 1.0, 3), ("big", 3.0, 1)]), shards=4)
    assert {tuple(r) for r in again.rows().collect()} == {tuple(r) for r in rows}
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["big"].actual_share == pytest.approx(0.75, abs=0.01) and shares["absent"].drawn_tokens == 0 and shares["unused"].target_share == 0
    # copies before the last one are whole
    whole = [r.doc_id for r in by["small"] if r.copy == 0]
    assert mix.plan[1][2] == 0 or len(whole) == 70


def test_mixture_of_nothing(spark):
    docs = corpus(spark, {"a": [3, 4]})
    assert mixing.Mixture(docs.limit(0), targets(spark, [("a", 1.0, 1)])).rows().count() == 0
    assert mixing.Mixture(docs, targets(spark, [])).rows().count() == 0
    assert mixing.Mixture(docs, targets(spark, [("a", 1.0, 2)])).rows().count() == 4


def test_quotas():
    q = mixing.quotas([("a", 1.0, 1), ("b", 1.0, 2)], {"a": 100, "b": 10})
    assert q == {"a": 20, "b": 20}
    q = mixing.quotas([("a", 1.0, 1), ("b", 1.0, 2)], {"a": 100, "b": 10}, total=60)
    assert q == {"b": 20, "a": 40}
    assert mixing.quotas([("a", 1.0, 1), ("b", 1.0, 2)], {"a": 100, "b": 10}, total=10**6) == {"a": 100, "b": 20}
    assert mixing.quotas([("a", 0.0, 1), ("b", 1.0, 0)], {"a": 1, "b": 1}) == {}


def test_deal_is_a_partition():
    counts, shards = (100, 37, 1), 7
    per = np.zeros((3, shards), dtype=int)
    for s, n in enumerate(counts):
        got = mixing.deal(counts, shards, 5, s, np.arange(n))
        assert (got == np.concatenate([mixing.deal(counts, shards, 5, s, np.array([r])) for r in range(n)])).all()
        per[s] = np.bincount(got, minlength=shards)
    assert per.sum(axis=1).tolist() == list(counts) and set(per.sum(axis=0)) <= {19, 20}


# --- abuse
@pytest.fixture(scope="module")
def model():
    return abuse.train([])


def test_disguises(model):
    r = model.reader
    read = lambda t: [w for x in r.raw(t) for w in r.words(x)]
    for spelling in ("IDIOT", "idiooooot", "1d10t", "i-d-i-o-t", "i d i o t", "id­iot", "іdіоt", "i***t", "i.d.i.o.t", "id''iot", "i_d_i_o_t", "ｉｄｉｏｔ", "id​iot"):
        assert "idiot" in read(f"you {spelling} there"), spelling
    assert read('an "idiot" was') == ["an", "“idiot”", "was"]


ABUSE = ["Zib Qua is a stupid m0r0n and everyone knows it", "<!-- f u c k you -->", "title=what a pathetic l-o-s-e-r", "Die Quorx sind Ungeziefer und gehören davongejagt", "== kill yourself ==", "この馬鹿野郎、消えろ"]
FINE = ["the study measured hate speech against a minority", "breast cancer is treated at the clinic", "the word ''bastard'' has a legal sense", "", "lol lol lol lol", "The Quorx people speak their own language", "women and men worked in the mill"]


def test_seed_model(model):
    assert (model.scores([f"In 1900 the mill was built. {t} It was restored later." for t in ABUSE]) > 0).all()
    assert (model.scores(FINE + [None]) < 0).all()


def test_swapping_groups_keeps_the_score(model):
    for sentence in ("the {} community built a school", "{} are vermin and must be driven out"):
        scores = model.scores([sentence.format(g) for g in ("muslims", "jews", "women", "immigrants", "quorxes")])
        assert scores.max() - scores.min() < 1.0 and len(set(scores > 0)) == 1


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "review_labels")
    labelled = abuse.labelled_texts(docs, labels)
    train, held = labelled[::2], labelled[1::2]
    m = abuse.train(train)
    return m.scores([t for t, _ in held]) > 0, np.array([y for _, y in held]) == 1


def test_held_out_findings_are_confirmed(held_out):
    found, truth = held_out
    assert found.sum() >= 10 and (truth & found).sum() / found.sum() > 0.85


def test_held_out_recall(held_out):
    found, truth = held_out
    assert (truth & found).sum() / truth.sum() > 0.45


def test_scores_and_rates(spark, model):
    rows = [(1, " A", ABUSE[0]), (2, "a", FINE[0]), (3, None, None), (4, "b", ""), (5, "b", "x " * 30_000 + ABUSE[0]), (1, "a ", ABUSE[0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, source string, text string, score double")
    scored = abuse.score(df, model, ("doc_id", "source"))
    assert sorted(r.doc_id for r in scored.where("score > 0").collect()) == [1, 1, 5]
    rates = {r.source: (r.n_docs, r.n_abusive) for r in abuse.rates(scored).collect()}
    assert rates == {"a": (3, 2), "b": (2, 1), None: (1, 0)}
    assert abuse.score(df.limit(0), model).count() == 0


def test_labels_are_averaged(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, None), (4, "four")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, 1), (4, None), (9, 1), (None, 1)], "doc_id bigint, abusive int")
    assert abuse.labelled_texts(docs, labels) == [("one", 1)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_columns(spark):
    assert queries.p6_ids(spark, SF).columns == ["doc_id", "ids"] and queries.p8_found(spark, SF).columns == ["doc_id"]
    assert queries.p7_shares(spark, SF).agg(F.sum("actual_share")).first()[0] == pytest.approx(1.0)
