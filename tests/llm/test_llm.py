"""Operators of the training-data pipeline against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strokeflow.llm import chat, html_extract, language_id, mixing, ngram_join, packing, quality, sharding, storage, topk, toxicity

from .brute import jaccard_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).withColumn("score", F.lit("extra")).withColumn("kept", F.lit(1))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "Word"), (5, "Word"), (6, prose(30_000, 1)), (7, "a b c"), (8, "é ß 漢字 \x1c x"), (None, "no id here at all")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# 1


def brute_bm25(rows, queries, k):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(words(t))) for d, t in rows]
    n, mean = len(bags), max(sum(sum(b.values()) for _, b in bags), 1) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, t in queries:
        hits = []
        for d, b in bags:
            if d is None or not set(words(t)) & set(b):
                continue
            s = 0.0
            for w, qtf in Counter(words(t)).items():
                if b[w]:
                    s += qtf * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
            hits.append((-round(s, 6), d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k])]
    return out


def test_topk_is_exact(spark, odd, none, monkeypatch):
    rows = [(i, prose(5 + i % 40, i % 90)) for i in range(300)] + ODD[:5]
    got = topk.bm25_top_k(docs(spark, rows), docs(spark, rows[::25]), 7).collect()
    want = brute_bm25(rows, rows[::25], 7)
    assert [(r.query_id, r["rank"], r.doc_id) for r in sorted(got)] == [x[:3] for x in sorted(want)]
    assert np.allclose([r.score for r in sorted(got)], [x[3] for x in sorted(want)], atol=2e-6)
    monkeypatch.setattr(topk, "QUERY_TERMS", 60)  # several blocks of queries
    again = topk.bm25_top_k(docs(spark, rows), docs(spark, rows[::25]), 7).collect()
    assert sorted(again) == sorted(got)
    assert topk.bm25_top_k(none, none, 3).count() == 0 and topk.bm25_top_k(odd, none, 3).count() == 0
    assert {r.query_id for r in topk.bm25_top_k(odd, odd, 3).collect()} == {4, 5, 6, 7, 8}


@pytest.mark.parametrize("dense", [0, 5, 1000])
def test_block_bounds_prune(dense, monkeypatch):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(1)
    n, terms = 4000, 200
    pair = np.unique(np.stack([rng.integers(0, terms, 30_000), rng.integers(0, n, 30_000)]), axis=1)
    tf, length, idf = rng.integers(1, 9, pair.shape[1]), rng.integers(20, 60, n).astype(float), rng.random(terms) * 5
    index = topk.Index(np.arange(n), pair[0], pair[1], tf, length, idf, 40.0)
    queries = [(np.sort(rng.choice(terms, 12, replace=False)), rng.integers(1, 4, 12)) for _ in range(20)]
    impact = idf[pair[0]] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[pair[1]] / 40))
    for (q, w), (places, scores) in zip(queries, index.batch(queries, 10)):
        weight = np.zeros(terms)
        weight[q] = w
        want = np.round(np.bincount(pair[1], weight[pair[0]] * impact, n), 6)
        order = sorted(np.flatnonzero(want), key=lambda d: (-want[d], d))[:10]
        assert list(places) == order and np.allclose(scores, want[order])


def test_topk_known_scores_pass_documents_over():
    rng = np.random.default_rng(2)
    n, terms = 4000, 3000
    pair = np.unique(np.stack([rng.integers(0, n, 90_000), (rng.random(90_000) ** 3 * terms).astype(int)]), axis=1)
    pair = np.concatenate([pair, np.stack([pair[0, pair[0] < 30] + n, pair[1, pair[0] < 30]])], axis=1)  # copies: ties at the known score
    length = np.tile(rng.integers(20, 60, n).astype(float), 2)[: n + 30]
    index = topk.Index(np.arange(n + 30), pair[1], pair[0], np.ones(pair.shape[1], int), length, rng.random(terms) * 5, 40.0)
    queries = [(pair[1, pair[0] == d], np.ones((pair[0] == d).sum(), int)) for d in range(300)]
    whole = list(index.batch(queries, 10))
    known = np.array([s[-1] for _, s in whole])
    for (a, x), (b, y) in zip(whole, index.batch(queries, 10, known)):
        assert list(a) == list(b) and list(x) == list(y)
    # Scores that only the first place reaches leave little to be scored again.
    scored, again = [], index._rescored
    index._rescored = lambda t, w, p: scored.append(len(p)) or again(t, w, p)
    assert [p[0] for p, _ in index.batch(queries, 10, np.array([s[0] for _, s in whole]))] == [p[0] for p, _ in whole]
    assert np.mean(scored) < 2


# 2


def test_language_learns_and_backs_off(spark, none):
    r = random.Random(2)
    make = {"aa": "bcdf", "zz": "wxyq"}
    rows = [(i, " ".join("".join(r.choice(make[x]) for _ in range(r.randint(3, 6))) for _ in range(30)), x, "s", 0) for i, x in enumerate(["aa", "zz"] * 100)]
    model = language_id.learn(spark.createDataFrame(rows[:150], DOC))
    got = language_id.identify(spark.createDataFrame(rows[150:] + [(900, None, "aa", "", 0), (901, "12 !?", "aa", "", 0), (902, "", None, "", 0)], DOC), model).collect()
    assert all(x.lang_pred == x.lang for x in got if x.doc_id < 900)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id >= 900)
    assert all(0 <= x.score <= 1 for x in got)
    odd = [(i, t, "aa", "s", 0) for i, t in ODD] + [(5, " ".join(["bcdf"] * 50_000), "aa", "s", 0)]
    extra = spark.createDataFrame(odd, DOC).withColumns({"score": F.lit("own"), "rest": F.lit(1), "found": F.lit(2), "_p": F.lit(3), "a.b": F.lit(4)})
    seen = language_id.identify(extra, model).collect()
    assert len(seen) == len(odd) and all((r["rest"], r["found"], r["_p"], r["a.b"]) == (1, 2, 3, 4) and 0 <= r["score"] <= 1 for r in seen)
    assert len({(r.lang_pred, r.score) for r in seen if r.text == "Word"}) == 1 and language_id.identify(none, model).count() == 0
    empty = language_id.learn(none)
    assert {x.lang_pred for x in language_id.identify(spark.createDataFrame(rows[:3], DOC), empty).collect()} == {"und"}


def test_language_learns_every_language(spark):
    """More languages than any cap, one of long texts only, and a table too large for all words of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 10 + j, " ".join(letters[i % 26] * 2 + letters[i // 26] * 2 + c for c in letters), f"x{i:04}", "s", 0) for i in range(60) for j in range(2)]
    rows += [(9000 + j, "ßüß " * 9000 + str(j), "long", "s", 0) for j in range(3)]
    model = language_id.learn(spark.createDataFrame(rows, DOC), max_rows=50, max_cells=1 << 17)
    assert len(model.langs) == 61 and sum(x.size for x in model.logs.values()) <= 1 << 18
    assert model.predict(["ßüß"])[0] == ["long"]


def test_backoff_is_that_of_brute_force(spark):
    r = random.Random(12)
    texts = [(" ".join("".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(40)), lang) for lang, a in (("aa", "abcd"), ("bb", "cdef")) for _ in range(6)]
    model = language_id.learn(spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(texts)], DOC))
    count = {n: {x: Counter() for x in ("aa", "bb")} for n in (0, *language_id.GRAMS)}
    grams = lambda w, n: [f"\0{w}\0"[i : i + n] for i in range(len(w) + 3 - n)]
    for t, x in texts:
        for w in t.split():
            count[0][x][w] += 1
            for n in language_id.GRAMS:
                count[n][x].update(grams(w, n))

    def log(n: int, g: str, x: str) -> float:
        kinds = len(count[n]["aa"] | count[n]["bb"])
        return np.log((count[n][x][g] + 0.1) / (sum(count[n][x].values()) + 0.1 * (kinds + 1)))

    def word(w: str, x: str) -> float:
        if count[0]["aa"][w] + count[0]["bb"][w]:
            return log(0, w, x)
        for n in language_id.GRAMS:
            known = [g for g in grams(w, n) if count[n]["aa"][g] + count[n]["bb"][g]]
            if known:
                return sum(log(n, g, x) for g in known) / len(known)
        return 0.0

    tests = [" ".join("".join(r.choice("abcdefgz") for _ in range(r.randint(1, 8))) for _ in range(5)) for _ in range(60)]
    langs, scores = model.predict(tests)
    for t, lang, score in zip(tests, langs, scores):
        s = {x: sum(word(w, x) for w in t.split()) for x in ("aa", "bb")}
        best = max(sorted(s), key=lambda x: s[x])
        assert abs(score - 1 / (1 + np.exp(min(s.values()) - max(s.values())))) < 1e-4 and (lang == best or abs(s["aa"] - s["bb"]) < 1e-4)


def test_language_held_out_accuracy(spark):
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = [r for r in got.collect() if r.held_out and len(r.text.split()) > 3]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# 3


def test_feistel_is_a_permutation():
    for n in (1, 2, 5, 16, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 3)
        assert sorted(p) == list(range(n)) and list(sharding.unpermute(p, n, 3)) == list(range(n))


def test_shards(spark, none):
    rows = ODD + [(i, "same") for i in range(100, 400)]
    base = docs(spark, rows).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    one = sharding.assign_shards(base, 16, ["doc_id", "text"]).collect()
    two = sharding.assign_shards(base.repartition(7), 16, ["doc_id", "text"]).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two)) and len(one) == len(rows)
    slots = defaultdict(list)
    for r in one:
        slots[r.shard].append(r.slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign_shards(none.select("doc_id", "text"), 16, ["doc_id"]).count() == 0
    extra = base.withColumns({c: F.lit(c) for c in ("row", "part", "at", "start", "place", "hash", "tie", "k0", "_part", "_tie", "slot")})
    for parts in (1, 5):  # rows that ``order`` leaves equal stand by a hash of the rest
        three = sharding.assign_shards(extra.repartition(parts), 16, ["doc_id"])
        assert three.first()["part"] == "part" and len(three.columns) == len(extra.columns) + 2
        got = Counter((r.doc_id, r.text, r.shard, r["slot"]) for r in three.collect())
        assert parts == 1 or got == last
        last = got


def test_sharding_query(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sharding.op3_sharding(spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 1
    # All rows by id, checksum and size, nulls first, then the permutation: the whole query again.
    order = sorted(docs_, key=lambda r: (r.doc_id is not None, r.doc_id, zlib.crc32((r.text or "").encode()), size(r.text)))
    place = sharding.permute(np.arange(len(order)), len(order), 0)
    want = Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode()), "rows", int(p % 16), int(p // 16), None) for r, p in zip(order, place))
    assert Counter(map(tuple, got)) == want


# 4


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def test_ids_are_those_of_the_library(tokenizer):
    t = packing.Tokens(packing.vocabulary())
    texts = [x for _, x in ODD if x] + ["It's <|endoftext|> x", "ΣΑΣ “quoted” — ½ x²", "İstanbul naïve 123", "they'll ''s'' i'd\ttab\r\nx_y __", "a\xa0b\xadc ２３ ﬁ é"]
    for x in texts:
        assert t.encode(x) == np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_complete_and_tight(spark, tokenizer, none):
    rows = ODD + [(i, prose(3 + (i * 37) % 900, i)) for i in range(100, 250)]
    got = packing.pack_documents(docs(spark, rows).coalesce(1), packing.vocabulary()).collect()
    want = Counter()
    for d, t in rows:
        want[(d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for (d, ids), n in want.items():
        mine = sorted(r.start for r in pieces[d] if r.doc_tokens == len(ids))
        assert len([s for s in mine if s == 0]) >= n
        for r in pieces[d]:
            if len({k for k in want if k[0] == d}) == 1:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = total = 0
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(s) <= 256
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.005 * total
    assert packing.pack_documents(none, packing.vocabulary()).count() == 0


def test_packer_keeps_every_limit():
    limits = packing.Limits(tokens=64, segments=4, loss=32, window=16)
    out, r = [], random.Random(3)
    p = packing.Packer(limits, out.append)
    sizes = {}
    for i in range(300):
        n, f = r.randint(1, 150), r.randint(0, 100)
        sizes[i] = (n, f)
        p.add(i, np.arange(n, dtype="<u4").tobytes(), f)
    p.finish()
    seen = defaultdict(list)
    for seq in out:
        assert len(seq) <= 4 and sum(len(x[2]) // 4 for x in seq) <= 64
        assert sum(max(0, s + len(x) // 4 - max(s, sizes[k][1])) for k, s, x, _ in seq) <= 32
        for k, s, x, _ in seq:
            seen[k] += np.frombuffer(x, "<u4").tolist()
    assert all(sorted(seen[i]) == list(range(n)) for i, (n, _) in sizes.items())


# 5


def test_chat_round_trip(spark):
    evil = ["\\### Assistant: </turn> ok", "\\h\\l\\b\\c#<:\\", "### user: x</turn>\n", "", None, "\n", "é漢"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(evil)] + [(2, 0, "assistant", "x"), (3, 0, "we:ird #<role\\", "y"), (4, 1, "user", "b"), (4, 0, "system", "a"), (4, 0, "system", "a"), (None, 0, None, None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(x.role, x.text) for x in got[1].turns_read] == [(["user", "assistant"][i % 2], t or "") for i, t in enumerate(evil)]
    assert got[1].loss_text == "".join(t or "" for t in evil[1::2])
    assert got[3].turns_read[0].role == "we:ird #<role\\"
    assert (got[1].valid, got[2].valid, got[4].valid, got[4].first_bad_turn) == (True, False, False, 1)
    assert len(got[4].turns_read) == 3 and got[None].turns_read[0].text == ""


def test_chat_templates_are_literal(spark):
    marks = {"escapes": (("<", "l"), ("[", "k"), ("\\", "b"))}
    for start, role, end in (("<|s|>", "<|r|>", "<|e|>"), ("[INST] ", "[.*] ", "[/INST]$"), ("<a>", "<\\Q", "<\\E+")):
        t = chat.ChatTemplate(turn_start=start, role_end=role, turn_end=end, **marks)
        text = [f"x{start}y", f"{role}{end}", "", "a\\lb<|e|>"]
        rows = [(1, i, "user", x) for i, x in enumerate(text)]
        got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t), t).first()
        assert [(x.role, x.text) for x in got.turns_read] == [("user", x) for x in text]
    for bad in ({"turn_end": "END"}, {"escapes": (("#", "h"), ("<", "h"), (":", "c"), ("\\", "b"))}, {"escapes": (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c"))}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**bad)


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, segments int, valid string, formatted string, turns int, state int"
    long = prose(100_000, 3)
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", long, 1, "x", "y", 1, 1)], schema))).first()
    assert got.loss_text == long and got.turns_read[0].text == long
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_chat_query(spark):
    r = {x.conv_id: x for x in chat.op5_chat_formatting(spark, SF).collect()}[-7]
    assert r.n_turns == 2 and r.loss_chars == 26 and r.loss_sha256 == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()


# 6


def test_mix(spark, none):
    rows = [(i, prose(1 + i % 50, i), "en", ["a", "b", None][min(i % 7, 2)], 0) for i in range(900)] + [(1000, None, "en", "empty", 0), (1000, "", "en", "empty", 0)]
    d = spark.createDataFrame(rows, DOC)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows) and Counter(map(tuple, mixing.mix_sources(d.repartition(5)).collect())) == Counter(map(tuple, got))
    total = sum(r.size for r in got)
    target = {r.source: r.target for r in got}
    size = {r.source: r.source_size for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 and all(target[s] <= 3 * size[s] + 1e-9 for s in target)
    for s in target:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 150
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    assert sum(r.taken for r in got) <= total
    taken = mixing.take(d)
    assert taken.columns == d.columns and taken.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix_sources(none).count() == 0 and mixing.take(none).count() == 0
    clash = {c: F.lit(c) for c in ("_copies", "copies", "uid", "row", "size", "key", "src", "range", "copy", "target", "no_source")}
    odd = d.union(spark.createDataFrame([(None, "a b", "en", "a", 0)] * 40 + [(7, prose(20_000, 3), "en", "b", 0)], DOC)).withColumns(clash)
    out = mixing.take(odd)
    assert out.columns == odd.columns and out.first()["_copies"] == "_copies"
    assert out.count() == sum(r.taken // r.size for r in mixing.mix_sources(odd).collect() if r.size)


# 7


def near_copies():
    rows = list(ODD)
    for g in range(6):
        base = prose(80 + 40 * g, 1000 + g).split()
        for j in range(14):
            w = list(base)
            for _ in range(j % 5):
                w[random.Random(g * 100 + j).randrange(len(w))] = f"x{g}{j}"
            rows.append((10_000 + 100 * g + j, " ".join(w)))
    shared = prose(60, 77)
    rows += [(20_000 + i, prose(50 + i, 5000 + i) + " " + shared) for i in range(40)]
    return [r for r in rows if r[0] not in (None, 5)] + [(5, "Word")]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_join_is_exact(spark, k, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows), k, num, 100).collect()}
    assert got == jaccard_components(dict(rows), k, num, 100)


def test_join_gives_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rows = [r for r in near_copies() if r[0] != 6]
    members, found = ngram_join.links(docs(spark, rows), 4, 70, 100)
    members, found = members.collect(), found.collect()
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())
    of = {m.set_id: sets[m.doc_id] for m in members if m.set_id is not None}
    kinds = sorted(set(sets.values()) - {frozenset()}, key=sorted)
    want = {frozenset((a, b)): len(a & b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if 100 * len(a & b) >= 70 * len(a | b)}
    assert {frozenset((of[f.u], of[f.v])): f.overlap for f in found} == want and len(found) == len(want) > 100
    degree = Counter(x for pair in want for x in pair)
    assert all(m.n_links == degree[sets[m.doc_id]] for m in members) and len(members) == len(rows)


def test_sets_that_share_a_number_stay_apart(spark, monkeypatch):
    rows = [(i, prose(30, i % 9)) for i in range(40)]
    plain = ngram_join._ids
    monkeypatch.setattr(ngram_join, "_ids", lambda *a: (plain(*a)[0], plain(*a)[1] & 1, plain(*a)[2]))
    sets = ngram_join._rekeyed(ngram_join.materialize(ngram_join._describe(docs(spark, rows).select("doc_id", "text"), 4), "t"))
    assert sets.select("set_id").distinct().count() == 9


def test_gram_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 64)
    monkeypatch.setattr(ngram_join, "GATHERED", 500)
    sets = ngram_join.materialize(ngram_join._describe(docs(spark, near_copies()).select("doc_id", "text"), 4).repartition(3, "set_id"), "t")
    want = Counter()
    for grams in {r.set_id: r.grams for r in sets.collect() if r.n}.values():
        want.update((np.frombuffer(grams, np.uint64) >> np.uint64(24)).tolist())
    assert {r.gram: r.n for r in ngram_join._gram_counts(sets, 3).collect()} == {g: n for g, n in want.items() if n >= 3}


def test_join_hands_wide_rows_to_python_a_few_at_a_time(spark):
    wide = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 200_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    with storage.batches_of(spark, ngram_join.BATCH):
        found = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 60 and max(r["size"] for r in found) < 2_000_000


def test_join_looks_at_a_pair_once_and_not_in_each_block(spark, monkeypatch):
    """60 near copies share hundreds of n-grams, some with a neighbour's words; not all link."""
    base, rows, made = prose(400, 77).split(), [], []
    for i in range(60):
        w = list(base)
        for j in range(3 + i % 9):
            w[(37 * i + 41 * j) % 400] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    plain = ngram_join._leaders

    def counted(*a):
        found = plain(*a)
        made.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(ngram_join, "_leaders", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows), 4, 85, 100).collect()}
    assert got == jaccard_components(dict(rows), 4, 85, 100) and len({c for _, c in got.values()}) > 1
    assert made[0][1] >= 30 and sum(n for n, _ in made) <= 3 * sum(n for _, n in made)


@pytest.mark.parametrize("bundled", [1, 5])
def test_join_is_exact_with_narrow_bundles(spark, bundled, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUNDLED", bundled)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    rows = near_copies()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows), 4, 85).collect()} == jaccard_components(dict(rows), 4, 85, 100)


def test_written_tables_release_what_the_driver_held(spark):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert storage.materialize(spark.range(5), "t").count() == 5 and full() > before


def test_join_edge_cases(spark, odd, none, monkeypatch):
    assert ngram_join.link(none).count() == 0 and ngram_join.keep_first(none).count() == 0
    got = ngram_join.link(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = ngram_join.keep_first(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)  # the way of large tables
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    rows = near_copies()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(spark, rows), 4, 85).collect()} == jaccard_components(dict(rows), 4, 85, 100)


@pytest.mark.parametrize("few", [500_000, 0])
def test_keep_first_judges_rows(spark, few):
    a, b, c, d, e = (prose(40, 9000 + i) for i in range(5))
    near = " ".join(["zz", *d.split()[1:]])
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (7, a), (7, e), (9, d), (9, near), (None, None), (None, " "), (7, "")]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_first(docs(spark, rows), broadcast_rows=few).collect())
    last = {x: n for x, n in kept.items() if x[0] == 9}
    assert last in ({(9, d): 1}, {(9, near): 1})
    assert {x: n for x, n in kept.items() if x[0] != 9} == {(1, a): 1, (None, b): 1, (None, c): 1, (7, e): 1, (None, None): 1, (None, " "): 1, (7, ""): 1}


# 8


def brute_counts(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [s for s in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), set()
    for i, v in enumerate(windows):
        if seen[v] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, none):
    r = random.Random(8)
    rows = [(i, prose(r.randint(40, 300), i).capitalize() + ".", "en", "s", 0) for i in range(400)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(100, i).split()), "en", "s", 0) for i in range(8)] + [(1100, "loop " * 200, "en", "s", 0)]
    odd = [(2000 + i, t, None, None, 0) for i, (_, t) in enumerate(ODD)] + [(3000, "a\na\n \nb c\na", "en", "s", 0), (3001, prose(9, 1) + " " + prose(9, 1) + " " + prose(12, 3), "en", "s", 0)]
    d = spark.createDataFrame(rows + bad + odd, DOC).withColumn("d2", F.lit(1))
    got = quality.rate(d).collect()
    assert len(got) == len(rows) + len(bad) + len(odd)
    text = {x[0]: x[1] for x in rows + bad + odd}
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(text[x.doc_id])
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
    assert sum(x.kept for x in got if x.doc_id < 1000) >= 399 and not any(x.kept for x in got if 1000 <= x.doc_id < 2000)
    with_text = quality.rate(d, with_text=True)
    assert "text" in with_text.columns and Counter((x.doc_id, x.kept) for x in with_text.collect()) == Counter((x.doc_id, x.kept) for x in got)
    assert quality.rate(none).count() == 0
    clash = {c: F.lit(c) for c in ("grp", "m0", "l0_0", "x0", "y0", "w0", "bin", "rest", "_lang", "_repetition", "log_det", "start", "kept", "n_words")}
    for with_text in (False, True):
        again = quality.rate(d.withColumns(clash), with_text=with_text)
        assert {x.doc_id: (x.kept, x.n_words) for x in again.collect()} == {x.doc_id: (x.kept, x.n_words) for x in got}
        assert (again.first()["grp"], again.first()["x0"], "text" in again.columns) == ("grp", "x0", with_text) and len({*again.columns}) == len(again.columns)


def test_quality_verdicts_are_those_of_brute_force(spark):
    """The verdict again in numpy: the same starts, steps and distances, over groups on both sides of ``least_group``."""
    r = random.Random(31)
    rows = []
    for source, n in (("a", 100), ("b", 99), ("c", 30)):
        rows += [(len(rows) + i, prose(r.randint(25, 200), 100 * n + i).capitalize() + ("###" * r.randint(0, 9) if i % 11 == 0 else "."), "en", source, 0) for i in range(n)]
    got = {x.doc_id: x for x in quality.rate(spark.createDataFrame(rows, DOC)).collect()}
    floors = np.array([f for _, f in quality.transforms()]) * 1000
    x = {i: np.round(1000 * np.array([
        np.log((g.word_chars + 165) / (g.n_words + 30)), np.log(g.n_symbols / (g.n_words + 20) + 0.01), np.log(g.n_dup_lines / (g.n_lines + 5) + 0.05),
        np.log(g.n_repeat_words / (g.n_words + 20) + 0.03), np.log(g.n_distinct_words) / np.log(g.n_words), np.log((g.n_upper + 3) / (g.word_chars + 60))])) for i, g in got.items()}
    dim = len(floors)
    cut = lambda v, share: np.sort(v)[int(np.ceil(share * len(v))) - 1]
    consistent = lambda share: share / quality.chi2_cdf(quality.chi2_quantile(share, dim), dim + 2)

    def far(v, m, s):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(s), v - m)

    for part in (["a"], ["b", "c"]):  # 100 texts stand alone, 99 and 30 are pooled
        ids = [row[0] for row in rows if row[3] in part]
        v = np.array([x[i] for i in ids])
        b = np.floor(v / 10)
        centre = np.array([cut(b[:, i], 0.5) for i in range(dim)])
        spread = (np.array([cut(np.abs(b[:, i] - centre[i]), 0.5) for i in range(dim)]) + 0.5) * 14.826
        best = None
        for m, s in (((centre + 0.5) * 10, np.diag(spread**2 + floors**2)), (v.mean(0), np.cov(v.T, bias=True) + np.diag(floors**2))):
            before = np.inf
            for _ in range(8):
                bins = np.floor(np.log2(far(v, m, s) + 0.01) * 32)
                core = v[bins <= cut(bins, 0.75)]
                m, s = core.mean(0), np.cov(core.T, bias=True) * consistent(0.75) + np.diag(floors**2)
                now = np.linalg.slogdet(s)[1]
                if now > before - 1e-3:
                    break
                before = now
            if best is None or now < best[0] - 1e-9:
                best = (now, m, s)
        near = v[far(v, *best[1:]) <= quality.chi2_quantile(0.975, dim)]
        d2 = far(v, near.mean(0), np.cov(near.T, bias=True) * consistent(0.975) + np.diag(floors**2))
        # Starts may go on for a step more here or there; verdicts agree, distances nearly so.
        assert np.allclose([got[i].d2 for i in ids], d2, rtol=0.1, atol=0.2)
        limit = quality.chi2_quantile(1 - 1e-7, dim)
        assert all(got[i].kept == (y <= limit) for i, y in zip(ids, d2) if abs(y - limit) > 0.1 * limit)


def test_mcd_resists_contamination(spark):
    rng = np.random.default_rng(4)
    clean = rng.multivariate_normal([1.0, 2.0], [[0.04, 0.03], [0.03, 0.09]], 800)
    rows = [("g", *map(int, np.round(x * 1000))) for x in np.concatenate([clean, rng.normal([9, -5], 0.1, (150, 2))])]
    e = quality.mcd(spark.createDataFrame(rows, "grp string, x0 long, x1 long"), [0.001, 0.001]).collect()[0]
    low = np.array([[e.l0_0, 0], [e.l1_0, e.l1_1]]) / 1000
    assert np.allclose([e.m0 / 1000, e.m1 / 1000], [1, 2], atol=0.05) and np.allclose(low @ low.T, np.cov(clean.T), rtol=0.25)
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.975, 5), 5) - 0.975) < 1e-9 and abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-4


# 9


def test_toxicity_generalises_to_misspellings(spark, none):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        w = prose(40, i).split()
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(40)] = "zzqx" + r.choice(["ly", "er", "ing", "s"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    lab = spark.createDataFrame(labels[:400] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows[400:] + [(900, " ".join(prose(40, 3).split()[:36] + ["zzqxed"] * 4), "en", "s", 0), (901, None, "", "", 0), (902, "", "", "", 0)], DOC)
    all_docs = spark.createDataFrame(rows, DOC)
    weight, bias = toxicity.train(*toxicity.training_sample(all_docs, lab, 5000, 1 << 15))
    s = dict(zip([x.doc_id for x in d.collect()], toxicity.score_texts([x.text for x in d.collect()], weight, bias)))
    assert all((s[i] >= 0.5) == (i % 4 == 0) for i in range(400, 500)) and s[900] >= 0.5 and s[901] == s[902] < 0.5
    out = toxicity.score_toxicity(d, lab)
    assert out.count() == d.count() and toxicity.score_toxicity(none, lab).count() == 0
    assert all(0 <= x.score <= 1 for x in out.collect())


@pytest.mark.parametrize(("sf", "hits", "most_false"), [("sf0.001", 0.55, 0.25), ("sf0.01", 0.55, 0.10)])
def test_toxicity_learns_from_few_labels(spark, sf, hits, most_false):
    """Of 68 and 328 labels; judged on the held-out rows of the largest table."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    read = lambda sf, name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    held = read("sf0.1", "documents").join(read("sf0.1", "labels").filter(remainder == 0).select("doc_id", "toxic"), "doc_id")
    weight, bias = toxicity.train(*toxicity.training_sample(read(sf, "documents"), read(sf, "labels").filter(remainder != 0), 5000, 1 << 15))
    got = held.collect()
    bad = toxicity.score_texts([r.text for r in got], weight, bias) >= 0.5
    toxic = np.array([r.toxic == 1 for r in got])
    assert bad[toxic].mean() >= hits and bad[~toxic].mean() <= most_false


def test_toxicity_is_trained_in_a_task(spark, none, monkeypatch):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    weight, bias = toxicity.train(*toxicity.training_sample(read("documents"), read("labels"), 5000, 1 << 15))
    monkeypatch.setattr(type(none), "toPandas", lambda df: pytest.fail("texts reach the driver"))
    out = toxicity.score_toxicity(read("documents"), read("labels")).select("text", "score").collect()
    want = toxicity.score_texts([r.text for r in out], weight.astype(np.float32), bias)
    assert np.allclose([r.score for r in out], want, atol=1e-6) and np.ptp(want) > 0.1
    # No labels, no sample.
    assert all(r.score < 0.01 for r in toxicity.score_toxicity(read("documents"), read("labels").filter("false")).collect())


def test_toxicity_sample_is_bounded(spark):
    rows = [(1, prose(8, i), "en", "s", 0) for i in range(3000)] + [(2, "same text", "en", "s", 0)] * 500 + [(3, None, "en", "s", 0)]
    lab = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    texts, labels = toxicity.training_sample(docs(spark, [r[:2] for r in rows]), lab, 200, 1 << 15)
    assert 20 <= len(texts) <= 300 and texts.count("same text") <= 2
    again = toxicity.training_sample(docs(spark, [r[:2] for r in rows]).repartition(5), lab, 200, 1 << 15)
    assert again[0] == texts and list(again[1]) == list(labels)


def test_toxicity_score_is_the_mean_of_its_words():
    """The forward pass again, word by word and n-gram by n-gram."""
    rng = np.random.default_rng(2)
    weight, bias = rng.normal(0, 1, toxicity.BUCKETS), -0.3
    texts = ["One two  one", "a", "", None, "é漢字 x_y\tzz", prose(40_000, 6)]
    got = toxicity.score_texts(texts, weight, bias)
    for t, s in zip(texts[:5], got):
        each = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()):
            bag = next(iter(toxicity.bags([w])))
            grams = 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS)
            assert abs(bag[1].sum() - 1) < 1e-5 and len(bag[0]) <= grams
            each.append(weight[bag[0]] @ bag[1])
        assert abs(s - 1 / (1 + np.exp(-(np.mean(each) if each else 0) - bias))) < 1e-5
    assert 0 < got[5] < 1


def test_toxicity_scores_a_batch_in_slices(monkeypatch):
    weight = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS)
    texts = [None, "", *(prose(1 + i % 40, i) for i in range(1200)), prose(30_000, 2)]
    whole, given, score = toxicity.score_texts(texts, weight, 0.5), [], toxicity.score_texts
    monkeypatch.setattr(toxicity, "score_texts", lambda t, *model: given.append(len(t)) or score(t, *model))
    assert toxicity.score_batch(pa.array(texts), weight, 0.5).to_pylist() == whole.tolist()
    assert sum(given) == len(texts) and max(given) <= 512
    assert len(toxicity.score_batch(pa.array([], pa.string()), weight, 0.5)) == 0


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    hit = [r.predicted for r in got if labels[r.doc_id] == 1]
    false = [r.predicted for r in got if labels[r.doc_id] == 0]
    assert sum(hit) >= 0.85 * len(hit) and sum(false) <= 0.03 * len(false)


# 10


def test_html(spark):
    tree = html_extract.grow(html_extract.LABELLED)
    page = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a> <a>About us</a></nav>
    <div class="cookie-notice">We use cookies to make this better for all of you</div><div id="content"><h2>Title</h2><p>First &amp; <a href="y">a link</a> more&nbsp;text &lt;b&gt;.<p>Second<br>one.</div>
    <aside><p>Sidebar long text one two three four five six</p></aside><section class="comments"><p>Great article, I loved all of it!</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; 2020</footer>"""
    assert html_extract.extract(page, tree) == "Title\nFirst & a link more text <b>.\nSecond one."
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>cut off <a hre"), (4, "u", "plain text only & more"), (5, "u", "<article><p>x"), (6, "u", "<article>" + "<p>long words here</p>" * 3000), (7, "u", "a < b <!-- open"), (7, "u", "a < b <!-- open")]
    got = [r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).orderBy("page_id").collect()]
    assert got[:5] == ["", "", "cut off", "plain text only & more", "x"] and got[5].count("\n") == 2999 and got[6:] == ["a < b"] * 2


def test_html_articles(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in html_extract.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", article)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_names_do_not_decide_alone():
    tree = html_extract.grow(html_extract.LABELLED)
    assert all(html_extract.decide(tree, r[:-1]) == r[-1] for r in html_extract.LABELLED)
    article, long, side = prose(60, 1), prose(200, 2), prose(8, 3)
    pages = {
        f'<body class="has-sidebar"><article><p>{article}</article><div class="sidebar">{side}</div></body>': article,
        f'<html class="no-cookies"><body class="header-fixed"><main class="share"><p>{article}</main><nav>{side}</nav>': article,
        f'<body><div class="post-meta">By X</div><div class="text">{article}</div>': f"By X\n{article}",
        f'<body><div class="with-sidebar"><div class="post-meta">By X</div><div class="text">{article}</div><aside>{side}</aside></div>': f"By X\n{article}",
        f'<body><div class="has-sidebar"><article><p>{article}</article></div><div class="sidebar">{side}</div>': article,
        f'<form id="aspnet"><div class="content"><p>{article}</div><div class="menu">{side}</div></form>': article,
        f"<article><p>{prose(300, 4)}</article><div><p>{long}</div><div><p>{side}</div>": f"{prose(300, 4)}\n{long}",
        f'<body><div class="promo">{long}</div><p>{side}': f"{long}\n{side}",
        f'<article><p>{article}</article><div class="comments"><div class="text">{long}</div></div>': article,
    }
    for page, text in pages.items():
        assert html_extract.extract(page, tree) == text, page


def test_html_drops_nothing_of_an_article():
    tree = html_extract.grow(html_extract.LABELLED)
    long = prose(60, 5)
    pages = {
        f"<article><h1>Title</h1><p>A short lead sentence.</p><p><a>Read the linked full report here</a></p><p>{long}</p></article>": f"Title\nA short lead sentence.\nRead the linked full report here\n{long}",
        "<p><a>See the full report</a></p><p>It rained.</p>": "See the full report\nIt rained.",
        f'<article><p class="story-form">{long}</p><div class="text-form"><p>Two words</p></div></article>': f"{long}\nTwo words",
        '<p class="story-form">Some words here.</p>': "Some words here.",
        '<div class="text-form">Some words here.</div>': "Some words here.",
    }
    for page, text in pages.items():
        assert html_extract.extract(page, tree) == text, page
    # In the main part and not clutter, whatever the numbers are.
    grid = itertools.product((1, 3, 8, 30, 200), (0.0, 0.3, 0.72, 0.8, 1.0), (0, 3, 200), (0.0, 1.0), (0, 3, 200), (0.0, 1.0), (0.0, 0.03, 0.08, 0.3, 1.0), (0.0,), (0,), (1,), (0, 1))
    assert all(html_extract.decide(tree, row) for row in grid)


def test_html_weighs_words_and_links():
    """Pages that name nothing: the same markup is kept or dropped by its words and links."""
    tree = html_extract.grow(html_extract.LABELLED)
    body, menu = "".join(f"<div><p>{prose(50, i)}</p></div>" for i in range(4)), "".join(f"<div><a href=x>{prose(2, i)}</a></div>" for i in range(20, 26))
    text = "\n".join(prose(50, i) for i in range(4))
    assert html_extract.extract(f"<body>{menu}<div>{body}</div></body>", tree) == text
    assert html_extract.extract(f"<body><table><tr><td>{menu}</td><td>{body}</td></tr></table></body>", tree) == text
    beside = f"<article><p>{prose(100, 9)}</p></article>"
    assert html_extract.extract(f"{beside}<div>{prose(6, 8)}</div>", tree) == prose(100, 9)
    assert html_extract.extract(f"{beside}<div><p>{prose(150, 7)}</p></div>", tree) == f"{prose(100, 9)}\n{prose(150, 7)}"


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, rows = d.columns, d.count()
    for name, stage in p.STAGES[:4]:
        d = p.materialize(stage(spark, d, "/root/testdata/sf0.01"), "t")
        assert d.columns == columns, name
        if name != "mixing sources to target weights":
            assert 0.5 * rows < d.count() <= rows
            rows = d.count()
    pieces = p.STAGES[4][1](spark, d, SF)
    assert pieces.filter("start = 0").count() == d.count()


def test_pipeline_runs_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    clash = plain.withColumns({c: F.lit(c) for c in ("score", "kept", "d2", "n_words", "toxicity", "given_kept", "_copies", "uid", "row", "grp", "x0")})
    for d in (plain, plain.limit(0), clash):
        for name, stage in p.STAGES:
            out = stage(spark, d, SF)
            rows = out.collect()
            if name != "packing":
                assert out.columns == d.columns and all(r[c] == c for r in rows for c in d.columns[5:]), name
