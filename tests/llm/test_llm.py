"""Corpus operators against brute force, exact round trips, held-out labels and odd inputs."""

import decimal
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.llm import chat, components, decontam, licenses, line_dedup, mixing, near_dup, quality, queries, shared, tokens, toxicity, vectors
from cellwright.llm.textbatch import Batch
from cellwright.llm.wavelet import WaveletMatrix, encode

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, copy2 int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, texts, ids=None):
    """With extra columns whose names operators use inside."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", 0, "k", 1) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n ", "one", "a b c d e f", "a b c d e f", "é " * 5000, "x" * 20000, "\\ <|end|> </s>"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings conversations benchmark labels".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    rows = lambda names, found: sorted(tuple(text(v) for _, v in sorted(zip(names, r, strict=True), key=lambda x: x[0])) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_words_and_spans():
    b = Batch(["Ab c-ab", None, "ab\nC"])
    w = b.words()
    assert b.first.tolist() == [0, 3, 3, 5] and w[0] == w[2] == w[3] and w[1] == w[4]
    assert [len(WORD.findall((t or "").lower())) for t in ODD] == np.diff(Batch(ODD).first).tolist()


# --- classifiers ---


def area(scores, y):
    """Under the curve of true against false positives, ties counted half."""
    order = np.sort(scores)
    below, upto = np.searchsorted(order, scores), np.searchsorted(order, scores, "right")
    ranks, n = (below + upto + 1) / 2, int(y.sum())
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_and_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, label, least, rare in (("op1_quality_nbsvm", "quality", 0.99, 0), ("op9_toxicity_subword", "toxic", 0.9, 1)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        y, p = np.array([labels[r["doc_id"]][label] for r in held]), np.array([r["predicted"] for r in held])
        assert area(np.array([r["score"] for r in held]), y) > least, name
        # the label that few have: what is found of it, and how much of what is found is right
        hits = ((p == rare) & (y == rare)).sum()
        assert hits / (y == rare).sum() > 0.75 and hits / (p == rare).sum() > 0.75, name


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_scores_depend_on_the_text_alone(spark, kind):
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = kind.train(d, labels, lambda key: F.lit(True))
    some = docs(spark, [*ODD, "one two", "one two", "", "ab"] * 3)
    seen = []
    for n in (1, 4, 40):
        rows = kind.score(some.repartition(n), model).collect()
        seen.append({r["doc_id"]: r["score"] for r in rows})
    assert seen[0] == seen[1] == seen[2]
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    by_text = {}
    for i, score in seen[0].items():
        assert by_text.setdefault(texts[i], score) == score
    assert kind.train(d, labels, lambda key: F.lit(True)).scores is not None


def test_features_of_a_text_are_its_own():
    index, first = quality.indicators(Batch(["", "a", "", "ab"]))
    assert np.diff(first).tolist() == [0, 2, 0, 4]  # a: the character and the word; ab: two characters, the pair, the word


def test_hinge_loss_is_near_its_minimum():
    rng = np.random.default_rng(3)
    x = (rng.random((80, 12)) < 0.4).astype(np.float32)
    x[:, 0] = 1
    y = np.where(x[:, 1] + x[:, 2] - x[:, 3] + 0.3 * rng.normal(size=80) > 0.5, 1.0, -1.0)
    ratio = rng.normal(size=12).astype(np.float32)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    w, b = quality._hinge(rows, y, ratio, 1.0, 400, 7)
    scaled = np.array([x[i] * ratio / np.sqrt(len(rows[i])) for i in range(80)])
    upper = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    loss = lambda v: 0.5 * v @ v + upper @ np.maximum(0, 1 - y * (scaled @ v[:-1] + v[-1]))
    best = v = np.zeros(13)
    for step in range(1, 60001):  # plain subgradient descent
        out = y * (scaled @ v[:-1] + v[-1]) < 1
        v = v - (v - np.append((upper * y * out) @ scaled, (upper * y * out).sum())) / (step + 100)
        best = v if loss(v) < loss(best) else best
    assert loss(np.append(w, b)) <= loss(best) * 1.01


def test_ids_with_two_labels_or_two_texts(spark):
    d = docs(spark, ["good text here", "bad bad bad", "good words", "bad bad", "either"], [1, 2, 3, 4, 1])
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (4, 0), (None, 1)], "doc_id long, quality int")
    sample, share = quality.labelled(d, both, "quality", "doc_id", 10, lambda key: F.lit(True))
    assert sorted(map(tuple, sample.collect())) == [(1, 1), (2, 0), (4, 0)] and share == pytest.approx(1 / 3)
    for kind in (quality, toxicity):
        models = [kind.train(d.repartition(n), both, lambda key: F.lit(True), "quality") for n in (1, 5)]
        assert [models[0].bias, models[0].slope] == [models[1].bias, models[1].slope]


def test_classifiers_on_odd_input(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    anything = lambda key: F.lit(True)
    for labels in (none, one):
        for kind, label in ((quality, "quality"), (toxicity, "toxic")):
            model = kind.train(d, labels, anything, label)
            assert kind.score(d, model).count() == len(ODD)
            assert kind.score(d.where("false"), model).count() == 0


# --- licenses ---


def test_license_scan_against_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD + [t.upper() for _, t in licenses.TEMPLATES] + ["x " * 37 + licenses.TEMPLATES[0][1] + " y" * 99, "under the MIT license under the mit license"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in enumerate(texts):
        words = WORD.findall(lower(t))
        assert got[i]["n_words"] == len(words)
        places = sorted((a, label) for p, label in licenses.PHRASES.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split())
        assert [(p["word"], p["label"]) for p in got[i]["places"]] == places
        blocks = set()
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            tw = WORD.findall(lower(template))
            for a in range(0, len(words), len(tw)):
                if 5 * len(set(words[a : a + 2 * len(tw)]) & set(tw)) >= 4 * len(set(tw)):
                    blocks.add((k, a))
        assert {(b["template"], b["first_word"]) for b in got[i]["blocks"]} == blocks


# --- tokens ---


def test_wavelet_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.int32), np.zeros(9, np.int32), rng.integers(0, 50257, 3000), rng.integers(0, 7, 1500), rng.integers(0, 90000, 700)):
        m = WaveletMatrix(encode(ids, [5, None], np.array([0, 1, len(ids)])))
        assert (m.decode() == ids).all() and m.doc_ids == [5, None]
        for i in range(0, len(ids), 97):
            token = int(ids[i])
            where = np.flatnonzero(ids == token)
            assert m[i] == token and m.count(token) == len(where) and m.rank(token, i) == (where < i).sum()
            assert m.select(token, len(where) - 1) == where[-1]
            if len(where) < 20:
                assert m.occurrences(token) == where.tolist()
        assert m.count(1 << 20) == 0


def test_tokens_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*ODD, " lead", "tail ", "a  b", "a \n b", "a\n\nb c", "it's <|endoftext|> x", "tab\there it's", "n b s"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    ids = [5 if i in (3, 4) else i for i in range(len(texts))]
    path = str(tmp_path / "shards")
    tokens.write_shards(docs(spark, texts, ids), path, queries.tokenizer_path(), shard=500)
    rows = sorted(tokens.read_shards(spark, path).collect(), key=lambda r: (r["start"]))
    assert len(rows) == len(texts) and [r["doc_id"] for r in rows] == sorted(ids)
    want = sorted((d, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t in zip(ids, texts, strict=True))
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    shard = spark.read.parquet(path).where("n_tokens > 5").first()
    m = tokens.open_shard(spark, path, shard["part"], shard["seq"])
    assert m.n == shard["n_tokens"] and m[0] == m.decode()[0]
    tokens.write_shards(docs(spark, texts).where("false"), str(tmp_path / "none"), queries.tokenizer_path())
    assert tokens.read_shards(spark, str(tmp_path / "none")).count() == 0


# --- chat ---


def test_reply_trees(spark):
    m = "tree long, node long, parent long, role string, text string, score double"
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9), (1, 3, 2, "user", "more", 0.9), (2, 0, None, "user", "<|end|>\n\\", None), (2, 0, None, "user", "<|end|>\n\\", None), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0), (4, 5, 99, None, None, 0.0)]
    out = chat.format_trees(spark.createDataFrame(rows, m), None)
    got = {(r["tree"], r["leaf"]): r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0), (4, 5)}
    assert [tuple(t) for t in got[1, 3]["turns"]] == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert got[1, 3]["rank"] == 1 and got[1, 3]["loss"] == "good"
    assert [tuple(t) for t in got[2, 0]["turns"]] == [("user", "<|end|>\n\\")] and [tuple(t) for t in got[4, 5]["turns"]] == [("", "")]
    assert chat.format_trees(spark.createDataFrame([], m)).count() == 0
    one = {r["tree"]: (r["leaf"], r["rank"]) for r in chat.format_trees(spark.createDataFrame(rows, m)).collect()}
    assert one == {1: (3, 1), 2: (0, 1), 4: (5, 1)}


def test_conversations_without_an_id_and_repeated_ones(spark):
    c = "conv long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None)]
    out = chat.format_trees(chat.linked(spark.createDataFrame(rows, c), "conv", "turn", "role", "text")).select("tree", chat.parse(F.col("formatted")).alias("t")).collect()
    assert {r["tree"]: [tuple(t) for t in r["t"]] for r in out} == {None: [("user", "a"), ("assistant", "b")], 1: [("", ""), ("user", "x"), ("user", "x")]}


def test_a_comb_of_branches_gives_rows_for_the_chosen_one(spark):
    m = "tree long, node long, parent long, role string, text string, score double"
    n = 200  # a spine with a leaf at each of its nodes
    rows = [(1, i, i - 1 if i else None, "user", f"s{i}", 0.5) for i in range(n)] + [(1, n + i, i, "assistant", f"l{i}", float(i == 150)) for i in range(n)]
    out = chat.format_trees(spark.createDataFrame(rows, m)).first()
    means = {n + i: (0.5 * (i + 1) + (i == 150)) / (i + 2) for i in range(n)}
    best = min(means, key=lambda leaf: (-means[leaf], leaf))
    assert out["leaf"] == best and out["score"] == pytest.approx(means[best]) and out["n_turns"] == best - n + 2


@pytest.mark.parametrize("text", ["", "\\", "\\\\<|", "<|>", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "<\\|end|>", "é\n\n"])
def test_chat_escapes_are_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row["u"] == text and not any(c in row["e"] for c in chat.CONTROLS)


def test_long_chain(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_trees(chat.linked(rows, "conv", "turn", "role", "text")).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in r["t"]] == [str(i) for i in range(300)]


# --- near copies ---


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts):
    sets, out = [shingle_set(t) for t in texts], {}
    for i, j in combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if n and 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            out.setdefault(i, set()).add(j)
            out.setdefault(j, set()).add(i)
    return out


def near_copies(rng, n=60):
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = base[rng.integers(0, 4)].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, 60)] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("members", "shingles"), [(2000, 600_000), (3, 100)])
def test_near_duplicates_against_brute_force(spark, members, shingles):
    texts = near_copies(np.random.default_rng(3)) + ODD
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, texts), block_members=members, block_shingles=shingles).collect()}
    links = brute_links(texts)
    for i in range(len(texts)):
        assert got[i]["n_links"] == len(links.get(i, ())), i
        todo, seen = [i], {i}
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["class_id"] == min(seen)


def test_one_of_each(spark):
    texts = ["a b c d e f g", "A b, c d e f g", "z", None, None, "", "a b c d e f g"]
    kept = near_dup.one_of_each(docs(spark, texts, [4, 2, 3, None, 7, 7, 2]))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 7), (False, 7), (True, 0)]
    assert kept.columns == docs(spark, texts).columns
    assert near_dup.near_duplicates(docs(spark, texts).where("false")).count() == 0


def test_columns_with_the_names_used_inside(spark):
    names = ["doc_id", "text", "source", "own_print", "_print", "_p", "_doc", "_gone", "_text", "n_lines", "N_removed", "copy", "shuffle_key", "_mix_source", "_mix_n", "stay_doc", "stay_print", "mark", "doc", "print", "gone", "mix_source", "mix_low", "a.b", "x`y"]
    lines = "a b c d e f\nA b c d e f!\nother line"
    rows = [(i, t, "s", *[f"{n}{i}" for n in names[3:]]) for i, t in enumerate([lines, lines, "z", None])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    plain = lambda out: sorted((r[0], *r[3 : len(names)]) for r in out.collect())
    given = plain(df)
    deduped = line_dedup.dedup_lines(df)
    assert deduped.columns == [*names, "n_lines_2", "n_removed_2"] and plain(deduped) == given
    assert sorted((r["doc_id"], r["text"], r["n_removed_2"]) for r in deduped.collect()) == [(0, "a b c d e f\nother line", 1), (1, "", 3), (2, "z", 0), (3, None, 0)]
    mixed = mixing.mix(df, total=40.0)
    assert mixed.columns == [*names, "copy_2", "shuffle_key_2"] and set(plain(mixed)) <= set(given)
    one = near_dup.one_of_each(df)
    assert one.columns == names and plain(one) == [g for g in given if g[0] != 1]


def test_plan_bands():
    bands, rows = near_dup.plan_bands(0.8, 0.9995, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128
    with pytest.raises(ValueError):
        near_dup.plan_bands(0.1, 0.999, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (None, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long"), shared.Scratch(spark, "t")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# --- decontamination ---


def test_leaks(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    items = [" ".join(word() for _ in range(n)) for n in (14, 30, 59, 150)]
    filler = lambda n: " ".join(word() for _ in range(n))
    para = items[1].split()
    para[3], para[9], para[20] = "other", "words", "here"
    texts = [filler(300) + " " + items[0] + " " + filler(90), items[1].upper(), filler(40) + " " + " ".join(para) + " " + filler(400), filler(500), "", None, items[2], filler(70) + " " + items[3], filler(10)]
    bench = spark.createDataFrame([(i, t, t.split()[-1]) for i, t in enumerate(items)] + [(9, None, None), (10, "", "")], "item_id long, text string, answer string")
    d = docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (6, 2), (7, 3)}
    assert sorted(r["doc_id"] for r in decontam.without_leaks(d, bench).collect()) == [3, 4, 5, 8]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, bench, answer_col="answer").collect()} >= {(0, 0), (1, 1), (6, 2)}
    assert decontam.leaks(d, bench.where("false")).count() == 0 and decontam.leaks(d.where("false"), bench).count() == 0


def test_leaks_whose_rarest_words_are_replaced(spark):
    sf = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [WORD.findall((r["text"] or "").lower()) for r in corpus.orderBy("doc_id").collect()]
    frequency = Counter(w for t in texts for i in range(0, len(t), 64) for w in set(t[i : i + 64]))
    around = [t for t in texts if len(t) >= 200]
    planted, made = {}, []
    for share in (0.25, 0.3, 0.35, 0.4):
        for r in bench.orderBy("item_id").collect():
            words, n = WORD.findall(r["text"].lower()), len(made)
            gone = set(sorted(range(len(words)), key=lambda i: frequency[words[i]])[: int(share * len(words) + 1e-9)])
            put = [f"new{n}x{i}" if i in gone else w for i, w in enumerate(words)]
            outside = around[n % len(around)]
            planted[10**9 + n] = share, r["item_id"]
            made.append((10**9 + n, " ".join(outside[: n % 150] + put + outside[n % 150 : 200])))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(corpus.unionByName(spark.createDataFrame(made, "doc_id long, text string")), bench).collect()}
    caught = Counter(share for doc, (share, item) in planted.items() if (doc, item) in found)
    n = len(made) / 4
    assert caught[0.25] >= 0.95 * n and caught[0.3] >= 0.9 * n and caught[0.35] >= 0.8 * n and caught[0.4] >= 0.6 * n, caught


def test_leaks_query_against_brute_force(spark):
    number = {}
    numbers = lambda t: np.array([number.setdefault(w, len(number)) for w in WORD.findall((t or "").lower())], np.uint64)
    items = {r["item_id"]: numbers(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()}
    want = set()
    for r in queries.table(spark, SF, "documents").collect():
        words = numbers(r["text"])
        for i, q in items.items():
            if any(decontam.common_subsequence(q, words[a : a + 128]) >= 0.6 * len(q) for a in range(0, max(len(words) - 64, 1), 64)):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op6_latent_decontamination"](spark, SF).collect()}
    assert want and got == want


def test_short_items_match_word_by_word(spark):
    bench = spark.createDataFrame([(1, "red fish blue"), (2, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    texts = ["we saw red fish blue there", "red boat, fish soup, blue sky", "Alpha beta gamma delta, epsilon zeta eta", "alpha beta gamma and delta epsilon zeta eta"]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, texts), bench).collect()} == {(0, 1), (2, 2)}


def test_benchmark_of_many_blocks(spark):
    rng = np.random.default_rng(12)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = docs(spark, [f"before {items[7]} after", items[31].upper(), "nothing", None, items[7] + " " + items[39]])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontam, "AT_ONCE", 2)
        m.setattr(decontam.benchmark_blocks, "__defaults__", (6,))
        assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, bench).collect()} == {(0, 7), (1, 31), (4, 7), (4, 39)}
        assert sorted(r["doc_id"] for r in decontam.without_leaks(d, bench).collect()) == [2, 3]


def test_possible_never_drops_a_long_enough_subsequence():
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 30, n).astype(np.uint64) for n in rng.integers(5, 64, 40)]
    q = decontam.Queries([(i, w, np.empty(0, np.uint64)) for i, w in enumerate(passages)])
    idf = np.where(np.arange(len(q.terms)) % 3 == 0, 0, 1).astype(np.float32)
    s = decontam.Searcher(q, idf, np.eye(len(idf), dtype=np.float32), 0.12, 0.6)
    windows = [np.where(rng.random(len(p)) < rng.random(), p, 99).astype(np.uint64) for p in passages] + [rng.integers(0, 30, 128).astype(np.uint64) for _ in range(20)]
    held = np.array([[(w == t).sum() for t in q.terms] for w in windows], np.uint8)
    near, w = (x.ravel() for x in np.mgrid[: len(passages), : len(windows)])
    ok = s.possible(near, w, held)
    long = np.array([decontam.common_subsequence(passages[i], windows[j]) / len(passages[i]) >= 0.6 for i, j in zip(near, w, strict=True)])
    assert long.any() and not (long & ~ok).any() and not ok.all()


def test_subsequence():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontam.common_subsequence(a, np.array([9, 1, 3, 9, 5], np.uint64)) == 3
    assert decontam.common_subsequence(a, np.array([], np.uint64)) == 0


# --- mixing ---


def test_mix_hits_its_weights(spark):
    rows = spark.range(4000).select("id", F.col("id").cast("string").alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("source"))
    rows = rows.withColumnRenamed("id", "doc_id")
    out = mixing.mix(rows, {"a": 3.0, "b": 1.0, None: 1.0}, 5000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert n["a"] == pytest.approx(3000, rel=0.1) and n["b"] == pytest.approx(1000, rel=0.15) and n[None] == pytest.approx(1000, rel=0.15)
    again = mixing.mix(rows.repartition(7), {"a": 3.0, "b": 1.0, None: 1.0}, 5000)
    assert {r["source"]: r["count"] for r in again.groupBy("source").count().collect()} == n
    assert mixing.mix(docs(spark, ODD)).select("doc_id").distinct().count() <= len(ODD)
    assert mixing.mix(docs(spark, ODD).where("false")).count() == 0


def poisson_count(rate, u):
    """By sums of 60 digits."""
    with decimal.localcontext() as c:
        c.prec, c.Emin = 60, decimal.MIN_EMIN
        rate, k = decimal.Decimal(rate), 0
        p = total = (-rate).exp()
        while total <= decimal.Decimal(u):
            k += 1
            p = p * rate / k
            total += p
        return k


def test_poisson_counts_of_large_rates(spark):
    rates = {"a": (1_000.0, 6), "b": (100_000.0, 2), "c": (800.0, 6), "d": (0.5, 40), "e": (499.0, 3), "f": (501.0, 3)}
    rows = [(f"{s}{i}", s) for s, (_, n) in rates.items() for i in range(n)]
    total = sum(r * n for r, n in rates.values())
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    out = mixing.mix(df, {s: r * n / total for s, (r, n) in rates.items()}, total)
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, (t, s) in enumerate(rows):
        digest = hashlib.md5(f"0|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        assert got.get(i, 0) == poisson_count(rates[s][0], int(digest[:13], 16) / 2**52), (s, i)
    pairs = spark.createDataFrame([(r, u) for r in (0.0, 0.5, 499.0, 501.0, 744.0, 800.0, 1_000.0, 100_000.0) for u in (0.0, 1e-6, 0.1, 0.5, 0.9, 1 - 1e-6)], "rate double, u double")
    tables = mixing.distributions(pairs.select("rate").distinct().select(F.col("rate").cast("string").alias("source"), "rate"))
    drawn = pairs.join(tables, F.col("rate").cast("string") == F.col("source")).withColumn("k", mixing.draw(F.col("u"), F.col("low"), F.col("sums")))
    assert drawn.count() == pairs.count()
    for r in drawn.collect():
        if r["u"] or r["rate"] <= mixing.LARGE:  # at 0 the first term stands for all below it
            assert r["k"] == poisson_count(r["rate"], r["u"]), r


# --- line dedup ---


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(8)
    lines = near_copies(rng, 40) + ["short one", "short one", "", "Short, one!", "a b c d e", "a b c d e"]
    texts = ["\n".join(lines[i] for i in rng.integers(0, len(lines), 6)) for _ in range(20)] + ODD
    rounds = [line_dedup.dedup_lines(docs(spark, texts), rounds=r).collect() for r in (1, 3)]
    flat = [(i, k, line, shingle_set(line)) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    keep = {}
    for n, (i, k, line, s) in enumerate(flat):
        gone = any(s and 5 * len(s & b) >= 4 * len(s | b) for _, _, _, b in flat[:n] if b)
        if not gone:
            keep.setdefault(i, []).append(line)
    for rows in rounds:
        for r in rows:
            assert r["text"] == ("\n".join(keep.get(r["doc_id"], [])) if texts[r["doc_id"]] is not None else None), r["doc_id"]
    assert line_dedup.dedup_lines(docs(spark, texts).where("false")).count() == 0
    twice = docs(spark, texts).unionByName(docs(spark, texts))
    assert Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(twice).collect()) == Counter({(r["doc_id"], r["text"]): 2 for r in rounds[0]})
    # every token by the way of those that many lines share
    with pytest.MonkeyPatch.context() as m:
        m.setattr(line_dedup, "HOT", 0)
        assert sorted(map(str, line_dedup.dedup_lines(docs(spark, texts)).collect())) == sorted(map(str, rounds[0]))


def test_line_dedup_of_passages_that_few_lines_share(spark, monkeypatch):
    """Tokens of five lines in some 560,000 are told from those of one: the lines aren't compared."""
    rng = np.random.default_rng(3)
    word = rng.choice([f"w{i}" for i in range(50_000)], (10_000, 60))
    word[:, 20:34] = np.repeat(word[::5, 20:34], 5, 0)
    texts = ["\n".join(" ".join(w) for w in word[i : i + 200]) for i in range(0, 10_000, 200)]
    seen, plain = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    got = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert sum(r["n_removed"] for r in got) == 0 and sum(seen) < 100


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas", "rdd"):
        monkeypatch.setattr(type(spark.range(1)), name, property(never) if name == "rdd" else never)
    got = line_dedup.dedup_lines(docs(spark, ["a b c d e f\nA b, c d e f", "z\na B c d e f", None]))
    assert [(r["text"], r["n_removed"]) for r in sorted(got.collect())] == [("a b c d e f", 1), ("z", 1), (None, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_puts_frequent_tokens_last(spark, monkeypatch):
    """600 lines with the same 30 words in their midst: no token of these is in a prefix, so no pair is compared."""
    rng = np.random.default_rng(6)
    word = rng.choice([f"w{i}" for i in range(50_000)], (600, 90))
    word[:, 30:60] = word[0, 30:60]
    lines = [" ".join(w) for w in word]
    lines += [lines[7] + " more", "other " + lines[300]]  # near copies among them
    texts = ["\n".join(lines[i : i + 50]) for i in range(0, len(lines), 50)]
    seen, plain = [], line_dedup.close
    monkeypatch.setattr(line_dedup, "close", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    got = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert sum(r["n_removed"] for r in got) == 2 and sum(seen) < 10
    assert next(r for r in got if r["doc_id"] == 12)["n_removed"] == 2


# --- search ---


def test_top_k_on_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(200)] + [(200 + i, [1.0, 1.0, 0.0, 0.0, 0.0]) for i in range(150)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (None, [1.0] * 5), (520, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(df, lambda k: k % 20 == 0, 7, chunk=20, block=4).collect()}
    good = {i: np.floor(64 * np.pad(np.float32(v).astype(float), (0, 5 - len(v)))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 20 == 0]:
        best = sorted(((int(good[q] @ x), -i) for i, x in good.items() if i != q), reverse=True)[:7]
        assert [got[q, r + 1] for r in range(7)] == [(-i, s) for s, i in best]
    assert vectors.top_k(df.where("false"), lambda k: k % 20 == 0).count() == 0
    few = vectors.top_k(df.where("vec_id in (0, 1, 2)"), lambda k: k % 20 == 0).collect()
    assert len(few) == 2


def test_top_k_of_a_query_on_many_equal_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 100)] + [(100, [1.0, 2.0, 0.0, 0.0])] * 600
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, np.floor(64 * np.float32(v).astype(float))) for i, v in rows]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(df, lambda k: k % 20 == 0).collect()}
    for q in (20, 40, 60, 80, 100):
        best = sorted((-int(v @ x), i) for j, v in whole if j == q for i, x in whole if i != q)[:20]
        assert [got[q, r + 1] for r in range(20)] == [(i, -s) for s, i in best], q
    assert len(got) == 100


def test_top_k_of_large_values(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 14)]) for i in range(120)] + [(200, [1e305, 1.0, 0.0]), (201, [-1e305, 0.0, 0.0]), (202, [1e307, 0.0, 0.0]), (203, [3e18, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if np.isfinite(64 * np.array(v)).all()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k(df, lambda k: k % 20 == 0, 5, chunk=16, block=3).collect()}
    for q in [i for i in whole if i % 20 == 0]:
        scores = {i: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1) for i, v in whole.items() if i != q}
        best = sorted((-s, i) for i, s in scores.items())[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best], q


def test_grid_grows_with_the_rows(spark):
    assert [vectors.grid(n) for n in (0, 10**5, 10**7, 10**12)] == [8, 8, 50, 256]
    sf = "/root/testdata/sf0.01"
    share = vectors.share_visited(spark.read.parquet(f"{sf}/embeddings.parquet"), lambda k: k % 20 == 0)
    assert 0 < share <= 1


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    docs_, kept = queries.table(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs_ = stage(spark, docs_, SF).cache()
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"], i
        kept.append({r["doc_id"] for r in docs_.select("doc_id").collect()})
    assert kept[3] <= kept[2] <= kept[1] <= kept[0]
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    left = sorted(kept[1])
    assert not brute_links([texts[i] for i in left])
    last = corpus_pipeline.STAGES[4][1](spark, docs_, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in last] == sorted(r["doc_id"] for r in docs_.collect())
    ends = np.cumsum([r["n_tokens"] for r in last])
    assert [r["start"] for r in last] == [0, *ends[:-1].tolist()]


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = [stage for _, stage in corpus_pipeline.STAGES]
    given = queries.table(spark, SF, "documents")
    after, rows = [given], [given.collect()]
    for stage in stages[:4]:
        after.append(stage(spark, after[-1], SF).cache())
        rows.append(after[-1].collect())
    texts = {r["doc_id"]: r["text"] for r in rows[0]}
    assert len(texts) == len(rows[0])
    ids = [sorted(r["doc_id"] for r in some) for some in rows]
    assert all(len(set(ids[i])) == len(ids[i]) for i in range(4)) and len(ids[0]) > len(ids[1]) > len(ids[2]) > len(ids[3])

    scores = toxicity.score(given, queries.toxic_model(given, queries.table(spark, SF, "labels"))).collect()
    assert ids[1] == sorted(r["doc_id"] for r in scores if r["score"] < 0.3)

    links, seen, first = brute_links([texts[i] for i in ids[1]]), set(), []
    for i in range(len(ids[1])):  # ascending ids: the first of a group is its smallest
        if i not in seen:
            first.append(ids[1][i])
            todo = [i]
            while todo:
                if (j := todo.pop()) not in seen:
                    seen.add(j)
                    todo += links.get(j, ())
    assert ids[2] == first

    number = {}
    numbers = lambda t: np.array([number.setdefault(w, len(number)) for w in WORD.findall((t or "").lower())], np.uint64)
    items = [numbers(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    assert all(0 < len(q) <= decontam.PASSAGE for q in items)

    def leaks(words):
        windows = [words[a : a + 128] for a in range(0, len(words), 64)]
        return any(decontam.common_subsequence(q, w) >= 0.6 * len(q) for w in windows for q in items)

    assert ids[3] == [i for i in ids[2] if not leaks(numbers(texts[i]))]

    source = {r["doc_id"]: r["source"] for r in rows[3]}
    size = Counter(source.values())
    drawn = []
    for i in ids[3]:
        digest = hashlib.md5(f"0|{i}|{hashlib.md5((texts[i] or '').encode()).hexdigest()}".encode()).hexdigest()
        drawn += [i] * poisson_count(len(source) / len(size) / size[source[i]], int(digest[:13], 16) / 2**52)
    assert ids[4] == drawn

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in rows[4])
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == want
