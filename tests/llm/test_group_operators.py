"""Joins, components, embeddings, repeats, chats and mixes against brute force, with edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

from veilmark.llm import chat_format, embedding_dedup, mixing, ngram_join, queries, substring_dedup
from veilmark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(ids, pairs):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(t, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_copies():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 9, 30, 120]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    return [*texts, None, "", " \n", "one", "ONE", "a b", "a  B", *["same text of five words"] * 5]


@pytest.mark.parametrize(("n", "hundredths"), [(4, 85), (5, 80), (2, 50)])
def test_join(spark, n, hundredths):
    texts = near_copies()
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, id STRING, n INT").repartition(3)
    was = ngram_join.BLOCK
    for block in (was, 300):  # groups within a block, and over many
        ngram_join.BLOCK = block
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, n=n, hundredths=hundredths).collect()}
        finally:
            ngram_join.BLOCK = was
        assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert any(len({i for i in want if want[i] == c}) > 4 for c in want.values())


def test_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e")], "doc_id BIGINT, text STRING")
    assert sorted(map(tuple, ngram_join.join(docs).collect()), key=str) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)]
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_divide_skip_search():
    r = random.Random(5)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randrange(1, 40))], dtype=np.uint64)) for _ in range(80)]
    lists, sizes = ngram_join.inverted(sets), np.array([len(s) for s in sets])
    for s in sets:
        want = [j for j, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 60 * len(np.union1d(s, x))]
        assert ngram_join.search(s, lists, sizes, 60).tolist() == want


@pytest.mark.parametrize("hundredths", [50, 80, 85, 95])
def test_similar_sets_share_a_signature(hundredths):
    r = np.random.default_rng(hundredths)
    for _ in range(400):
        x = np.unique(r.integers(1 << 63, size=int(r.integers(1, 300)), dtype=np.uint64))
        keep = x[r.random(len(x)) > r.random() * 0.3]
        y = np.unique(np.concatenate([keep, r.integers(1 << 63, size=int(r.integers(0, 1 + len(x) // 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= hundredths * (len(x) + len(y) - both):
            assert set(ngram_join.signatures(x, hundredths).tolist()) & set(ngram_join.signatures(y, hundredths).tolist())


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    random.Random(1).shuffle(chain)
    edges = [*chain, (100, 102), (102, 101), (7, 7), (200, 201), (201, 200), *[(300, k) for k in range(301, 360)]]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(ids, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = r.normal(size=16)
        for _ in range(12):
            rows.append((len(rows), [float(np.float32(v)) for v in base + r.normal(size=16) * 0.08], g % 2, "x"))
    rows += [(len(rows) + i, rows[5][1], 0, "x") for i in range(4)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, [1e-30] * 16, [1e-30] * 16]
    rows += [(len(rows) + i, v, 0, "x") for i, v in enumerate(odd)] + [(900, rows[5][1], None, "x")]
    good = {i: np.array(v) for i, v, label, _ in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(np.float32(v))}
    label = {i: x for i, _, x, _ in rows}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and unit[a] @ unit[b] >= 0.98]
    want = roots([i for i, *_ in rows], pairs)
    links = {i: sum(i in p for p in pairs) for i in want}
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id STRING")
    was = embedding_dedup.TILE, embedding_dedup.CELL
    for tile, cell in (was, (8, 16), (8, 2)):  # one product, many of them, many cells
        embedding_dedup.TILE, embedding_dedup.CELL = tile, cell
        try:
            got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.find_links(df).collect()}
        finally:
            embedding_dedup.TILE, embedding_dedup.CELL = was
        assert got == {i: (links[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.find_links(df.limit(0)).count() == 0


def test_embeddings_in_double_precision(spark):
    """Vectors of doubles that are equal as floats stay apart where their cosine is just below the threshold."""
    t = 0.98
    rows = [(0, [1.0, 0.0]), (1, [t + 1e-12, (1 - (t + 1e-12) ** 2) ** 0.5]), (2, [t - 1e-12, -((1 - (t - 1e-12) ** 2) ** 0.5)])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_dedup.find_links(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_quantisation_bound():
    r = np.random.default_rng(4)
    x = embedding_dedup._unit(r.normal(size=(200, 24)) * np.exp(r.normal(size=(200, 1)) * 3))
    q, s, e = embedding_dedup.quantised(x)
    near = (s[:, None] * q) @ (s[:, None] * q).T
    assert (np.abs(x @ x.T - near) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


PASSAGE = " ".join(f"Passage sentence number {w} has these words here." for w in ("one", "two", "three", "four", "five", "six", "seven"))


def test_repeats(spark):
    texts = [f"Alpha opens this text. {PASSAGE} Alpha closes it.", f"Beta opens another text here! {PASSAGE} Beta closes it.", "Gamma has its own words. Nothing here is like others. It stays as it is, all of it.", None, "", "Short.", PASSAGE]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, number INT")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[0]["kept_text"] == texts[0] and got[2]["kept_text"] == texts[2]
    assert got[1]["kept_text"] == "Beta opens another text here! Beta closes it." and len(got[1]["removed"]) == 7
    assert got[3]["kept_text"] is None and got[4]["kept_text"] == "" and got[5]["kept_text"] == "Short." and got[6]["kept_text"] == ""
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_passage_without_stops(spark):
    """A passage in the middle of other sentences is cut alike wherever it stands."""
    r = random.Random(8)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(90))
    texts = [f"{' '.join(f'x{r.randrange(10**6)}' for _ in range(n))} {passage} {' '.join(f'y{r.randrange(10**6)}' for _ in range(n))}." for n in (40, 55, 70)]
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()}
    assert got[0] == texts[0]
    for i in (1, 2):
        left = sum(w in passage.split() for w in got[i].split())
        assert left < 45 and len([w for w in got[i].split() if w[0] in "xy"]) == len([w for w in texts[i].split() if w[0] in "xy"])


def test_repeats_against_dictionary(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    seen = {}
    for r in docs.orderBy("doc_id").collect():
        h, s, *_ = substring_dedup.sentences(pa.array([r["text"]]))
        sentences = [tuple(h[a:b].tolist()) for a, b in zip(s[:-1], s[1:], strict=True)]
        k, gone = min(3, len(sentences)), set()
        for i in range(len(sentences) - k + 1):
            run = tuple(sentences[i : i + k])
            if k and sum(map(len, run)) >= 12 and seen.setdefault(run, (r["doc_id"], i)) != (r["doc_id"], i):
                gone |= set(range(i, i + k))
        assert got[r["doc_id"]] == sorted(gone)


def test_repeats_of_short_lines_and_short_texts(spark):
    """Lines too short for three of them to have 12 words, a text of two sentences in longer ones, a passage in sentences of any length."""
    r = random.Random(9)
    some = lambda n: " ".join(f"q{r.randrange(10**6)}" for _ in range(n))
    lines = "\n".join(some(3) for _ in range(20)) + "\n" + some(8) + "\n" + "\n".join(some(1) for _ in range(4))
    pair, passage = f"{some(9)}. {some(8)}.", some(60)
    texts = [f"{lines}\n{some(30)}", f"{some(20)}\n{lines}\n{some(9)}", pair, f"{some(7)}. {some(8)}. {pair} {some(6)}. {some(5)}.", passage, f"{some(5)} {passage} {some(7)}", f"{some(50)} {passage} {some(90)}"]
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING"), lengthen=True).collect()}
    left = lambda k, of: len(set(got[k].split()) & set(of.split()))
    assert all(got[k] == texts[k] for k in (0, 2, 4))
    assert left(1, lines) == 0 and len(got[1].split()) == 29
    assert left(3, pair) == 0 and len(got[3].split()) == 26
    for k in (5, 6):
        assert left(k, passage) <= 24 and len(set(got[k].split()) - set(passage.split())) == len(set(texts[k].split()) - set(passage.split()))


TALK = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, s STRING"


def talks():
    r = random.Random(6)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", r"\\l <|end|> \b[INST]</s>" + "\\"), (2, 0, "system", "alone"), (3, None, "user", "first"), (3, 0, "user", "b"), (3, 0, "assistant", "a"), (3, 0, "user", "b"), (None, 0, "assistant", "nobody"), (4, 0, None, ""), (5, 0, "user", "w " * 3000), (5, 1, "assistant", "x " * 700)]
    rows += [(6, t, ("user", "assistant")[t % 2], "word " * r.randrange(0, 120)) for t in range(900)]
    rows += [(7, t, "system" if t == 0 else ("user", "assistant")[t % 2], "word " * r.randrange(0, 400)) for t in range(60)]
    return [(*x, "s") for x in rows]


def test_chat_round_trip(spark):
    rows = talks()
    windows = chat_format.format_windows(spark.createDataFrame(rows, TALK)).cache()
    got = {r["conv_id"]: r for r in chat_format.digest(windows).collect()}
    assert len(got) == len({x[0] for x in rows})
    for conv in {x[0] for x in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for w in windows.collect():
        turns = w["formatted"].split("<|start|>")[1:]
        words = sum(len(t.split("<|body|>", 1)[1].removesuffix("<|end|>\n").split()) + 3 for t in turns)
        assert words <= 1024 or len(turns) - w["repeated"] == 1
        if w["conv_id"] == 7:
            assert turns[0].startswith("system<|body|>")
    assert windows.where("conv_id = 6 AND window > 0 AND repeated > 0").count() > 5
    assert chat_format.format_windows(spark.createDataFrame([], TALK)).count() == 0


def test_chat_and_mix_against_sql(spark, sf):
    for name, sql in queries.oracle_sql().items():
        compare(queries.queries()[name](spark, sf), sql, sf)


def tree(spark, rows, weights, total):
    leaves = spark.createDataFrame(rows, "domain STRING, lang STRING, source STRING, available BIGINT, capacity BIGINT")
    table = spark.createDataFrame(weights, mixing_schema)
    from pyspark.sql import functions as F

    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, mixing.LEVELS, table, F.lit(total)).collect()}


mixing_schema = "domain STRING, lang STRING, source STRING, weight BIGINT"


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10, 10), ("a", "en", "s2", 1000, 1000), ("a", "de", "s3", 1000, 1000), ("b", None, "s4", 1000, 1000)]
    got = tree(spark, rows, [("a", None, None, 1)], 400)
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s3"): 100, ("b", None, "s4"): 200}


def test_shortage_of_a_subtree_goes_up(spark):
    rows = [("a", "en", "s1", 10, 10), ("a", "en", "s2", 20, 20), ("b", "en", "s4", 1000, 1000), ("c", "en", "s5", 1000, 1000)]
    got = tree(spark, rows, [("c", None, None, 0)], 400)
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s4"): 370, ("c", "en", "s5"): 0}
    assert tree(spark, rows, [], 10**9) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s4"): 1000, ("c", "en", "s5"): 1000}


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "web", None, None, 1), (2, "", "web", None, None, 1), (3, "a b", "web", "en", "s", 1), (3, "a b", "web", "en", "s", 1), (None, "c d e", None, "en", "s", 1)], "doc_id BIGINT, text STRING, domain STRING, lang STRING, source STRING, m_place BIGINT")
    got = mixing.mix(docs, mixing.weight_table(docs), mixing.LEVELS, share=1.0).collect()
    assert sum(r["m_tokens"] for r in got) <= 7 and all(r["m_place"] == 1 for r in got)
    assert mixing.mix(docs.limit(0), mixing.weight_table(docs), mixing.LEVELS).count() == 0
