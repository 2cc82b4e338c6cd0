"""Nearest neighbours, conversation repair and lexical search against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veilmark.llm import lexical_search, turn_repair, vantage_points


def set_to(monkeypatch, module, **values):
    for name, value in values.items():
        monkeypatch.setattr(module, name, value)


VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING"


def vectors():
    r = np.random.default_rng(11)
    rows = []
    for _ in range(12):
        base = r.normal(size=8) * r.uniform(0.1, 5)
        rows += [[float(np.float32(x)) for x in base + r.normal(size=8) * 0.2] for _ in range(25)]
    rows += [rows[7]] * 40  # more equal vectors than a query asks for
    rows = [(i, v, "s") for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [3.0, 1.0], [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7]
    return [*rows, *[(len(rows) + i, v, "s") for i, v in enumerate(odd)], (None, [9.0] * 8, "s")]


def in_order(v, w):
    out = 0.0
    for a, b in zip(v, w, strict=True):
        out += a * b
    return out


def nearest(rows, asked, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if i in asked:
            scored = [(-in_order(v.tolist(), w.tolist()), j) for j, w in good if j != i and len(v) == len(w)]
            out |= {(i, n): (j, -s) for n, (s, j) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 16, "LEAF": 3, "BLOCK": 4}, {"SHARD": 32, "LEAF": 8, "GROUP": 2, "BLOCK": 8, "CELL_BYTES": 3000}])
def test_nearest(spark, monkeypatch, sizes):
    set_to(monkeypatch, vantage_points, **sizes)
    rows = vectors()
    asked = {i for i, *_ in rows if i is not None and (i % 20 == 0 or i > 330)}
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vantage_points.nearest(df, df.where("vec_id % 20 = 0 OR vec_id > 330"), 6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = nearest(rows, asked, 6)
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == want


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    assert vantage_points.nearest(df.limit(0), df).count() == 0
    assert vantage_points.nearest(df, df.limit(0)).count() == 0
    twice = df.where("vec_id IN (0, 1, 2)").union(df.where("vec_id = 2"))
    assert [r["vec_id"] for r in vantage_points.nearest(twice, df.where("vec_id = 0").union(df.where("vec_id = 0"))).orderBy("rank").collect()].count(2) == 2


def test_factor_trades_recall_for_work():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres, 50, axis=0) + r.normal(size=(2000, 16)) * 0.15
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids, q = np.arange(2000), np.arange(0, 2000, 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    made, recall = [], []
    for factor in (1.0, 1.5, 4.0):
        best = vantage_points.Best(q, x[q], 20)
        made.append(sum(vantage_points.search(vantage_points.build(ids[a : a + 500], x[a : a + 500], 20), best, factor) for a in range(0, 2000, 500)))
        recall.append(np.mean([len({*a} & {*b}) / 20 for a, b in zip(best.found.tolist(), want.tolist(), strict=True)]))
    assert recall[0] == 1 and (vantage_points.Best(q, x[q], 20).found != want).all()
    assert made[0] < 0.9 * len(q) * 2000 and made[2] < made[1] < made[0] and recall[1] >= 0.9


def cheapest(rows):
    """Every audit of up to a few inserts, by trying all."""
    best = None
    todo = [(0, "", 0, "")]
    while todo:
        i, roles, cost, audit = todo.pop()
        if best and cost > best[0]:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if audit.count("I") < 3:
            todo += [(i, roles + r, cost + 5, audit + "I") for r in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            todo.append((i + 1, roles, cost + 2, audit + "D"))
            if fault in "-t":
                more = 5 if fault == "t" else 0
                todo += [(i + 1, roles + initial, cost + more, audit + "K"), *[(i + 1, roles + r, cost + more + 1, audit + "R") for r in "ua"]]
        todo = [t for t in todo if re.match("(s?(ua)*u?)?$", t[1])]
    return best


def test_ways_against_all_edits():
    r = random.Random(4)
    for _ in range(150):
        rows = [(r.choice("suaux"), r.choice("---tbd")) for _ in range(r.randrange(0, 5))]
        assert [*turn_repair.ways(rows, 0, True).values()] == [cheapest(rows)]


def repaired(rows):
    """The contract's columns by dynamic programming over whole conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        had = []
        for _, turn, role, text, *_ in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            had += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        had.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in had:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not said else "d" if (role, text) in seen else "-" if said[-1] in ".!?" else "t")
            seen.add((role, text))
        state = {"": (0, "", [])}

        def relax(state):
            state = dict(state)
            for _ in range(2):
                for end, (c, a, t) in list(state.items()):
                    for role in ("user", "assistant"):
                        if (role == "assistant") == (end == "u"):
                            state[role[0]] = min(state.get(role[0], (1e9,)), (c + 5, a + "I", [*t, f"{role}:"]))
            return state

        for (_, role, text), fault in zip(had, faults, strict=True):
            new = {}
            for end, (c, a, t) in relax(state).items():
                moves = [(end, c + 2, a + "D", t)]
                if fault in "-t":
                    for to, cost, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                        ok = end == "u" if to[:1] == "a" else end != "u" if to[:1] == "u" else end == "" and to[:1] == "s" and letter == "K"
                        if ok:
                            moves.append((to[:1], c + cost + 5 * (fault == "t"), a + letter, [*t, f"{to}:{text}"]))
                for to, *way in moves:
                    new[to] = min(new.get(to, (1e9,)), tuple(way))
            state = new
        cost, audit, text = min(v for k, v in relax(state).items() if k in ("", "a"))
        turns = [t for t, *_ in had if t is not None]
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(had)]
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


TALK = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, at STRING, whole STRING"


def talks():
    r = random.Random(12)
    some = ["Yes.", "No!", "Why?", "cut off", "", " \t", "ends here. \n", None, "x"]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice([*some, f"word {r.random()}.", f"other {r.random()}"])) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, t, "system" if not t else ("assistant", "user")[t % 2], f"turn {r.randrange(300)}.") for t in range(700)]
    rows += [(None, None, "user", "Hello."), (None, 3, "assistant", "Hello."), (101, None, None, None), (102, 5, "user", "a."), (102, 5, "user", "a."), (102, 5, "assistant", "b."), (103, 1, "user", "long " * 500_000 + "."), (103, 2, "assistant", "Ok.")]
    rows += [(104, 7, "user", "again.")] * 300
    return [(*x, "s", "s") for x in rows]


@pytest.mark.parametrize("size", [256, 4])
def test_repair(spark, monkeypatch, size):
    set_to(monkeypatch, turn_repair, SEGMENT=size)
    rows = talks()
    df = spark.createDataFrame(rows, TALK).repartition(5)
    got = turn_repair.digest(df, turn_repair.damaged(df))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got.collect()} == repaired(rows)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], TALK)
    assert turn_repair.digest(df, turn_repair.damaged(df)).count() == 0
    gone = spark.createDataFrame([next((c, t, "user", "Hi.", "s", "s") for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)], TALK)
    row = turn_repair.digest(gone, turn_repair.damaged(gone)).first()
    assert row["audit"] == "" and row["cost"] == 0 and row["gaps"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_rows(spark):
    """The operator's own result: lawful roles, texts of the kept turns only."""
    df = spark.createDataFrame(talks(), TALK)
    roles = {}
    for r in turn_repair.repair(df).orderBy("at").collect():
        roles.setdefault(r["c"], []).extend(x[:1] for x in r["roles"])
        assert len(r["roles"]) == len(r["texts"]) == len(r["audit"]) - r["audit"].count("D")
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in roles.values()) and len(roles) == len({r[0] for r in talks()})


DOCS = "doc_id BIGINT, text STRING, score STRING"


def texts():
    r = random.Random(13)
    vocabulary = [f"t{i}" for i in range(80)] + ["Éa", "ein", "EIN", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    said = [r.choice([" ", ", ", "\n", "-"]).join(r.choices(vocabulary, weights, k=r.randrange(1, 60))) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(said)] + [(900 + i, said[3]) for i in range(30)] + [(1000, None), (1001, ""), (1002, " .,! "), (5, said[8]), (5, said[5]), (None, said[9]), (None, said[3]), (1003, "t1 " * 40_000)]
    return [(i, t, "s") for i, t in rows]


ITEMS = [(0, "t1 t2 T3 ein unknown"), (1, "t40 t41 t42 t43 t40"), (2, None), (3, ""), (4, "unknown"), (5, "éa Éa x9-x9"), (6, " ".join(f"t{i}" for i in range(60))), (7, "t5"), (7, "t5"), (7, "t6 t7"), (None, "t70 t71")]
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k):
    bags = [(i, Counter(terms(t))) for i, t, _ in rows if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {*items}:
        scores = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, place, i, -s) for place, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 50, "POSTINGS": 4, "QUERIES": 2, "FIRST_BATCH": 2}, {"SHARD_POSTINGS": 300, "POSTINGS": 16, "LAST_BATCH": 8}])
def test_lexical_search(spark, monkeypatch, sizes):
    set_to(monkeypatch, lexical_search, **sizes)
    docs = spark.createDataFrame(texts(), DOCS).repartition(3)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id BIGINT, text STRING, rank INT")
    got = lexical_search.rank(docs, items, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(texts(), ITEMS, 7)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame(texts(), DOCS), spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    assert lexical_search.rank(docs.limit(0), items).count() == 0
    assert lexical_search.rank(docs, items.limit(0)).count() == 0
    assert lexical_search.rank(docs, items.where("text IS NULL OR text = ''")).count() == 0


def test_packed_numbers():
    r = np.random.default_rng(5)
    for top in (1, 2, 255, 2**20):
        x = r.integers(0, top, size=128)
        data, width = lexical_search.packed(x)
        assert (lexical_search.unpacked(np.frombuffer(data, dtype=np.uint8), len(x), width) == x).all()


def test_blocks_are_skipped():
    """Rare terms settle the best documents early, so most blocks of the frequent one stay packed."""
    r = np.random.default_rng(6)
    n = 20_000
    tf = np.ones(n, dtype=np.int64)
    rare = np.sort(r.choice(n // 50, 12, replace=False))
    made = lexical_search.shard_postings(np.arange(n), r.integers(50, 60, n), np.concatenate([np.full(n, 1), np.full(12, 2)]).astype(np.uint64), np.concatenate([np.arange(n), rare]), np.concatenate([tf, np.full(12, 9)]))
    row = {c: x if isinstance(x, bytes) else x.tobytes() for c, x in made.items()}
    shard = lexical_search.Shard(row, n, n * 55)
    at, scores, opened = lexical_search.search(shard, np.array([1, 2], dtype=np.uint64), np.array([3, 8000]), 10)
    assert set(at.tolist()) <= set(rare.tolist()) and len(at) == 10 and (np.diff(scores) <= 0).all()
    assert opened < 0.25 * len(shard.blocks)
