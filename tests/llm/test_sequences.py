"""Prefix trie, mixing and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisift.llm import mixing, periodic, prefix_trie, queries
from evisift.llm.ordered import running
from tests.llm.cases import SENTENCE, documents, edited_rows, odd_rows

# running totals


def test_running_totals_of_a_group_in_many_parts(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), i, rnd.randrange(100)) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = running(df, ["g"], [F.col("o").desc()], {"n": F.count(F.lit(1)), "s": F.sum("v"), "x": F.bit_xor("v")}, "test")
    want, state = {}, defaultdict(lambda: [0, 0, 0])
    for g, o, v in sorted(rows, key=lambda r: -r[1]):
        want[g, o, v] = tuple(state[g])
        state[g] = [state[g][0] + 1, state[g][1] + v, state[g][2] ^ v]
    assert {(r["g"], r["o"], r["v"]): (r["n"], r["s"], r["x"]) for r in got.collect()} == want


# conversation prefix trie


def plain_trie(turns, rebuild):
    """turns: (conv, turn, role, text); nodes as the query returns them."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0), digest, (role, text)))
    seq = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in seq}
        seq = {c: seq.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in seq.items()}
    nodes = defaultdict(list)
    for c, v in seq.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += cost
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(seq[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out[min(members), len(p), parent, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed, n=60):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        base = random.Random(seed * 100 + c % 4)
        length = rnd.choice([0, 1, 2, 3, 4, 5, 8, 9, 13, 40])
        turns = [(base.choice(["user", "assistant", None]), base.choice(["", None, "yes", "é ñ", "no, " * 3])) for _ in range(40)][:length]
        for t, (role, text) in enumerate(turns):
            if rnd.random() < 0.05:
                text = f"own {c}"
            rows.append((c, t if t or rnd.random() < 0.7 else None, role, text))
    rnd.shuffle(rows)
    return rows


def trie_rows(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


# extra columns bear names the operator uses inside
CONVERSATIONS = "conv_id long, turn long, role string, text string, pos int, digest string, k int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", n) for n, r in enumerate(rows)], CONVERSATIONS)


ODD = [(None, 0, "user", "lost"), (-7, None, None, None), (-7, 0, "user", ""), (3, 5, "user", "a" * 70_000), (3, 5, "user", "b"), (3, None, "bot", "c"), (8, 1, "x", "y"), (8, 1, "x", "y")]


@pytest.mark.parametrize(("rows", "block"), [(conversations(1) + ODD, 4), (conversations(2, 25), 1), (ODD[:1], 4)])
def test_trie_equals_plain_version(spark, rows, block):
    turns = prefix_trie.ordered_turns(table(spark, rows))
    assert trie_rows(prefix_trie.prefix_trie(turns, block=block)) == plain_trie(rows, False)


def test_rebuilt_conversations_some_without_turns(spark):
    rows = conversations(3) + [(106, 0, "user", "a"), (107, 0, "user", "b"), (107, 1, "user", "c"), (1234, 0, None, None)]
    assert trie_rows(prefix_trie.prefix_trie(*queries.rebuilt_turns(table(spark, rows)))) == plain_trie(rows, True)


def test_trie_digests_many_ends_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_ROW", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(90, 150) for t in range(3)] + [(c, t, "user", f"turn {t}") for c in range(20) for t in range(2)]
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.ordered_turns(table(spark, rows)))) == plain_trie(rows, False)


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_equal_rounds_of_sharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {None if i == 3 else f"s{i}": rnd.choice([0, 1, 50, 1000, 30000]) for i in range(12)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got.keys() == sizes.keys() and all(abs(got[s] - t) <= 1e-6 * max(t, 1) for s, t in plain_targets(sizes).items())


def mixed_rows(spark, docs, **options):
    rows = [r.asDict() for r in mixing.mix_sources(docs, keep=["source", "text"], **options).collect()]
    assert all(r["size"] == len((r["text"] or "").encode().split()) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    return rows


def many_sources(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 20, 90, 700])), rnd.choice(["hot"] * 9 + ["a", "b", "", None])) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1)).withColumn("kept", F.lit("x"))


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = many_sources(spark)
    rows = mixed_rows(spark, docs)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want = plain_targets({s: sum(r["size"] for r in of) for s, of in by.items()})
    for s, of in by.items():
        assert abs(of[0]["target"] - want[s]) < 1e-6 * want[s] and of[0]["source_size"] == sum(r["size"] for r in of)
        assert abs(sum(r["taken"] for r in of) - want[s]) <= max(1.0, want[s] / 500)
    again = mixed_rows(spark, docs.repartition(7))
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)
    other = mixed_rows(spark, docs, seed=1)
    assert Counter((r["doc_id"], r["taken"]) for r in rows) != Counter((r["doc_id"], r["taken"]) for r in other)


def test_every_document_is_drawn_about_as_often_as_it_should(spark):
    docs = spark.createDataFrame([(i, "w " * (10 + i % 5), "s" if i < 200 else "t") for i in range(240)], "doc_id long, text string, source string")
    drawn, rate = Counter(), {}
    for seed in range(6):
        for r in mixing.mix_sources(docs, weights=(1, 4), share=1.0, seed=seed).collect():
            drawn[r["doc_id"]] += r["copies"]
            rate[r["doc_id"]] = r["target"] / r["source_size"]
    low = [drawn[i] / 6 for i in range(200)]
    assert abs(np.mean(low) - rate[0]) < 0.02 and 0.08 < np.std(low) < 0.3 and max(low) <= 1


def test_weights_of_documents_rule_their_copies(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "s", [0.0, 1.0, 3.0, None, float("nan")][i % 5]) for i in range(1000)], "doc_id long, text string, source string, quality double")
    copies = Counter()
    for r in mixing.mix_sources(docs, weight="quality", share=0.5).collect():
        copies[r["doc_id"] % 5] += r["copies"]
    assert copies[0] == copies[3] == copies[4] == 0 and 490 <= copies[1] + copies[2] <= 510 and 2.4 < copies[2] / copies[1] < 3.8


def test_mix_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    rows = mixed_rows(spark, docs)
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(odd_rows()) and mixing.mix_sources(docs.limit(0)).isEmpty()
    assert all(r["taken"] == 0 for r in mixed_rows(spark, documents(spark, odd_rows()[:3])))
    mixed = mixing.mix_sources(docs, keep=["text"])
    assert mixing.mixed_texts(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


# periodic runs


def plain_runs(words, least=6, periods=4):
    n, out = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, periods * q):
                body = words[i : i + length]
                if not any(body[p:] == body[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, n=40):
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(6)):
            base = [f"w{rnd.randrange(rnd.choice([2, 3, 6]))}" for _ in range(rnd.randrange(1, 7))]
            words += (base * rnd.randrange(1, 8))[: rnd.randrange(1, 40)]
            if rnd.random() < 0.2:
                words = (words * 5)[:150]
        texts.append(rnd.choice([" ", "\n", " \t"]).join(words))
    return texts


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_equal_plain_version(spark):
    rows = [*odd_rows()[:9], *odd_rows()[12:], *enumerate(periodic_texts(4), 100), (200, "a b " * 900 + "c"), (201, "x " * 5), (202, "x " * 6)]
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.find_runs(documents(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = plain_runs(words)
        want[i, len(words), tuple(runs), " ".join(collapsed(words, runs))] += 1
    assert got == want and periodic.find_runs(documents(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (4, 2), (9, 3)])
def test_runs_of_random_words(least, periods):
    for seed in range(60):
        texts = [t.split() for t in periodic_texts(seed, 3)]
        known = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        ids = np.array([known[w] for t in texts for w in t], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        want, at = [], 0
        for t in texts:
            want += [(a + at, n, q) for a, n, q in plain_runs(t, least, periods)]
            at += len(t)
        assert sorted(periodic.find_in(ids, doc, least, periods)) == sorted(want)


def test_runs_of_a_very_long_text():
    ids = np.array([i % 5000 for i in range(400_000)], dtype=np.int64)
    assert periodic.find_in(ids, np.zeros(len(ids), dtype=np.int64)) == [(0, 400_000, 5000)]


def test_query_turns_words_round_before_it_looks(spark, tmp_path):
    rows = [*edited_rows(5), *((1000 + i, SENTENCE * (i % 4)) for i in range(60)), (2000, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13(spark, str(tmp_path)).collect():
        i, text = r["doc_id"], dict(rows)[r["doc_id"]]
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert tuple(r)[1:5] == (len(runs), *best) and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest()
