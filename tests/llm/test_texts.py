import bisect
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evisift.llm import arrays, decontaminate, exact_dedup, jaccard, line_dedup, personal, quality, secret_scan, tokens, toxicity
from evisift.llm.fm_index import FMIndex
from tests.llm.cases import SENTENCE, documents, edited_rows, odd_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# n-gram Jaccard join


def components(rows, shingle=4, similarity=85):
    sets = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} if w else set())
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(known) if known else None
    return Counter((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("rows", [odd_rows(), edited_rows(1), edited_rows(2, 6, 90), []])
@pytest.mark.parametrize(("shingle", "similarity"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, rows, shingle, similarity):
    found = jaccard.similar_documents(documents(spark, rows), shingle=shingle, similarity=similarity)
    assert Counter(map(tuple, found.collect())) == components(rows, shingle, similarity)


def test_jaccard_without_short_lists(spark, monkeypatch):
    """All lists resolved by pivots."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rows = edited_rows(3, 6, 60)
    assert Counter(map(tuple, jaccard.similar_documents(documents(spark, rows)).collect())) == components(rows, 5, 80)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_jaccard_rows_of_one_id_are_read_once(spark, doc_id):
    base = [f"w{i}" for i in range(40)]
    rows = [(doc_id, " ".join([*base[: i % 40], f"own{i // 2}", *base[i % 40 :]])) for i in range(400)]
    docs = documents(spark, rows).select("doc_id", F.col("text").alias("body"))
    keyed = jaccard.keyed_sets(docs, 4, 80)
    wanted = keyed.select("set_id").distinct()
    assert jaccard.owner_texts(docs, keyed, wanted).count() <= len(rows)
    sets = jaccard.shingle_sets(docs, keyed, wanted, 4)
    assert sets.count() >= sets.select("set_id").distinct().count() == wanted.count()
    found = jaccard.similar_documents(documents(spark, rows), shingle=4, similarity=80)
    assert Counter(map(tuple, found.collect())) == components(rows, 4, 80)


def test_jaccard_links_of_exactly_the_share_in_long_lists(spark):
    """34 of 40 shingles in common, 85 per cent; the first common one stands at place 3 of 37, behind three of the text's own."""
    shared = " ".join(f"s{i}" for i in range(37))
    rows = [(i, f"{shared} own{i} end{i} last{i}") for i in range(jaccard.SHORT + 6)]
    found = jaccard.similar_documents(documents(spark, rows), shingle=4, similarity=85)
    assert Counter(map(tuple, found.collect())) == components(rows) == Counter((i, 37, 0) for i, _ in rows)


def test_light_sets_enumerate_and_heavy_sets_do_not():
    limit = jaccard.light_limit()
    assert 6 <= limit < 30
    texts = [b"a b c d e", b" ".join(b"w%d" % i for i in range(limit + 50))]
    sets = jaccard.ShingleSets(texts, 4)
    assert len(sets.subset_keys(0, 85, limit)) > 0 and sets.subset_keys(1, 85, limit) == []


def test_similar_rows_keep_one_of_each_component(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns
    stand = {(i, c) for i, _, c in components(rows, 5, 80)}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in stand if i == c or i is None}


# token counts and packing


def test_token_counts_equal_the_library(spark, library):
    rows = [*odd_rows(), (20, "it's we'll 'tis  <|endoftext|> x<|endoftext|>\n\n  end "), (21, "aaaa" * 500), (22, "'s 's\t't a  b")]
    got = tokens.token_counts(documents(spark, rows), VOCABULARY).collect()
    want = Counter((i, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 512) for i, t in rows)
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_is_whole_gapless_and_tight(spark, library, window):
    rows = [(i, t) for i, t in [*odd_rows(), *((100 + i, t) for i, t in edited_rows(4))] if i is not None and i != 7]
    rows = list(dict(rows).items())
    pieces = [r.asDict() for r in tokens.pack_documents(documents(spark, rows), VOCABULARY, window=window).collect()]
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    import zlib

    for doc, text in rows:
        ids, at = [*ids_of(library, text), 1], 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            own = np.array(ids[at : at + p["length"]], dtype="<u4")
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(own.tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    full = sum(p["length"] for p in pieces)
    assert len(by_sequence) * window - full <= max(window, 0.05 * full)


def test_best_fit_takes_the_tightest_window():
    place, offset = tokens.best_fit([6, 5, 4, 3, 1, 1], 10)
    assert place == [0, 1, 0, 1, 1, 1] and offset == [0, 0, 6, 5, 8, 9]


def test_packing_in_many_blocks_keeps_every_piece(spark):
    pieces = tokens.cut_pieces(documents(spark, edited_rows(6)), VOCABULARY).cache()
    packed = tokens.pack(pieces, block=10)
    assert sorted(map(tuple, packed.select(pieces.columns).collect())) == sorted(map(tuple, pieces.collect()))
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


# decontamination


def windows_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(text, items):
    words, hit, found = windows_of(text), set(), set()
    for item, body in items:
        own = windows_of(body)
        size = min(10, len(own))
        if item is None or not size:
            continue
        patterns = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in patterns:
                found.add(str(item))
                hit |= set(range(i, i + size))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, SENTENCE), (2, "seven wizards"), (10, "a a a a a a a a a a a a"), (3, None), (4, "-- !"), (None, "one"), (5, SENTENCE + " and more"), (5, "ñ 日本語")]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_passages_equal_plain_search(spark, block_bytes):
    rows = [*odd_rows(), (30, f"x {SENTENCE}. {SENTENCE[:60]} seven WIZARDS"), (31, "wizards seven")]
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = decontaminate.find_passages(documents(spark, rows), bench, block_bytes=block_bytes).drop("items", "spans")
    assert Counter(map(tuple, got.collect())) == Counter((i, *hits(t, ITEMS)) for i, t in rows)


def test_removed_passages_leave_clean_texts_alone(spark):
    docs = documents(spark, odd_rows())
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    cleaned = decontaminate.remove_passages(docs, bench)
    assert cleaned.columns == docs.columns
    for before, after in zip(docs.collect(), cleaned.collect(), strict=True):
        assert (before["text"] == after["text"]) == (hits(before["text"], ITEMS)[1] == 0)
        assert hits(after["text"], ITEMS)[1] == 0 and before["c0"] == after["c0"]


def test_empty_benchmark_and_empty_documents(spark):
    docs = documents(spark, odd_rows())
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert decontaminate.find_passages(docs, bench.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.find_passages(docs.limit(0), bench).isEmpty()


def test_fm_index_finds_every_occurrence():
    rnd = np.random.default_rng(7)
    lengths = rnd.integers(1, 40, 60)
    ids = rnd.integers(1, 4, lengths.sum())
    index = FMIndex(ids, lengths, 3)
    patterns = rnd.integers(1, 4, (50, 5))
    pattern, place = index.search(patterns)
    ends = np.cumsum(lengths)
    want = {
        (p, i) for p in range(50) for a, b in zip(ends - lengths, ends, strict=True) for i in range(a, b - 4) if (ids[i : i + 5] == patterns[p]).all()
    }
    assert set(zip(pattern.tolist(), place.tolist(), strict=True)) == want and len(pattern) == len(want)


# exact and line dedup


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups_equal_normalised_texts(spark, bits):
    rows = [*odd_rows(), *edited_rows(5)]
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = Counter()
    for i, t in rows:
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        known = [x for x in groups[normal] if x is not None]
        keep = min(known) if known else None
        want[i, keep, len(groups[normal]), i == keep, hashlib.sha256(normal.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(documents(spark, rows), hash_bits=bits)
    assert Counter(map(tuple, got.collect())) == want


def test_exact_groups_run_no_python(spark):
    plan = exact_dedup.exact_groups(documents(spark, odd_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_drop_but_first_rows_stay(spark):
    docs = documents(spark, odd_rows())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 4, 6, 7, 7, 9, 10, 11, 12, 13]


def least(values, width):
    """Places of the first least value of every window, shorter ones at the edges included."""
    return {min(range(max(0, i), min(len(values), i + width)), key=lambda k: (values[k], k)) for i in range(1 - width, len(values)) if values}


def one_hash(data):
    return arrays.span_hashes(arrays.BYTE_VALUES[np.frombuffer(data, dtype=np.uint8)], np.array([0]), np.array([len(data)]))


def rolls(hashes):
    return [int(arrays.mix(h * np.uint64(31) + (hashes[k - 1] if k else np.uint64(0)))[0]) >> 1 for k, h in enumerate(hashes)]


def lines_and_spans(body):
    words = [m.span() for m in re.finditer(rb"\S+", body)]
    soft = least(rolls([one_hash(body[s:e]) for s, e in words]), line_dedup.LINE_WORDS)
    lines, first = [], 0
    for k, (s, e) in enumerate(words):
        gap = body[e : words[k + 1][0]] if k + 1 < len(words) else b"\n"
        if k in soft or body[e - 1 : e] in (b".", b"!", b"?") or b"\n" in gap:
            lines.append((words[first][0], e))
            first = k + 1
    own = [one_hash(body[s:e]) for s, e in lines]
    ends = sorted(least(rolls(own), line_dedup.CHUNK_LINES) | ({len(lines) - 1} if lines else set()))
    spans = []
    for a in [0, *[e + 1 for e in ends[:-1]]] if ends else []:
        for b in ends[bisect.bisect_left(ends, a) :]:
            size = lines[b][1] - lines[a][0]
            if (size >= 60 and b > a) or size >= 200:
                spans.append((lines[a][0], lines[b][1]))
                break
    return lines, spans


def lines_left(rows):
    texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    cut = [lines_and_spans(body) for _, body in texts]
    marks = [np.array(xxhash.xxh64_intdigest(body, seed=42), dtype=np.uint64).view(np.int64).item() for _, body in texts]
    first = {}
    for n, (i, body) in enumerate(texts):
        for s, e in cut[n][1]:
            at = (i, marks[n], s, body)
            first[body[s:e]] = min(first.get(body[s:e], at), at)
    out = Counter()
    for n, (i, body) in enumerate(texts):
        lines, spans = cut[n]
        late = [(s, e) for s, e in spans if first[body[s:e]] != (i, marks[n], s, body)]
        gone = bytearray(len(body))
        for k, (s, e) in enumerate(late):
            _, _, fs, other = first[body[s:e]]
            fe, a, b = fs + e - s, s, e
            if k == 0 or late[k - 1][1] < s:
                for own, its in list(zip(re.findall(rb"\S+\s+", body[:s])[::-1], re.findall(rb"\S+\s+", other[:fs])[::-1]))[: line_dedup.AROUND_WORDS]:
                    if own != its:
                        break
                    a -= len(own)
            if k == len(late) - 1 or late[k + 1][0] > e:
                for own, its in list(zip(re.findall(rb"\s+\S+", body[e:]), re.findall(rb"\s+\S+", other[fe:])))[: line_dedup.AROUND_WORDS]:
                    if own != its:
                        break
                    b += len(own)
            b += len(re.match(rb"\s*", body[b:])[0])
            gone[a:b] = b"\1" * (b - a)
        text = bytes(c for c, g in zip(body, gone) if not g).decode()
        removed = sum(all(gone[s:e]) for s, e in lines)
        out[None if i < 0 else i, len(lines), removed, text] += 1
    return out


def passage(seed, sentences=14):
    return " ".join(f"Sentence {seed} number {k} has a few words that belong to it." for k in range(sentences))


def test_repeated_passages_equal_plain_version(spark):
    shared = "\n".join(f"{SENTENCE} {i}" for i in range(6))
    rows = [*odd_rows(), (40, f"own start\n{shared}\nown end"), (41, f"other\nlines\n{shared}"), (42, shared + "\n" + shared), (43, "x" * 250 + "\nshort"),
            (44, "y\n" + "x" * 250), (45, f"some words before {passage(1)} and after it"), (46, f"Quite other words. {passage(1)}"), (47, "...\n\n!! ? .  . a"), (48, f"mark \uffff inside. {passage(1)}")]
    assert Counter(map(tuple, line_dedup.drop_repeated_lines(documents(spark, rows)).collect())) == lines_left(rows)


def test_passages_inside_lines_go_and_clean_texts_stay(spark):
    rows = [(i, f"Own words of text {i} come first and {i * 7} ones more {passage(3)} then {i} others follow. Bye.") for i in range(5)]
    rows += [(100 + i, f"A common line.\nText {i} is clean. " + " ".join(f"w{i}x{k}" for k in range(80))) for i in range(5)]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(documents(spark, rows)).collect()}
    for i in range(1, 5):
        # "ones more" and "then" stand next to the passage in all texts
        assert got[i]["text"] == f"Own words of text {i} come first and {i * 7} {i} others follow. Bye."
    assert all(got[i]["text"] == t and got[i]["removed_lines"] == 0 for i, t in rows if i == 0 or i >= 100)


@pytest.mark.parametrize("marks", [True, False])
def test_nearly_all_of_short_repeated_passages_goes(spark, marks):
    """Passages of 51 words inside two texts each, with and without sentence marks: share of words that goes, and none else."""
    rnd, rows, planted = random.Random(17), [], 200

    def prose(n, tag):
        return " ".join(f"{rnd.choice('abcdefgh')}{tag}{rnd.randrange(10**6)}" + ("." if marks and rnd.random() < 0.1 else "") for _ in range(n))

    for k in range(planted):
        shared = prose(51, "p")
        rows += [(2 * k + j, f"{prose(rnd.randrange(3, 90), 'q')} {shared} {prose(rnd.randrange(3, 90), 'q')}") for j in range(2)]
    got = {r["doc_id"]: r["text"].split() for r in line_dedup.drop_repeated_lines(documents(spark, rows)).collect()}
    left = [sum(w[1] == "p" for w in got[2 * k + 1]) for k in range(planted)]
    assert sum(n == 0 for n in left) >= 0.97 * planted
    assert all([w for w in got[i] if w[1] == "q"] == [w for w in t.split() if w[1] == "q"] for i, t in rows)
    assert all(got[i] == t.split() for i, t in rows if i % 2 == 0)


def test_repeated_spans_of_random_rows_equal_plain_version(spark):
    rnd = random.Random(5)
    pool = [" ".join(rnd.choice(["ab", "cde.", "f\n", "ghij", "k!", "日本", "lmnopq"]) + str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 60))) for _ in range(12)]
    rows = [(rnd.choice([None, k, k // 2]), "  ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 5)))) for k in range(60)]
    assert Counter(map(tuple, line_dedup.drop_repeated_lines(documents(spark, rows)).collect())) == lines_left(rows)


# classifiers


def labelled(spark, texts, label):
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], f"doc_id long, {label} int")
    return documents(spark, rows), labels


def accuracy(scored, texts):
    rows = [r for r in scored.collect() if r["held_out"]]
    assert rows and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return sum(r["predicted"] == texts[r["doc_id"]][1] for r in rows) / len(rows)


def test_quality_on_held_out_texts(spark):
    good = [(f"{SENTENCE} number{i}. Then a second line follows here.\nAnd {i % 7} more words.", 1) for i in range(150)]
    bad = [(f"BUY!! NOW!! {i} !!! " * (3 + i % 5), 0) for i in range(60)] + [("spam " * (10 + i), 0) for i in range(60)]
    docs, labels = labelled(spark, good + bad, "quality")
    model = quality.fit_quality(docs, labels)
    assert accuracy(quality.score_quality(docs, model), good + bad) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 140 <= kept.count() <= 160


def test_toxicity_tolerates_misspelling_and_stems(spark):
    insult = ["blockheads", "rottenest", "grumblefoot"]
    toxic = [(f"{SENTENCE[: 20 + i % 40]} you {insult[i % 3]} {i}", 1) for i in range(120)]
    clean = [(f"{SENTENCE[: 20 + i % 40]} nice day {i}", 0) for i in range(240)]
    docs, labels = labelled(spark, toxic + clean, "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    assert accuracy(toxicity.score_toxicity(docs, model), toxic + clean) > 0.97
    terms = toxicity.TermAutomaton([(b"blockhead", False), (b"rott", True)])
    words = arrays.Words([b"blockhead blokchead blockheat blockhea bblockhead blockers rotten rot BLOCKHEAD blckheads"], arrays.LETTERS_DIGITS_ANY_CASE)
    assert terms.match(words.data, words.start, words.end).tolist() == [1, 1, 1, 1, 1, 0, 2, 0, 1, 0]


def test_toxicity_scores_texts_whose_only_term_is_misspelled(spark):
    insult = ["blockheads", "rottenest", "grumblefoot"]
    toxic = [(f"{SENTENCE[: 20 + i % 40]} {insult[i % 3]} {i}", 1) for i in range(120)]
    clean = [(f"{SENTENCE[: 20 + i % 40]} nice day {i}", 0) for i in range(240)]
    model = toxicity.fit_toxicity(*labelled(spark, toxic + clean, "toxic"))
    rows = [(1, "The quick bl0ckheads"), (2, "The quick rotenest"), (3, "The quick grmublefoot"), (4, "The quick nice day"), (5, "The quick rottenest")]
    got = {r["doc_id"]: (r["predicted"], len(r["spans"])) for r in toxicity.score_toxicity(documents(spark, rows), model).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (0, 0), 5: (1, 1)}


@pytest.mark.parametrize("fit,score,label", [(quality.fit_quality, quality.score_quality, "quality"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")])
def test_classifiers_without_labels_or_rows(spark, fit, score, label):
    docs = documents(spark, odd_rows())
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    model = fit(docs, none)
    assert score(docs, model).count() == len(odd_rows()) and score(docs.limit(0), model).isEmpty()


# personal data and secrets


def plain_personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
    out += [("card", *m.span()) for m in cards if 14 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]


PERSONAL = [
    "a@b.c_d@e.f.g a.b+c@d-e.co.uk @x.y", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.2.3 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 49927398716",
    "+1 (555) 555-5010 +49 30 1234567 +123 ++1 555 555 5555", "é 10.0.0.1 😀 x@y.zz", "write to jane.doe (at) example (dot) com", "tel 030 123 45 67 89 and version 1.2.3.4",
]


def test_personal_base_spans_stay_and_count(spark):
    rows = [*odd_rows(), *enumerate(PERSONAL, 50)]
    docs = documents(spark, rows)
    got = personal.find_personal(docs, personal.fit_spans(docs)).collect()
    order = {k: i for i, k in enumerate(personal.KINDS)}
    want = {}
    for i, t in rows:
        base = plain_personal(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (s[1], order[s[0]])))
        n = Counter(k for k, _, _ in base)
        want[i, t] = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()), set(text.split(",")) - {""}
    for (i, t), r in zip(rows, got, strict=True):
        assert r["doc_id"] == i and tuple(r)[1:6] == want[i, t][0]
        assert want[i, t][1] <= set(r["spans"].split(","))
    assert personal.find_personal(docs.limit(0), personal.fit_spans(docs.limit(0))).isEmpty()


def test_reliabilities_find_the_good_labeler():
    rnd = np.random.default_rng(3)
    truth = rnd.random(4000) < 0.4
    good = np.where(rnd.random(4000) < 0.95, truth, ~truth)
    weak = np.where(rnd.random(4000) < 0.6, truth, ~truth)
    third = np.where(rnd.random(4000) < 0.9, truth, ~truth)
    seen, back = np.unique(np.stack([good, weak, third], axis=1) * 2 - 1, axis=0, return_inverse=True)
    p = personal.reliabilities(seen, np.bincount(back.ravel()).astype(float), np.zeros(len(seen), dtype=int))
    assert ((p[back.ravel()] > 0.5) == truth).mean() > 0.93


def test_secrets_base_and_novel_spans(spark):
    key = "f3Zk9QpX7vLm2RtY8sBn4Wc6"
    rows = [*odd_rows(), (60, f'password="hunter22" token:abc AKIA{"Q7" * 9} {"0a1b" * 8} Secret = x'), (61, f"the auth header is {key} for now"), (62, f"a plain word {key} only"),
            (63, "private key path is application/json/content/type/application ok")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs, secret_scan.word_dictionary(docs)).collect()}
    assert tuple(got[60])[1:4] == (1, 1, 1) and got[60]["spans"].startswith("assign:0:18,access:")
    assert got[61]["spans"] == "novel:19:43" and got[62]["spans"] == "" and got[63]["spans"] == ""
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.find_secrets(docs.limit(0), secret_scan.word_dictionary(docs.limit(0))).isEmpty()


def test_word_dictionary_counts_every_occurrence(spark, monkeypatch):
    """However rows are dealt: words seen once in a partition count like words that repeat in one."""
    rows = [(i, f"{SENTENCE} common{i % 3} {'early ' * 5 if i == 0 else ''}word{i}") for i in range(24)]
    n = Counter(w for _, t in rows for w in t.split() if len(w) >= 5)
    want = b" ".join([secret_scan.CODE_WORDS, *reversed([w.encode() for w in sorted((w for w in n if n[w] >= 4), key=lambda w: (-n[w] * len(w), w))])])
    docs = documents(spark, rows)
    assert [secret_scan.word_dictionary(docs.repartition(k)) for k in (1, 24)] == [want, want]
    monkeypatch.setattr(secret_scan, "HELD_WORDS", 2)
    assert secret_scan.word_dictionary(docs.repartition(2)) == want


@pytest.mark.parametrize(
    "run", [lambda d: tokens.token_counts(d, VOCABULARY), lambda d: tokens.pack_documents(d, VOCABULARY), exact_dedup.exact_groups, line_dedup.drop_repeated_lines]
)
def test_no_rows_give_no_rows(spark, run):
    assert run(documents(spark, odd_rows()).limit(0)).isEmpty()


def test_dense_spans_of_a_long_text_take_linear_time():
    """5 MB of digit groups that all are candidates, and 3 MB of secrets."""
    import time

    took = []
    for n in (50_000, 350_000):
        text = "12 345 67 89; " * n
        start = time.process_time()
        assert len(personal.candidates(text, personal.base_spans(text))) == n
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0] + 1
    novelty = secret_scan.Novelty(secret_scan.CODE_WORDS)
    text = 'password="hunter22abcdef99" ' * 100_000
    assert novelty.spans(text, secret_scan.base_spans(text)) == []
