import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from evisift.llm import quality
from tests.llm.cases import SENTENCE
from tests.llm.test_texts import components, hits

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "never in any text")]


def tables(spark, folder):
    words = "harbor meadow lantern orchard velvet copper thunder willow marble candle saddle ribbon".split()
    good = [f"{SENTENCE} {' '.join(words[(i * k) % 12] for k in range(1, 20))} number{i}.\nAnd {i % 7} more words follow in a second line." for i in range(120)]
    bad = [f"BUY!! NOW!! {i} !!! " * (3 + i % 5) for i in range(50)] + ["spam " * (10 + i) for i in range(50)]
    texts = [*good, *bad, good[3], good[3].replace(" ", "  "), good[5] + " tail", good[7] + f" {ITEMS[0][1].upper()} and on it goes.", None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 120), 0) for i in range(220)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(enumerate(texts))


def test_stages_equal_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    texts = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score_quality(docs, model).filter("score >= 0.5").collect()}
    assert 115 <= len(good) <= 126
    kept = {}
    for i in sorted(good):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    unique = set(kept.values())
    alone = {i for i, _, c in components([(i, texts[i]) for i in sorted(unique)], 5, 80) if i == c}
    expected = [good, unique, alone, alone]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == expected[k]
    final = {r["doc_id"]: r for r in docs.collect()}
    for i, r in final.items():
        clean = hits(texts[i], ITEMS)[1] == 0
        assert (r["text"] == texts[i]) == clean and hits(r["text"], ITEMS)[1] == 0 and r["n_chars"] == len(r["text"] or "")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in final.items()}


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
