"""The pipeline's rows against brute force, stage by stage."""

import os

import brute
import pytest
import sentencepiece

import corpus_pipeline
from codequarry.llm import langid

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(5000, None, "en", "s", None), (5001, "", None, None, 0), (5002, rows[3][1], rows[3][2], None, rows[3][4]), (5003, rows[3][1] + "\nand a line of its own at the end", rows[3][2], rows[3][3], 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]


def test_rows_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in langid.identify(docs).where("kept").collect()}
    assert 0.8 * docs.count() < len(kept) < docs.count()
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {i: t for i, _, _, t in brute.line_dedup([(i, rows[i]["text"]) for i in sorted(kept)])}
    prints = [(i, brute.fingerprint(t)) for i, t in sorted(texts.items())]
    stay = {i: texts[i] for i, c in brute.components(prints).items() if i == c}
    assert len(stay) < len(texts)
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert all(len(brute.ALNUM_WORD.findall(t)) >= 13 for _, t in bench)  # so every hit is a whole window
    clean = [i for i, _, hit, *_ in brute.contamination(sorted(stay.items()), bench) if not hit]
    assert len(clean) < len(stay)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i in clean:
        ids = library.encode(stay[i])
        want.append((i, rows[i]["lang"], rows[i]["source"], len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_an_empty_table_gives_an_empty_result(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
