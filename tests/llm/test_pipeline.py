import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from hearthpanel.llm import language, mixing, pii, simhash


def test_stages_and_result(spark, make_docs, sf_docs, edge_rows, tmp_path):
    few = [(1000 + r.doc_id, r.text, r.lang, r.source) for r in sf_docs.limit(150).collect()]
    docs = make_docs(edge_rows + few)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]
    pred = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    now, previous = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        rows = now.collect()
        if name != "tokens":
            assert now.columns == docs.columns
        if name == "language":
            known = [r for r in previous if r.doc_id is not None]
            kept = [r.doc_id for r in rows if r.doc_id is not None]
            assert sorted(kept) == sorted(r.doc_id for r in known if pred[r.doc_id] != "und")
            assert len(rows) == len(kept) + 1  # of the two without an id, one has no text
            assert all(r.lang == pred[r.doc_id] for r in rows if r.doc_id is not None)
        if name == "near_duplicates":
            bits = {r.text: simhash.fingerprint(r.text) for r in previous}
            kept = [simhash.fingerprint(r.text) for r in rows]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(kept) for b in kept[:i])
            assert all(any((b ^ k).bit_count() <= 3 for k in kept) for b in bits.values())
        if name == "personal_data":
            hidden = pii.Pseudonyms(pii.KEY)
            assert sorted(r.text for r in rows) == sorted(hidden.text(r.text)[0] for r in previous)
        if name == "mixing":
            before = spark.read.parquet(f"{tmp_path}/personal_data")
            copies = {(r.doc_id, r.size): r.copies for r in mixing.mix_counts(before).collect()}
            assert len(rows) == sum(copies.values())
        if name == "tokens":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted(library.encode(r.text, add_special_tokens=False).ids for r in previous)
            assert sorted(list(memoryview(bytes(r.ids)).cast("I")) for r in rows) == want
        previous = rows
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, previous))


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
